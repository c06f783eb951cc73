"""Statistics whose definition is part of a result: quantile interpolation, degrees of freedom, fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest(column: str | Column, q: float) -> Column:
    """The quantile by nearest rank of an aggregate: the sorted values' element floor(q (n - 1) + 0.5); null for no values."""
    values = F.array_sort(F.collect_list(column))
    return F.get(values, F.floor(F.lit(q) * (F.size(values) - 1) + 0.5).cast("int"))


def nearest_sql(column: str, q: float, order: str = "") -> str:
    return f"list({column} ORDER BY {column})[CAST(floor({q} * (count({column}) - 1) + 0.5) AS INT) + 1]"


def linear(column: str | Column, q: float) -> Column:
    """The quantile by linear interpolation."""
    return F.percentile(column, F.lit(q))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def _both(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """The two columns, null where either is."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def corr(a: str | Column, b: str | Column) -> Column:
    """Pearson's correlation of an aggregate; null where either doesn't vary (the built-in one fails there in ANSI mode)."""
    x, y = _both(a, b)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def slope(y: str | Column, x: str | Column) -> Column:
    """The slope of least squares of an aggregate; null where x doesn't vary."""
    v, u = _both(y, x)
    return F.try_divide(F.covar_pop(v, u), F.nullif(F.var_pop(u), F.lit(0.0)))
