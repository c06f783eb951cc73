"""Queries of the general problems 3, 4, 6 and 7: raw records, instants, drift, trailing periods."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import drift, instants, rejects, rolling
from ledgerloom.plans.record_sql import SQL  # noqa: F401
from ledgerloom.session import stored
from ledgerloom.sources.tables import table


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.headers(*[table(spark, folder, n) for n in ("statement_lines", "bank_statements", "bank_header_mappings")])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "statement_lines")
    return rejects.rejects(lines, _headers(spark, folder))


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records: line_id, statement_id, line_no and the fields joined by a unit separator."""
    lines = table(spark, folder, "statement_lines")
    return rejects.checked(lines, _headers(spark, folder)).where("reason is null").select("line_id", "statement_id", "line_no", F.array_join("fields", "\u001f").alias("fields"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return instants.all_instants(table(spark, folder, "transactions"), table(spark, folder, "statement_lines"), table(spark, folder, "bank_statements")).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(*[table(spark, folder, n) for n in ("statement_lines", "bank_statements", "bank_header_mappings")])


def p6_unified(spark: SparkSession, folder: str) -> DataFrame:
    """The one table of all records."""
    return drift.unified(*[table(spark, folder, n) for n in ("statement_lines", "bank_statements", "bank_header_mappings")]).withColumn("other", F.to_json("other")).withColumn("failed", F.array_join("failed", ","))


def _sums(spark: SparkSession, folder: str) -> DataFrame:
    days = instants.transaction_days(table(spark, folder, "transactions"), table(spark, folder, "bank_statements"), "entity_id", "amount", "direction")
    return stored(rolling.daily(days), "days")  # read twice: for the spans and for the tiles


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    days = instants.transaction_days(table(spark, folder, "transactions"), table(spark, folder, "bank_statements"), "entity_id")
    days = days.where("entity_id is not null").select(F.col("entity_id").alias("entity"), "day").distinct()
    return rolling.quiet(stored(days, "days"), 30).select(F.col("entity").alias("entity_id"), F.date_format("day", "yyyy-MM-dd").alias("quiet_day"))


def _money(cents: Column) -> Column:
    """Whole cents as an amount, without a detour over doubles."""
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("decimal(22,2)")


def p7_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and averages by direction over the last 7 and 30 days, of each entity and day; averages are per row that has an amount, to four places, null where there is none."""
    out = rolling.trailing(_sums(spark, folder), (7, 30))
    money = [_money(F.col(f"{c}_{w}")).cast("decimal(20,2)").alias(f"{c}_total_{w}d") for w in (7, 30) for c in ("dr", "cr")]
    mean = lambda cents, n, name: F.round(F.when(n > 0, _money(cents) / n.cast("decimal(12,0)")), 4).cast("double").alias(name)
    means = [mean(F.col(f"{x}_{w}"), F.col(f"n_{x}_{w}"), f"{x}_mean_{w}d") for w in (7, 30) for x in ("dr", "cr")]
    means += [mean(F.col(f"dr_{w}") + F.col(f"cr_{w}"), F.col(f"n_dr_{w}") + F.col(f"n_cr_{w}"), f"mean_{w}d") for w in (7, 30)]
    return out.select(F.col("entity").alias("entity_id"), "day", F.col("n_7").alias("rows_7d"), F.col("n_30").alias("rows_30d"), *money, *means)


QUERIES = {f.__name__: f for f in (p3_found, p3_loaded, p4_found, p6_found, p6_unified, p7_found, p7_rolling)}
