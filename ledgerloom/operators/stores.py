"""Guards, exports, pattern stores and token-bounded chunks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import usable

SEVERITIES = {"high": 3, "medium": 2, "low": 1}


def checked_request(entity_ids: Sequence[str], date_from: str | None = None, date_to: str | None = None, most: int | None = None) -> list[str]:
    """The ids of a request: not empty, none blank, dates in order, and no more than ``most`` if given; else ValueError."""
    if not entity_ids:
        raise ValueError("no entity ids")
    if any(not str(i).strip() for i in entity_ids):
        raise ValueError("a blank entity id")
    if most is not None and len(entity_ids) > most:
        raise ValueError(f"more than {most} entity ids")
    if date_from and date_to and date_from > date_to:
        raise ValueError("date_from is after date_to")
    return list(entity_ids)


def export(df: DataFrame, path: str, kind: str = "csv", *order) -> None:
    """Writes df as csv (all fields quoted, with a header), json or parquet, in order if one is given."""
    out = df.orderBy(*order) if order else df
    writer = out.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        getattr(writer, kind)(path)


def active_patterns(store: DataFrame, workspace: str | None = None) -> DataFrame:
    """The active patterns of a workspace, by priority, then success rate descending, then pattern.

    store: workspace, pattern, active, priority, success_rate.
    """
    p = store.where("active") if workspace is None else store.where("active").where(F.col("workspace") == workspace)
    return p.orderBy(F.col("priority").asc_nulls_last(), F.col("success_rate").desc_nulls_last(), "pattern")


def pattern_summary(store: DataFrame) -> DataFrame:
    """One row: patterns, active ones, and the mean success rate to two places."""
    return store.agg(F.count("*").alias("patterns"), F.coalesce(F.sum(F.col("active").cast("int")), F.lit(0)).alias("active"), F.round(F.avg("success_rate"), 2).alias("mean_success"))


def with_pattern(store: DataFrame, workspace: str, pattern: str, priority: int = 100) -> DataFrame:
    """The store with one pattern more; a pattern that doesn't compile or holds no group raises ValueError."""
    if not usable([pattern]):
        raise ValueError("the pattern doesn't compile or holds no group")
    row = store.sparkSession.createDataFrame([(workspace, pattern, True, priority, None)], "workspace string, pattern string, active boolean, priority int, success_rate double")
    return store.unionByName(row)


def by_severity(flags: DataFrame) -> DataFrame:
    """Flags, one for each type and description (the most severe), high before medium before low."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])[F.lower("severity")], F.lit(0))
    best = flags.groupBy("type", "description").agg(F.max_by("severity", rank).alias("severity"))
    return best.orderBy(F.desc(rank), "type", "description")


def chunks(rows: DataFrame, group: str, order: Sequence[str], size: str, limit: int) -> DataFrame:
    """rows with ``chunk``: in order, rows fill a chunk while its sizes stay within ``limit``; a row above it is a chunk of its own.

    The fill is an ordered fold within a group (an entity's rows of one report); nulls count as 0.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        out, used, chunk = [], 0, 0
        for s in pdf[size].fillna(0):
            if used and used + s > limit:
                chunk, used = chunk + 1, 0
            used += s
            out.append(chunk)
        return pdf.assign(chunk=pd.Series(out, index=pdf.index, dtype="int64"))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", chunk long"
    return rows.groupBy(group).applyInPandas(fold, schema)


def padded(cells: Sequence[str], width: int) -> list[str]:
    """A table row brought to a fixed width: cut or filled with empty cells."""
    return [*cells[:width], *[""] * (width - len(cells))]


def statement_tables(tables: DataFrame, keywords: Sequence[str] = ("date", "description", "particulars", "debit", "credit", "balance", "withdrawal", "deposit", "narration", "amount")) -> DataFrame:
    """Which extracted tables are statements: enough header keywords and a plausible width, and enough rows that look like movements.

    tables: id, header array<string>, rows array<array<string>>. A row counts if its first cell begins with a date or some
    cell is an amount.
    """
    word = "(?i)" + "|".join(keywords)
    width = F.size("header")
    hits = F.size(F.filter("header", lambda c: F.coalesce(c.rlike(word), F.lit(False))))
    date, money = r"^\s*\d{1,4}[-/. ][A-Za-z0-9]{1,9}[-/. ]\d{2,4}", r"^\s*[\d,]+\.\d{2}\s*$"
    valid = F.size(F.filter("rows", lambda r: F.coalesce(F.get(r, F.lit(0)).rlike(date), F.lit(False)) | F.exists(r, lambda c: F.coalesce(c.rlike(money), F.lit(False)))))
    header_ok = (hits >= F.greatest(F.lit(1), F.floor(width / 4))) & width.between(3, 15)
    rows_ok = valid >= F.greatest(F.lit(1), F.floor(F.size("rows") / 3))
    return tables.select("id", header_ok.alias("header_ok"), valid.alias("valid_rows"), (rows_ok & (header_ok | (valid >= 3))).alias("is_statement"))

