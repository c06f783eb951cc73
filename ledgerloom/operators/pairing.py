"""Pairs of movements: round trips, rapid movements, transfer patterns.

Candidates come from equi-joins on entity (and counterparty) and a time bucket, so a range never meets all rows of an
entity. Where each row may be used once, the serial rule (left rows in order, each takes its best free right row) runs
within a group on its candidates alone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, at: str = "t", strict: bool = True) -> DataFrame:
    """The pairs of equal keys with 0 < right - left <= width (micros), columns led by l_ and r_: each left row meets two buckets of ``width``."""
    lo = F.floor(F.col(at) / width)
    a = left.select(*[F.col(c).alias(c if c in keys else f"l_{c}") for c in left.columns], F.explode(F.array(lo, lo + 1)).alias("_b"))
    b = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns], F.floor(F.col(at) / width).alias("_b"))
    gap = F.col(f"r_{at}") - F.col(f"l_{at}")
    return a.join(b, [*keys, "_b"]).where((gap > 0 if strict else gap >= 0) & (gap <= width)).drop("_b")


def _sides(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = ledger.where("DATE is not null").withColumns({"t": F.unix_micros("DATE"), "id": F.col("transaction_id"), "oi": F.col("original_index")})
    pick = lambda side: rows.where(F.col(side) > 0).select("entity_id", "counterparty", "id", "t", "oi", F.col(side).alias("amount"))
    return pick("DEBIT"), pick("CREDIT")


def round_trip_candidates(ledger: DataFrame, tolerance: float = 5.0, days: int = 30, least: float = 1000) -> DataFrame:
    """entity_id, counterparty, debit and credit of an amount within ``tolerance`` percent that came back within ``days`` (strictly later)."""
    d, c = _sides(ledger.where(F.trim("counterparty") != ""))
    j = interval_join(d.where(F.col("amount") >= least), c.where(F.col("amount") >= least), ["entity_id", "counterparty"], days * DAY)
    pct = F.abs(F.col("l_amount") - F.col("r_amount")) / F.col("l_amount") * 100
    return j.withColumn("pct", pct).where(F.col("pct") <= tolerance)


def claimed(candidates: DataFrame, group: list[str], left_order: list[str], preference: list[str], left: str = "l_id", right: str = "r_id") -> DataFrame:
    """The candidates that remain when left rows, in order, each take the free right row they prefer; groups are independent.

    A group holds only candidates, which the joins bound by time and amount, never all rows of an entity.
    """
    columns = candidates.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*left_order, *preference], kind="stable")
        done, used, keep = set(), set(), []
        for k, (a, b) in enumerate(zip(pdf[left], pdf[right], strict=True)):
            if a not in done and b not in used:
                done.add(a)
                used.add(b)
                keep.append(k)
        return pdf.iloc[keep][columns]

    return candidates.groupBy(*group).applyInPandas(run, candidates.schema)


def round_trips(ledger: DataFrame, tolerance: float = 5.0, days: int = 30, least: float = 1000) -> DataFrame:
    """First fit: each debit, in order, takes the first free credit that fits."""
    return claimed(round_trip_candidates(ledger, tolerance, days, least), ["entity_id", "counterparty"], ["l_t", "l_oi", "l_id"], ["r_t", "r_oi", "r_id"])


def rapid_candidates(ledger: DataFrame, hours: int = 24, tolerance: float = 5.0, least: float = 1000, ahead: int = 19) -> DataFrame:
    """Credits of ``least`` or more and the debits among the next ``ahead`` rows within ``hours`` whose amount is within ``tolerance`` percent.

    The band is over row numbers: each credit meets row numbers by an equi-join on (entity, number).
    """
    w = W.partitionBy("entity_id").orderBy("DATE", "original_index", "transaction_id")
    rows = ledger.where("DATE is not null").select("entity_id", "counterparty", F.col("transaction_id").alias("id"), F.unix_micros("DATE").alias("t"), "DEBIT", "CREDIT", F.row_number().over(w).alias("rn"))
    c = rows.where(F.col("CREDIT") >= least).where("CREDIT > 0").select("entity_id", F.col("counterparty").alias("l_cp"), F.col("id").alias("l_id"), F.col("t").alias("l_t"), F.col("CREDIT").alias("l_amount"), F.col("rn").alias("l_rn"), F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + ahead)).alias("rn"))
    d = rows.where("DEBIT > 0").select("entity_id", F.col("counterparty").alias("r_cp"), F.col("id").alias("r_id"), F.col("t").alias("r_t"), F.col("DEBIT").alias("r_amount"), "rn")
    pct = F.abs(F.col("l_amount") - F.col("r_amount")) / F.col("l_amount") * 100
    return c.join(d, ["entity_id", "rn"]).withColumn("pct", pct).where((F.col("pct") <= tolerance) & (F.col("r_t") - F.col("l_t") <= hours * HOUR))


def rapid_movements(ledger: DataFrame, hours: int = 24, tolerance: float = 5.0, least: float = 1000) -> DataFrame:
    """Each credit, in order, takes the free debit of the smallest difference, the earliest of equals."""
    return claimed(rapid_candidates(ledger, hours, tolerance, least), ["entity_id"], ["l_rn"], ["pct", "rn"])


def repeated_pairs(moves: DataFrame) -> DataFrame:
    return moves.groupBy(F.col("l_cp").alias("in_counterparty"), F.col("r_cp").alias("out_counterparty")).agg(F.count("*").alias("n")).where("n >= 2")


def transfer_candidates(ledger: DataFrame, days: int = 7, match: float = 90, deviance: float = 10, least: float = 1000) -> DataFrame:
    """A credit from one counterparty and a debit to another within ``days`` of (match - deviance) to (match + deviance) percent of it, with a score."""
    d, c = _sides(ledger.where(F.trim("counterparty") != ""))
    j = interval_join(c.where(F.col("amount") >= least), d.where(F.col("amount") >= least), ["entity_id"], days * DAY).where("l_counterparty <> r_counterparty")
    low, high = (match - deviance) / 100, (match + deviance) / 100
    j = j.where((F.col("r_amount") >= F.col("l_amount") * low) & (F.col("r_amount") <= F.col("l_amount") * high))
    score = 0.7 * (1 - F.abs(F.col("r_amount") - F.col("l_amount")) / F.col("l_amount")) + 0.3 * (1 - (F.col("r_t") - F.col("l_t")) / DAY / days)
    return j.withColumn("score", score)


def transfer_patterns(ledger: DataFrame, least_occurrences: int = 2, **options) -> DataFrame:
    """source, destination, occurrences, averages of the pairs that the serial rule keeps (best score first), by entity."""
    c = transfer_candidates(ledger, **options).withColumn("_rank", -F.col("score"))
    kept = claimed(c, ["entity_id"], ["l_t", "l_oi", "l_id"], ["_rank", "r_t", "r_oi", "r_id"])
    g = kept.groupBy(F.col("l_counterparty").alias("source"), F.col("r_counterparty").alias("destination"))
    return g.agg(F.count("*").alias("occurrences"), F.avg("l_amount").alias("mean_in"), F.avg("r_amount").alias("mean_out")).where(F.col("occurrences") >= least_occurrences)


def dwell(ledger: DataFrame, hours: int = 24, similar: float = 0.8) -> DataFrame:
    """entity_id, pairs and mean_hours of all (in, out) pairs within ``hours`` whose amounts are similar; no row is claimed."""
    d, c = _sides(ledger)
    j = interval_join(c, d, ["entity_id"], hours * HOUR)
    alike = 1 - F.abs(F.col("l_amount") - F.col("r_amount")) / F.greatest("l_amount", "r_amount")
    return j.where(alike > similar).groupBy("entity_id").agg(F.count("*").alias("pairs"), F.avg((F.col("r_t") - F.col("l_t")) / HOUR).alias("mean_hours"))


def hours_between(a: str | Column, b: str | Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / HOUR
