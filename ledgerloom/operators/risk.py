"""Risk roll-ups of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.search import CASH_WORDS, has_word

CRORE_5, LAKH_20, MANY = 50_000_000, 2_000_000, 300


def entity_risk(transactions: DataFrame) -> DataFrame:
    """entity_id, score (0 to 100) and factors: volume above 5 crore 20, more than 300 rows 15, cash share above half 25, a single amount of 20 lakh or more 20.

    The cash share is rounded to two places before it is compared. Null descriptions count as not cash.
    """
    cash = has_word(F.coalesce("description", F.lit("")), CASH_WORDS).cast("double")
    a = transactions.where("entity_id is not null").groupBy("entity_id").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("double")).alias("s"), F.max(F.col("amount").cast("double")).alias("m"), F.round(F.avg(cash), 2).alias("r"))
    tests = (("high volume", F.col("s") > CRORE_5, 20), ("many transactions", F.col("n") > MANY, 15), ("mostly cash", F.col("r") > 0.5, 25), ("large single amount", F.col("m") >= LAKH_20, 20))
    score = sum((F.when(t, points).otherwise(0) for _, t, points in tests), F.lit(0))
    return a.select("entity_id", F.least(F.lit(100), score).alias("score"), F.array_compact(F.array(*[F.when(t, name) for name, t, _ in tests])).alias("factors"))
