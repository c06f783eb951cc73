"""Streaming forms: period sums with a watermark, and cash alerts. An extension; the batch forms are the measure.

Both take a streaming ledger (see sources.ledger.standardised) and give a streaming DataFrame; the caller starts it, with a
checkpoint location in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.search import CASH_WORDS, has_word


def period_sums(ledger: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """entity_id, period, debit_sum, credit_sum, n for each window; rows later than ``late`` are dropped by the watermark, null times too."""
    g = ledger.withWatermark("DATE", late).groupBy(F.window("DATE", window).alias("w"), "entity_id")
    return g.agg(F.sum("DEBIT").alias("debit_sum"), F.sum("CREDIT").alias("credit_sum"), F.count("*").alias("n")).select("entity_id", F.col("w.start").alias("period"), "debit_sum", "credit_sum", "n")


def cash_alerts(ledger: DataFrame, threshold: float = 50_000) -> DataFrame:
    """The cash movements above a threshold, as they arrive."""
    return ledger.where(has_word(F.col("DESCRIPTION"), CASH_WORDS)).where((F.col("DEBIT") > threshold) | (F.col("CREDIT") > threshold))
