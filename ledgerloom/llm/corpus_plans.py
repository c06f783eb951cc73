"""Queries of problems 8, 9 and 10, over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, mixing, mojibake
from ledgerloom.session import stored
from ledgerloom.sources.tables import table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), "doc_id")


def _mix(spark: SparkSession, folder: str) -> DataFrame:
    counts = stored(bpe.token_counts(table(spark, folder, "documents"), "doc_id", "source"), "token-counts")
    return mixing.mixed(counts, table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, tokens, times of the documents the mix uses."""
    return _mix(spark, folder)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached."""
    return mixing.shares(_mix(spark, folder), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.garbled(table(spark, folder, "documents"), keep_text=False).select("doc_id").distinct()


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, restorable and the text as far as it could be restored."""
    return mojibake.garbled(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p8_ids, p9_mix, p9_shares, p10_found, p10_restored)}
SQL: dict[str, str] = {}
