"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.history import History, clusters, increments, pairs
from ledgerloom.sources.tables import table


def _accepted(spark: SparkSession, folder: str) -> History:
    """A store that took the batches in order: batch 1 is the history, then come the weekly ones, those of fewer than LEAST records together with the next."""
    transactions, statements = table(spark, folder, "transactions"), table(spark, folder, "bank_statements")
    store = History(spark)
    for batch in increments(store.load(transactions, statements, F.coalesce("batch_no", F.lit(1)))):
        store.take(batch)
    store.settle()
    return store


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(_accepted(spark, folder).mapping())


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each record that was recorded more than once, with its representative."""
    return clusters(_accepted(spark, folder).mapping())


def p1_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What each increment cost: its batches and rows, the rows and bytes of the history that it read, the rows the history had, and its links; the row without a batch is the pass over records without a day."""
    return spark.createDataFrame(_accepted(spark, folder).log, "first int, batch int, rows long, probed_rows long, probed_bytes long, history_rows long, links long")


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p1_batches)}
SQL: dict[str, str] = {}
