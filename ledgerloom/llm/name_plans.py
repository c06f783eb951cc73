"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import names
from ledgerloom.session import stored
from ledgerloom.sources.tables import table


def named(spark: SparkSession, folder: str) -> DataFrame:
    """name and party of every distinct name of counterparties and entities."""
    every = stored(names.distinct_names(table(spark, folder, "transactions").select("counterparty_merged"), table(spark, folder, "entities").select("entity_name")), "names")
    return names.parties(every, table(spark, folder, "nickname_ref"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.name_pairs(named(spark, folder))


def p5_parties(spark: SparkSession, folder: str) -> DataFrame:
    """Each name with its party and how many spellings the party has: one row a name."""
    from pyspark.sql import functions as F

    rows = stored(named(spark, folder).select("name", "party"), "parties")
    return rows.join(rows.groupBy("party").agg(F.count("*").alias("spellings")), "party").select("name", "party", "spellings")


QUERIES = {f.__name__: f for f in (p5_found, p5_parties)}
SQL: dict[str, str] = {}
