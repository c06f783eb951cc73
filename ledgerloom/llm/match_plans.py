"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import matching
from ledgerloom.llm.name_plans import named
from ledgerloom.session import stored
from ledgerloom.sources.tables import table


def p2_matches(spark: SparkSession, folder: str) -> DataFrame:
    """transaction_id, mapped_entity_id, mapping_confidence."""
    names = stored(named(spark, folder), "named")
    return matching.matches(table(spark, folder, "transactions"), table(spark, folder, "entities"), table(spark, folder, "accounts"), names)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_matches(spark, folder).select("transaction_id", F.col("mapped_entity_id").alias("entity_id")).distinct()


def p2_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """How far confidences are to be trusted: over all rows whose mapping is verified, their mapping hidden, by tenth of confidence
    rows, the mean confidence and the share that is right; tenth -1 are the rows that get no entity."""
    t = table(spark, folder, "transactions").where("mapping_verified and mapped_entity_id is not null and transaction_id is not null and counterparty_merged is not null")
    asked = t.withColumns({"mapped_entity_id": F.lit(None).cast("string"), "mapping_verified": F.lit(False)})
    names = stored(named(spark, folder), "named")
    got = matching.matches(asked, table(spark, folder, "entities"), table(spark, folder, "accounts"), names).withColumnRenamed("mapped_entity_id", "told")
    j = t.select("transaction_id", "mapped_entity_id").join(got, "transaction_id", "left")
    tenth = F.when(F.col("told").isNull(), -1).otherwise(F.least(F.floor(F.col("mapping_confidence") * 10), F.lit(9))).cast("int")
    return j.groupBy(tenth.alias("tenth")).agg(F.count("*").alias("rows"), F.round(F.avg("mapping_confidence"), 4).alias("mean_confidence"), F.round(F.avg((F.col("told") == F.col("mapped_entity_id")).cast("double")), 4).alias("right"))


QUERIES = {f.__name__: f for f in (p2_found, p2_matches, p2_calibration)}
SQL: dict[str, str] = {}
