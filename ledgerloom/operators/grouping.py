"""Groups of entities that behave alike: scaled features, k-means with a fixed seed, silhouette."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("n", "total", "mean", "deviation", "credit_share", "counterparties", "days")


def entity_features(ledger: DataFrame) -> DataFrame:
    """entity_id and its features; nulls and undefined values are 0."""
    a = F.col("DEBIT") + F.col("CREDIT")
    g = ledger.where("entity_id is not null").groupBy("entity_id").agg(
        F.count("*").alias("n"), F.sum(a).alias("total"), F.avg(a).alias("mean"), F.stddev_samp(a).alias("deviation"), F.try_divide(F.sum("CREDIT"), F.sum(a)).alias("credit_share"),
        F.countDistinct("counterparty").alias("counterparties"), F.countDistinct(F.to_date("DATE")).alias("days"),
    )
    return g.select("entity_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


def grouped(features: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """entity_id and group (0 to k - 1). Labels depend on the order of rows in partitions; groups don't say more than likeness."""
    v = VectorAssembler(inputCols=list(FEATURES), outputCol="raw").transform(features)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    return KMeans(k=k, seed=seed).fit(scaled).transform(scaled).select("entity_id", F.col("prediction").alias("group"), "features")


def silhouette(groups: DataFrame) -> float:
    return ClusteringEvaluator(predictionCol="group").evaluate(groups)
