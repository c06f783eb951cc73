"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are uniform, so equal ranges of them are buckets of equal size within a source,
and a range-sort needs no sampling. Token counts are summed by bucket, bucket sums are summed along the keys, and only
within a bucket are documents put in order: a source that holds most rows is spread over its buckets. Each source is cut at
its exact budget; documents of a source whose budget exceeds its size are repeated for whole epochs before the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1024


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, available and budget: the largest total at which every source reaches its share.

    sizes: source, available (tokens). The total is the least of available * max_repeats / target_share; a source with
    share 0 gets nothing. A target source without tokens makes the total 0, as no mix then has the target shares. One row
    per source: the table is as long as ``targets``.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats"))
    t = t.join(sizes, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).cast("long").alias("available"))
    total = t.where("target_share > 0").agg(F.coalesce(F.min(F.try_divide(F.col("available") * F.col("max_repeats"), F.col("target_share"))), F.lit(0.0)).alias("total"))
    return t.crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeats", "available", F.least(F.floor(F.col("total") * F.col("target_share") + 1e-6), F.col("available") * F.col("max_repeats")).cast("long").alias("budget"))


def mixed(counts: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """key, source, tokens and times of each document used: how often the mix takes it.

    counts: key, source, text_hash, tokens. A document is taken in the last, partial epoch if the tokens up to and with it
    along its source's keys fit the rest of the budget. Documents without tokens, and those of null or unlisted sources,
    are not used. Equal keys are ordered by text_hash, so the same tables give the same mix. counts is read twice: write it first.
    """
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col("text_hash"))
    rows = counts.where("source is not null and tokens > 0").withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 54).cast("int") if buckets == 1024 else F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    sizes = sums.groupBy("source").agg(F.sum("in_bucket").alias("available"))
    plan = budgets(sizes, targets).where("budget > 0").withColumn("epochs", F.floor(F.try_divide(F.col("budget"), F.col("available")))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    along = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # at most ``buckets`` rows a source
    cut = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(along), F.lit(0))).join(plan.select("source", "epochs", "rest"), "source")
    # sources in targets times buckets: a table of fixed size
    placed = rows.join(F.broadcast(cut), ["source", "bucket"]).where("epochs > 0 or before < rest")
    within = W.partitionBy("source", "bucket").orderBy("h", key, "text_hash").rowsBetween(W.unboundedPreceding, 0)
    edge = placed.where("before < rest and before + in_bucket > rest").withColumn("upto", F.col("before") + F.sum("tokens").over(within))
    edge = edge.select(key, "source", "tokens", (F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).cast("int").alias("times"))
    clear = placed.where("before >= rest or before + in_bucket <= rest").select(key, "source", "tokens", (F.col("epochs") + F.when(F.col("before") + F.col("in_bucket") <= F.col("rest"), 1).otherwise(0)).cast("int").alias("times"))
    return clear.unionByName(edge).where("times > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, documents, tokens_used, most_times and actual_share of a mix; one row per target source."""
    used = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("times")).alias("tokens_used"), F.max("times").alias("most_times"))
    t = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    out = t.join(used, "source", "left").fillna(0, ["documents", "tokens_used", "most_times"])
    total = F.sum("tokens_used").over(W.partitionBy())  # one row per source
    return out.withColumn("actual_share", F.try_divide(F.col("tokens_used"), total))
