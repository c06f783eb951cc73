"""Profiles of counterparties: one row an entity and counterparty, whatever their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.stats import corr, slope

KEY = ["entity_id", "counterparty"]


def prepared(ledger: DataFrame, least: int = 1) -> DataFrame:
    """The rows with a date and a counterparty that isn't blank: act (both sides), x (whole 24 h blocks since the frame's first row), i and n in the group."""
    rows = ledger.where("DATE is not null").where(F.trim("counterparty") != "")
    first = rows.agg(F.min("DATE").alias("d0"))
    w = W.partitionBy(*KEY)
    x = F.floor(F.floor((F.unix_micros("DATE") - F.unix_micros("d0")) / 1_000_000) / 86400)
    rows = rows.crossJoin(F.broadcast(first)).withColumns({"act": F.col("DEBIT") + F.col("CREDIT"), "x": x.cast("long")})  # one row
    return rows.withColumns({"i": F.row_number().over(w.orderBy("DATE", "original_index", "transaction_id")), "n": F.count("*").over(w)}).where(F.col("n") >= least)


def trends(ledger: DataFrame, least: int = 3) -> DataFrame:
    """transactions, slope of activity on days, and direction: stable where the correlation is below 0.3, else its sign."""
    g = prepared(ledger, least).groupBy(*KEY).agg(F.count("*").alias("transactions"), slope("act", F.col("x").cast("double")).alias("b"), corr("act", F.col("x").cast("double")).alias("r"))
    r = F.coalesce("r", F.lit(0.0))
    return g.select(*KEY, "transactions", F.coalesce("b", F.lit(0.0)).alias("slope"), F.when(F.abs(r) < 0.3, "stable").when(r > 0, "increasing").otherwise("decreasing").alias("direction"))


def risk(ledger: DataFrame, least: int = 3) -> DataFrame:
    """The risk (0 to 1) of each counterparty: pace, variation of amounts, round amounts, imbalance of sides, one weekday's share."""
    rows = prepared(ledger, least)
    g = rows.groupBy(*KEY).agg(
        F.count("*").alias("k"), F.sum("DEBIT").alias("dr"), F.sum("CREDIT").alias("cr"), F.avg("act").alias("m"), F.stddev_samp("act").alias("s"),
        F.avg(((F.pmod("act", F.lit(1000.0)) == 0) | (F.pmod("act", F.lit(500.0)) == 0)).cast("double")).alias("r"), (F.datediff(F.max("DATE"), F.min("DATE")) + 1).alias("days"),
    )
    day = rows.groupBy(*KEY, F.dayofweek("DATE").alias("dow")).agg(F.count("*").alias("c")).groupBy(*KEY).agg(F.max("c").alias("c"))
    step = lambda v, *levels: F.coalesce(_steps(v, levels), F.lit(0.0))
    pace, variation, imbalance = F.col("k") / F.col("days"), F.try_divide("s", "m"), F.try_divide(F.abs(F.col("dr") - F.col("cr")), F.col("dr") + F.col("cr"))
    share = F.when(F.col("k") > 3, F.col("c") / F.col("k"))
    total = step(pace, (1, 0.2), (0.5, 0.1)) + step(variation, (2, 0.25), (1, 0.15)) + step(F.col("r"), (0.7, 0.15), (0.5, 0.08)) + step(imbalance, (0.9, 0.2), (0.7, 0.1)) + step(share, (0.8, 0.2), (0.6, 0.1))
    return g.join(day, KEY).select(*KEY, F.col("k").alias("transactions"), F.least(F.lit(1.0), total).alias("risk"))


def _steps(value, levels):
    out = F.lit(0.0)
    for bound, points in reversed(levels):
        out = F.when(value > bound, points).otherwise(out)
    return out


def velocity(ledger: DataFrame, least: int = 3) -> DataFrame:
    """Mean, least and most days between the rows of a counterparty, and how many gaps are within a day."""
    rows = prepared(ledger, least)
    gap = F.col("x") - F.lag("x").over(W.partitionBy(*KEY).orderBy("DATE", "original_index", "transaction_id"))
    return rows.withColumn("gap", gap).groupBy(*KEY).agg(F.avg("gap").alias("mean_gap"), F.min("gap").alias("least_gap"), F.max("gap").alias("most_gap"), F.sum(F.when(F.col("gap") == 0, 1).otherwise(0)).alias("same_day"))


def halves(ledger: DataFrame, least: int = 4) -> DataFrame:
    """How the mean amount changed from the first half of a counterparty's rows to the second, and whether its net flow turned."""
    rows = prepared(ledger, least)
    early = F.col("i") <= F.floor(F.col("n") / 2)
    net = F.col("CREDIT") - F.col("DEBIT")
    g = rows.groupBy(*KEY).agg(F.avg(F.when(early, F.col("act"))).alias("e"), F.avg(F.when(~early, F.col("act"))).alias("l"), F.sum(F.when(early, net).otherwise(0.0)).alias("ne"), F.sum(F.when(~early, net).otherwise(0.0)).alias("nl"))
    change = F.try_divide(F.col("l") - F.col("e"), F.col("e"))
    return g.select(*KEY, change.alias("amount_change"), (F.col("ne") * F.col("nl") < 0).alias("flow_turned"), F.when(F.abs(change) > 1, "high").when(F.abs(change) > 0.5, "medium").otherwise("none").alias("severity"))
