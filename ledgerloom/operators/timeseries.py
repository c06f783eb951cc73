"""Period series of ledgers and their statistics, for every entity at once.

A series has one row a period: entity_id, period and sums. Standard deviations have n - 1 in the denominator unless a name
says population; quantiles of anomaly bounds are by nearest rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.stats import corr, nearest, slope

SMALL = 1e-10


def periods(ledger: DataFrame, grain: str = "day", by: str = "entity_id") -> DataFrame:
    """Sums, counts, means and deviations of debits, credits, net flow and activity by period (hour, day, week, month).

    Debits and credits are never null in a ledger, so each is counted once a row: ``intensity`` is twice the rows. The
    modes of the hour and the weekday (1 Monday) are the smallest of the most frequent ones. Rows without a date are left out.
    """
    led = ledger.where("DATE is not null").withColumns({"period": F.date_trunc(grain, "DATE"), "h": F.hour("DATE"), "net": F.col("CREDIT") - F.col("DEBIT"), "act": F.col("CREDIT") + F.col("DEBIT")})
    mode = lambda c, name: led.groupBy(by, "period", c.alias("v")).agg(F.count("*").alias("k")).groupBy(by, "period").agg(F.max_by("v", F.struct("k", -F.col("v"))).alias(name))
    hours, weekdays = mode(F.col("h"), "hour_mode"), mode(F.weekday("DATE") + 1, "weekday_mode")
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    agg = led.groupBy(by, "period").agg(
        F.sum("DEBIT").alias("debit_sum"), F.count("DEBIT").alias("debit_count"), F.avg("DEBIT").alias("debit_mean"), std("DEBIT").alias("debit_std"),
        F.sum("CREDIT").alias("credit_sum"), F.count("CREDIT").alias("credit_count"), F.avg("CREDIT").alias("credit_mean"), std("CREDIT").alias("credit_std"),
        F.sum("net").alias("net_flow_sum"), F.avg("net").alias("net_flow_mean"), F.sum("act").alias("activity_sum"), F.avg("act").alias("activity_mean"),
    )
    ratio = F.when(F.col("credit_sum") > 0, F.col("debit_sum") / (F.col("credit_sum") + SMALL))  # without credits it is no ratio
    return agg.join(hours, [by, "period"]).join(weekdays, [by, "period"]).withColumn("ratio", ratio).withColumns({"intensity": F.col("debit_count") + F.col("credit_count"), "volatility": (F.col("debit_std") + F.col("credit_std")) / 2})


def daily_series(ledger: DataFrame, by: str = "entity_id") -> DataFrame:
    """entity_id, period, debit, credit, net, activity and i (1, 2, ...) and n (how many periods): the narrow series."""
    s = ledger.where("DATE is not null").groupBy(by, F.date_trunc("day", "DATE").alias("period")).agg(F.sum("DEBIT").alias("debit"), F.sum("CREDIT").alias("credit"))
    w = W.partitionBy(by)
    return s.withColumns({"net": F.col("credit") - F.col("debit"), "activity": F.col("credit") + F.col("debit")}).withColumns({"i": F.row_number().over(w.orderBy("period")), "n": F.count("*").over(w)})


def trend(series: DataFrame, metric: str, by: str = "entity_id") -> DataFrame:
    """Least squares of a metric on days since the first period: n, slope, intercept, r2, t, pseudo_p and label; fewer than two periods give zeros.

    r2 is 1 - SSres / (SStot + 1e-10): strong above 0.7, moderate above 0.3, else weak. t is r sqrt(n - 2) / sqrt(1 - r2), null where that isn't defined;
    pseudo_p is 2 (1 - |t| / (|t| + n - 2)), which is no probability.
    """
    x = F.datediff("period", F.min("period").over(W.partitionBy(by))).cast("double")
    s = series.withColumn("x", x)
    g = s.groupBy(by).agg(F.count("*").alias("n"), slope(metric, "x").alias("b"), corr(metric, "x").alias("c"), (F.var_pop(metric) * F.count("*")).alias("syy"), F.avg(metric).alias("my"), F.avg("x").alias("mx"))
    flat = (F.col("n") < 2) | F.col("b").isNull()
    r = F.col("c") * F.col("c")
    r2 = F.when(flat, 0.0).otherwise(1 - (1 - F.coalesce(r, F.lit(1.0))) * F.col("syy") / (F.col("syy") + SMALL))
    t = F.when(~flat & (F.col("n") > 2), F.col("c") * F.sqrt(F.col("n") - 2) / F.sqrt(F.nullif(F.greatest(F.lit(0.0), 1 - r), F.lit(0.0))))
    p = F.when(t.isNotNull(), 2 * (1 - F.abs(t) / (F.abs(t) + F.col("n") - 2)))
    out = g.select(by, "n", F.when(flat, 0.0).otherwise(F.col("b")).alias("slope"), F.when(flat, 0.0).otherwise(F.col("my") - F.col("b") * F.col("mx")).alias("intercept"), r2.alias("r2"), t.alias("t"), p.alias("pseudo_p"))
    return out.withColumn("strength", F.when(F.col("r2") > 0.7, "strong").when(F.col("r2") > 0.3, "moderate").otherwise("weak"))


METRICS = ("debit", "credit", "net", "activity")


def trends(series: DataFrame, metrics: tuple[str, ...] = METRICS, by: str = "entity_id") -> DataFrame:
    """The trend of each metric, one row an entity and metric."""
    long = series.select(by, "period", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x")).select(by, "period", "x.*")
    key = F.concat_ws("|", F.col(by).cast("string"), "metric")
    ids = long.select(key.alias("_key"), by, "metric").distinct()
    return trend(long.withColumn("_key", key), "value", "_key").join(ids, "_key").drop("_key")


def moving(series: DataFrame, metric: str, most: int = 7, by: str = "entity_id", deviation: bool = False) -> DataFrame:
    """The rolling mean (or population deviation) over w = min(most, n // 3) periods, null before the first full window; w < 2 gives nulls."""
    w = F.least(F.lit(most), F.floor(F.col("n") / 3)).cast("int")
    out = F.lit(None).cast("double")
    for k in range(2, most + 1):
        frame = W.partitionBy(by).orderBy("period").rowsBetween(1 - k, 0)
        value = F.stddev_pop(metric).over(frame) if deviation else F.avg(metric).over(frame)
        out = F.when((w == k) & (F.col("i") >= k), value).otherwise(out)
    return series.withColumn("moving", out)


def liquidity(series: DataFrame, by: str = "entity_id") -> DataFrame:
    """Positive, negative and neutral periods, the least cumulative net flow (drawdown, if below 0) and the final position."""
    c = series.withColumn("cum", F.sum("net").over(W.partitionBy(by).orderBy("period").rowsBetween(W.unboundedPreceding, 0)))
    count = lambda t: F.sum(F.when(t, 1).otherwise(0))
    return c.groupBy(by).agg(count(F.col("net") > 0).alias("positive"), count(F.col("net") < 0).alias("negative"), count(F.col("net") == 0).alias("neutral"), F.least(F.min("cum"), F.lit(0.0)).alias("drawdown"), F.max_by("cum", "period").alias("final"), F.coalesce(F.stddev_pop("net"), F.lit(0.0)).alias("flow_deviation"))


def acceleration(series: DataFrame, by: str = "entity_id") -> DataFrame:
    """Mean, least and most first difference of activity; null for one period."""
    d = series.withColumn("diff", F.col("activity") - F.lag("activity").over(W.partitionBy(by).orderBy("period")))
    return d.groupBy(by).agg(F.avg("diff").alias("mean_change"), F.min("diff").alias("least_change"), F.max("diff").alias("most_change"))


def iqr_anomalies(series: DataFrame, metric: str, by: str = "entity_id") -> DataFrame:
    """Periods outside [q1 - 1.5 iqr, q3 + 1.5 iqr]; high where above the upper bound by more than the iqr."""
    q = series.groupBy(by).agg(nearest(metric, 0.25).alias("q1"), nearest(metric, 0.75).alias("q3"))
    s = series.join(q, by).withColumn("iqr", F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    hit = s.where((F.col(metric) < low) | (F.col(metric) > high))
    return hit.select(by, "period", F.col(metric).alias("value"), F.when(F.col(metric) > high + F.col("iqr"), "high").otherwise("medium").alias("severity"))


def velocity_anomalies(series: DataFrame, by: str = "entity_id") -> DataFrame:
    """Periods whose activity is above the mean by more than two deviations; high above three."""
    g = series.groupBy(by).agg(F.avg("activity").alias("m"), F.stddev_samp("activity").alias("sd"))
    s = series.join(g, by).where(F.col("activity") > F.col("m") + 2 * F.col("sd"))
    return s.select(by, "period", "activity", F.when(F.col("activity") > F.col("m") + 3 * F.col("sd"), "high").otherwise("medium").alias("severity"))


def velocity(series: DataFrame, by: str = "entity_id") -> DataFrame:
    """Mean, most, deviation, the 80 % threshold by nearest rank and how many periods lie above it."""
    g = series.groupBy(by).agg(F.avg("activity").alias("mean"), F.max("activity").alias("most"), F.coalesce(F.stddev_samp("activity"), F.lit(0.0)).alias("deviation"), nearest("activity", 0.8).alias("threshold"))
    above = series.join(g.select(by, "threshold"), by).groupBy(by).agg(F.sum((F.col("activity") > F.col("threshold")).cast("int")).alias("above"))
    return g.join(above, by)


def correlations(series: DataFrame, by: str = "entity_id") -> DataFrame:
    pair = lambda a, b: corr(a, b)
    return series.groupBy(by).agg(pair("debit", "credit").alias("debit_credit"), pair("debit", "activity").alias("debit_activity"), pair("credit", "activity").alias("credit_activity"), pair("net", "activity").alias("net_activity"))


def autocorrelation(series: DataFrame, lag: int = 7, by: str = "entity_id") -> DataFrame:
    """The correlation of activity with itself ``lag`` periods before, where there are twice as many periods; strong above 0.6."""
    s = series.where(F.col("n") >= 2 * lag).withColumn("was", F.lag("activity", lag).over(W.partitionBy(by).orderBy("period")))
    return s.groupBy(by).agg(corr("activity", "was").alias("r")).withColumn("strong", F.coalesce(F.col("r") > 0.6, F.lit(False)))


def zero_crossings(series: DataFrame, by: str = "entity_id") -> DataFrame:
    """How often activity crosses its moving mean (at most five periods; where that is undefined, its own mean), per period, for more than ten periods."""
    s = moving(series.where("n > 10"), "activity", 5, by)
    w = W.partitionBy(by)
    base = F.coalesce("moving", F.avg("moving").over(w))
    s = s.withColumn("de", F.col("activity") - base)
    s = s.withColumn("turn", (F.signum("de") != F.signum(F.lag("de").over(w.orderBy("period")))).cast("int"))
    return s.groupBy(by).agg((F.sum("turn") / F.max("n")).alias("frequency"), (F.stddev_pop("de") / (F.avg(F.abs("activity")) + SMALL)).alias("strength"))


def month_of_year(series: DataFrame, by: str = "entity_id") -> DataFrame:
    """by, month, periods, mean and deviation (n - 1; 0 for one period) of activity over the same month of all years, and whether it is the peak."""
    g = series.groupBy(by, F.month("period").alias("month")).agg(F.count("*").alias("periods"), F.avg("activity").alias("mean"), F.coalesce(F.stddev_samp("activity"), F.lit(0.0)).alias("deviation"))
    top = g.groupBy(by).agg(F.max_by("month", F.struct("mean", -F.col("month"))).alias("peak"))
    return g.join(top, by).withColumn("is_peak", F.col("month") == F.col("peak")).drop("peak")


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")
