"""Pass-through accounts: balancing of flows by interval, scores, and the patterns that go with them, for all entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.stats import linear

#: Interval, tolerance of |net| / flow, least periods.
INTERVALS = (("daily", 0.10, 3), ("weekly", 0.15, 2), ("monthly", 0.20, 2))


def lifetime(ledger: DataFrame) -> DataFrame:
    """entity_id, net, total, ratio (|net| / total) and suspicion (1 - ratio); rows of no flow are left out."""
    g = ledger.groupBy("entity_id").agg(F.sum("CREDIT").alias("c"), F.sum("DEBIT").alias("d"), F.count("*").alias("n"), F.sum((F.col("CREDIT") > 0).cast("int")).alias("nc"), F.sum((F.col("DEBIT") > 0).cast("int")).alias("nd"), F.floor((F.unix_micros(F.max("DATE")) - F.unix_micros(F.min("DATE"))) / 86_400_000_000).alias("span"))
    total = F.col("c") + F.col("d")
    out = g.where(total > 0).select("entity_id", (F.col("c") - F.col("d")).alias("net"), total.alias("total"), (F.abs(F.col("c") - F.col("d")) / total).alias("ratio"), "n", "nc", "nd", "span")
    return out.withColumn("suspicion", 1 - F.col("ratio"))


def interval_balance(ledger: DataFrame, kind: str) -> DataFrame:
    """entity_id, periods with both sides, balanced ones, their share, whether that is a finding.

    The weekly key is the calendar year and the ISO week, so the week over a year's end is two keys.
    """
    tolerance, least = next((t, k) for name, t, k in INTERVALS if name == kind)
    keys = {"daily": [F.to_date("DATE").alias("k")], "weekly": [F.year("DATE").alias("y"), F.weekofyear("DATE").alias("k")], "monthly": [F.date_format("DATE", "yyyy-MM").alias("k")]}[kind]
    p = ledger.where("DATE is not null").groupBy("entity_id", *keys).agg(F.sum("CREDIT").alias("c"), F.sum("DEBIT").alias("d")).where("c > 0 and d > 0")
    balanced = F.abs(F.col("c") - F.col("d")) / (F.col("c") + F.col("d")) <= tolerance
    g = p.groupBy("entity_id").agg(F.count("*").alias("periods"), F.sum(balanced.cast("int")).alias("balanced"))
    share = F.col("balanced") / F.col("periods")
    return g.withColumn("share", share).withColumn("found", (F.col("periods") >= least) & (share >= 0.6))


def rolling_balance(ledger: DataFrame, days: int, step: int = 3, tolerance: float = 0.15) -> DataFrame:
    """The same over half-open windows of ``days`` that start every ``step`` days from an entity's first row, while they end within its rows.

    Each row goes to the windows that hold it by arithmetic on its offset, no range join. Needs five rows and a span of
    ``days``; windows of two rows or more with both sides count; found: three windows or more, half of them balanced.
    """
    w = W.partitionBy("entity_id")
    rows = ledger.where("DATE is not null").withColumns({"t0": F.min("DATE").over(w), "t1": F.max("DATE").over(w), "rows": F.count("*").over(w)})
    day = 86_400_000_000
    offset, reach = F.unix_micros("DATE") - F.unix_micros("t0"), F.unix_micros("t1") - F.unix_micros("t0")
    rows = rows.where(F.col("rows") >= 5).where(reach >= days * day)
    last = F.floor((reach - days * day) / (step * day))
    low = F.greatest(F.lit(0), F.floor((offset - days * day) / (step * day)) + 1)
    high = F.least(last, F.floor(offset / (step * day)))
    held = rows.where(low <= high).select("entity_id", "DEBIT", "CREDIT", F.explode(F.sequence(low, high)).alias("k"))
    p = held.groupBy("entity_id", "k").agg(F.sum("CREDIT").alias("c"), F.sum("DEBIT").alias("d"), F.count("*").alias("n")).where("n >= 2 and c > 0 and d > 0")
    balanced = F.abs(F.col("c") - F.col("d")) / (F.col("c") + F.col("d")) <= tolerance
    g = p.groupBy("entity_id").agg(F.count("*").alias("periods"), F.sum(balanced.cast("int")).alias("balanced"))
    share = F.col("balanced") / F.col("periods")
    return g.withColumn("share", share).withColumn("found", (F.col("periods") >= 3) & (share >= 0.5))


def _steps(value: Column, *levels: tuple[float, float], above: bool = False) -> Column:
    out = F.lit(0.0)
    for bound, points in reversed(levels):
        out = F.when(value >= bound if above else value <= bound, points).otherwise(out)
    return out


SENSITIVITY = {"low": 0.8, "medium": 1.0, "high": 1.2}


def intervals(ledger: DataFrame) -> DataFrame:
    """entity_id, interval, suspicion, place of every interval that shows balanced flows: the lifetime always, the others where they are a finding."""
    whole = lifetime(ledger).select("entity_id", F.lit("lifetime").alias("interval"), "suspicion", F.lit(0).alias("place"))
    kinds = [(name, interval_balance(ledger, name)) for name, _, _ in INTERVALS] + [("rolling_7d", rolling_balance(ledger, 7)), ("rolling_30d", rolling_balance(ledger, 30))]
    for place, (name, found) in enumerate(kinds, 1):
        whole = whole.unionByName(found.where("found").select("entity_id", F.lit(name).alias("interval"), F.col("share").alias("suspicion"), F.lit(place).alias("place")))
    return whole


def pass_through(ledger: DataFrame, sensitivity: float = 1.0) -> DataFrame:
    """entity_id, ratio, score, alert, interval, suspicion, intervals of pass-through: how near the flows balance, how many rows, how short the span, both sides.

    The interval told is that of the largest suspicion (of equals the first of lifetime, daily, weekly, monthly, rolling); the ratio is the
    lifetime's for each of them. Alert: score 0.4 or more and a ratio of 0.25 or less. Scores are cut at 1. Days of the span are whole blocks of 24 h.
    """
    g = lifetime(ledger)
    best = intervals(ledger).groupBy("entity_id").agg(F.max_by("interval", F.struct("suspicion", -F.col("place"))).alias("interval"), F.max("suspicion").alias("suspicion"), F.count("*").alias("intervals"))
    balance = _steps(F.col("ratio"), (0.02, 0.70), (0.05, 0.60), (0.10, 0.45), (0.20, 0.25))
    volume = _steps(F.col("n"), (15, 0.15), (8, 0.10), (5, 0.05), above=True)
    dense = F.when((F.col("span") <= 30) & (F.col("n") >= 8), 0.10).when((F.col("span") <= 60) & (F.col("n") >= 12), 0.05).otherwise(0.0)
    sides = F.when((F.col("nc") >= 3) & (F.col("nd") >= 2), 0.05).when((F.col("nc") >= 2) & (F.col("nd") >= 1), 0.02).otherwise(0.0)
    score = F.least(F.lit(1.0), (balance + volume + dense + sides) * sensitivity)
    out = g.select("entity_id", "ratio", score.alias("score"), ((score >= 0.4) & (F.col("ratio") <= 0.25)).alias("alert"))
    return out.join(best, "entity_id")


def phases(ledger: DataFrame) -> DataFrame:
    """Of an entity's credits and debits: counts, sums, medians, quartiles (linear) and variation (population)."""
    long = ledger.select("entity_id", F.explode(F.array(F.struct(F.lit("CR").alias("side"), F.col("CREDIT").alias("a")), F.struct(F.lit("DR").alias("side"), F.col("DEBIT").alias("a")))).alias("x")).select("entity_id", "x.*").where("a > 0")
    return long.groupBy("entity_id", "side").agg(F.count("*").alias("n"), F.sum("a").alias("total"), F.avg("a").alias("mean"), linear("a", 0.5).alias("median"), linear("a", 0.25).alias("q1"), linear("a", 0.75).alias("q3"), F.try_divide(F.stddev_pop("a"), F.avg("a")).alias("variation"))


def debit_timing(ledger: DataFrame, days: int = 7, least: int = 3) -> DataFrame:
    """entity_id, debits, fed (debits with at least ``least`` credits in the ``days`` before them, the moment itself left out) and timing.

    timing is 0.2 for each fed debit, and 0.3 where the gaps between three debits or more (whole blocks of 24 h) vary by less
    than 0.3 of their mean; cut at 1.
    """
    t = F.unix_micros("DATE")
    w = W.partitionBy("entity_id").orderBy("t").rangeBetween(-days * 86_400_000_000, -1)
    rows = ledger.where("DATE is not null").withColumn("t", t).withColumn("before", F.sum((F.col("CREDIT") > 0).cast("int")).over(w)).where("DEBIT > 0")
    gap = F.floor((F.col("t") - F.lag("t").over(W.partitionBy("entity_id").orderBy("t", "original_index", "transaction_id"))) / 86_400_000_000)
    g = rows.withColumn("gap", gap).groupBy("entity_id").agg(F.count("*").alias("debits"), F.sum((F.coalesce("before", F.lit(0)) >= least).cast("int")).alias("fed"), F.avg("gap").alias("m"), F.stddev_samp("gap").alias("s"))
    even = F.coalesce((F.col("debits") >= 3) & (F.col("m") > 0) & (F.try_divide("s", "m") < 0.3), F.lit(False))
    return g.select("entity_id", "debits", "fed", F.least(F.lit(1.0), F.col("fed") * 0.2 + F.when(even, 0.3).otherwise(0.0)).alias("timing"))


def classic(ledger: DataFrame, sensitivity: float = 1.0) -> DataFrame:
    """Collect small, pay out large: entity_id, score, alert from count and median ratios, shares of credits up to their median and debits from theirs, and timing.

    Five credits and one debit at least. Alert: a score of 0.4 / sensitivity or more (sensitivity counts twice).
    """
    p = phases(ledger)
    side = lambda s, x: p.where(F.col("side") == s).select("entity_id", F.col("n").alias(f"n_{x}"), F.col("median").alias(f"m_{x}"))
    both = side("CR", "c").join(side("DR", "d"), "entity_id").where("n_c >= 5 and n_d >= 1")
    share = lambda c, test: F.avg(F.when(F.col(c) > 0, test.cast("double")))
    s = ledger.join(both, "entity_id").groupBy("entity_id").agg(share("CREDIT", F.col("CREDIT") <= F.col("m_c")).alias("small"), share("DEBIT", F.col("DEBIT") >= F.col("m_d")).alias("large"))
    j = both.join(s, "entity_id").join(debit_timing(ledger), "entity_id", "left")
    counts, medians = F.col("n_c") / F.col("n_d"), F.try_divide("m_d", "m_c")
    score = (
        F.when(counts >= 2, F.least(F.lit(0.25), (counts - 2) * 0.1)).otherwise(0.0) + F.when(medians >= 3, F.least(F.lit(0.25), (medians - 3) * 0.05)).otherwise(0.0)
        + F.when(F.col("small") > 0.6, (F.col("small") - 0.6) * 0.5).otherwise(0.0) + F.when(F.col("large") > 0.4, (F.col("large") - 0.4) * 0.25).otherwise(0.0) + F.coalesce("timing", F.lit(0.0)) * 0.15
    )
    adjusted = score * sensitivity
    return j.select("entity_id", F.least(F.lit(1.0), adjusted).alias("score"), (adjusted >= 0.4 / sensitivity).alias("alert"))


def periodic(ledger: DataFrame) -> DataFrame:
    """entity_id, period (7, 14 or 30 days), strength (the share of gaps between debits within two days of it), periodic, score, alert; three debits at least.

    Gaps are whole 24 h blocks. Ties go to the shorter period. The score of a periodic entity is 0.4 for a strength above 0.7, 0.3 for amounts that vary by
    less than 0.4 of their mean, 0.3 for a strength above 0.5; it is an alert from 0.5.
    """
    w = W.partitionBy("entity_id").orderBy("DATE", "original_index", "transaction_id")
    gap = F.floor((F.unix_micros("DATE") - F.unix_micros(F.lag("DATE").over(w))) / 86_400_000_000)
    d = ledger.where("DEBIT > 0").select("entity_id", gap.alias("gap"), "DEBIT")
    near = lambda p: F.avg((F.abs(F.col("gap") - p) <= 2).cast("double"))
    g = d.groupBy("entity_id").agg(F.count("*").alias("n"), near(7).alias("s7"), near(14).alias("s14"), near(30).alias("s30"), F.try_divide(F.stddev_samp("DEBIT"), F.avg("DEBIT")).alias("cv")).where("n >= 3")
    best = F.greatest("s7", "s14", "s30")
    score = F.when(best > 0.5, F.when(best > 0.7, 0.4).otherwise(0.0) + F.when(F.greatest(F.lit(0.0), 1 - F.col("cv")) > 0.6, 0.3).otherwise(0.0) + 0.3).otherwise(0.0)
    return g.select("entity_id", F.when(F.col("s7") == best, 7).when(F.col("s14") == best, 14).otherwise(30).alias("period"), best.alias("strength"), (best > 0.5).alias("periodic"), score.alias("score"), (score >= 0.5).alias("alert"))


def advice(score: str, indicators: str) -> Column:
    """What to do about an alert, from its score and the names of its indicators (an array)."""
    s = F.col(score)
    band = F.when(s >= 0.8, F.array(F.lit("investigate at once"), F.lit("consider restricting the account"), F.lit("report the suspicion"))).when(s >= 0.6, F.array(F.lit("monitor closely"), F.lit("review transactions in detail"), F.lit("review the customer"))).otherwise(F.array(F.lit("go on monitoring"), F.lit("review with other risk factors")))
    told = F.lower(F.array_join(indicators, " "))
    by = [F.when(F.contains(told, F.lit(k)), text) for k, text in (("timing", "analyse the timing in detail"), ("threshold", "review for structuring"), ("periodic", "find the source of the periodic payments"))]
    return F.array_compact(F.concat(band, F.array(*by, F.lit("compare with known pass-through accounts"), F.lit("find out who controls the account"))))


def threshold_avoidance(ledger: DataFrame, thresholds: tuple[int, ...] = (10_000, 20_000, 50_000, 100_000)) -> DataFrame:
    """entity_id, score (0 to 1) and alert: shares of amounts just below a threshold (above a fifth) summed, and 0.3 where most amounts are round thousands."""
    a = F.col("DEBIT") + F.col("CREDIT")
    shares = [F.avg(((a >= 0.85 * t) & (a < t)).cast("double")).alias(f"s{t}") for t in thresholds]
    g = ledger.where(a > 0).groupBy("entity_id").agg(*shares, F.avg((F.pmod(a, F.lit(1000.0)) == 0).cast("double")).alias("r"))
    total = sum((F.when(F.col(f"s{t}") > 0.2, F.col(f"s{t}")).otherwise(0.0) for t in thresholds), F.lit(0.0)) + F.when(F.col("r") > 0.6, 0.3).otherwise(0.0)
    score = F.least(F.lit(1.0), total)
    return g.select("entity_id", score.alias("score"), (score >= 0.4).alias("alert"))
