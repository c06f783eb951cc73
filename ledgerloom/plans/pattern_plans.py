"""Pass-through scoring and pairing of movements, over the event ledger."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerloom.operators import mule as M
from ledgerloom.operators import pairing as J
from ledgerloom.sources.ledger import EVENT_SQL, event_ledger

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def take(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql.replace("{L}", "WITH " + EVENT_SQL)
        return f

    return take


@query("{L} SELECT entity_id, round(sum(credit) - sum(debit), 2) AS net, round(sum(credit) + sum(debit), 2) AS total, round(abs(sum(credit) - sum(debit)) / (sum(credit) + sum(debit)), 4) AS ratio FROM L GROUP BY 1")
def a17_lifetime_flow(spark, folder):
    return M.lifetime(event_ledger(spark, folder)).select("entity_id", F.round("net", 2).alias("net"), F.round("total", 2).alias("total"), F.round("ratio", 4).alias("ratio"))


def _interval_sql(keys: str, tolerance: float, least: int) -> str:
    n = len(re.findall(r" AS [a-z]+(?:,|$)", keys)) + 1
    return f"""{{L}}, p AS (SELECT entity_id, {keys}, sum(credit) AS c, sum(debit) AS d FROM L GROUP BY {', '.join(str(k) for k in range(1, n + 1))}), g AS (SELECT entity_id, count(*) AS periods, sum(CASE WHEN abs(c - d) / (c + d) <= {tolerance} THEN 1 ELSE 0 END) AS balanced FROM p WHERE c > 0 AND d > 0 GROUP BY 1)
 SELECT entity_id, periods, balanced, round(balanced * 1.0 / periods, 4) AS share, periods >= {least} AND balanced * 1.0 / periods >= 0.6 AS found FROM g"""


def _interval(kind: str):
    return lambda spark, folder: M.interval_balance(event_ledger(spark, folder), kind).withColumn("share", F.round("share", 4))


query(_interval_sql("CAST(d AS DATE) AS k", 0.10, 3), "a15_daily_balance")(_interval("daily"))
query(_interval_sql("year(d) AS y, weekofyear(d) AS k", 0.15, 2), "a15_weekly_balance")(_interval("weekly"))
query(_interval_sql("strftime(d, '%Y-%m') AS k", 0.20, 2), "a15_monthly_balance")(_interval("monthly"))


ROLLING = """{L}, m AS (SELECT entity_id, min(d) AS t0, max(d) AS t1, count(*) AS n FROM L GROUP BY 1 HAVING count(*) >= 5 AND epoch_us(max(d)) - epoch_us(min(d)) >= {W} * 86400000000),
 w AS (SELECT entity_id, t0, unnest(generate_series(0, CAST(floor((epoch_us(t1) - epoch_us(t0) - {W} * 86400000000) / (3 * 86400000000.0)) AS BIGINT))) AS k FROM m),
 p AS (SELECT w.entity_id, w.k, sum(credit) AS c, sum(debit) AS d, count(*) AS n FROM w JOIN L ON L.entity_id = w.entity_id AND epoch_us(L.d) >= epoch_us(t0) + k * 3 * 86400000000 AND epoch_us(L.d) < epoch_us(t0) + k * 3 * 86400000000 + {W} * 86400000000 GROUP BY 1, 2),
 g AS (SELECT entity_id, count(*) AS periods, sum(CASE WHEN abs(c - d) / (c + d) <= 0.15 THEN 1 ELSE 0 END) AS balanced FROM p WHERE n >= 2 AND c > 0 AND d > 0 GROUP BY 1) SELECT entity_id, periods, balanced, round(balanced * 1.0 / periods, 4) AS share, periods >= 3 AND balanced * 1.0 / periods >= 0.5 AS found FROM g"""


@query(ROLLING.replace("{W}", "7"))
def a16_j15_rolling_balance(spark, folder):
    return M.rolling_balance(event_ledger(spark, folder), 7).withColumn("share", F.round("share", 4))


@query(ROLLING.replace("{W}", "10"))
def a16_ten_day_balance(spark, folder):
    """The same over ten days: the events span thirty, so a window of thirty days never fits in."""
    return M.rolling_balance(event_ledger(spark, folder), 10).withColumn("share", F.round("share", 4))


@query("""{L}, x AS (SELECT entity_id, 'CR' AS side, credit AS a FROM L WHERE credit > 0 UNION ALL SELECT entity_id, 'DR', debit FROM L WHERE debit > 0) SELECT entity_id, side, count(*) AS n, round(sum(a), 2) AS total, round(quantile_cont(a, 0.5), 3) AS median, round(quantile_cont(a, 0.25), 3) AS q1, round(quantile_cont(a, 0.75), 3) AS q3, round(stddev_pop(a) / avg(a), 4) AS variation FROM x GROUP BY 1, 2""")
def a18_phases(spark, folder):
    p = M.phases(event_ledger(spark, folder))
    return p.select("entity_id", "side", "n", F.round("total", 2).alias("total"), *[F.round(c, 3).alias(c) for c in ("median", "q1", "q3")], F.round("variation", 4).alias("variation"))


def _found_sql(text: str, name: str, place: int) -> str:
    """The findings of an interval's query as rows of the union."""
    return f"SELECT entity_id, '{name}' AS interval, share AS suspicion, {place} AS place FROM ({text.replace('{L}', 'WITH ' + EVENT_SQL)}) WHERE found"


_UNION = " UNION ALL ".join(
    [f"SELECT entity_id, 'lifetime' AS interval, 1 - ratio AS suspicion, 0 AS place FROM (WITH {EVENT_SQL} SELECT entity_id, abs(sum(credit) - sum(debit)) / (sum(credit) + sum(debit)) AS ratio FROM L GROUP BY 1)"]
    + [_found_sql(t, n, k) for k, (n, t) in enumerate((("daily", _interval_sql("CAST(d AS DATE) AS k", 0.10, 3)), ("weekly", _interval_sql("year(d) AS y, weekofyear(d) AS k", 0.15, 2)), ("monthly", _interval_sql("strftime(d, '%Y-%m') AS k", 0.20, 2)), ("rolling_7d", ROLLING.replace("{W}", "7")), ("rolling_30d", ROLLING.replace("{W}", "30"))), 1)]
).replace("round(balanced * 1.0 / periods, 4) AS share", "balanced * 1.0 / periods AS share")
PASS = """{L}, g AS (SELECT entity_id, abs(sum(credit) - sum(debit)) / (sum(credit) + sum(debit)) AS r, count(*) AS n, sum(CASE WHEN credit > 0 THEN 1 ELSE 0 END) AS nc, sum(CASE WHEN debit > 0 THEN 1 ELSE 0 END) AS nd, (epoch_us(max(d)) - epoch_us(min(d))) // 86400000000 AS span FROM L GROUP BY 1),
 s AS (SELECT entity_id, r, CASE WHEN r <= 0.02 THEN 0.7 WHEN r <= 0.05 THEN 0.6 WHEN r <= 0.1 THEN 0.45 WHEN r <= 0.2 THEN 0.25 ELSE 0 END + CASE WHEN n >= 15 THEN 0.15 WHEN n >= 8 THEN 0.1 WHEN n >= 5 THEN 0.05 ELSE 0 END + CASE WHEN span <= 30 AND n >= 8 THEN 0.1 WHEN span <= 60 AND n >= 12 THEN 0.05 ELSE 0 END + CASE WHEN nc >= 3 AND nd >= 2 THEN 0.05 WHEN nc >= 2 AND nd >= 1 THEN 0.02 ELSE 0 END AS s FROM g)"""
M01 = PASS + ", u AS (" + _UNION + """), b AS (SELECT entity_id, arg_max(interval, (suspicion, -place)) AS interval, max(suspicion) AS suspicion, count(*) AS intervals FROM u GROUP BY 1)
 SELECT entity_id, round(r, 4) AS ratio, round(CAST(least(1.0, s) AS DOUBLE), 4) AS score, least(1.0, s) >= 0.4 AND r <= 0.25 AS alert, interval, round(suspicion, 4) AS suspicion, intervals FROM s JOIN b USING (entity_id)"""


@query(M01)
def m01_pass_through(spark, folder):
    p = M.pass_through(event_ledger(spark, folder))
    return p.select("entity_id", F.round("ratio", 4).alias("ratio"), F.round("score", 4).alias("score"), "alert", "interval", F.round("suspicion", 4).alias("suspicion"), "intervals")


@query(PASS + " SELECT level, count(*) AS alerts, round(CAST(avg(least(1.0, s * k)) AS DOUBLE), 4) AS mean_score FROM s, (VALUES ('low', 0.8), ('medium', 1.0), ('high', 1.2)) v(level, k) WHERE least(1.0, s * k) >= 0.4 AND r <= 0.25 GROUP BY 1")
def m07_sensitivity(spark, folder):
    """Alerts of pass-through and their mean score by sensitivity."""
    led, out = event_ledger(spark, folder), None
    for level, k in M.SENSITIVITY.items():
        one = M.pass_through(led, k).where("alert").agg(F.count("*").alias("alerts"), F.round(F.avg("score"), 4).alias("mean_score")).select(F.lit(level).alias("level"), "alerts", "mean_score")
        out = one if out is None else out.unionByName(one)
    return out.where("alerts > 0")


TIMING = """x AS (SELECT a.entity_id, a.transaction_id, a.d, a.oi, count(b.transaction_id) AS k FROM L a LEFT JOIN L b ON b.entity_id = a.entity_id AND b.credit > 0 AND epoch_us(b.d) >= epoch_us(a.d) - 7 * 86400000000 AND epoch_us(b.d) < epoch_us(a.d) WHERE a.debit > 0 GROUP BY ALL),
 y AS (SELECT *, (epoch_us(d) - epoch_us(lag(d) OVER (PARTITION BY entity_id ORDER BY d, oi, transaction_id))) // 86400000000 AS gap FROM x),
 t AS (SELECT entity_id, count(*) AS debits, sum(CASE WHEN k >= 3 THEN 1 ELSE 0 END) AS fed, least(1.0, sum(CASE WHEN k >= 3 THEN 1 ELSE 0 END) * 0.2 + CASE WHEN count(*) >= 3 AND avg(gap) > 0 AND stddev_samp(gap) / avg(gap) < 0.3 THEN 0.3 ELSE 0 END) AS timing FROM y GROUP BY 1)"""


@query(PASS + ", " + TIMING + """, c AS (SELECT entity_id, count(*) AS n, quantile_cont(credit, 0.5) AS m FROM L WHERE credit > 0 GROUP BY 1), q AS (SELECT entity_id, count(*) AS n, quantile_cont(debit, 0.5) AS m FROM L WHERE debit > 0 GROUP BY 1),
 z AS (SELECT L.entity_id, any_value(c.n) AS nc, any_value(q.n) AS nd, any_value(c.m) AS mc, any_value(q.m) AS md, avg(CASE WHEN credit > 0 THEN CASE WHEN credit <= c.m THEN 1.0 ELSE 0.0 END END) AS small, avg(CASE WHEN debit > 0 THEN CASE WHEN debit >= q.m THEN 1.0 ELSE 0.0 END END) AS large FROM L JOIN c USING (entity_id) JOIN q USING (entity_id) GROUP BY 1),
 w AS (SELECT z.entity_id, CASE WHEN nc * 1.0 / nd >= 2 THEN least(0.25, (nc * 1.0 / nd - 2) * 0.1) ELSE 0 END + CASE WHEN md / mc >= 3 THEN least(0.25, (md / mc - 3) * 0.05) ELSE 0 END + CASE WHEN small > 0.6 THEN (small - 0.6) * 0.5 ELSE 0 END + CASE WHEN large > 0.4 THEN (large - 0.4) * 0.25 ELSE 0 END + timing * 0.15 AS score FROM z JOIN t USING (entity_id) WHERE nc >= 5)
 SELECT w.entity_id, round(CAST(least(1.0, score) AS DOUBLE), 4) AS score, score >= 0.4 AS alert FROM w JOIN s USING (entity_id) WHERE least(1.0, s.s) >= 0.4 AND r <= 0.25""")
def m02_m03_classic(spark, folder):
    """The classic pattern, for entities that the pass-through score alerts on."""
    led = event_ledger(spark, folder)
    return M.classic(led).join(M.pass_through(led).where("alert").select("entity_id"), "entity_id", "left_semi").withColumn("score", F.round("score", 4))


@query("""{L}, x AS (SELECT entity_id, debit, floor((epoch_us(d) - epoch_us(lag(d) OVER (PARTITION BY entity_id ORDER BY d, oi))) / 86400000000.0) AS gap FROM L WHERE debit > 0),
 g AS (SELECT entity_id, count(*) AS n, avg(CASE WHEN gap IS NULL THEN NULL WHEN abs(gap - 7) <= 2 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN gap IS NULL THEN NULL WHEN abs(gap - 14) <= 2 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN gap IS NULL THEN NULL WHEN abs(gap - 30) <= 2 THEN 1.0 ELSE 0.0 END) AS c, stddev_samp(debit) / avg(debit) AS cv FROM x GROUP BY 1 HAVING count(*) >= 3),
 z AS (SELECT *, greatest(a, b, c) AS m FROM g), w AS (SELECT *, CASE WHEN m > 0.5 THEN CASE WHEN m > 0.7 THEN 0.4 ELSE 0 END + CASE WHEN greatest(0, 1 - cv) > 0.6 THEN 0.3 ELSE 0 END + 0.3 ELSE 0 END AS s FROM z)
 SELECT entity_id, CASE WHEN a = m THEN 7 WHEN b = m THEN 14 ELSE 30 END AS period, round(m, 4) AS strength, m > 0.5 AS periodic, CAST(s AS DOUBLE) AS score, s >= 0.5 AS alert FROM w""")
def m04_periodic(spark, folder):
    return M.periodic(event_ledger(spark, folder)).withColumns({"strength": F.round("strength", 4), "score": F.round("score", 4)})


@query(PASS + " SELECT entity_id, CASE WHEN s >= 0.8 THEN 'investigate at once|consider restricting the account|report the suspicion' WHEN s >= 0.6 THEN 'monitor closely|review transactions in detail|review the customer' ELSE 'go on monitoring|review with other risk factors' END || '|compare with known pass-through accounts|find out who controls the account' AS advice FROM s WHERE least(1.0, s) >= 0.4 AND r <= 0.25")
def m06_advice(spark, folder):
    """What to do about each pass-through alert; its indicators name no timing, threshold or period."""
    p = M.pass_through(event_ledger(spark, folder)).where("alert").withColumns({"score": F.round("score", 6), "indicators": F.array(F.lit("balanced flow"))})
    return p.select("entity_id", F.array_join(M.advice("score", "indicators"), "|").alias("advice"))


@query("""{L}, g AS (SELECT entity_id, avg(CASE WHEN amount >= 8500 AND amount < 10000 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN amount >= 17000 AND amount < 20000 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN amount >= 42500 AND amount < 50000 THEN 1.0 ELSE 0.0 END) AS c, avg(CASE WHEN amount >= 85000 AND amount < 100000 THEN 1.0 ELSE 0.0 END) AS d, avg(CASE WHEN amount % 1000 = 0 THEN 1.0 ELSE 0.0 END) AS r FROM L WHERE amount > 0 GROUP BY 1),
 s AS (SELECT entity_id, least(1.0, CASE WHEN a > 0.2 THEN a ELSE 0 END + CASE WHEN b > 0.2 THEN b ELSE 0 END + CASE WHEN c > 0.2 THEN c ELSE 0 END + CASE WHEN d > 0.2 THEN d ELSE 0 END + CASE WHEN r > 0.6 THEN 0.3 ELSE 0 END) AS s FROM g) SELECT entity_id, round(CAST(s AS DOUBLE), 4) AS score, s >= 0.4 AS alert FROM s""")
def m05_threshold(spark, folder):
    return M.threshold_avoidance(event_ledger(spark, folder)).withColumn("score", F.round("score", 4))


@query("{L}, " + TIMING + " SELECT entity_id, debits, fed, round(CAST(timing AS DOUBLE), 4) AS timing FROM t")
def j14_debit_timing(spark, folder):
    return M.debit_timing(event_ledger(spark, folder)).withColumn("timing", F.round("timing", 4))


ROUND = """{L} SELECT a.entity_id, a.cp AS counterparty, a.transaction_id AS debit_id, b.transaction_id AS credit_id, round(abs(a.debit - b.credit) / a.debit * 100, 4) AS pct FROM L a JOIN L b ON a.entity_id = b.entity_id AND a.cp = b.cp AND epoch_us(b.d) > epoch_us(a.d) AND epoch_us(b.d) - epoch_us(a.d) <= 30 * 86400000000
 WHERE trim(a.cp) <> '' AND a.debit >= 1000 AND b.credit >= 1000 AND abs(a.debit - b.credit) / a.debit * 100 <= 5"""


def _moves(df, *more):
    return df.select("entity_id", *more, F.col("l_id"), F.col("r_id"), F.round("pct", 4).alias("pct"))


@query(ROUND)
def j07_round_trip_candidates(spark, folder):
    return J.round_trip_candidates(event_ledger(spark, folder)).select("entity_id", "counterparty", F.col("l_id").alias("debit_id"), F.col("r_id").alias("credit_id"), F.round("pct", 4).alias("pct"))


@query()
def j07_round_trips(spark, folder):
    return J.round_trips(event_ledger(spark, folder)).select("entity_id", "counterparty", F.col("l_id").alias("debit_id"), F.col("r_id").alias("credit_id"), F.round("pct", 1).alias("pct"))


@query("""{L}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d, oi) AS rn FROM L) SELECT a.entity_id, a.transaction_id AS credit_id, b.transaction_id AS debit_id, round(abs(a.credit - b.debit) / a.credit * 100, 4) AS pct FROM r a JOIN r b ON a.entity_id = b.entity_id AND b.rn > a.rn AND b.rn <= a.rn + 19
 WHERE a.credit >= 1000 AND b.debit > 0 AND epoch_us(b.d) - epoch_us(a.d) <= 24 * 3600000000 AND abs(a.credit - b.debit) / a.credit * 100 <= 5""")
def j09_rapid_candidates(spark, folder):
    return J.rapid_candidates(event_ledger(spark, folder)).select("entity_id", F.col("l_id").alias("credit_id"), F.col("r_id").alias("debit_id"), F.round("pct", 4).alias("pct"))


@query()
def j09_rapid_movements(spark, folder):
    return J.rapid_movements(event_ledger(spark, folder)).select("entity_id", F.col("l_id").alias("credit_id"), F.col("r_id").alias("debit_id"), F.round("pct", 1).alias("pct"))


@query()
def j10_repeated_pairs(spark, folder):
    return J.repeated_pairs(J.rapid_movements(event_ledger(spark, folder)))


@query("""{L} SELECT a.entity_id, a.transaction_id AS credit_id, b.transaction_id AS debit_id, round(0.7 * (1 - abs(b.debit - a.credit) / a.credit) + 0.3 * (1 - (epoch_us(b.d) - epoch_us(a.d)) / 86400000000.0 / 7), 4) AS score FROM L a JOIN L b ON a.entity_id = b.entity_id AND epoch_us(b.d) > epoch_us(a.d) AND epoch_us(b.d) - epoch_us(a.d) <= 7 * 86400000000
 WHERE trim(a.cp) <> '' AND trim(b.cp) <> '' AND a.cp <> b.cp AND a.credit >= 1000 AND b.debit >= 1000 AND b.debit >= a.credit * 0.8 AND b.debit <= a.credit * 1.0""")
def j11_transfer_candidates(spark, folder):
    return J.transfer_candidates(event_ledger(spark, folder)).select("entity_id", F.col("l_id").alias("credit_id"), F.col("r_id").alias("debit_id"), F.round("score", 4).alias("score"))


@query()
def j11_transfer_patterns(spark, folder):
    return J.transfer_patterns(event_ledger(spark, folder))


@query("""{L} SELECT a.entity_id, count(*) AS pairs, round(avg((epoch_us(b.d) - epoch_us(a.d)) / 3600000000.0), 3) AS mean_hours FROM L a JOIN L b ON a.entity_id = b.entity_id AND a.credit > 0 AND b.debit > 0 AND epoch_us(b.d) > epoch_us(a.d) AND epoch_us(b.d) - epoch_us(a.d) <= 24 * 3600000000
 WHERE 1 - abs(a.credit - b.debit) / greatest(a.credit, b.debit) > 0.8 GROUP BY 1""")
def j12_dwell(spark, folder):
    return J.dwell(event_ledger(spark, folder)).withColumn("mean_hours", F.round("mean_hours", 3))
