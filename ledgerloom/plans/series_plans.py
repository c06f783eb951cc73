"""Period series, their statistics, and the profiles of cash flow and counterparties, over the event ledger."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.stats import linear
from ledgerloom.operators import counterparty as C
from ledgerloom.operators import timeseries as T
from ledgerloom.operators.search import CASH_WORDS, has_word
from ledgerloom.sources.ledger import EVENT_SQL, event_ledger
from ledgerloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SERIES = """, P0 AS (SELECT entity_id, CAST(d AS DATE) AS period, sum(debit) AS debit, sum(credit) AS credit FROM L GROUP BY 1, 2),
 P AS (SELECT *, credit - debit AS net, credit + debit AS activity, row_number() OVER (PARTITION BY entity_id ORDER BY period) AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM P0)"""


def query(sql: str | None = None, name: str | None = None):
    def take(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql.replace("{L}", "WITH " + EVENT_SQL).replace("{P}", "WITH " + EVENT_SQL + SERIES)
        return f

    return take


def _series(spark, folder):
    return T.daily_series(event_ledger(spark, folder))


@query("""{L} SELECT entity_id, round(sum(credit), 2) AS inflow, round(sum(debit), 2) AS outflow, count(*) AS n, sum(CASE WHEN debit > 50000 OR credit > 50000 THEN 1 ELSE 0 END) AS large FROM L
 WHERE regexp_matches(descr, '(?i)cash|atm|withdrawal|chq') GROUP BY 1""")
def a11_cash_flow(spark, folder):
    led = event_ledger(spark, folder).where(has_word(F.col("DESCRIPTION"), CASH_WORDS))
    return led.groupBy("entity_id").agg(F.round(F.sum("CREDIT"), 2).alias("inflow"), F.round(F.sum("DEBIT"), 2).alias("outflow"), F.count("*").alias("n"), F.sum(F.when((F.col("DEBIT") > 50000) | (F.col("CREDIT") > 50000), 1).otherwise(0)).alias("large"))


@query("""{L}, a AS (SELECT entity_id, debit AS x FROM L UNION ALL SELECT entity_id, credit FROM L) SELECT entity_id, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median, max(x) AS most, min(x) AS least FROM a GROUP BY 1""")
def a11_amount_spread(spark, folder):
    """Mean, median, most and least over debits and credits together, zeros of the other side included."""
    both = event_ledger(spark, folder).select("entity_id", F.explode(F.array("DEBIT", "CREDIT")).alias("x"))
    return both.groupBy("entity_id").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(linear("x", 0.5), 4).alias("median"), F.max("x").alias("most"), F.min("x").alias("least"))


@query("{L} SELECT entity_id, dayname(d) AS weekday, count(*) AS n FROM L GROUP BY 1, 2")
def a11_weekdays(spark, folder):
    return event_ledger(spark, folder).groupBy("entity_id", F.date_format("DATE", "EEEE").alias("weekday")).agg(F.count("*").alias("n"))


def _periods_sql(grain: str) -> str:
    return f"""{{L}}, h AS (SELECT entity_id, date_trunc('{grain}', d) AS period, hour(d) AS h, count(*) AS k FROM L GROUP BY 1, 2, 3), hm AS (SELECT entity_id, period, h, row_number() OVER (PARTITION BY entity_id, period ORDER BY k DESC, h) AS r FROM h),
 g AS (SELECT entity_id, date_trunc('{grain}', d) AS period, round(sum(debit), 2) AS debit_sum, count(debit) AS debit_count, round(avg(debit), 4) AS debit_mean, round(coalesce(stddev_samp(debit), 0.0), 3) AS debit_std, round(sum(credit), 2) AS credit_sum, round(avg(credit), 4) AS credit_mean, round(coalesce(stddev_samp(credit), 0.0), 3) AS credit_std,
 round(sum(credit - debit), 2) AS net_flow_sum, round(avg(credit - debit), 4) AS net_flow_mean, round(avg(credit + debit), 4) AS activity_mean, round(sum(debit) / (sum(credit) + 1e-10), 4) AS ratio, round((coalesce(stddev_samp(debit), 0.0) + coalesce(stddev_samp(credit), 0.0)) / 2, 3) AS volatility, 2 * count(*) AS intensity FROM L GROUP BY 1, 2),
 wm AS (SELECT entity_id, period, w, row_number() OVER (PARTITION BY entity_id, period ORDER BY k DESC, w) AS r FROM (SELECT entity_id, date_trunc('{grain}', d) AS period, isodow(d) AS w, count(*) AS k FROM L GROUP BY 1, 2, 3)) SELECT g.entity_id, epoch_us(g.period) AS period_micros, debit_sum, debit_count, debit_mean, debit_std, credit_sum, credit_mean, credit_std, net_flow_sum, net_flow_mean, activity_mean, CASE WHEN credit_sum > 0 THEN ratio END AS ratio, volatility, intensity, h AS hour_mode, w AS weekday_mode FROM g JOIN hm ON hm.entity_id = g.entity_id AND hm.period = g.period AND hm.r = 1 JOIN wm ON wm.entity_id = g.entity_id AND wm.period = g.period AND wm.r = 1"""


def _periods(grain: str):
    def run(spark, folder):
        p = T.periods(event_ledger(spark, folder), grain)
        p = T.rounded(T.rounded(p, "debit_sum", "credit_sum", "net_flow_sum", places=2), "debit_mean", "credit_mean", "net_flow_mean", "activity_mean", "ratio")
        p = T.rounded(p, "debit_std", "credit_std", "volatility", places=3)
        return p.select("entity_id", F.unix_micros("period").alias("period_micros"), "debit_sum", "debit_count", "debit_mean", "debit_std", "credit_sum", "credit_mean", "credit_std", "net_flow_sum", "net_flow_mean", "activity_mean", "ratio", "volatility", "intensity", "hour_mode", "weekday_mode")

    return run


for _g in ("hour", "day", "week", "month"):
    query(_periods_sql(_g), f"a12_periods_{_g}")(_periods(_g))


@query("{P} SELECT entity_id, count(*) AS periods, arg_max(CAST(period AS VARCHAR), activity) AS peak, arg_max(CAST(period AS VARCHAR), debit) AS debit_peak, arg_max(CAST(period AS VARCHAR), credit) AS credit_peak, round(avg(activity), 4) AS mean_activity, round(max(debit), 2) AS most_debit, round(max(credit), 2) AS most_credit FROM P GROUP BY 1")
def a13_summary(spark, folder):
    return _series(spark, folder).groupBy("entity_id").agg(F.count("*").alias("periods"), F.max_by(T.iso("period"), "activity").alias("peak"), F.max_by(T.iso("period"), "debit").alias("debit_peak"), F.max_by(T.iso("period"), "credit").alias("credit_peak"), F.round(F.avg("activity"), 4).alias("mean_activity"), F.round(F.max("debit"), 2).alias("most_debit"), F.round(F.max("credit"), 2).alias("most_credit"))


@query("""WITH P AS (SELECT entity_id, CAST(day AS DATE) AS period, sum(activity) AS activity FROM (SELECT entity_id, CAST(created_at AS DATE) AS day, CAST(amount AS DOUBLE) AS activity FROM transactions WHERE entity_id IS NOT NULL) GROUP BY 1, 2), n AS (SELECT entity_id FROM P GROUP BY 1 HAVING count(*) > 30),
 g AS (SELECT entity_id, month(period) AS month, count(*) AS periods, avg(activity) AS mean, coalesce(stddev_samp(activity), 0.0) AS deviation FROM P WHERE entity_id IN (SELECT entity_id FROM n) GROUP BY 1, 2)
 SELECT entity_id, month, periods, round(mean, 3) AS mean, round(deviation, 2) AS deviation, row_number() OVER (PARTITION BY entity_id ORDER BY mean DESC, month) = 1 AS is_peak FROM g""")
def a14_months(spark, folder):
    """Statistics by month of the year over the days on which the store's rows were recorded, of entities with more than 30 such days."""
    t = table(spark, folder, "transactions").where("entity_id is not null")
    s = t.groupBy("entity_id", F.to_date("created_at").alias("period")).agg(F.sum(F.col("amount").cast("double")).alias("activity"))
    many = s.groupBy("entity_id").agg(F.count("*").alias("k")).where("k > 30").select("entity_id")
    return T.rounded(T.rounded(T.month_of_year(s.join(many, "entity_id", "left_semi")), "mean", places=3), "deviation", places=2)


@query("""{P}, X AS (SELECT entity_id, period, unnest(['debit', 'credit', 'net', 'activity']) AS metric, unnest([debit, credit, net, activity]) AS y FROM P), Q AS (SELECT *, date_diff('day', min(period) OVER (PARTITION BY entity_id), period) AS x FROM X),
 g AS (SELECT entity_id, metric, count(*) AS n, CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) END AS b, CASE WHEN var_pop(x) > 0 THEN regr_intercept(y, x) END AS a, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(y, x) END AS c FROM Q GROUP BY 1, 2), t AS (SELECT *, CASE WHEN n > 2 AND b IS NOT NULL THEN c * sqrt(n - 2) / sqrt(nullif(greatest(0, 1 - c * c), 0)) END AS t FROM g)
 SELECT entity_id, metric, n, round(coalesce(b, 0.0), 3) AS slope, round(CASE WHEN b IS NULL THEN 0.0 ELSE a END, 2) AS intercept, round(CASE WHEN b IS NULL THEN 0.0 ELSE coalesce(c * c, 1.0) END, 4) AS r2, round(t, 3) AS t, round(2 * (1 - abs(t) / (abs(t) + n - 2)), 4) AS pseudo_p, CASE WHEN b IS NULL THEN 'weak' WHEN c * c > 0.7 THEN 'strong' WHEN c * c > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM t""")
def x01_x02_trend(spark, folder):
    """The trends of debits, credits, net flow and activity of each entity."""
    t = T.rounded(T.trends(_series(spark, folder)), "slope", "t", places=3)
    return T.rounded(T.rounded(t, "intercept", places=2), "r2", "pseudo_p")


@query("""{P}, m AS (SELECT entity_id, period, i, n, least(7, n // 3) AS w FROM P), v AS (SELECT a.entity_id, a.period, a.i, a.w, avg(b.activity) AS v FROM m a JOIN P b ON b.entity_id = a.entity_id AND b.i > a.i - a.w AND b.i <= a.i GROUP BY ALL)
 SELECT entity_id, CAST(period AS VARCHAR) AS period, CASE WHEN w >= 2 AND i >= w THEN round(v, 3) END AS moving FROM v""")
def w03_rolling_mean(spark, folder):
    return T.moving(_series(spark, folder), "activity").select("entity_id", T.iso("period").alias("period"), F.round("moving", 3).alias("moving"))


@query("""{P}, m AS (SELECT entity_id, period, i, n, least(5, n // 3) AS w FROM P), v AS (SELECT a.entity_id, a.period, a.i, a.w, stddev_pop(b.activity) AS v FROM m a JOIN P b ON b.entity_id = a.entity_id AND b.i > a.i - a.w AND b.i <= a.i GROUP BY ALL)
 SELECT entity_id, CAST(period AS VARCHAR) AS period, CASE WHEN w >= 2 AND i >= w THEN round(v, 3) END AS moving FROM v""")
def w04_rolling_deviation(spark, folder):
    return T.moving(_series(spark, folder), "activity", 5, deviation=True).select("entity_id", T.iso("period").alias("period"), F.round("moving", 3).alias("moving"))


@query("""{P}, c AS (SELECT *, sum(net) OVER (PARTITION BY entity_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS cum FROM P)
 SELECT entity_id, sum(CASE WHEN net > 0 THEN 1 ELSE 0 END) AS positive, sum(CASE WHEN net < 0 THEN 1 ELSE 0 END) AS negative, sum(CASE WHEN net = 0 THEN 1 ELSE 0 END) AS neutral, round(least(min(cum), 0.0), 2) AS drawdown, round(arg_max(cum, period), 2) AS final, round(stddev_pop(net), 3) AS flow_deviation FROM c GROUP BY 1""")
def w05_x08_liquidity(spark, folder):
    return T.rounded(T.rounded(T.liquidity(_series(spark, folder)), "drawdown", "final", places=2), "flow_deviation", places=3)


@query("""{P}, c AS (SELECT entity_id, activity - lag(activity) OVER (PARTITION BY entity_id ORDER BY period) AS x FROM P) SELECT entity_id, round(avg(x), 3) AS mean_change, round(min(x), 2) AS least_change, round(max(x), 2) AS most_change FROM c GROUP BY 1""")
def w06_acceleration(spark, folder):
    return T.rounded(T.rounded(T.acceleration(_series(spark, folder)), "mean_change", places=3), "least_change", "most_change", places=2)


@query("{P}, " + ", ".join(f"c{k} AS (SELECT entity_id, {k} AS lag, activity, lag(activity, {k}) OVER (PARTITION BY entity_id ORDER BY period) AS was FROM P WHERE n >= 2 * {k})" for k in (7, 14, 30)) + ", c AS (SELECT * FROM c7 UNION ALL SELECT * FROM c14 UNION ALL SELECT * FROM c30) SELECT entity_id, lag, round(corr(activity, was), 4) AS r, coalesce(corr(activity, was) > 0.6, false) AS strong FROM c GROUP BY 1, 2")
def w11_x09_autocorrelation(spark, folder):
    """Autocorrelation at lags of 7, 14 and 30 periods, where there are twice as many."""
    s, out = _series(spark, folder), None
    for k in (7, 14, 30):
        one = T.autocorrelation(s, k).withColumn("lag", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return T.rounded(out, "r")


def _anomalies_sql(m: str) -> str:
    return f"""SELECT P.entity_id, '{m}' AS metric, CAST(period AS VARCHAR) AS period, round({m}, 2) AS value, CASE WHEN {m} > q3 + 2.5 * (q3 - q1) THEN 'high' ELSE 'medium' END AS severity FROM P JOIN (SELECT entity_id, v[CAST(floor(0.25 * (k - 1) + 0.5) AS INT) + 1] AS q1, v[CAST(floor(0.75 * (k - 1) + 0.5) AS INT) + 1] AS q3 FROM (SELECT entity_id, list({m} ORDER BY {m}) AS v, count(*) AS k FROM P GROUP BY 1)) b USING (entity_id) WHERE {m} < q1 - 1.5 * (q3 - q1) OR {m} > q3 + 1.5 * (q3 - q1)"""


@query("{P} " + " UNION ALL ".join(_anomalies_sql(m) for m in ("debit", "credit", "activity")))
def x03_iqr_anomalies(spark, folder):
    """Anomalies of debits, credits and activity."""
    s, out = _series(spark, folder), None
    for m in ("debit", "credit", "activity"):
        one = T.iqr_anomalies(s, m).select("entity_id", F.lit(m).alias("metric"), T.iso("period").alias("period"), F.round("value", 2).alias("value"), "severity")
        out = one if out is None else out.unionByName(one)
    return out


@query("""{P}, g AS (SELECT entity_id, avg(activity) AS m, stddev_samp(activity) AS s FROM P GROUP BY 1) SELECT entity_id, CAST(period AS VARCHAR) AS period, round(activity, 2) AS activity, CASE WHEN activity > m + 3 * s THEN 'high' ELSE 'medium' END AS severity FROM P JOIN g USING (entity_id) WHERE activity > m + 2 * s""")
def x04_velocity_anomalies(spark, folder):
    return T.velocity_anomalies(_series(spark, folder)).select("entity_id", T.iso("period").alias("period"), F.round("activity", 2).alias("activity"), "severity")


@query("""{P}, q AS (SELECT entity_id, list(activity ORDER BY activity) AS v, count(*) AS k, avg(activity) AS m, max(activity) AS x, coalesce(stddev_samp(activity), 0.0) AS s FROM P GROUP BY 1), t AS (SELECT *, v[CAST(floor(0.8 * (k - 1) + 0.5) AS INT) + 1] AS th FROM q)
 SELECT entity_id, round(m, 4) AS mean, round(x, 2) AS most, round(s, 3) AS deviation, round(th, 2) AS threshold, (SELECT count(*) FROM P WHERE P.entity_id = t.entity_id AND P.activity > t.th) AS above FROM t""")
def x05_velocity(spark, folder):
    return T.rounded(T.rounded(T.rounded(T.velocity(_series(spark, folder)), "mean"), "most", "threshold", places=2), "deviation", places=3)


@query("{P} SELECT entity_id, round(corr(debit, credit), 4) AS debit_credit, round(corr(debit, activity), 4) AS debit_activity, round(corr(credit, activity), 4) AS credit_activity, round(corr(net, activity), 4) AS net_activity FROM P GROUP BY 1")
def x06_correlations(spark, folder):
    return T.rounded(T.correlations(_series(spark, folder)), "debit_credit", "debit_activity", "credit_activity", "net_activity")


@query("{P} SELECT entity_id, round(coalesce(stddev_samp(activity), 0.0), 3) AS deviation, round(coalesce(stddev_samp(activity), 0.0) / avg(activity), 4) AS variation, round(max(activity) - min(activity), 2) AS span, round(quantile_cont(activity, 0.75) - quantile_cont(activity, 0.25), 3) AS iqr FROM P GROUP BY 1")
def x07_volatility(spark, folder):
    sd = F.coalesce(F.stddev_samp("activity"), F.lit(0.0))
    return _series(spark, folder).groupBy("entity_id").agg(F.round(sd, 3).alias("deviation"), F.round(F.try_divide(sd, F.avg("activity")), 4).alias("variation"), F.round(F.max("activity") - F.min("activity"), 2).alias("span"), F.round(linear("activity", 0.75) - linear("activity", 0.25), 3).alias("iqr"))


@query("""{P}, m AS (SELECT entity_id, period, i, n, activity, least(5, n // 3) AS w FROM P WHERE n > 10), v AS (SELECT a.entity_id, a.period, a.i, a.n, a.w, a.activity, avg(b.activity) AS v FROM m a JOIN P b ON b.entity_id = a.entity_id AND b.i > a.i - a.w AND b.i <= a.i GROUP BY ALL),
 x AS (SELECT *, CASE WHEN i >= w THEN v END AS mv FROM v), y AS (SELECT *, activity - coalesce(mv, avg(mv) OVER (PARTITION BY entity_id)) AS de FROM x), z AS (SELECT *, CASE WHEN sign(de) <> sign(lag(de) OVER (PARTITION BY entity_id ORDER BY period)) THEN 1 ELSE 0 END AS turn FROM y)
 SELECT entity_id, round(sum(turn) * 1.0 / max(n), 4) AS frequency, round(stddev_pop(de) / (avg(abs(activity)) + 1e-10), 4) AS strength FROM z GROUP BY 1""")
def w12_zero_crossings(spark, folder):
    return T.rounded(T.zero_crossings(_series(spark, folder)), "frequency", "strength")


@query("""{L}, x AS (SELECT *, epoch(d) / 3600.0 - lag(epoch(d) / 3600.0) OVER (PARTITION BY entity_id ORDER BY d, oi) AS gap FROM L) SELECT entity_id, round(avg(gap), 3) AS mean_hours, round(quantile_cont(gap, 0.5), 3) AS median_hours, round(stddev_samp(gap), 3) AS std_hours, round(min(gap), 3) AS least_hours, round(max(gap), 3) AS most_hours FROM x GROUP BY 1""")
def w07_gaps(spark, folder):
    w = W.partitionBy("entity_id").orderBy("DATE", "original_index")
    led = event_ledger(spark, folder)
    gap = (F.unix_micros("DATE") - F.unix_micros(F.lag("DATE").over(w))) / 3.6e9
    g = led.select("entity_id", gap.alias("gap"))
    return g.groupBy("entity_id").agg(F.round(F.avg("gap"), 3).alias("mean_hours"), F.round(linear("gap", 0.5), 3).alias("median_hours"), F.round(F.stddev_samp("gap"), 3).alias("std_hours"), F.round(F.min("gap"), 3).alias("least_hours"), F.round(F.max("gap"), 3).alias("most_hours"))


CP = """{L}, c AS (SELECT *, debit + credit AS act, CAST(floor(epoch(d) - epoch(min(d) OVER ())) AS BIGINT) // 86400 AS x, row_number() OVER (PARTITION BY entity_id, cp ORDER BY d, oi) AS i, count(*) OVER (PARTITION BY entity_id, cp) AS n FROM L WHERE trim(cp) <> '')"""


@query(CP + " SELECT entity_id, cp AS counterparty, n AS transactions, round(coalesce(CASE WHEN var_pop(x) > 0 THEN regr_slope(act, x) END, 0.0), 2) AS slope, CASE WHEN coalesce(abs(CASE WHEN var_pop(x) > 0 AND var_pop(act) > 0 THEN corr(act, x) END), 0) < 0.3 THEN 'stable' WHEN corr(act, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM c WHERE n >= 3 GROUP BY 1, 2, 3")
def x10_x13_counterparty_trend(spark, folder):
    return T.rounded(C.trends(event_ledger(spark, folder)), "slope", places=2)


@query(CP + """, g AS (SELECT entity_id, cp, count(*) AS n, sum(debit) AS dr, sum(credit) AS cr, avg(act) AS m, stddev_samp(act) AS s, avg(CASE WHEN act % 1000 = 0 OR act % 500 = 0 THEN 1.0 ELSE 0.0 END) AS r, date_diff('day', CAST(min(d) AS DATE), CAST(max(d) AS DATE)) + 1 AS days FROM c WHERE n >= 3 GROUP BY 1, 2),
 w AS (SELECT entity_id, cp, max(k) AS k FROM (SELECT entity_id, cp, isodow(d), count(*) AS k FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2)
 SELECT entity_id, cp AS counterparty, round(least(1.0, CASE WHEN n / days > 1 THEN 0.2 WHEN n / days > 0.5 THEN 0.1 ELSE 0 END + CASE WHEN s / m > 2 THEN 0.25 WHEN s / m > 1 THEN 0.15 ELSE 0 END + CASE WHEN r > 0.7 THEN 0.15 WHEN r > 0.5 THEN 0.08 ELSE 0 END
 + CASE WHEN abs(dr - cr) / (dr + cr) > 0.9 THEN 0.2 WHEN abs(dr - cr) / (dr + cr) > 0.7 THEN 0.1 ELSE 0 END + CASE WHEN n > 3 AND k * 1.0 / n > 0.8 THEN 0.2 WHEN n > 3 AND k * 1.0 / n > 0.6 THEN 0.1 ELSE 0 END), 4) AS risk FROM g JOIN w USING (entity_id, cp)""")
def x11_counterparty_risk(spark, folder):
    return C.risk(event_ledger(spark, folder)).select("entity_id", "counterparty", F.round("risk", 4).alias("risk"))


@query(CP + ", y AS (SELECT *, x - lag(x) OVER (PARTITION BY entity_id, cp ORDER BY d, oi) AS gap FROM c WHERE n >= 3) SELECT entity_id, cp AS counterparty, round(avg(gap), 4) AS mean_gap, min(gap) AS least_gap, max(gap) AS most_gap, sum(CASE WHEN gap = 0 THEN 1 ELSE 0 END) AS same_day FROM y GROUP BY 1, 2")
def x12_counterparty_velocity(spark, folder):
    return C.velocity(event_ledger(spark, folder)).select("entity_id", "counterparty", F.round("mean_gap", 4).alias("mean_gap"), "least_gap", "most_gap", "same_day")


@query(CP + """, h AS (SELECT entity_id, cp, avg(CASE WHEN i <= n // 2 THEN act END) AS e, avg(CASE WHEN i > n // 2 THEN act END) AS l, sum(CASE WHEN i <= n // 2 THEN credit - debit ELSE 0 END) AS ne, sum(CASE WHEN i > n // 2 THEN credit - debit ELSE 0 END) AS nl FROM c WHERE n >= 4 GROUP BY 1, 2)
 SELECT entity_id, cp AS counterparty, round((l - e) / e, 4) AS amount_change, ne * nl < 0 AS flow_turned, CASE WHEN abs((l - e) / e) > 1 THEN 'high' WHEN abs((l - e) / e) > 0.5 THEN 'medium' ELSE 'none' END AS severity FROM h""")
def w08_halves(spark, folder):
    return C.halves(event_ledger(spark, folder)).withColumn("amount_change", F.round("amount_change", 4))


@query(CP + " SELECT entity_id, cp AS counterparty, strftime(d, '%Y-%m') AS month, count(*) AS n, round(sum(act), 2) AS total FROM c GROUP BY 1, 2, 3")
def a19_counterparty_months(spark, folder):
    led = event_ledger(spark, folder).where(F.trim("counterparty") != "")
    return led.groupBy("entity_id", "counterparty", F.date_format("DATE", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("DEBIT") + F.col("CREDIT")), 2).alias("total"))


@query(CP + ", g AS (SELECT entity_id, cp, isodow(d) AS w, count(*) AS k FROM c GROUP BY 1, 2, 3), y AS (SELECT entity_id, cp, CAST(d AS DATE) AS day, count(*) AS k FROM c GROUP BY 1, 2, 3), z AS (SELECT entity_id, cp, max(k) AS most_a_day, count(CASE WHEN k > 1 THEN 1 END) AS busy_days FROM y GROUP BY 1, 2) SELECT entity_id, cp AS counterparty, any_value(most_a_day) AS most_a_day, any_value(busy_days) AS busy_days, round(max(k) * 1.0 / sum(k), 4) AS weekday_share FROM g JOIN z USING (entity_id, cp) GROUP BY 1, 2")
def a19_counterparty_days(spark, folder):
    """The largest share of one weekday, most rows of one day, and days with more than one, by counterparty."""
    led = event_ledger(spark, folder).where(F.trim("counterparty") != "")
    key = ["entity_id", "counterparty"]
    week = led.groupBy(*key, F.dayofweek("DATE").alias("w")).agg(F.count("*").alias("k")).groupBy(*key).agg(F.round(F.max("k") / F.sum("k"), 4).alias("weekday_share"))
    day = led.groupBy(*key, F.to_date("DATE").alias("d")).agg(F.count("*").alias("k")).groupBy(*key).agg(F.max("k").alias("most_a_day"), F.count(F.when(F.col("k") > 1, 1)).alias("busy_days"))
    return day.join(week, key)


@query(CP + ", g AS (SELECT entity_id, cp, count(*) AS n, sum(act) AS v, avg(act) AS m, stddev_samp(act) AS s, greatest(1, date_diff('day', CAST(min(d) AS DATE), CAST(max(d) AS DATE)) + 1) AS days FROM c WHERE n >= 3 GROUP BY 1, 2) SELECT entity_id, cp AS counterparty, round(n * 1.0 / days, 4) AS rows_a_day, round(v / days, 3) AS amount_a_day, days FROM g")
def x12_counterparty_rates(spark, folder):
    """Rows and amount a day of each counterparty with three rows or more, over its calendar days."""
    led = event_ledger(spark, folder).where(F.trim("counterparty") != "")
    days = F.greatest(F.lit(1), F.datediff(F.max("DATE"), F.min("DATE")) + 1)
    g = led.groupBy("entity_id", "counterparty").agg(F.count("*").alias("n"), F.sum(F.col("DEBIT") + F.col("CREDIT")).alias("v"), days.alias("days")).where("n >= 3")
    return g.select("entity_id", "counterparty", F.round(F.col("n") / F.col("days"), 4).alias("rows_a_day"), F.round(F.col("v") / F.col("days"), 3).alias("amount_a_day"), "days")
