"""Roll-ups for reports: centralities, anomalies, alert and counterparty summaries, severities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import centrality as Z
from ledgerloom.operators import counterparty as C
from ledgerloom.operators import graph
from ledgerloom.operators import mule as M
from ledgerloom.operators import pairing as J
from ledgerloom.operators.risk import entity_risk
from ledgerloom.plans.network_plans import nation_edges
from ledgerloom.plans.pattern_plans import SQL as PATTERN_SQL
from ledgerloom.plans.series_plans import SQL as SERIES_SQL
from ledgerloom.session import stored
from ledgerloom.sources.ledger import EVENT_SQL, event_ledger
from ledgerloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def take(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql.replace("{L}", "WITH " + EVENT_SQL)
        return f

    return take


@query()
def g11_g12_centralities(spark, folder):
    return Z.centralities(stored(nation_edges(spark, folder), "edges"))


@query()
def g14_hubs(spark, folder):
    e = stored(nation_edges(spark, folder), "edges")
    degree = graph.nodes(e).select("node", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    return Z.hubs(Z.centralities(e).join(graph.page_rank(e), "node").join(degree, "node"))


@query()
def g17_anomalies(spark, folder):
    e = stored(nation_edges(spark, folder), "edges")
    return Z.anomalies(graph.nodes(e), graph.cycles(e, 3, 4))


@query("{L}, h AS (SELECT entity_id, date_trunc('hour', d) AS h, count(*) AS n FROM L GROUP BY 1, 2 HAVING count(*) > 1) SELECT entity_id, epoch_us(h) AS hour_micros, n FROM h")
def g18_same_hour(spark, folder):
    return Z.same_hour(event_ledger(spark, folder), "entity_id", "DATE").select("entity_id", F.unix_micros("hour").alias("hour_micros"), "n")


@query()
def w10_bursts(spark, folder):
    return Z.bursts(event_ledger(spark, folder), "entity_id", "DATE", 24, 3)


@query(f"SELECT count(*) AS entities, sum(CASE WHEN alert THEN 1 ELSE 0 END) AS alerts, round(max(score), 4) AS most, sum(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) AS high FROM ({PATTERN_SQL['m01_pass_through']})")
def a25_alert_summary(spark, folder):
    p = M.pass_through(event_ledger(spark, folder))
    return p.agg(F.count("*").alias("entities"), F.sum(F.col("alert").cast("int")).alias("alerts"), F.round(F.max("score"), 4).alias("most"), F.sum((F.round("score", 4) >= 0.7).cast("int")).alias("high"))


@query(f"SELECT count(*) AS counterparties, round(avg(risk), 4) AS mean_risk, sum(CASE WHEN risk >= 0.6 THEN 1 ELSE 0 END) AS high FROM ({SERIES_SQL['x11_counterparty_risk']})")
def a26_counterparty_insights(spark, folder):
    r = C.risk(event_ledger(spark, folder)).withColumn("risk", F.round("risk", 4))
    return r.agg(F.count("*").alias("counterparties"), F.round(F.avg("risk"), 4).alias("mean_risk"), F.sum((F.col("risk") >= 0.6).cast("int")).alias("high"))


@query("""SELECT entity_id, counterparty, debit_id, credit_id, round(1 - pct / 100, 4) AS confidence, CASE WHEN 1 - pct / 100 >= 0.9 THEN 'high' WHEN 1 - pct / 100 >= 0.7 THEN 'medium' WHEN 1 - pct / 100 >= 0.5 THEN 'low' ELSE 'info' END AS severity FROM (""" + PATTERN_SQL["j07_round_trip_candidates"] + ")")
def g28_round_trip_severity(spark, folder):
    c = J.round_trip_candidates(event_ledger(spark, folder)).withColumn("confidence", 1 - F.round("pct", 4) / 100)
    return c.select("entity_id", "counterparty", F.col("l_id").alias("debit_id"), F.col("r_id").alias("credit_id"), F.round("confidence", 4).alias("confidence"), Z.severity("confidence").alias("severity"))


@query("""WITH t AS (SELECT counterparty_merged AS cp, entity_id, transaction_id FROM transactions WHERE counterparty_merged IS NOT NULL) SELECT cp AS counterparty, count(*) AS linked, count(DISTINCT entity_id) AS entities FROM t GROUP BY 1 HAVING count(DISTINCT entity_id) >= 3""")
def g29_a07_counterparty_alerts(spark, folder):
    """Counterparties that three entities or more deal with, and how many transactions are linked by them."""
    t = table(spark, folder, "transactions").where("counterparty_merged is not null")
    return t.groupBy(F.col("counterparty_merged").alias("counterparty")).agg(F.count("*").alias("linked"), F.countDistinct("entity_id").alias("entities")).where("entities >= 3")


@query()
def g22_entity_report(spark, folder):
    """entity_id, score, factors and the recommendations that go with them."""
    r = entity_risk(table(spark, folder, "transactions"))
    advice = F.array_compact(F.array(F.when(F.array_contains("factors", "mostly cash"), "verify the source of cash"), F.when(F.array_contains("factors", "high volume"), "request statements of all accounts"), F.when(F.array_contains("factors", "large single amount"), "examine the largest movements")))
    return r.withColumn("recommendations", F.array_join(advice, "; ")).withColumn("factors", F.array_join("factors", "; "))


@query()
def g19_groups(spark, folder):
    from ledgerloom.operators import grouping

    return grouping.grouped(grouping.entity_features(event_ledger(spark, folder))).select("entity_id", "group")


@query()
def f04_chunks(spark, folder):
    """Rows of each entity in chunks of at most 500 characters of description."""
    from ledgerloom.operators.stores import chunks

    led = event_ledger(spark, folder).select("entity_id", "transaction_id", F.length("DESCRIPTION").alias("size"))
    return chunks(led, "entity_id", ["transaction_id"], "size", 500)
