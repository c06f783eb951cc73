"""Networks and flows, over the event ledger and the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import plain_name_sql
from ledgerloom.operators import flows, graph, resolve
from ledgerloom.sources.ledger import EVENT_SQL, event_ledger
from ledgerloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
E_SQL = EVENT_SQL + """, R AS (SELECT CASE WHEN direction = 'DR' THEN 'entity_' || entity_id ELSE 'external_' || trim(cp) END AS src, CASE WHEN direction = 'DR' THEN 'external_' || trim(cp) ELSE 'entity_' || entity_id END AS dst, amount, d, transaction_id FROM L WHERE trim(cp) <> ''),
 E AS (SELECT src, dst, sum(amount) AS total, count(*) AS n, max(d) AS last_at FROM R GROUP BY 1, 2)"""
NATION_SQL = """F0 AS (SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS src, 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS dst, l_extendedprice AS amount, l_shipdate AS d, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
 F AS (SELECT src, dst, sum(amount) AS total, count(*) AS n FROM F0 WHERE src <> dst GROUP BY 1, 2)"""


def line_key():
    """An order line is told by all four keys: line numbers repeat within an order."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def query(sql: str | None = None, name: str | None = None):
    def take(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql.replace("{E}", "WITH " + E_SQL).replace("{N}", "WITH RECURSIVE " + NATION_SQL)
        return f

    return take


def event_rows(spark, folder) -> DataFrame:
    """src, dst, amount, DATE, transaction_id of the event ledger."""
    led = event_ledger(spark, folder).where(F.trim("counterparty") != "")
    own, other = F.concat(F.lit("entity_"), F.col("entity_id").cast("string")), F.concat(F.lit("external_"), F.trim("counterparty"))
    out = F.col("direction") == "DR"
    return led.select(F.when(out, own).otherwise(other).alias("src"), F.when(out, other).otherwise(own).alias("dst"), "amount", "DATE", "transaction_id")


def nation_edges(spark, folder) -> DataFrame:
    """Trade between nations of customers and suppliers: a small, dense network."""
    name = lambda c: F.concat(F.lit("N"), F.lpad(F.col(c).cast("string"), 2, "0"))
    li = table(spark, folder, "lineitem").join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = li.where("c_nationkey <> s_nationkey").select(name("c_nationkey").alias("src"), name("s_nationkey").alias("dst"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").cast("timestamp").alias("DATE"), line_key().alias("transaction_id"))
    return graph.folded(rows)


@query("{E} SELECT src, dst, round(total, 2) AS total, n FROM E")
def g01_a20_edges(spark, folder):
    return graph.edges(event_ledger(spark, folder)).select("src", "dst", F.round("total", 2).alias("total"), "n")


@query("""{E}, x AS (SELECT src AS node, 0.0 AS i, total AS o, 0 AS di, 1 AS dq FROM E UNION ALL SELECT dst, total, 0.0, 1, 0 FROM E), g AS (SELECT node, sum(i) AS i, sum(o) AS o, sum(di) AS di, sum(dq) AS dq FROM x GROUP BY 1)
 SELECT node, round(i, 2) AS in_total, round(o, 2) AS out_total, di AS in_degree, dq AS out_degree, round((di + dq) * 1.0 / ((SELECT count(*) FROM g) - 1), 6) AS centrality FROM g""")
def g10_nodes(spark, folder):
    n = graph.nodes(graph.edges(event_ledger(spark, folder)))
    return n.select("node", F.round("in_total", 2).alias("in_total"), F.round("out_total", 2).alias("out_total"), "in_degree", "out_degree", F.round("centrality", 6).alias("centrality"))


@query("""{E}, n AS (SELECT count(*) AS n FROM (SELECT src FROM E UNION SELECT dst FROM E)) SELECT n.n AS nodes, count(*) AS edges, round(count(*) * 1.0 / (n.n * (n.n - 1)), 6) AS density, round(sum(CASE WHEN EXISTS (SELECT 1 FROM E b WHERE b.src = a.dst AND b.dst = a.src) THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS reciprocity, round(sum(total), 2) AS volume FROM E a, n GROUP BY n.n""")
def g15_a22_overview(spark, folder):
    return graph.overview(graph.edges(event_ledger(spark, folder))).select("nodes", "edges", F.round("density", 6).alias("density"), F.round("reciprocity", 6).alias("reciprocity"), F.round("volume", 2).alias("volume"))


LEAST_EDGE = 90_000  # what an edge of the cycle search carries at least: the filter that the search takes as a parameter
_PLAIN = plain_name_sql
RESOLVED_SQL = f"""NM AS (SELECT DISTINCT counterparty_merged AS name FROM transactions WHERE counterparty_merged IS NOT NULL), XA AS (SELECT NM.name, min(entity_id) AS is_ FROM NM JOIN entities e ON e.entity_name = NM.name GROUP BY 1),
 XR AS (SELECT name, {_PLAIN('name')} AS p FROM NM WHERE name NOT IN (SELECT name FROM XA)), XN AS (SELECT XR.name, min(entity_id) AS is_ FROM XR JOIN entities e ON {_PLAIN('e.entity_name')} = XR.p WHERE XR.p <> '' GROUP BY 1), RS AS (SELECT * FROM XA UNION ALL SELECT * FROM XN),
 TR AS (SELECT 'entity_' || entity_id AS own, CASE WHEN is_ IS NOT NULL THEN 'entity_' || is_ ELSE 'external_' || trim(counterparty_merged) END AS other, direction, CAST(amount AS DOUBLE) AS amount, created_at AS d, transaction_id FROM transactions t LEFT JOIN RS ON RS.name = t.counterparty_merged WHERE entity_id IS NOT NULL AND trim(coalesce(counterparty_merged, '')) <> ''),
 RR AS (SELECT CASE WHEN direction = 'DR' THEN own ELSE other END AS src, CASE WHEN direction = 'DR' THEN other ELSE own END AS dst, amount, d, transaction_id FROM TR WHERE own <> other),
 RE AS (SELECT src, dst, sum(amount) AS total, count(*) AS n, arg_max(amount, (d, transaction_id)) AS last_amount, max(d) AS last_at FROM RR GROUP BY 1, 2)"""


def resolved_rows(spark, folder, alike: bool = False) -> DataFrame:
    """The store's rows as movements between entities and outsiders; counterparties are resolved by equal and plain names, by likeness if asked for."""
    t = table(spark, folder, "transactions")
    r = resolve.resolved(t.select(F.col("counterparty_merged").alias("name")), table(spark, folder, "entities"))
    led = t.select("transaction_id", "entity_id", F.coalesce("counterparty_merged", F.lit("")).alias("counterparty"), "direction", F.col("amount").cast("double").alias("amount"), F.col("created_at").alias("DATE"))
    return graph.resolved_rows(led, r if alike else r.where("how <> 'alike'"))


def large_edges(spark, folder) -> DataFrame:
    """The edges of LEAST_EDGE or more of the resolved network."""
    from ledgerloom.session import stored

    return stored(graph.folded(resolved_rows(spark, folder)).where(F.col("total") >= LEAST_EDGE), "edges")


@query(f"WITH {RESOLVED_SQL} SELECT src, dst, round(total, 2) AS total, n FROM RE")
def g01_resolved_edges(spark, folder):
    """The network of entities and outsiders, counterparties resolved by equal and plain names."""
    return graph.folded(resolved_rows(spark, folder)).select("src", "dst", F.round("total", 2).alias("total"), "n")


@query()
def g01_alike_edges(spark, folder):
    """The same network, names resolved by likeness too."""
    return graph.folded(resolved_rows(spark, folder, alike=True)).select("src", "dst", F.round("total", 2).alias("total"), "n")


CYCLES_SQL = f"""WITH RECURSIVE {RESOLVED_SQL}, F AS (SELECT * FROM RE WHERE total >= {LEAST_EDGE}), P(s0, path, here, k) AS (SELECT src, [src, dst], dst, 2 FROM F WHERE dst > src UNION ALL SELECT s0, list_append(path, dst), dst, k + 1 FROM P JOIN F ON F.src = P.here WHERE k < 10 AND dst > s0 AND NOT list_contains(path, dst)),
 CY AS (SELECT path, k AS length FROM P JOIN F ON F.src = P.here AND F.dst = P.s0 WHERE k >= 3)"""


@query(CYCLES_SQL + " SELECT array_to_string(path, '>') AS path, length FROM CY")
def g02_cycles(spark, folder):
    """The cycles of three to ten nodes over the large edges of the resolved network."""
    return graph.cycles(large_edges(spark, folder), 3, 10).select(F.array_join("path", ">").alias("path"), "length")


@query(CYCLES_SQL + f""", LG AS (SELECT array_to_string(path, '>') AS id, length, i, path[i] AS src, path[CASE WHEN i = length THEN 1 ELSE i + 1 END] AS dst FROM (SELECT path, length, unnest(generate_series(1, length)) AS i FROM CY)),
 G AS (SELECT id, any_value(length) AS length, sum(last_amount) AS total, (epoch_us(max(last_at)) - epoch_us(min(last_at))) // 86400000000 AS days, arg_max(last_amount, i) - arg_min(last_amount, i) AS net, coalesce(var_samp(last_amount), 0.0) AS v, avg(last_amount) AS m FROM LG JOIN F USING (src, dst) GROUP BY 1)
 SELECT id AS path, length, round(total, 2) AS total, days, round(net, 2) AS net, round(greatest(0.0, least(1.0, (1 - abs(net) / total) * (1 - CASE WHEN days > 30 THEN least(0.5, days / 365.0) ELSE 0 END) * (1 - CASE WHEN length > 3 THEN least(0.2, (length - 3) * 0.05) ELSE 0 END) * (1 + 0.2 * greatest(0.0, 1 - v / (m * m))))), 4) AS confidence FROM G WHERE days <= 365 AND abs(net) / total <= 0.5""")
def g03_g09_cycle_scores(spark, folder):
    """Totals, days, net flow and confidence of these cycles, those within a year and a net flow of half their total."""
    e = large_edges(spark, folder)
    c = graph.cycle_scores(graph.cycles(e, 3, 10), e, net_limit=0.5)
    return c.select("path", "length", F.round("total", 2).alias("total"), "days", F.round("net", 2).alias("net"), F.round("confidence", 4).alias("confidence"))


@query()
def g06_g08_cycle_kinds(spark, folder):
    """AML confidence and kind of these cycles; hubs are nodes of which a tenth of all nodes or more are neighbours, or with a rank of 0.1 or more."""
    e = large_edges(spark, folder)
    n = graph.nodes(e)
    hubs = n.where("centrality >= 0.1").select("node").union(graph.page_rank(e).where("rank >= 0.1").select("node"))
    c = graph.cycle_scores(graph.cycles(e, 3, 10), e, hubs, net_limit=0.5)
    return c.select("path", "length", F.round("aml_confidence", 4).alias("aml_confidence"), "kind")


@query(CYCLES_SQL + " SELECT length, count(*) AS cycles FROM CY GROUP BY 1")
def a23_cycle_lengths(spark, folder):
    """How many cycles there are of each true length."""
    return graph.cycles(large_edges(spark, folder), 3, 10).groupBy("length").agg(F.count("*").alias("cycles"))


@query("""{E}, g AS (SELECT src, avg(CASE WHEN amount >= 8000 AND amount < 10000 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN amount >= 4000 AND amount < 5000 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN amount >= 2400 AND amount < 3000 THEN 1.0 ELSE 0.0 END) AS c, avg(CASE WHEN amount % 100 = 0 THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n FROM R GROUP BY 1),
 q AS (SELECT src, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS k FROM (SELECT src, amount, count(*) AS k FROM R GROUP BY 1, 2) GROUP BY 1) SELECT src, round(CAST(least(1.0, (a + b + c) * 0.5 + CASE WHEN r > 0.7 THEN 0.3 ELSE 0 END + least(0.4, k * 1.0 / n)) AS DOUBLE), 4) AS score FROM g JOIN q USING (src)""")
def g07_structuring(spark, folder):
    return graph.structuring(event_rows(spark, folder)).withColumn("score", F.round("score", 4))


@query("""{E}, t AS (SELECT src, dst, sum(amount) AS s, min(amount) AS m FROM R GROUP BY 1, 2), h AS (SELECT src FROM t GROUP BY 1 HAVING count(*) >= 3), g AS (SELECT src, count(*) AS targets, avg(s) AS mean, coalesce(stddev_samp(s), 0.0) AS sd FROM t WHERE m < 10000 AND s < 50000 AND src IN (SELECT src FROM h) GROUP BY 1 HAVING count(*) >= 3)
 SELECT src, targets, round(mean, 3) AS mean, round(greatest(0.0, 1 - sd / mean), 4) AS coordination FROM g""")
def g20_g21_smurfing(spark, folder):
    return graph.smurfing(event_rows(spark, folder)).select("src", "targets", F.round("mean", 3).alias("mean"), F.round("coordination", 4).alias("coordination"))


@query()
def g13_page_rank(spark, folder):
    return graph.page_rank(graph.edges(event_ledger(spark, folder)))


#: Labels spread from each node to all it reaches, both ways; UNION drops what was reached before.
REACH = """WITH RECURSIVE {E_}, U AS (SELECT src AS a, dst AS b FROM E UNION SELECT dst, src FROM E), C(node, label) AS (SELECT a, a FROM U UNION SELECT U.b, C.label FROM C JOIN U ON U.a = C.node WHERE C.label < U.b), K AS (SELECT node, min(label) AS component FROM C GROUP BY 1)""".replace("{E_}", E_SQL)


@query(REACH + " SELECT count(*) AS nodes, count(DISTINCT component) AS components FROM K", "g15_component_count")
def _wcc_count(spark, folder):
    c = graph.components(graph.edges(event_ledger(spark, folder)))
    return c.agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))


@query(REACH + " SELECT node, component FROM K")
def g15_components(spark, folder):
    return graph.components(graph.edges(event_ledger(spark, folder)))


@query("""{E}, o AS (SELECT total AS x, row_number() OVER (ORDER BY total) AS i, count(*) OVER () AS n FROM E) SELECT max(n) AS n, round(sum(x), 2) AS total, round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n), 6) AS concentration FROM o""")
def a24_concentration(spark, folder):
    c = graph.concentration(graph.edges(event_ledger(spark, folder)), "total")
    return c.select("n", F.round("total", 2).alias("total"), F.round("concentration", 6).alias("concentration"))


WEEK = 7 * 86_400_000_000
FLOW_SQL = """WITH V AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_orderkey AS ok, epoch_us(l_shipdate) AS t, CASE WHEN l_returnflag = 'R' THEN 'S' || l_suppkey ELSE 'C' || o_custkey END AS source, CASE WHEN l_returnflag = 'R' THEN 'C' || o_custkey ELSE 'S' || l_suppkey END AS target, l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice >= {T}),
 J AS (SELECT a.id AS a, b.id AS b, a.target AS node, a.source AS a_source, b.target AS b_target FROM V a JOIN V b ON a.target = b.source AND a.id <> b.id AND b.t - a.t BETWEEN 0 AND 604800000000)"""
LEAST_FLOW = 0


def order_flows(spark, folder, least: float = LEAST_FLOW) -> DataFrame:
    """id, ok, t, source, target, amount: order lines as payments from customer to supplier, returned ones the other way; amounts of ``least`` or more (the event filter; all by default)."""
    li = table(spark, folder, "lineitem").where(F.col("l_extendedprice") >= least).join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    s, c = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    back = F.col("l_returnflag") == "R"
    return li.select(line_key().alias("id"), F.col("l_orderkey").alias("ok"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t"), F.when(back, s).otherwise(c).alias("source"), F.when(back, c).otherwise(s).alias("target"), F.col("l_extendedprice").alias("amount"))


@query(FLOW_SQL.replace("{T}", str(LEAST_FLOW)) + " SELECT a, b, node FROM J")
def j13_adjacency(spark, folder):
    return flows.adjacency(order_flows(spark, folder), WEEK).select("a", "b", "node")


@query(FLOW_SQL.replace("{T}", str(LEAST_FLOW)) + """, s AS (SELECT a AS id, count(*) AS n, count(DISTINCT b_target) AS k FROM J GROUP BY 1), m AS (SELECT b AS id, count(*) AS n, count(DISTINCT a_source) AS k FROM J GROUP BY 1)
 SELECT coalesce(s.id, m.id) AS id, coalesce(s.n > 1 AND s.k > 1, false) AS splits, coalesce(m.n > 1 AND m.k > 1, false) AS merges FROM s FULL JOIN m ON s.id = m.id""")
def g25_branches(spark, folder):
    return flows.branches(flows.adjacency(order_flows(spark, folder), WEEK))


@query(FLOW_SQL.replace("{T}", str(LEAST_FLOW)) + """, c AS (SELECT *, ok // 100 AS g FROM V), k AS (SELECT *, CASE WHEN lag(target) OVER w IS NULL OR lag(target) OVER w <> source OR t - lag(t) OVER w > 604800000000 THEN 1 ELSE 0 END AS brk FROM c WINDOW w AS (PARTITION BY g ORDER BY t, id)),
 r AS (SELECT *, sum(brk) OVER (PARTITION BY g ORDER BY t, id) AS run FROM k) SELECT g AS grp, run, count(*) AS events, round(sum(amount), 2) AS total FROM r GROUP BY 1, 2 HAVING count(*) >= 2""")
def w09_runs(spark, folder):
    ev = order_flows(spark, folder).withColumn("grp", F.floor(F.col("ok") / 100))
    return flows.runs(ev, WEEK, "grp").select("grp", "run", "events", F.round("total", 2).alias("total"))


@query()
def g24_t03_chains(spark, folder):
    return flows.chains(order_flows(spark, folder), WEEK)


@query()
def g26_t04_hubs(spark, folder):
    from ledgerloom.session import stored

    ev = stored(order_flows(spark, folder), "flows")
    return flows.hubs(stored(flows.chains(ev, WEEK), "chains"), ev)


@query("{E} SELECT src, dst, round(total / max(total) OVER (), 6) AS width FROM E")
def g30_scaled(spark, folder):
    e = graph.edges(event_ledger(spark, folder))
    most = e.agg(F.max("total").alias("m"))
    return e.crossJoin(F.broadcast(most)).select("src", "dst", F.round(F.col("total") / F.col("m"), 6).alias("width"))  # one row
