"""Transaction networks: edges and nodes, degrees, bounded cycles, components, ranks, hubs, smurfing.

Iterations are joins of edges with a table of nodes, written to the shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import released, stored


def edges(ledger: DataFrame, entity: str = "entity_id") -> DataFrame:
    """src, dst, total, n, first_at, last_at, last_amount: a debit goes from the entity to its counterparty, any other row comes from it.

    Entities are named ``entity_<id>`` and counterparties ``external_<name>``; rows without a counterparty are left out.
    """
    own, other = F.concat(F.lit("entity_"), F.col(entity).cast("string")), F.concat(F.lit("external_"), F.trim("counterparty"))
    out = F.col("direction") == "DR"
    rows = ledger.where(F.trim("counterparty") != "").select(F.when(out, own).otherwise(other).alias("src"), F.when(out, other).otherwise(own).alias("dst"), "amount", "DATE", "transaction_id")
    return folded(rows)


def resolved_rows(ledger: DataFrame, resolved: DataFrame) -> DataFrame:
    """src, dst, amount, DATE, transaction_id: as ``edges`` names them, but a counterparty that is resolved (name, entity_id) is that
    entity's node, so that entities are linked with each other; a row from an entity to itself is left out."""
    own = F.concat(F.lit("entity_"), F.col("entity_id").cast("string"))
    rows = ledger.where("entity_id is not null").where(F.trim("counterparty") != "")
    met = rows.join(resolved.select(F.col("name").alias("counterparty"), F.col("entity_id").alias("_is")), "counterparty", "left")
    other = F.when(F.col("_is").isNotNull(), F.concat(F.lit("entity_"), F.col("_is"))).otherwise(F.concat(F.lit("external_"), F.trim("counterparty")))
    out = F.col("direction") == "DR"
    return met.select(F.when(out, own).otherwise(other).alias("src"), F.when(out, other).otherwise(own).alias("dst"), "amount", "DATE", "transaction_id").where("src <> dst")


def folded(rows: DataFrame) -> DataFrame:
    """Edges of rows (src, dst, amount, DATE, transaction_id); the last amount is that of the latest row, of equal times of the largest id."""
    return rows.groupBy("src", "dst").agg(F.sum("amount").alias("total"), F.count("*").alias("n"), F.min("DATE").alias("first_at"), F.max("DATE").alias("last_at"), F.max_by("amount", F.struct("DATE", "transaction_id")).alias("last_amount"))


def nodes(e: DataFrame) -> DataFrame:
    """node, in_total, out_total, in_degree, out_degree and degree centrality (degree / (nodes - 1))."""
    both = e.select(F.col("src").alias("node"), F.lit(0.0).alias("i"), F.col("total").alias("o"), F.lit(0).alias("di"), F.lit(1).alias("do")).unionAll(e.select(F.col("dst"), F.col("total"), F.lit(0.0), F.lit(1), F.lit(0)))
    g = both.groupBy("node").agg(F.sum("i").alias("in_total"), F.sum("o").alias("out_total"), F.sum("di").alias("in_degree"), F.sum("do").alias("out_degree"))
    count = g.agg(F.count("*").alias("_n"))
    return g.crossJoin(F.broadcast(count)).withColumn("centrality", F.try_divide(F.col("in_degree") + F.col("out_degree"), F.col("_n") - 1)).drop("_n")  # one row


def overview(e: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, reciprocity (share of edges whose reverse is there), volume."""
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    two = e.join(back, ["src", "dst"], "left_semi").agg(F.count("*").alias("two"))
    g = e.agg(F.count("*").alias("edges"), F.sum("total").alias("volume"))
    n = e.select("src").union(e.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    j = g.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(n))  # one row each
    return j.select("nodes", "edges", F.try_divide("edges", F.col("nodes") * (F.col("nodes") - 1)).alias("density"), F.try_divide("two", "edges").alias("reciprocity"), "volume")


def cycles(e: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    """path (the node names, the least first), length: the simple cycles of ``least`` to ``most`` nodes.

    A cycle is found once, from its least node: paths grow only over nodes greater than their start and never twice over
    one node, so the bound on length bounds the work, unlike an enumeration that is cut afterwards.
    """
    hop = e.where("src <> dst").select("src", "dst").distinct()
    start = hop.where("dst > src").select(F.col("src").alias("start"), F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    out = None
    level = start
    for k in range(2, most + 1):
        step = level.join(hop.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at")
        if k >= least:
            done = step.where("next = start").select("path", F.lit(k).alias("length"))
            out = done if out is None else out.unionAll(done)
        if k < most:
            level = stored(step.where("next > start").where(~F.array_contains("path", F.col("next"))).select("start", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("at")), "paths")
    return out


def cycle_scores(found: DataFrame, e: DataFrame, hubs: DataFrame | None = None, least_amount: float = 0.0, most_days: int = 365, net_limit: float = 0.1) -> DataFrame:
    """path, length, total, days, net, confidence, aml_confidence and kind of the cycles that pass, from the latest row of each edge.

    Net flow is that of the first (least) node: its last edge in minus its first edge out, so it doesn't depend on where a
    cycle is entered. Confidence falls with net flow, with a duration above 30 days and a length above three, and rises
    with the evenness of amounts. The AML confidence weighs how round the trip is, its pace, structuring of its amounts, its
    length and the evenness of amounts by 0.30, 0.25, 0.20, 0.15 and 0.10. Kind: simple for two nodes; up to four hub-mediated if one of the
    ``hubs`` (node) is on the path, else complex, and complex beyond. Passes: total of ``least_amount`` or more, ``most_days`` or fewer,
    |net| / total within ``net_limit``.
    """
    c = found.withColumn("id", F.array_join("path", ">"))
    legs = c.select("id", "length", F.posexplode("path").alias("k", "src"), "path").withColumn("dst", F.element_at("path", (F.pmod(F.col("k") + 1, F.col("length")) + 1).cast("int"))).drop("path")
    legs = legs.join(e.select("src", "dst", "last_amount", "last_at"), ["src", "dst"])
    mark = F.lit(0) if hubs is None else F.coalesce("_hub", F.lit(0))
    if hubs is not None:
        legs = legs.join(hubs.select(F.col("node").alias("src"), F.lit(1).alias("_hub")).distinct(), "src", "left")
    x = F.col("last_amount")
    near = [F.sum(((x >= 0.8 * t) & (x < t)).cast("int")).alias(f"near{t}") for t in (10_000, 5_000, 3_000)]
    g = legs.groupBy("id", "length").agg(
        F.sum(x).alias("total"), F.min("last_at").alias("t0"), F.max("last_at").alias("t1"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"), F.avg(x).alias("m"),
        (F.max_by("last_amount", "k") - F.min_by("last_amount", "k")).alias("net"), F.max(mark).alias("hub"), *near,
        F.sum((F.pmod(x, F.lit(100.0)) == 0).cast("int")).alias("round"), F.countDistinct("last_amount").alias("different"), F.collect_list("last_amount").alias("amounts"),
    )
    days = F.floor((F.unix_micros("t1") - F.unix_micros("t0")) / 86_400_000_000)
    share = F.abs(F.col("net")) / F.col("total")
    long = F.when(days > 30, F.least(F.lit(0.5), days / 365)).otherwise(0.0)
    many = F.when(F.col("length") > 3, F.least(F.lit(0.2), (F.col("length") - 3) * 0.05)).otherwise(0.0)
    even = 1 + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("v") / (F.col("m") * F.col("m")))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - share) * (1 - long) * (1 - many) * even))
    # an edge has one latest amount and a path few edges: repeats are counted within the row
    repeats = F.size(F.filter(F.array_distinct("amounts"), lambda a: F.size(F.filter("amounts", lambda b: b == a)) > 1))
    n = F.col("length")
    structuring = F.least(F.lit(1.0), sum((F.col(f"near{t}") / n * 0.5 for t in (10_000, 5_000, 3_000)), F.lit(0.0)) + F.when(F.col("round") > n * 0.7, 0.3).otherwise(0.0) + F.least(F.lit(0.4), repeats / n))
    pace = F.when(days <= 1, 1.0).when(days <= 7, 0.8).when(days <= 30, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - days / 365))
    tangle = F.when(n == 2, 0.3).when(n <= 4, 1.0).when(n <= 6, 0.7).otherwise(0.4)
    steady = F.greatest(F.lit(0.0), 1 - F.sqrt("v") / F.col("m"))
    aml = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - 2 * share) * 0.30 + pace * 0.25 + structuring * 0.20 + tangle * 0.15 + steady * 0.10)
    kind = F.when(n == 2, "simple").when((n <= 4) & (F.col("hub") == 1), "hub-mediated").otherwise("complex")
    out = g.select(F.col("id").alias("path"), "length", "total", days.alias("days"), "net", confidence.alias("confidence"), aml.alias("aml_confidence"), kind.alias("kind"), share.alias("net_share"))
    return out.where((F.col("total") >= least_amount) & (F.col("days") <= most_days) & (F.col("net_share") <= net_limit)).drop("net_share")


def page_rank(e: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node, rank after a fixed number of rounds; the rank of nodes without edges out is spread over all."""
    hop = stored(e.select("src", "dst").distinct(), "hops")
    all_nodes = stored(hop.select(F.col("src").alias("node")).union(hop.select("dst")).distinct(), "nodes")
    out = hop.groupBy("src").agg(F.count("*").alias("k"))
    n = all_nodes.count()
    if not n:
        return all_nodes.withColumn("rank", F.lit(1.0))
    rank = all_nodes.withColumn("rank", F.lit(1.0 / n))
    for r in range(rounds):
        given = rank.join(out, rank.node == out.src, "left")
        dangling = given.where("k is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        gain = given.where("k is not null").select("src", (F.col("rank") / F.col("k")).alias("part")).join(hop, "src").groupBy("dst").agg(F.sum("part").alias("gain"))
        rank = all_nodes.join(gain, all_nodes.node == gain.dst, "left").crossJoin(F.broadcast(dangling)).select("node", ((1 - damping) / n + damping * (F.coalesce("gain", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))  # one row
        rank = stored(rank, "rank") if r % 5 == 4 else rank
    return rank


def components(e: DataFrame) -> DataFrame:
    """node, component: the least node of its weakly connected component, by the least label of neighbours and the label's own, until none changes."""
    both = stored(e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select("dst", "src")).distinct(), "both")
    label = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    after = label
    while True:
        least = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("c"))
        step = label.join(least, label.node == least.a).select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("cc"))
        before, after = after, stored(step.join(jump, "component", "left").select("node", "old", F.coalesce("cc", "component").alias("component")), "component")
        released(before)
        label = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return label


def smurfing(rows: DataFrame, least_targets: int = 3, amount: float = 10_000, total: float = 50_000) -> DataFrame:
    """src, targets, mean and coordination (1 - variation of target sums) of hubs that pay small sums to several targets.

    rows: src, dst, amount, DATE. A target counts if a payment to it is below ``amount`` and all of them together below ``total``.
    """
    t = rows.groupBy("src", "dst").agg(F.sum("amount").alias("s"), F.min("amount").alias("least"), F.count("*").alias("k"))
    hubs = t.groupBy("src").agg(F.count("*").alias("out")).where(F.col("out") >= 3)
    c = t.where((F.col("least") < amount) & (F.col("s") < total)).join(hubs.select("src"), "src", "left_semi")
    g = c.groupBy("src").agg(F.count("*").alias("targets"), F.avg("s").alias("mean"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("sd"))
    return g.where(F.col("targets") >= least_targets).select("src", "targets", "mean", F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean")).alias("coordination"))


def structuring(rows: DataFrame, by: str = "src", thresholds: tuple[int, ...] = (10_000, 5_000, 3_000)) -> DataFrame:
    """The share of amounts just below a threshold (half weighted), round amounts above 70 % and how many amounts repeat, cut at 1."""
    near = [F.avg(((F.col("amount") >= 0.8 * t) & (F.col("amount") < t)).cast("double")).alias(f"s{t}") for t in thresholds]
    g = rows.groupBy(by).agg(*near, F.avg((F.pmod("amount", F.lit(100.0)) == 0).cast("double")).alias("r"), F.count("*").alias("n"))
    repeat = rows.groupBy(by, "amount").agg(F.count("*").alias("k")).groupBy(by).agg(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("repeated"))
    score = sum((F.col(f"s{t}") * 0.5 for t in thresholds), F.lit(0.0)) + F.when(F.col("r") > 0.7, 0.3).otherwise(0.0) + F.least(F.lit(0.4), F.col("repeated") / F.col("n"))
    return g.join(repeat, by).select(by, F.least(F.lit(1.0), score).alias("score"))


def concentration(values: DataFrame, column: str) -> DataFrame:
    """The Gini-style concentration of a column: 2 sum(i x) / (n sum(x)) - (n + 1) / n over values in order.

    Ranks come from counts below each distinct value, so the sorted column is never in one task: equal values share the mean rank.
    """
    v = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("k"))
    b = v.withColumn("b", F.floor(F.log2(F.greatest(F.abs("x"), F.lit(1e-9)))).cast("int"))  # buckets in the order of size
    sums = b.groupBy("b").agg(F.sum("k").alias("bk"))
    before = sums.withColumn("below", F.coalesce(F.sum("bk").over(W.partitionBy().orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # some hundred rows
    r = b.join(F.broadcast(before.select("b", "below")), "b").withColumn("c", F.col("below") + F.sum("k").over(W.partitionBy("b").orderBy("x")))
    mean_rank = F.col("c") - (F.col("k") - 1) / 2
    g = r.agg(F.sum("k").alias("n"), F.sum(F.col("x") * F.col("k")).alias("s"), F.sum(mean_rank * F.col("x") * F.col("k")).alias("w"))
    return g.select("n", F.col("s").alias("total"), (2 * F.try_divide("w", F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("concentration"))


def scaled(c: str | Column) -> Column:
    """A column over its largest value: for node and edge sizes."""
    return F.try_divide(c, F.max(c).over(W.partitionBy()))
