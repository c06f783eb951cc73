"""Path-based measures of small networks, anomaly scores, and clusters of times.

Shortest paths between all pairs take (nodes x edges) work and as many rows as reachable pairs: these are for networks of
entities under inquiry, not for a bank's whole ledger. ``most_nodes`` makes that bound a parameter; beyond it an error says so.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stored


def shortest_paths(e: DataFrame, most_nodes: int = 2000) -> DataFrame:
    """s, t, d, ways: length and number of shortest directed paths of all reachable pairs, a level a round."""
    hop = stored(e.where("src <> dst").select("src", "dst").distinct(), "hops")
    n = hop.select("src").union(hop.select("dst")).distinct().count()
    if n > most_nodes:
        raise ValueError(f"{n} nodes; all-pairs paths are bounded to {most_nodes}")
    level = hop.select(F.col("src").alias("s"), F.col("dst").alias("t"), F.lit(1).alias("d"), F.lit(1.0).alias("ways"))
    seen = stored(level, "paths")
    front = seen
    for d in range(2, n + 1):
        step = front.join(hop, front.t == hop.src).where("s <> dst").groupBy("s", F.col("dst").alias("t")).agg(F.sum("ways").alias("ways"))
        front = stored(step.join(seen.select("s", "t"), ["s", "t"], "left_anti").select("s", "t", F.lit(d).alias("d"), "ways"), "front")
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front), "paths")
    return seen


def centralities(e: DataFrame, most_nodes: int = 2000) -> DataFrame:
    """node, betweenness (directed, over (n - 1)(n - 2)) and closeness (incoming distances, scaled by the share of nodes that reach it)."""
    p = shortest_paths(e, most_nodes)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    n = nodes.count()
    x = p.select("s", F.col("t").alias("v"), F.col("d").alias("d1"), F.col("ways").alias("w1"))
    y = p.select(F.col("s").alias("v"), "t", F.col("d").alias("d2"), F.col("ways").alias("w2"))
    through = x.join(y, "v").where("s <> t").join(p, ["s", "t"]).where("d1 + d2 = d")
    b = through.groupBy("v").agg((F.sum(F.col("w1") * F.col("w2") / F.col("ways")) / max(1, (n - 1) * (n - 2))).alias("betweenness"))
    c = p.groupBy(F.col("t").alias("v")).agg(F.count("*").alias("k"), F.sum("d").alias("total"))
    c = c.select("v", (F.col("k") / F.col("total") * F.col("k") / max(1, n - 1)).alias("closeness"))
    j = nodes.withColumnRenamed("node", "v").join(b, "v", "left").join(c, "v", "left")
    return j.select(F.col("v").alias("node"), F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.coalesce("closeness", F.lit(0.0)).alias("closeness"))


def hubs(measures: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The nodes with a betweenness or rank of ``threshold`` or more, or with as many edges as that share of the nodes, and their weight.

    measures: node, betweenness, rank, degree (edges in and out). The weight is 0.4 betweenness, 0.3 degree (over the nodes but one) and 0.2 rank.
    """
    count = measures.agg(F.count("*").alias("_n"))
    m = measures.crossJoin(F.broadcast(count))  # one row
    hit = (F.col("betweenness") >= threshold) | (F.col("rank") >= threshold) | (F.col("degree") >= F.col("_n") * threshold)
    return m.where(hit).withColumn("weight", 0.4 * F.col("betweenness") + 0.3 * F.coalesce(F.try_divide("degree", F.col("_n") - 1), F.lit(0.0)) + 0.2 * F.col("rank")).drop("_n")


def anomalies(nodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """node, score: half its centrality, 0.3 the share of cycles it is in, 0.2 its share of volume, cut at 1.

    nodes: node, centrality, in_total, out_total. cycles: path (array of nodes). Volumes are those of the edges.
    """
    total = nodes.agg(F.sum(F.col("in_total") + F.col("out_total")).alias("all"))
    count = cycles.agg(F.count("*").alias("cycles"))
    part = cycles.select(F.explode("path").alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    j = nodes.join(part, "node", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(count))  # one row each
    score = 0.5 * F.col("centrality") + 0.3 * F.coalesce(F.try_divide("k", "cycles"), F.lit(0.0)) + 0.2 * F.coalesce(F.try_divide(F.col("in_total") + F.col("out_total"), F.col("all")), F.lit(0.0))
    return j.select("node", F.least(F.lit(1.0), score).alias("score"))


def same_hour(times: DataFrame, by: str, at: str) -> DataFrame:
    """by, hour, n: hours in which more than one of a group's times fall."""
    return times.groupBy(by, F.date_trunc("hour", at).alias("hour")).agg(F.count("*").alias("n")).where("n > 1")


def bursts(times: DataFrame, by: str, at: str, hours: float = 24, least: int = 3) -> DataFrame:
    """by, start, n of greedy windows: from a time on, all within ``hours``; kept with max(least, a tenth of the group) times or more.

    A kept window ends where the next begins; otherwise the next time starts one.
    """
    span = int(hours * 3_600_000_000)
    t = times.where(F.col(at).isNotNull()).select(by, F.unix_micros(at).alias("t"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["t"].sort_values().to_numpy()
        need, i, out = max(least, len(v) // 10), 0, []
        while i < len(v):
            j = int(v.searchsorted(v[i] + span, side="right"))
            if j - i >= need:
                out.append((pdf[by].iloc[0], int(v[i]), j - i))
                i = j
            else:
                i += 1
        return pd.DataFrame(out, columns=[by, "start", "n"])

    return t.groupBy(by).applyInPandas(run, f"{by} {dict(t.dtypes)[by]}, start long, n long")


def severity(score: str) -> Column:
    """high from 0.9, medium from 0.7, low from 0.5, else info."""
    c = F.col(score)
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").when(c >= 0.5, "low").otherwise("info")
