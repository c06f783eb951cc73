"""Chronological flows: adjacent events, runs, chains with a beam, branch points and hubs.

Events: id, t (micros), source, target, amount.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import stored


def adjacency(events: DataFrame, gap: int) -> DataFrame:
    """a, b: events where b starts at a's target within ``gap`` micros after a (the same moment included); equal ids don't pair."""
    lo = F.floor(F.col("t") / gap)
    a = events.select(F.col("id").alias("a"), F.col("target").alias("node"), F.col("t").alias("ta"), F.col("source").alias("a_source"), F.explode(F.array(lo, lo + 1)).alias("bucket"))
    b = events.select(F.col("id").alias("b"), F.col("source").alias("node"), F.col("t").alias("tb"), F.col("target").alias("b_target"), lo.alias("bucket"))
    return a.join(b, ["node", "bucket"]).where((F.col("tb") - F.col("ta")).between(0, gap)).where("a <> b").select("a", "b", "node", "ta", "tb", "a_source", "b_target")


def runs(events: DataFrame, gap: int, by: str) -> DataFrame:
    """by, run, first, events, total: runs of two or more consecutive events, in (t, id) order within ``by``, each starting where the one before ended."""
    w = W.partitionBy(by).orderBy("t", "id")
    breaks = F.coalesce(((F.lag("target").over(w) != F.col("source")) | (F.col("t") - F.lag("t").over(w) > gap)).cast("int"), F.lit(1))
    r = events.withColumn("brk", breaks).withColumn("run", F.sum("brk").over(w))
    return r.groupBy(by, "run").agg(F.min_by("id", F.struct("t", "id")).alias("first"), F.count("*").alias("events"), F.sum("amount").alias("total")).where("events >= 2")


def branches(adjacent: DataFrame) -> DataFrame:
    """id, splits, merges: an event splits if it goes on to several targets, and merges if it comes from several sources."""
    s = adjacent.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("successors"), F.countDistinct("b_target").alias("targets"))
    m = adjacent.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("predecessors"), F.countDistinct("a_source").alias("sources"))
    j = s.join(m, "id", "full").fillna(0)
    return j.select("id", ((F.col("successors") > 1) & (F.col("targets") > 1)).alias("splits"), ((F.col("predecessors") > 1) & (F.col("sources") > 1)).alias("merges"))


def chains(events: DataFrame, gap: int, most: int | None = None, beam: int = 8) -> DataFrame:
    """path (event ids joined), events, total, start, end: chains of two or more events, at most ``most`` if given; at each length the ``beam`` best a last event are kept.

    Best: the larger total, then the smaller path. The beam bounds the work; it is the operator's documented feature. No
    event comes twice in a chain, so chains of events of the same moment end too, and lengths go on until none is left.
    """
    adj = stored(adjacency(events, gap).select("a", "b"), "adjacent")
    e = events.select("id", "amount", "source", "target")
    level = e.select(F.col("id").cast("string").alias("path"), F.col("id").alias("last"), F.lit(1).alias("events"), F.col("amount").alias("total"), F.col("source").alias("start"), F.col("target").alias("end"))
    out = level.where("false")
    for _ in itertools.count() if most is None else range(most - 1):
        step = level.join(adj, level["last"] == adj["a"]).join(e.select(F.col("id").alias("b"), F.col("amount").alias("x"), F.col("target").alias("to")), "b")
        step = step.where(~F.array_contains(F.split("path", ">"), F.col("b").cast("string")))
        step = step.select(F.concat_ws(">", "path", F.col("b").cast("string")).alias("path"), F.col("b").alias("last"), (F.col("events") + 1).alias("events"), (F.col("total") + F.col("x")).alias("total"), "start", F.col("to").alias("end"))
        level = stored(step.withColumn("r", F.row_number().over(W.partitionBy("last").orderBy(F.desc("total"), "path"))).where(F.col("r") <= beam).drop("r"), "chains")
        if level.isEmpty():
            break
        out = out.unionAll(level)
    return out.withColumn("is_cycle", F.col("start") == F.col("end"))


def hubs(found: DataFrame, events: DataFrame) -> DataFrame:
    """node, chains, passes, in_amount, out_amount, previous, next: inner nodes of chains, which money passes through."""
    c = found.select("path", F.posexplode(F.split("path", ">")).alias("k", "id"))
    e = events.select(F.col("id").cast("string").alias("id"), "source", "target", "amount")
    j = c.join(e, "id")
    nxt = j.select("path", (F.col("k") - 1).alias("k"), F.col("target").alias("next"), F.col("amount").alias("out"))
    p = j.join(nxt, ["path", "k"])
    return p.groupBy(F.col("target").alias("node")).agg(F.countDistinct("path").alias("chains"), F.count("*").alias("passes"), F.sum("amount").alias("in_amount"), F.sum("out").alias("out_amount"), F.countDistinct("source").alias("previous"), F.countDistinct("next").alias("next"))
