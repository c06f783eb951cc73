"""Resolution of counterparty names by rules: normalised equality, edit similarity within a first word, coverage of patterns."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import compared_name, first_word, plain_name, similarity, usable


RUN = 3  # letters of the runs by which names left over meet entities


def ratio_of_blocks(a: str, b: str) -> float:
    """Twice the letters in matching blocks (the longest first, then left and right of it) over the letters of both texts."""
    return SequenceMatcher(None, a, b).ratio()


def resolved(names: DataFrame, entities: DataFrame, least: float = 0.8) -> DataFrame:
    """name, entity_id, how: the entity of the same name, else of the same plain name, else of the plain name that is most alike
    (ratio of matching blocks of ``least`` or more); of several the smallest id. Names without one are left out.

    For the last step only names left over meet entities, by runs of letters (``most_alike``).
    """
    n = names.select("name").where("name is not null").distinct()
    exact = n.join(entities.select(F.col("entity_name").alias("name"), "entity_id"), "name").groupBy("name").agg(F.min("entity_id").alias("entity_id")).withColumn("how", F.lit("exact"))
    rest = n.join(exact.select("name"), "name", "left_anti").withColumn("plain", plain_name(F.col("name"))).where("plain <> ''")
    known = entities.select(plain_name(F.col("entity_name")).alias("plain"), "entity_id").where("plain <> ''")
    plain = rest.join(known, "plain").groupBy("name").agg(F.min("entity_id").alias("entity_id")).withColumn("how", F.lit("plain"))
    left = rest.join(plain.select("name"), "name", "left_anti")
    fuzzy = most_alike(left, known.groupBy("plain").agg(F.min("entity_id").alias("entity_id")), least).withColumn("how", F.lit("alike"))
    return exact.unionByName(plain).unionByName(fuzzy)


def most_alike(left: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """name, entity_id of the known plain name that is most alike to each name's, with a ratio of ``least`` or more.

    Candidates share a run of RUN letters and lengths that such a ratio allows. A ratio of 0.8 leaves texts of eight letters or
    more, with one gap or change in four letters at most, a run of three; a pair whose every third letter differs isn't met.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - RUN + 1)), lambda k: F.col(c).substr(k, F.lit(RUN))))
    a = left.select("name", F.col("plain").alias("p"), F.length("plain").alias("la"), F.explode(grams("plain")).alias("gram"))
    b = known.select(F.col("plain").alias("q"), "entity_id", F.length("plain").alias("lb"), F.explode(grams("plain")).alias("gram"))
    # a ratio of r needs the shorter to have r / (2 - r) of the longer's letters
    near = F.least("la", "lb") >= F.greatest("la", "lb") * (least / (2 - least))
    met = a.join(b, "gram").where(near).groupBy("name", "p", "q").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("shared"))

    @F.pandas_udf("double")
    def score(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([ratio_of_blocks(x, y) for x, y in zip(p, q, strict=True)], dtype="float64")

    scored = met.withColumn("r", score("p", "q")).where(F.col("r") >= least)
    return scored.groupBy("name").agg(F.max_by("entity_id", F.struct("r", F.col("q"))).alias("entity_id"))


def merge_pairs(counts: DataFrame, least: float = 0.95) -> DataFrame:
    """name, target: names to merge into the most frequent one of their first word (of equals the smallest), if similar enough.

    counts: name, n. The target is compared with each name of its group, not each with each.
    """
    g = counts.where("name is not null").withColumn("key", first_word(F.col("name"))).where("key <> ''")
    best = g.groupBy("key").agg(F.count("*").alias("members"), F.max_by("name", F.struct("n", F.xxhash64("name"))).alias("_any"), F.max("n").alias("top"))
    target = g.join(best.where("members > 1").select("key", "top"), "key").where("n = top").groupBy("key").agg(F.min("name").alias("target"))
    j = g.join(target, "key").where("name <> target")
    return j.where(similarity(compared_name(F.col("name")), compared_name(F.col("target"))) >= least).select("name", "target")


def pattern_coverage(texts: DataFrame, patterns: Sequence[str], column: str = "text") -> DataFrame:
    """One row: distinct texts, how many some pattern matches from their start (whatever the case), and the percentage."""
    hit = F.lit(False)
    for p in usable(patterns):
        hit = hit | F.col(column).rlike(f"(?i)^(?:{p})")
    t = texts.select(column).where(F.col(column).isNotNull()).distinct()
    return t.agg(F.count("*").alias("texts"), F.coalesce(F.sum(hit.cast("int")), F.lit(0)).alias("matched")).withColumn("accuracy", F.round(F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("texts")), F.lit(0.0)), 2))
