"""Deduplicating new batches against all history, without reading the history again.

A store in the shared folder keeps, for all that was accepted: a blocking-key table of narrow rows, in files by period of
days; the learned weights of the fields; and a mapping from records to the representative of their cluster, as one small
table for each batch that changed it. A manifest says which files hold which days, so a store can be opened again and a batch
reads only the files whose days its own rows reach. Of those only rows in blocks that the batch holds are shuffled.

Blocks are (account, direction, amount in whole units); within them records are compared if their days are at most REACH
apart. Records equal in all that is compared are one class, made by a partial aggregation before anything is shuffled by block;
its head alone is compared, so a group of copies costs what one record costs in any task, whatever its size. Candidate pairs
are scored field by field (Fellegi-Sunter weights, learned by expectation maximisation over the counts of agreement patterns, a
table of fixed size), and union-find runs over the representatives in the blocks that new links touch; nothing else of the
mapping is read or written.

Records without a readable day fall in no period: they are looked up by balance, reference or text within their block, all
at once and in one pass (``settle``), not batch by batch.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.instants import with_days
from ledgerloom.session import drop_path, fresh_path, get_text, put_text, stored

SPAN = 16  # days a bucket of the key spans
REACH = 4  # days that two records of one movement may lie apart
PERIOD = 64  # days of a file of the key table
BULK = 5_000  # records of a period from which a batch writes it to files of its own; what is fewer shares one
SMALL = 100_000  # distinct blocks that may be broadcast: 8 bytes each, under 1 MB
LEAST = 2_000  # records that an increment holds at least: smaller batches are taken together with those that follow them
MERGE = 16  # batches whose small tables are merged into one
NO_DAY = -(2**31)
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

RECORDS = "id binary, block long, day int, cents long, balance long, text_hash long, ref_hash long, text string, copies long"
SAME = ("block", "day", "cents", "balance", "text_hash", "ref_hash")  # what records of one class share
MEMBERS = "id binary, head binary, block long, pattern int"
LINKS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("block", T.LongType()), T.StructField("pattern", T.IntegerType())])
PAIRS = T.StructType([*LINKS.fields, T.StructField("text_a", T.StringType()), T.StructField("text_b", T.StringType())])
MAPPING = T.StructType([T.StructField("id", T.BinaryType()), T.StructField("rep", T.BinaryType()), T.StructField("block", T.LongType()), T.StructField("batch", T.IntegerType())])

#: Levels of agreement by field, best first; a pattern is one level of each.
LEVELS = {"amount": ("same", "rounded"), "balance": ("same", "rounded", "unknown", "other"), "day": ("same", "next", "near", "unknown"), "text": ("same with reference", "same reference", "same", "similar", "unknown", "open", "other")}
OPEN = LEVELS["text"].index("open")
PATTERNS = 2 * 4 * 4 * 7
COPY = (0, 2)  # the patterns of records equal in all fields, all of them known: links whatever the weights


def packed(key: Column) -> Column:
    """A key in few bytes: 17 for a canonical UUID, else its text behind a mark."""
    return F.when(key.rlike(UUID), F.concat(F.lit(b"\0"), F.unhex(F.replace(key, F.lit("-"), F.lit(""))))).otherwise(F.concat(F.lit(b"\1"), F.encode(key, "utf-8")))


def unpacked(key: Column) -> Column:
    h = F.lower(F.hex(F.substring(key, 2, 16)))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(F.substring(key, 1, 1) == F.lit(b"\0"), uuid).otherwise(F.decode(F.expr("substring(`%s`, 2)" % "_k"), "utf-8"))


def with_key(df: DataFrame, packed_name: str, name: str) -> DataFrame:
    return df.withColumn("_k", F.col(packed_name)).withColumn(name, unpacked(F.col("_k"))).drop("_k", packed_name)


def folded(text: Column) -> Column:
    """A description without case, blanks and separators."""
    return F.upper(F.regexp_replace(text, "[^\\p{L}\\p{N}]", ""))


def records(transactions: DataFrame, statements: DataFrame, *keep: Column) -> DataFrame:
    """The narrow rows of the key table, with the columns to ``keep``. Rows without an account, direction or amount are never linked and left out."""
    t = transactions.where("transaction_id is not null and account_id is not null and direction is not null and amount is not null")
    text = folded(F.col("description"))
    reference = F.regexp_extract("description", r"(\d{8,})", 1)
    cents = lambda c: (F.col(c) * 100).cast("long")
    out = with_days(
        t, statements, packed(F.col("transaction_id")), F.xxhash64("account_id", "direction", F.bround("amount", 0)), cents("amount"), cents("balance"),
        F.when(F.col("description").isNotNull() & (text != ""), F.xxhash64(text)), F.when(reference != "", F.xxhash64(reference)), F.nullif(text, F.lit("")), *keep,
    )
    kept = [F.col(f"_c{7 + k}").alias(f"kept{k}") for k in range(len(keep))]
    return out.select(F.col("_c0").alias("id"), F.col("_c1").alias("block"), F.coalesce(F.unix_date("day"), F.lit(NO_DAY)).alias("day"), F.col("_c2").alias("cents"), F.col("_c3").alias("balance"), F.col("_c4").alias("text_hash"), F.col("_c5").alias("ref_hash"), F.col("_c6").alias("text"), *kept)


def _compare(r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The agreement pattern of each pair of rows (i, j) as one number."""
    ca, cb = r["cents"][i], r["cents"][j]
    amount = np.where(ca == cb, 0, 1)
    ba, bb = r["balance"][i], r["balance"][j]
    none = ~(r["has_balance"][i] & r["has_balance"][j])
    near = (np.abs(ba - bb) < 100) & ((ba % 100 == 0) | (bb % 100 == 0))
    balance = np.where(none, 2, np.where(ba == bb, 0, np.where(near, 1, 3)))
    da, db = r["day"][i], r["day"][j]
    day = np.where((da == NO_DAY) | (db == NO_DAY), 3, np.minimum(np.abs(da - db), 2))
    no_text = ~(r["has_text"][i] & r["has_text"][j])
    same = r["text_hash"][i] == r["text_hash"][j]
    refs = r["has_ref"][i] & r["has_ref"][j]
    same_ref = refs & (r["ref_hash"][i] == r["ref_hash"][j])
    text = np.where(no_text, 4, np.where(same & refs, 0, np.where(same_ref, 1, np.where(same, 2, OPEN))))
    return (((amount * 4 + balance) * 4 + day) * 7 + text).astype(np.int32)


def levels(pattern: int) -> dict[str, int]:
    rest, text = divmod(int(pattern), 7)
    rest, day = divmod(rest, 4)
    amount, balance = divmod(rest, 4)
    return {"amount": amount, "balance": balance, "day": day, "text": text}


def _plausible(pattern: np.ndarray) -> np.ndarray:
    """Pairs worth scoring: amounts equal, or one of them rounded and something else agreeing."""
    amount = pattern // 112
    balance = pattern // 28 % 4
    text = pattern % 7
    return ((amount == 0) & ((balance < 3) | (text <= 1) | (pattern // 7 % 4 != 2))) | (balance == 0) | (text <= 1)


def _fields(t: pa.Table) -> dict[str, np.ndarray]:
    out = {n: t.column(n).to_numpy() for n in ("block", "bucket", "day", "cents")}
    for n, has in (("balance", "has_balance"), ("text_hash", "has_text"), ("ref_hash", "has_ref")):
        col = t.column(n)
        out[has] = col.is_valid().to_numpy()
        out[n] = col.fill_null(0).to_numpy()
    out["new"] = t.column("new").to_numpy(zero_copy_only=False)
    return out


def _pairs(t: pa.Table) -> pa.RecordBatch:
    """The candidate pairs of whole groups of (block, bucket), sorted by them, then by day and values.

    A pair counts in the bucket of its later day alone, which both rows enter, so it is found once.
    """
    n = t.num_rows
    r = _fields(t)
    same = np.zeros(n, bool)
    same[1:] = (r["block"][1:] == r["block"][:-1]) & (r["bucket"][1:] == r["bucket"][:-1])
    group = np.cumsum(~same)
    left, right = [], []
    step, alive = 1, np.arange(n)
    while True:
        alive = alive[alive + step < n]
        j = alive + step
        near = (group[alive] == group[j]) & (r["day"][j] - r["day"][alive] <= REACH)
        # rows are sorted by day: once the next day is further than REACH away, no later row is nearer
        alive, j = alive[near], j[near]
        if not len(alive):
            break
        ok = (r["new"][alive] | r["new"][j]) & (r["day"][j] // SPAN == r["bucket"][j])
        left.append(alive[ok])
        right.append(j[ok])
        step += 1
    i, j = np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
    pattern = _compare(r, i, j)
    keep = _plausible(pattern)
    i, j, pattern = pa.array(i[keep]), pa.array(j[keep]), pattern[keep]
    open_ = pa.array(pattern % 7 == OPEN)
    ids, texts, none = t.column("id").combine_chunks(), t.column("text").combine_chunks(), pa.scalar(None, pa.string())
    told = [pc.if_else(open_, texts.take(k), none) for k in (i, j)]
    return pa.RecordBatch.from_arrays([ids.take(i), ids.take(j), pa.array(r["block"][np.asarray(i)]), pa.array(pattern), *told], PAIRS.names)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of batches sorted by group, whose last group may go on in the next batch."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        t = pa.Table.from_batches([*kept, b])
        block, bucket = t.column("block").to_numpy(), t.column("bucket").to_numpy()
        inside = np.flatnonzero((block != block[-1]) | (bucket != bucket[-1]))
        cut = int(inside[-1]) + 1 if len(inside) else 0
        if cut:
            yield _pairs(t.slice(0, cut))
        kept = t.slice(cut).to_batches()
    if kept:
        yield _pairs(pa.Table.from_batches(kept))


def candidates(old: DataFrame | None, new: DataFrame, parts: int | None = None) -> DataFrame:
    """a, b, block, pattern of the pairs of a new head with an old or another new one, each pair once; heads without a day have none.

    parts: shuffle partitions, where the caller knows the rows to be few.
    """
    bucket = F.floor(F.col("day") / SPAN).cast("int")
    edge = F.floor((F.col("day") + REACH) / SPAN).cast("int")
    rows = new.withColumn("new", F.lit(True))
    if old is not None:
        rows = rows.unionByName(old.withColumn("new", F.lit(False)))
    # a record within REACH of the next bucket also enters that one
    rows = rows.where(F.col("day") != NO_DAY).drop("copies").select("*", F.explode(F.array_distinct(F.array(bucket, edge))).alias("bucket"))
    rows = (rows.repartition(parts, "block", "bucket") if parts else rows.repartition("block", "bucket")).sortWithinPartitions("block", "bucket", "day", "cents", "balance", "text_hash", "ref_hash", "id")
    return with_texts(rows.mapInArrow(_groups, PAIRS))


def undated(every: DataFrame, few: bool = False) -> DataFrame:
    """a, b, block, pattern of the pairs of heads of which one at least has no day: equal in cents and in balance, reference or text.

    few: that those without a day are known to be few, so that their blocks may be broadcast; rows of other blocks are dropped at the scan.
    """
    blocks = every.where(F.col("day") == NO_DAY).select("block").distinct()
    every = stored(every.join(F.broadcast(blocks) if few else blocks, "block", "left_semi"), "undated")  # read six times
    side = lambda df, n: df.select(*[F.col(c).alias(f"{c}_{n}") for c in ("id", "balance", "text_hash", "ref_hash", "text", "day")], "block", "cents")
    a, b = side(every.where(F.col("day") == NO_DAY), "a"), side(every, "b")
    found = None
    for c in ("balance", "ref_hash", "text_hash"):
        one = a.where(f"{c}_a is not null").withColumn("k", F.col(f"{c}_a")).join(b.where(f"{c}_b is not null").withColumn("k", F.col(f"{c}_b")), ["block", "cents", "k"]).drop("k")
        found = one if found is None else found.unionByName(one)
    found = found.where((F.col("id_a") < F.col("id_b")) | ((F.col("id_a") > F.col("id_b")) & (F.col("day_b") != NO_DAY)))
    both = lambda c: F.col(f"{c}_a").isNotNull() & F.col(f"{c}_b").isNotNull()
    equal = lambda c: F.col(f"{c}_a") == F.col(f"{c}_b")
    near = (F.abs(F.col("balance_a") - F.col("balance_b")) < 100) & ((F.col("balance_a") % 100 == 0) | (F.col("balance_b") % 100 == 0))
    balance = F.when(~both("balance"), 2).when(equal("balance"), 0).when(near, 1).otherwise(3)
    text = F.when(~both("text_hash"), 4).when(equal("text_hash") & both("ref_hash"), 0).when(both("ref_hash") & equal("ref_hash"), 1).when(equal("text_hash"), 2).otherwise(OPEN)
    pattern = ((balance * 4 + 3) * 7 + text).cast("int")
    return with_texts(found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "block", pattern.alias("pattern"), "text_a", "text_b")).dropDuplicates(["a", "b"])


def with_texts(pairs: DataFrame) -> DataFrame:
    """a, b, block, pattern: where texts neither agree nor share a reference, with the level that the texts themselves tell."""
    longest, shortest = F.greatest(F.length("text_a"), F.length("text_b")), F.least(F.length("text_a"), F.length("text_b"))
    inside = (shortest >= 10) & (F.contains("text_a", "text_b") | F.contains("text_b", "text_a"))
    # a description may be cut or led by a mark: what is shorter is compared with as much of the longer
    near = F.levenshtein("text_a", "text_b") <= F.greatest(F.lit(2), F.floor(longest * 0.2))
    lead, tail = (lambda c: F.col(c).substr(F.lit(1), shortest)), (lambda c: F.expr(f"right({c}, least(length(text_a), length(text_b)))"))
    cut = (shortest >= 12) & ((F.levenshtein(lead("text_a"), lead("text_b")) <= F.floor(shortest * 0.15)) | (F.levenshtein(tail("text_a"), tail("text_b")) <= F.floor(shortest * 0.15)))
    level = F.when(inside | near | cut, LEVELS["text"].index("similar")).otherwise(LEVELS["text"].index("other"))
    still = F.col("pattern") % 7 == OPEN
    return pairs.select("a", "b", "block", F.when(still, F.col("pattern") - OPEN + level).otherwise(F.col("pattern")).cast("int").alias("pattern"))


@dataclass
class Weights:
    """Probabilities of each level among links (m) and among other candidates (u), and the share of links."""

    m: dict[str, list[float]] = field(default_factory=dict)
    u: dict[str, list[float]] = field(default_factory=dict)
    share: float = 0.1

    def score(self, pattern: int) -> float:
        """The log odds that a pair of this pattern is one movement."""
        at = levels(pattern)
        return math.log(self.share / (1 - self.share)) + sum(math.log(self.m[f][k] / self.u[f][k]) for f, k in at.items())


START = Weights(
    m={"amount": [0.95, 0.05], "balance": [0.85, 0.05, 0.09, 0.01], "day": [0.83, 0.12, 0.04, 0.01], "text": [0.55, 0.15, 0.15, 0.1, 0.02, 0.01, 0.02]},
    u={"amount": [0.9, 0.1], "balance": [0.001, 0.002, 0.03, 0.967], "day": [0.4, 0.29, 0.3, 0.01], "text": [0.02, 0.01, 0.4, 0.1, 0.02, 0.01, 0.44]},
    share=0.2,
)


def learned(counts: dict[int, int], rounds: int = 40, start: Weights = START) -> Weights:
    """Weights by expectation maximisation over pattern counts (at most 224 patterns), with a light prior from ``start``.

    Without candidates the start weights are returned. The prior keeps levels that never occur from having no weight.
    """
    total = sum(counts.values())
    if not total:
        return start
    w = start
    prior = max(100.0, 0.02 * total)
    for _ in range(rounds):
        m = {f: [prior * p for p in start.m[f]] for f in LEVELS}
        u = {f: [prior * p for p in start.u[f]] for f in LEVELS}
        links = prior * start.share
        for pattern, n in counts.items():
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, w.score(pattern)))))
            links += n * p
            for f, k in levels(pattern).items():
                m[f][k] += n * p
                u[f][k] += n * (1 - p)
        w = Weights({f: [x / sum(v) for x in v] for f, v in m.items()}, {f: [x / sum(v) for x in v] for f, v in u.items()}, min(0.999, max(0.001, links / (total + prior))))
    return w


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over rows (block, a, b, batch) sorted by block: those with a batch are the mapping before (a is of the
    representative b), the latest of an a counts; the others are links. What is new or changed comes out: id, rep, block."""
    parent: dict[bytes, bytes] = {}
    was: dict[bytes, tuple[int, bytes]] = {}
    links: list[tuple[bytes, bytes]] = []
    out: list[tuple[bytes, bytes, int]] = []

    def find(x: bytes) -> bytes:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def done(block: int) -> None:
        for x, (_, rep) in was.items():
            parent.setdefault(rep, rep)
            parent[x] = rep if x != rep else parent[x]
        for x, y in links:
            rx, ry = (find(parent.setdefault(z, z)) for z in (x, y))
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
        out.extend((x, find(x), block) for x in list(parent) if x not in was or was[x][1] != find(x))
        parent.clear(), was.clear(), links.clear()

    def batch() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["id", "rep", "block"])
        out.clear()
        return got

    last = None
    for b in batches:
        for block, x, y, k in zip(*[b.column(c).to_pylist() for c in ("block", "a", "b", "batch")], strict=True):
            if last is not None and block != last:
                done(last)
                if len(out) > 50_000:
                    yield batch()
            last = block
            if k is None:
                links.append((x, y))
            elif x not in was or was[x][0] < k:
                was[x] = (k, y)
    if last is not None:
        done(last)
    yield batch()


def union_find(links: DataFrame, before: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """id, rep, block of the records that new links (a, b, block) bring to another representative, the least id of a cluster.

    before: the mapping rows of the blocks that the links touch. Blocks are independent of each other. Within a block only
    heads of classes stand, so a block is as large as it has different movements, not copies.
    """
    rows = links.select("block", "a", "b", F.lit(None).cast("int").alias("batch"))
    if before is not None:
        rows = rows.unionByName(before.select("block", F.col("id").alias("a"), F.col("rep").alias("b"), "batch"))
    rows = rows.repartition(parts, "block") if parts else rows.repartition("block")
    return rows.sortWithinPartitions("block").mapInArrow(_found, "id binary, rep binary, block long")


def increments(loaded: list[dict], least: int = LEAST) -> list[dict]:
    """Loaded batches in their order, one an increment; batches of fewer than ``least`` records are put together until they are as
    many, as a job costs more than they do. What is found is the same, as rows of one increment are compared with each other too."""
    out: list[dict] = []
    for one in loaded:
        if out and sum(f["rows"] for f in out[-1]["files"]) < least:
            out[-1] = {"first": out[-1]["first"], "of": one["of"], "files": out[-1]["files"] + one["files"]}
        else:
            out.append({"first": one["of"], **one})
    return out


@contextmanager
def _listed(spark: SparkSession) -> Iterator[None]:
    """Lists some hundred named folders on the driver instead of by a job."""
    key = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        yield
    finally:
        spark.conf.set(key, was)


class History:
    """What was accepted so far, in a folder that all executors share; a folder that holds a store is opened as it was left."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "history")
        kept = json.loads(get_text(spark, f"{self.path}/manifest.json") or "{}")
        self.batches: int = kept.get("batches", 0)
        self.weights: Weights | None = Weights(**kept["weights"]) if kept.get("weights") else None
        #: Files of the key table: where, and the first and last day, rows and bytes.
        self.files: list[dict] = kept.get("files", [])
        #: Tables of the mapping and of members, in order.
        self.maps: list[str] = kept.get("maps", [])
        self.member_files: list[str] = kept.get("members", [])
        #: What each increment read and made: its first and last batch, rows, probed_rows, probed_bytes, history_rows, links.
        self.log: list[dict] = kept.get("log", [])

    def _save(self) -> None:
        put_text(self.spark, f"{self.path}/manifest.json", json.dumps({"batches": self.batches, "weights": vars(self.weights) if self.weights else None, "files": self.files, "maps": self.maps, "members": self.member_files, "log": self.log}))

    def _read(self, schema, paths: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{p}" for p in paths]
        if not paths:
            return self.spark.createDataFrame([], schema)
        with _listed(self.spark):
            return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return df

    def load(self, transactions: DataFrame, statements: DataFrame, batch: Column | None = None) -> list[dict]:
        """Reads records into classes, once, and writes heads by batch and period and the other members; nothing is compared yet.

        batch: which batch a row came with (default: all are one); batches follow each other in its order. Gives the files of
        each batch, in order, for ``take``: as much as batches times periods.
        """
        spark, tag = self.spark, fresh_path(self.spark, "load").rsplit("-", 1)[1]
        staged = stored(records(transactions, statements, F.lit(0) if batch is None else batch).withColumnRenamed("kept0", "part_of"), "staged")
        period = F.when(F.col("day") == NO_DAY, F.lit(None).cast("int")).otherwise(F.floor(F.col("day") / PERIOD).cast("int"))
        bulk = staged.groupBy("part_of", period.alias("period")).agg(F.count("*").alias("n")).where(F.col("n") >= BULK).where("period is not null")
        # one row for each batch and period that is written apart
        own = F.broadcast(bulk.select("part_of", F.col("period").alias("own")))
        heads = staged.groupBy("part_of", *SAME).agg(F.min("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("copies"))
        heads = heads.withColumn("_p", period).join(own.withColumnRenamed("part_of", "_b"), (F.col("part_of") == F.col("_b")) & (F.col("_p") == F.col("own")), "left")
        heads = heads.withColumns({"of": F.col("part_of"), "period": F.when(F.col("_p").isNull(), -(2**30)).otherwise(F.coalesce("own", F.lit(2**30)))})
        heads.select("id", *SAME, "text", "copies", "of", "period").hint("rebalance", "of", "period").write.partitionBy("of", "period").mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/heads-{tag}")
        written = spark.read.schema(f"{RECORDS}, of int, period int").parquet(f"{self.path}/heads-{tag}")
        each = written.groupBy("of", "period", F.col("_metadata.file_path").alias("file")).agg(F.max("_metadata.file_size").alias("size"), F.count("*").alias("rows"), F.min("day").alias("low"), F.max("day").alias("high"), F.sum(F.when(F.col("copies") > 1, F.col("copies"))).alias("many"))
        sums = each.groupBy("of", "period").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.coalesce(F.sum("many"), F.lit(0)).alias("many")).orderBy("of", "period").collect()
        many = written.where("copies > 1").select(F.col("of").alias("_of"), F.col("id").alias("head"), *[F.col(c).alias(f"_{c}") for c in SAME])
        same = F.col("part_of") == F.col("_of")
        for c in SAME:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        known = lambda c: F.col(c).isNotNull()
        own_pattern = ((F.when(known("balance"), 0).otherwise(2) * 4 + F.when(F.col("day") == NO_DAY, 3).otherwise(0)) * 7 + F.when(~known("text_hash"), 4).when(known("ref_hash"), 0).otherwise(2)).cast("int")
        members = []
        if sum(r["many"] for r in sums):
            self._write(staged.join(many, same).where("id <> head").select("id", "head", "block", own_pattern.alias("pattern")), f"members-{tag}")
            members = [f"members-{tag}"]
        self.member_files += members
        drop_path(spark, staged._stored_at)
        out: list[dict] = []
        for r in sums:
            if not out or out[-1]["of"] != r["of"]:
                out.append({"of": r["of"], "files": []})
            out[-1]["files"].append({"at": f"heads-{tag}/of={r['of']}/period={r['period']}", "low": r["low"], "high": r["high"], "rows": r["rows"], "size": r["size"]})
        return out

    def take(self, loaded: dict) -> None:
        """Accepts one loaded batch: its heads are compared with each other and with those of the files its days reach, links are
        scored, and the clusters they touch are updated. The store is then as it is after this batch, whatever comes later."""
        k, files = self.batches, loaded["files"]
        rows = sum(f["rows"] for f in files)
        dated = [(f["low"], f["high"]) for f in files if f["low"] is not None and f["high"] != NO_DAY]
        touched = [f for f in self.files if f["high"] != NO_DAY and any(f["low"] <= high + REACH and f["high"] >= low - REACH for low, high in dated)]
        new = self._read(RECORDS, [f["at"] for f in files])
        old, parts = None, max(1, rows // 20_000) if rows < 1_000_000 else None
        if touched:
            blocks = new.select("block").distinct()
            old = self._read(RECORDS, [f["at"] for f in touched]).join(F.broadcast(blocks) if rows <= SMALL else blocks, "block", "left_semi")
        found = candidates(old, new, parts)
        if self.weights is None:
            found = self._write(found, f"candidates-{k}")
            found = self._read(LINKS, [f"candidates-{k}"])
            self.weights = learned({r["pattern"]: r["n"] for r in found.where(~F.col("pattern").isin(*COPY)).groupBy("pattern").agg(F.count("*").alias("n")).collect()})
        links = self._link(found, k, parts)
        self.log.append({"first": loaded.get("first", loaded["of"]), "batch": loaded["of"], "rows": rows, "probed_rows": sum(f["rows"] for f in touched), "probed_bytes": sum(f["size"] for f in touched), "history_rows": sum(f["rows"] for f in self.files), "links": links})
        self.files += files
        self.batches = k + 1
        if self.batches % MERGE == 0:
            self._merge()
        self._save()

    def _link(self, found: DataFrame, k: int, parts: int | None) -> int:
        """Writes the links among the pairs found, and what they change of the mapping; how many links."""
        seen = Observation(f"links-{k}")
        self._write(found.where(F.col("pattern").isin(self.good())).observe(seen, F.count("*").alias("n")), f"links-{k}")
        n = seen.get["n"]
        if n:
            links = self._read(LINKS, [f"links-{k}"])
            before = None
            if self.maps:
                blocks = links.select("block").distinct()
                before = self._read(MAPPING, self.maps).join(F.broadcast(blocks) if n <= SMALL else blocks, "block", "left_semi")
            changed = union_find(links, before, max(1, n // 20_000) if n < 1_000_000 else None)
            self._write(changed.withColumn("batch", F.lit(k)).select(*MAPPING.names), f"mapping-{k}")
            self.maps.append(f"mapping-{k}")
        drop_path(self.spark, f"{self.path}/links-{k}")
        drop_path(self.spark, f"{self.path}/candidates-{k}")
        return n

    def _merge(self) -> None:
        """Merges the small tables of the last batches: of each record the latest mapping row, of the heads all."""
        if len(self.maps) > 1:
            rows = self._read(MAPPING, self.maps)
            latest = rows.groupBy("id").agg(F.max_by(F.struct("rep", "block", "batch"), "batch").alias("m")).select("id", "m.rep", "m.block", "m.batch")
            name = f"mapping-to-{self.batches}"
            self._write(latest, name)
            for m in self.maps:
                drop_path(self.spark, f"{self.path}/{m}")
            self.maps = [name]
        small = [f for f in self.files if f["rows"] < BULK and f["high"] != NO_DAY]
        if len(small) > MERGE // 2:
            name = f"heads-to-{self.batches}"
            self._write(self._read(RECORDS, [f["at"] for f in small]).coalesce(1 + sum(f["rows"] for f in small) // 1_000_000), name)
            for f in small:
                drop_path(self.spark, f"{self.path}/{f['at']}")
            merged = {"at": name, "low": min(f["low"] for f in small), "high": max(f["high"] for f in small), "rows": sum(f["rows"] for f in small), "size": sum(f["size"] for f in small)}
            self.files = [f for f in self.files if f not in small] + [merged]

    def settle(self) -> None:
        """Compares the heads without a day with all others, in one pass over the key table; to be called after the batches of a day or a load."""
        if any(f["high"] == NO_DAY for f in self.files):
            if self.weights is None:
                self.weights = START
            rows = sum(f["rows"] for f in self.files if f["high"] == NO_DAY)
            links = self._link(undated(self._read(RECORDS, [f["at"] for f in self.files]), rows <= SMALL), self.batches, None)
            self.log.append({"first": None, "batch": None, "rows": rows, "probed_rows": sum(f["rows"] for f in self.files), "probed_bytes": sum(f["size"] for f in self.files), "history_rows": sum(f["rows"] for f in self.files), "links": links})
            self.batches += 1
        self._save()

    def accept(self, batch: DataFrame, statements: DataFrame) -> None:
        """Adds one batch of transactions, all of them as one increment."""
        for one in self.load(batch, statements):
            self.take(one)
        self.settle()

    def good(self) -> list[int]:
        """The patterns that are links: those of a positive score, and those of records equal in all fields."""
        return sorted({p for p in range(PATTERNS) if p % 7 != OPEN and self.weights.score(p) > 0} | set(COPY))

    def mapping(self) -> DataFrame:
        """id, rep of all records in clusters, the members of classes among them."""
        heads = self._read(MAPPING, self.maps).groupBy("id").agg(F.max_by("rep", "batch").alias("rep"))
        if not self.member_files:
            return heads
        members = self._read(MEMBERS, self.member_files)
        alone = F.col("pattern").isin(self.good() if self.weights else list(COPY))
        placed = members.join(heads.withColumnRenamed("id", "head"), "head", "left").select("id", "head", "rep", alone.alias("alone")).where("rep is not null or alone")
        lone = placed.where("rep is null").select(F.col("head").alias("id"), F.col("head").alias("rep")).distinct()
        return heads.unionByName(placed.select("id", F.coalesce("rep", "head").alias("rep"))).unionByName(lone)


def pairs(mapping: DataFrame) -> DataFrame:
    """transaction_id_a, transaction_id_b: all pairs of records of one cluster, the smaller id first."""
    m = with_key(mapping.select("id", "rep"), "id", "transaction_id")
    a = m.select("rep", F.col("transaction_id").alias("transaction_id_a"))
    b = m.select("rep", F.col("transaction_id").alias("transaction_id_b"))
    return a.join(b, "rep").where("transaction_id_a < transaction_id_b").select("transaction_id_a", "transaction_id_b")


def clusters(mapping: DataFrame) -> DataFrame:
    """transaction_id, representative and size of the cluster, one row for each record recorded more than once."""
    sizes = mapping.groupBy("rep").agg(F.count("*").alias("copies"))
    out = with_key(mapping.select("id", "rep").join(sizes, "rep"), "id", "transaction_id")
    return with_key(out, "rep", "representative").select("transaction_id", "representative", "copies")
