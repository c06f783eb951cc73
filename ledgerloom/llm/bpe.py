"""Encoding of a whole corpus by a byte-level BPE vocabulary.

Each piece of a text is merged with a segment tree over the ranks of its adjacent pairs: the root holds the leftmost pair of
the lowest rank, a merge changes two leaves and their ancestors, and the piece is done when the root holds no rank. A piece
of n bytes takes O(n log n), so one very long piece can't stall a task. Pieces repeat, so each worker keeps those it has seen.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that cuts a text into pieces, as the vocabulary's authors published it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 62
KEPT = 200_000


def ranks_of(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    # leaf i: rank of the token at i joined to its right neighbour, and i itself in the low bits, so the minimum is the leftmost
    shift = n.bit_length()
    mask = (1 << shift) - 1
    tree = [NONE] * (2 * size)
    right = list(range(1, n + 1))  # start of the next token, n at the end
    left = list(range(-1, n - 1))
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    def pair(i: int) -> int:
        j = right[i]
        if j >= n:
            return NONE
        r = ranks.get(piece[i : right[j]])
        return NONE if r is None else r << shift | i

    while tree[1] != NONE:
        i = tree[1] & mask
        j = right[i]
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        put(j, NONE)
        put(i, pair(i))
        if left[i] >= 0:
            put(left[i], pair(left[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


class Encoder:
    """Encodes texts; keeps the ids of up to KEPT pieces."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        self.ranks = ranks_of(data)
        self.pieces = regex.compile(pattern)
        self.seen: dict[str, list[int]] = {}

    def ids(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null text. A lone surrogate counts as the replacement character."""
        if not text:
            return []
        out: list[int] = []
        seen = self.seen
        for piece in self.pieces.findall(text):
            got = seen.get(piece)
            if got is None:
                got = merged(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= 64:
                    if len(seen) >= KEPT:
                        seen.clear()
                    seen[piece] = got
            out += got
        return out


@lru_cache(maxsize=4)
def encoder(data: bytes) -> Encoder:
    return Encoder(data)


def vocabulary(df: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """The vocabulary file, read on the driver and broadcast: a file of fixed size, under 1 MB."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least, since Parquet packs much text into few bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def encoded(df: DataFrame, key: str, text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """key and ids (a list of integers) of each row; an empty list for an empty and for a null text. Rows repeat as they do in df."""
    words = vocabulary(df, folder, name)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(words.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids = pa.array([own.ids(x) for x in b.column(1).to_pylist()], pa.list_(pa.field("element", pa.int32(), nullable=False)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, schema)


def token_counts(df: DataFrame, *keys: str, text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """The key columns, tokens (0 for an empty and for a null text) and text_hash of each row."""
    words = vocabulary(df, folder, name)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("text_hash", T.LongType()), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(words.value)
        for b in batches:
            counts = pa.array([len(own.ids(x)) for x in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], counts], schema.names)

    return spread(df.select(*keys, F.xxhash64(text).alias("text_hash"), text)).mapInArrow(run, schema)
