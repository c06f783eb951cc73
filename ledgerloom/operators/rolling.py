"""Rolling totals over trailing periods, days without activity included.

Rows are summed by entity and day before anything else, so an entity with a third of all rows is as small as any other.
Time is cut into tiles; a tile also gets the days before it that its windows reach (its halo), so tiles are independent.
On the workers entities by days are packed into dense numpy blocks and multiplied by banded window operators. Amounts
are whole cents: a block is multiplied as doubles while every sum stays below 2**53, and as 64-bit integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 128
SLICE = 256  # tiles that are dense at once
#: What is summed by day: rows; cents and rows with an amount, by direction.
SUMS = ("n", "dr", "cr", "n_dr", "n_cr")


def daily(rows: DataFrame, entity: str = "entity_id", day: str = "day", amount: str = "amount", direction: str = "direction") -> DataFrame:
    """entity, day, n, dr, cr, n_dr, n_cr: rows, cents and rows with an amount by direction (other directions and null amounts count in n only)."""
    cents = lambda side: F.coalesce(F.sum(F.when(F.col(direction) == side, (F.col(amount) * 100).cast("long"))), F.lit(0))
    paid = lambda side: F.count(F.when(F.col(direction) == side, F.col(amount)))
    rows = rows.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    return rows.groupBy(F.col(entity).alias("entity"), F.col(day).alias("day")).agg(F.count("*").alias("n"), cents("DR").alias("dr"), cents("CR").alias("cr"), paid("DR").alias("n_dr"), paid("CR").alias("n_cr"))


def band(tile: int, halo: int, window: int) -> np.ndarray:
    """The operator that sums ``window`` trailing days: (halo + tile) days in, tile days out."""
    days = np.arange(halo + tile)[:, None] - halo
    out = np.arange(tile)[None, :]
    return ((days <= out) & (days > out - window)).astype(np.float64)


def _tiles(sums: DataFrame, halo: int, tile: int, columns: Sequence[str]) -> DataFrame:
    """entity, tile, first, last, k (places of days with rows, halo included) and an array of each of ``columns`` along k, of each tile from an entity's first day to its last.

    A tile holds at most halo + tile days, so its arrays are bounded whatever an entity's rows.
    """
    marked = sums.withColumn("d", F.unix_date("day"))
    span = marked.groupBy("entity").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    own = F.floor(F.col("d") / tile)
    reach = F.array_distinct(F.array(own, F.floor((F.col("d") + halo) / tile)))
    if halo > tile:
        reach = F.sequence(own, F.floor((F.col("d") + halo) / tile))
    cell = marked.select("entity", "d", *columns, F.explode(reach).alias("tile"))
    place = (F.col("d") - F.col("tile") * tile + halo).cast("int")
    packed = cell.groupBy("entity", "tile").agg(F.collect_list(place).alias("k"), *[F.collect_list(c).alias(c) for c in columns])
    every = span.select("entity", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / tile), F.floor(F.col("last") / tile))).alias("tile"))
    return every.join(packed, ["entity", "tile"], "left").select("entity", "tile", F.col("first").cast("long"), F.col("last").cast("long"), "k", *columns)


def _blocks(batch: pa.RecordBatch, halo: int, tile: int, columns: Sequence[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Dense (rows, halo + tile) blocks of ``columns`` (of a mark of days with rows, without any), each row's start, and which of its days are inside the entity's span."""
    k = batch.column("k")
    row = np.repeat(np.arange(len(k)), np.asarray(k.value_lengths().fill_null(0)))
    place = np.asarray(k.flatten())
    blocks = {}
    for name in columns or ("k",):
        block = np.zeros((len(k), halo + tile), np.int64)
        block[row, place] = np.asarray(batch.column(name).flatten()) if columns else 1
        blocks[name] = block
    start = np.asarray(batch.column("tile")) * tile
    low = np.clip(np.asarray(batch.column("first")) - start, 0, tile)
    high = np.clip(np.asarray(batch.column("last")) - start, -1, tile - 1)
    inside = (np.arange(tile)[None, :] >= low[:, None]) & (np.arange(tile)[None, :] <= high[:, None])
    return blocks, start, inside


def _times(block: np.ndarray, operator: np.ndarray) -> np.ndarray:
    if np.abs(block).sum(axis=1, dtype=np.float64).max(initial=0) < 2**53:
        return np.rint(block.astype(np.float64) @ operator).astype(np.int64)
    return block @ operator.astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE tiles at most: dense blocks and results are some MB, however many tiles a batch brings."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            yield whole.slice(at, SLICE)


def trailing(sums: DataFrame, windows: Sequence[int] = (7, 30), tile: int = TILE) -> DataFrame:
    """entity, day and for each window w: n_w, dr_w, cr_w (cents), n_dr_w, n_cr_w, for every day from an entity's first to its last.

    sums: entity, day, n, dr, cr, n_dr, n_cr as from ``daily``, one row per entity and day. An empty table gives no rows.
    """
    halo = max(windows) - 1
    operators = {w: band(tile, halo, w) for w in windows}
    fields = [("entity", T.StringType()), ("day", T.DateType())] + [(f"{c}_{w}", T.LongType()) for w in windows for c in SUMS]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            blocks, start, inside = _blocks(b, halo, tile, SUMS)
            rows, place = np.nonzero(inside)
            out = [b.column("entity").take(pa.array(rows)), pa.array((start[rows] + place).astype(np.int32)).cast(pa.date32())]
            for w in windows:
                out += [pa.array(_times(blocks[c], operators[w])[rows, place]) for c in SUMS]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return _tiles(sums.select(F.col("entity").cast("string"), "day", *SUMS), halo, tile, SUMS).mapInArrow(run, schema)


def quiet(sums: DataFrame, window: int = 30, tile: int = TILE) -> DataFrame:
    """entity and day of the days between an entity's first and last whose trailing window holds none of its rows.

    sums: entity, day, one row per entity and day with rows; nothing else is packed.
    """
    halo = window - 1
    operator = band(tile, halo, window)
    schema = T.StructType([T.StructField("entity", T.StringType()), T.StructField("day", T.DateType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            blocks, start, inside = _blocks(b, halo, tile, ())
            rows, place = np.nonzero(inside & (_times(blocks["k"], operator) == 0))
            yield pa.RecordBatch.from_arrays([b.column("entity").take(pa.array(rows)), pa.array((start[rows] + place).astype(np.int32)).cast(pa.date32())], schema.names)

    return _tiles(sums.select(F.col("entity").cast("string"), "day"), halo, tile, ()).mapInArrow(run, schema)
