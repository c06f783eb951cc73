"""Mixed timestamp formats and time zones, brought to one instant in UTC.

A file's clock runs in one zone. Where ``zone_name`` is missing it is estimated: every candidate zone (an offset history)
is tried on the file's local times, and the one that violates least wins, a violation being an instant after the file's
ingestion or one that runs backwards against the sequence of the file's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import PLAIN, with_instant
from ledgerloom.operators.rejects import checked, field, headers


def estimated_zones(rows: DataFrame, files: DataFrame, zones: DataFrame, default: str = "UTC") -> DataFrame:
    """statement_id and zone_name for each file of ``files`` whose zone is null.

    rows: statement_id, text, position (sequence number in the file, may be null). files: statement_id, day_order,
    upload_date. zones: zone_name, n (the candidate zones and how many files are known to run in each; at most one row
    per IANA zone, some hundreds, so it may be broadcast). Violations are counted by equi-joins of neighbours on
    (file, candidate, position), never by a window over a whole file. Ties go to the candidate known for more files, then
    to the smaller name; a file without readable rows gets the most frequent zone, or ``default`` without candidates.
    """
    candidates = F.broadcast(zones.where(F.col("zone_name").isNotNull()).select("zone_name", "n"))
    tried = rows.join(files.select("statement_id", "day_order", "upload_date"), "statement_id").crossJoin(candidates)
    at = with_instant(tried, "text", F.col("zone_name"), F.col("day_order")).where("at_has_clock")
    late = at.groupBy("statement_id", "zone_name").agg(F.sum((F.col("at_utc_micros") > F.unix_micros("upload_date")).cast("long")).alias("late"))
    here = at.where("position is not null").select("statement_id", "zone_name", "position", "at_utc_micros")
    before = here.select("statement_id", "zone_name", (F.col("position") + 1).alias("position"), F.col("at_utc_micros").alias("was"))
    back = here.join(before, ["statement_id", "zone_name", "position"]).groupBy("statement_id", "zone_name").agg(F.sum((F.col("was") > F.col("at_utc_micros")).cast("long")).alias("back"))
    counts = files.select("statement_id").crossJoin(candidates).join(late, ["statement_id", "zone_name"], "left").join(back, ["statement_id", "zone_name"], "left")
    cost = F.coalesce("late", F.lit(0)) + F.coalesce("back", F.lit(0))
    best = counts.groupBy("statement_id").agg(F.min_by("zone_name", F.struct(cost, -F.col("n"), F.col("zone_name"))).alias("zone_name"))
    return files.select("statement_id").distinct().join(best, "statement_id", "left").select("statement_id", F.coalesce("zone_name", F.lit(default)).alias("zone_name"))


def zoned(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """statement_id, zone_name, day_order of each file, missing zones estimated from ``rows`` (statement_id, text, position).

    Nothing is read of ``rows`` where no file lacks its zone. Of a statement_id that occurs twice one row counts.
    """
    files = statements.select("statement_id", "zone_name", "day_order", "upload_date").where("statement_id is not null").dropDuplicates(["statement_id"])
    known = files.where("zone_name is not null").select("statement_id", "zone_name", "day_order")
    missing = files.where("zone_name is null")
    if missing.isEmpty():
        return known
    zones = known.groupBy("zone_name").agg(F.count("*").alias("n"))
    found = estimated_zones(rows.join(missing.select("statement_id"), "statement_id", "left_semi"), missing, zones)
    return known.unionByName(missing.select("statement_id", "day_order").join(found, "statement_id").select("statement_id", "zone_name", "day_order"))


def transaction_zones(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    return zoned(statements, transactions.select("statement_id", F.col("tx_date").alias("text"), F.col("original_index").alias("position")))


def transaction_instants(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """transaction_id and utc_micros of each readable tx_date that isn't plain yyyy-MM-dd.

    Plain dates are filtered at the scan, before the join with the files; a row whose file is unknown is read in UTC.
    Null, empty and unreadable dates give no row.
    """
    rows = transactions.select("transaction_id", "statement_id", "tx_date", "original_index").where("tx_date is not null").where(~F.trim("tx_date").rlike(PLAIN))
    joined = rows.join(transaction_zones(transactions, statements), "statement_id", "left")
    at = with_instant(joined, "tx_date", F.col("zone_name"), F.col("day_order"))
    return at.where("at_utc_micros is not null").select("transaction_id", F.col("at_utc_micros").alias("utc_micros"))


def line_instants(lines: DataFrame, statements: DataFrame, plain: bool = False, loaded: DataFrame | None = None) -> DataFrame:
    """line_id and utc_micros of the movement's date of each record that could be loaded; plain dates only if asked for."""
    head = headers(lines)
    loaded = checked(lines, head) if loaded is None else loaded
    dated = loaded.where("reason is null").join(head.select("statement_id", "roles"), "statement_id")
    dated = dated.select("line_id", "statement_id", F.col("line_no").alias("position"), field("date").alias("text")).where("text is not null")
    dated = dated if plain else dated.where(~F.trim("text").rlike(PLAIN))
    at = with_instant(dated.join(zoned(statements, dated), "statement_id", "left"), "text", F.col("zone_name"), F.col("day_order"))
    return at.where("at_utc_micros is not null").select("line_id", F.col("at_utc_micros").alias("utc_micros"))


def all_instants(transactions: DataFrame, lines: DataFrame, statements: DataFrame) -> DataFrame:
    """table_name, row_key, utc_micros: every readable date that isn't plain, of both tables."""
    a = transaction_instants(transactions, statements).select(F.lit("transactions").alias("table_name"), F.col("transaction_id").alias("row_key"), "utc_micros")
    b = line_instants(lines, statements).select(F.lit("statement_lines").alias("table_name"), F.col("line_id").cast("string").alias("row_key"), "utc_micros")
    return a.unionByName(b)


def transaction_days(transactions: DataFrame, statements: DataFrame, *columns: str) -> DataFrame:
    """The given columns and ``day``, the date of the row's instant in its file's zone; rows with unreadable dates are left out.

    Only rows whose date isn't plain are joined with their files: a plain date is its own day in any zone.
    """
    rows = transactions.select("statement_id", "tx_date", "original_index", *[c for c in columns if c not in ("statement_id", "tx_date", "original_index")])
    plain = F.coalesce(F.trim("tx_date").rlike(PLAIN), F.lit(False))
    own = rows.where(plain).select(*columns, F.trim("tx_date").try_cast("date").alias("day")).where("day is not null")
    other = rows.where(~plain & F.col("tx_date").isNotNull()).join(transaction_zones(transactions, statements), "statement_id", "left")
    other = with_instant(other, "tx_date", F.col("zone_name"), F.col("day_order")).where("at_day is not null")
    return own.unionByName(other.select(*columns, F.col("at_day").alias("day")))


def with_days(transactions: DataFrame, statements: DataFrame, *columns: Column) -> DataFrame:
    """The given columns of every row and ``day`` as in ``transaction_days``, null where the date can't be read."""
    plain = F.coalesce(F.trim("tx_date").rlike(PLAIN), F.lit(False))
    names = [f"_c{k}" for k in range(len(columns))]
    rows = transactions.select("statement_id", "tx_date", plain.alias("_plain"), *[c.alias(n) for c, n in zip(columns, names, strict=True)])
    own = rows.where("_plain or tx_date is null").select(*names, F.when(F.col("_plain"), F.trim("tx_date").try_cast("date")).alias("day"))
    other = rows.where("not _plain and tx_date is not null").join(transaction_zones(transactions, statements), "statement_id", "left")
    other = with_instant(other, "tx_date", F.col("zone_name"), F.col("day_order"))
    return own.unionByName(other.select(*names, F.col("at_day").alias("day")))
