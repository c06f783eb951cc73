"""Schemas that drift between files: one consistent table of all records, and a report of every change.

Loaded records become (path, value) pairs with their raw types; types are counted by file and path, and the report compares
a file's paths, by what they mean, with those of the account's file before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.dates import COMPACT, DAY_NAMED, FIGURES, ISO, MONTH_NAMED, PLAIN, with_instant
from ledgerloom.operators.instants import zoned
from ledgerloom.operators.rejects import amount, checked, field, headers
from ledgerloom.session import stored

#: All notations of dates in one; the one with a back reference is the first, so that its groups keep their numbers.
_DATE = "|".join(f"(?:{p})" for p in (FIGURES, PLAIN, ISO, DAY_NAMED, MONTH_NAMED, COMPACT))
_MONEY = r"(?i)^\(?[+-]?\s*(₹|rs\.?)?\s*[+-]?\s*\d+(,\d+)*(\.\d*)?\s*\)?\s*(cr|dr)?\.?$"
_NUMBER = r"^[+-]?\s*(₹|[Rr][Ss]\.?)?\s*[+-]?\s*\d+(,\d+)*"


def raw_type(value: Column, role: Column) -> Column:
    """whole, decimal, date, date-time or text; null for a blank value. Bare figures are dates only in date fields."""
    t = F.trim(value)
    dated = F.split(role, "#")[0].isin("date", "value_date")
    figures = t.rlike(r"^\d+$") & F.length(t).isin(5, 8, 10, 13, 16)
    clock = t.rlike(r"\d{1,2}:\d{2}|^\d{8}T\d{6}") | (t.rlike(r"^\d+$") & F.length(t).isin(10, 13, 16))
    date = F.when(clock, "date-time").otherwise("date")
    # the numbers, then one expression for all notations of dates: of a text that is neither, no more is tried
    return (
        F.when(value.isNull() | (t == ""), F.lit(None).cast("string"))
        .when(dated & figures, date)
        .when(t.rlike(_NUMBER + "$"), "whole")
        .when(t.rlike(_NUMBER + r"\.\d*$|^[+-]?\.\d+$"), F.when(dated & ~t.rlike(_NUMBER), "text").otherwise("decimal"))
        .when(t.rlike(_DATE), date)
        .otherwise("text")
    )


def paths(loaded: DataFrame, head: DataFrame) -> DataFrame:
    """line_id, statement_id and ``row``, a map from path (role) to value, of each loaded record."""
    return loaded.where("reason is null").join(head, "statement_id").select("line_id", "statement_id", "line_no", F.map_from_arrays("roles", "fields").alias("row"))


def path_types(rows: DataFrame) -> DataFrame:
    """statement_id, role, kind, n, letters, sums: how often each raw type occurs, by file and path, how long its values are
    together, and how many are sums of money, a side (Cr, Dr, brackets) told with them or not. A blank has the kind ''.
    """
    long = rows.select("statement_id", F.explode("row").alias("role", "value"))
    kind = F.coalesce(raw_type(F.col("value"), F.col("role")), F.lit(""))
    return long.select("statement_id", "role", kind.alias("kind"), F.length(F.trim("value")).alias("len"), F.trim("value").rlike(_MONEY).cast("int").alias("money")).groupBy("statement_id", "role", "kind").agg(F.count("*").alias("n"), F.sum("len").alias("letters"), F.coalesce(F.sum("money"), F.lit(0)).alias("sums"))


def field_types(stats: DataFrame) -> DataFrame:
    """statement_id, role, kind, filled (share of values that aren't blank), length (mean of these), money (share of sums): what a file's field holds.

    The kind is the narrowest type that holds all values: whole and decimal numbers together are decimal, dates and
    date-times together date-time; any other mixture is text; null where all values are blank.
    """
    valued = F.col("kind") != ""
    seen = stats.groupBy("statement_id", "role").agg(
        F.collect_set(F.when(valued, F.col("kind"))).alias("kinds"), F.sum(F.when(valued, F.col("n")).otherwise(0)).alias("some"), F.sum("n").alias("n"), F.sum(F.when(valued, F.col("letters")).otherwise(0)).alias("letters"), F.sum("sums").alias("sums"),
    )
    only = lambda *k: F.size(F.array_except("kinds", F.array(*map(F.lit, k)))) == 0
    kind = F.when(F.size("kinds") == 0, F.lit(None).cast("string")).when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).when(only("whole", "decimal"), "decimal").when(only("date", "date-time"), "date-time").otherwise("text")
    return seen.select("statement_id", "role", kind.alias("kind"), (F.col("some") / F.col("n")).alias("filled"), F.try_divide("letters", "some").alias("length"), (F.col("sums") / F.col("n")).alias("money"))


def meant(types: DataFrame) -> DataFrame:
    """statement_id, role, meaning: roles by what fields hold, for the fields whose names no rule knows.

    In a file without a date the field of dates that is filled most is its date; without a balance, the field that most often
    holds a sum (in nine records of ten at least, of equals the longer) its balance; without a description, the field of the longest texts its description. A file has few
    fields: nothing here is larger than the headers.
    """
    has = types.groupBy("statement_id").agg(F.collect_set("role").alias("roles"))
    unknown = types.where(F.col("role").startswith("other:")).join(has, "statement_id")
    lacks = lambda r: ~F.array_contains("roles", r)
    as_date, as_number, as_text = F.col("kind").isin("date", "date-time") & lacks("date"), (F.col("money") >= 0.9) & lacks("balance"), (F.col("kind") == "text") & lacks("description")
    told = unknown.withColumn("meaning", F.when(as_date, "date").when(as_number, "balance").when(as_text, "description")).where("meaning is not null")
    best = told.groupBy("statement_id", "meaning").agg(F.max_by("role", F.struct(F.when(F.col("meaning") == "description", F.col("length")).when(F.col("meaning") == "balance", F.col("money")).otherwise(F.col("filled")), F.coalesce("length", F.lit(0.0)), "role")).alias("role"))
    return best.select("statement_id", "role", "meaning")


def with_meanings(head: DataFrame, meanings: DataFrame) -> DataFrame:
    """head with the roles that ``meant`` tells in place of those of unknown names."""
    told = meanings.groupBy("statement_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "meaning"))).alias("told"))
    roles = F.transform("roles", lambda r: F.coalesce(F.try_element_at("told", r), r))
    return head.join(told, "statement_id", "left").select("statement_id", "names", F.when(F.col("told").isNull(), F.col("roles")).otherwise(roles).alias("roles"))


def unified(lines: DataFrame, statements: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """One typed table of all loaded records: line_id, statement_id, line_no, utc_micros, description, debit, credit, balance,
    the other fields as a map, and ``failed``, the names of fields whose value couldn't be cast.

    Blank and absent fields are null and never failed. A balance may end in Cr or Dr (Dr is negative).
    """
    head = stored(headers(lines, statements, mappings), "headers")
    loaded = stored(checked(lines, head).where("reason is null"), "loaded")
    # only files with a name that no rule knows are looked into
    unknown = head.where(F.exists("roles", lambda r: r.startswith("other:")))
    told = stored(meant(field_types(path_types(paths(loaded, unknown)))), "meanings")
    rows = loaded.join(with_meanings(head, told).select("statement_id", "roles"), "statement_id")
    zones = zoned(statements, rows.select("statement_id", field("date").alias("text"), F.col("line_no").alias("position")))
    rows = rows.join(zones, "statement_id", "left").withColumn("written_date", field("date"))
    at = with_instant(rows, "written_date", F.col("zone_name"), F.col("day_order"))
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    balance = F.trim(field("balance"))
    bare = F.regexp_replace(balance, r"(?i)\s*(cr|dr)\.?$", "")
    sign = F.when(balance.rlike(r"(?i)dr\.?$") | balance.rlike(r"^\(.*\)$"), -1).otherwise(1)
    money = lambda r: amount(field(r))
    typed = at.select(
        "line_id", "statement_id", "line_no", F.col("at_utc_micros").alias("utc_micros"), "written_date",
        F.nullif(F.trim(field("description")), F.lit("")).alias("description"),
        money("debit").alias("debit"), money("credit").alias("credit"), field("debit").alias("_d"), field("credit").alias("_c"),
        (amount(F.regexp_replace(bare, "[()]", "")) * sign).cast("decimal(15,2)").alias("balance"), balance.alias("_b"),
        F.map_filter(F.map_from_arrays("roles", "fields"), lambda k, v: ~k.isin("date", "description", "debit", "credit", "balance") & (F.trim(v) != "")).alias("other"),
    )
    fails = [F.when(typed[v].isNull() & ~blank(typed[raw]), F.lit(v)) for v, raw in (("debit", "_d"), ("credit", "_c"), ("balance", "_b"))]
    fails.append(F.when(F.col("utc_micros").isNull() & ~blank(F.col("written_date")), F.lit("date")))
    return typed.withColumn("failed", F.array_compact(F.array(*fails))).drop("_d", "_c", "_b", "written_date")


def changes(lines: DataFrame, statements: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """statement_id, change, old_field, new_field: what each raw file changed against its account's raw file before.

    Files are ordered by upload_date, then statement_id; files without an account or a readable header are left out.
    Order, letter case and outer blanks of names are no change, nor is a type that one of the files can't show. Two fields
    are the same if names mean the same by the bank's mapping or the rules, if what they hold means the same (``meant``), or if what
    one file lost and the next gained hold the same and nothing else does (``alike``).
    """
    head = stored(headers(lines, statements, mappings), "headers")
    types = stored(field_types(path_types(paths(checked(lines, head), head))), "types")  # read four times
    told = stored(meant(types), "meanings")
    head = with_meanings(head, told)
    types = stored(types.join(told, ["statement_id", "role"], "left").withColumn("role", F.coalesce("meaning", "role")).drop("meaning"), "types")
    files = head.where("names is not null").join(statements.select("statement_id", "account_id", "upload_date").where("account_id is not null").dropDuplicates(["statement_id"]), "statement_id")
    order = W.partitionBy("account_id").orderBy(F.col("upload_date").asc_nulls_first(), "statement_id")
    # an account's files are few next to its records: the window holds headers only
    files = files.select("statement_id", "names", "roles", F.lag("statement_id").over(order).alias("before"), F.lag("names").over(order).alias("old_names"), F.lag("roles").over(order).alias("old_roles")).where("before is not null")
    new = files.select("statement_id", "before", F.explode(F.arrays_zip("roles", "names")).alias("f")).select("statement_id", "before", F.col("f.roles").alias("role"), F.col("f.names").alias("new_field"))
    old = files.select("statement_id", "before", F.explode(F.arrays_zip("old_roles", "old_names")).alias("f")).select("statement_id", "before", F.col("f.old_roles").alias("role"), F.col("f.old_names").alias("old_field"))
    holds = lambda side: F.struct("kind", "filled", "length").alias(side)
    both = new.join(old, ["statement_id", "before", "role"], "full")
    both = both.join(types.select("statement_id", "role", holds("new")), ["statement_id", "role"], "left")
    both = stored(both.join(types.select(F.col("statement_id").alias("before"), "role", holds("old")), ["before", "role"], "left"), "fields")
    pairs = alike(both)
    both = both.join(pairs.select("statement_id", F.col("lost").alias("role"), F.lit(True).alias("gone")), ["statement_id", "role"], "left").where("gone is null").drop("gone")
    both = both.join(pairs.select("statement_id", F.col("gained").alias("role"), F.col("old_field").alias("was"), F.col("old").alias("held")), ["statement_id", "role"], "left")
    both = both.withColumns({"old_field": F.coalesce("old_field", "was"), "old": F.coalesce("old", "held")})
    same = F.lower("old_field") == F.lower("new_field")
    what = F.array_compact(F.array(
        F.when(F.col("old_field").isNull(), F.lit("added")),
        F.when(F.col("new_field").isNull(), F.lit("removed")),
        F.when(~same, F.lit("renamed")),
        F.when(F.col("old_field").isNotNull() & F.col("new_field").isNotNull() & (F.col("old.kind") != F.col("new.kind")), F.lit("type_changed")),
    ))
    return both.select("statement_id", F.explode(what).alias("change"), F.coalesce("old_field", F.lit("")).alias("old_field"), F.coalesce("new_field", F.lit("")).alias("new_field")).distinct()


def alike(both: DataFrame) -> DataFrame:
    """statement_id, lost, gained (roles), old_field, old: fields with names no rule knows of which one file lost one and the
    next gained one that hold the same: one kind, filled alike (a fifth apart at most), as long (a quarter apart at most), and no
    other pair of the two files is so."""
    unknown = both.where(F.col("role").startswith("other:"))
    lost = unknown.where("new_field is null").select("statement_id", F.col("role").alias("lost"), "old_field", "old")
    gained = unknown.where("old_field is null").select("statement_id", F.col("role").alias("gained"), "new")
    near = (F.col("old.kind") == F.col("new.kind")) & (F.abs(F.col("old.filled") - F.col("new.filled")) <= 0.2) & (F.abs(F.col("old.length") - F.col("new.length")) <= 0.25 * F.greatest("old.length", "new.length"))
    met = lost.join(gained, "statement_id").where(near)
    alone = met.groupBy("statement_id").agg(F.count("*").alias("n")).where("n = 1")
    return met.join(alone.select("statement_id"), "statement_id").select("statement_id", "lost", "gained", "old_field", "old")
