"""Dates and instants written in mixed notations.

``with_instant`` reads a text column into one instant in UTC. All of it is built-in column expressions, so it stays in
whole-stage code generation; the plain notation, by far the most frequent, is decided by the first test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zone abbreviations and their offsets from UTC in minutes (IST is India's).
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "GST": 240, "PKT": 300, "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540,
    "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"

_CLOCK = r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)"
_TAIL = r"(?: ?(AM|PM|am|pm))?(?: ?(Z|[A-Z]{3,4}|[+-]\d{2}:?\d{2}))?"
PLAIN = r"^\d{4}-\d{2}-\d{2}$"
ISO = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[ T]{_CLOCK}{_TAIL}$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?$"
FIGURES = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:[ T]{_CLOCK}{_TAIL})?$"
DAY_NAMED = rf"^(?:[A-Za-z]{{3,9}}, )?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})[ -](\d{{4}}|\d{{2}})(?:[ T]{_CLOCK}{_TAIL})?$"
MONTH_NAMED = rf"^([A-Za-z]{{3,9}}) (\d{{1,2}}), (\d{{4}})(?:[ T]{_CLOCK}{_TAIL})?$"
SLASHED = rf"^(\d{{4}})([/.])(\d{{1,2}})\2(\d{{1,2}})(?:[ T]{_CLOCK}{_TAIL})?$"

DAY = 86_400_000_000


def month_number(name: Column) -> Column:
    """1 to 12 for an English month name or its first letters, else null."""
    at = F.instr(F.lit(MONTHS), F.upper(F.substring(name, 1, 3)))
    return F.when((at > 0) & (F.pmod(at - 1, F.lit(3)) == 0), ((at - 1) / 3 + 1).cast("int"))


def _parts(t: Column, order: Column) -> Column:
    """The text as 'y-m-d|clock|AM or PM|zone', or 'epoch|microseconds||'; a text of no notation stays without bars.

    A chain of anchored replacements, one a notation: what one has rewritten holds a bar, so no later one fits it.
    """
    mdy = F.coalesce(order, F.lit("DMY")) == "MDY"
    put = lambda pattern, to: F.regexp_replace(out, F.lit(pattern), to if isinstance(to, Column) else F.lit(to))
    out = t
    out = put(ISO, "$1-$2-$3|$4|$5|$6")
    out = put(FIGURES, F.when(mdy, "$4-$1-$3|$5|$6|$7").otherwise("$4-$3-$1|$5|$6|$7"))
    out = put(DAY_NAMED, "$3-$2-$1|$4|$5|$6")
    out = put(MONTH_NAMED, "$3-$1-$2|$4|$5|$6")
    out = put(COMPACT, "$1-$2-$3|$4:$5:$6||$7")
    out = put(SLASHED, "$1-$3-$4|$5|$6|$7")
    figures = F.length(t)
    bare = (
        F.when(figures == 8, F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.concat(F.substring(t, 7, 2), F.lit("|||"))))
        .when(figures == 5, F.concat(F.date_add(F.lit("1899-12-30").cast("date"), t.try_cast("int")).cast("string"), F.lit("|||")))
        .when(figures == 10, F.concat(F.lit("epoch|"), t, F.lit("000000||")))
        .when(figures == 13, F.concat(F.lit("epoch|"), t, F.lit("000||")))
        .when(figures == 16, F.concat(F.lit("epoch|"), t, F.lit("||")))
    )
    return F.when(t.rlike(r"^\d+$"), bare).otherwise(out)


def _date(text: Column) -> Column:
    """y-m-d with a month in figures and a year of four."""
    y, m, d = F.substring_index(text, "-", 1), F.substring_index(F.substring_index(text, "-", 2), "-", -1), F.substring_index(text, "-", -1)
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    month = F.when(m.rlike("^[A-Za-z]"), month_number(m).cast("string")).otherwise(m)
    return F.concat(year, F.lit("-"), month, F.lit("-"), d)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns added behind a generator, so that no later filter or projection inlines and repeats them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_instant(df: DataFrame, text: str, zone: Column, order: Column, prefix: str = "at_") -> DataFrame:
    """Adds {prefix}utc_micros, {prefix}day, {prefix}has_clock, {prefix}has_zone and {prefix}plain for the text column.

    A value without a zone is read in ``zone`` (UTC where null); a date alone is its midnight there; a clock time that
    occurs twice or never is read with the offset in force before the change. ``order`` (DMY or MDY, DMY where null)
    decides dates of figures only. {prefix}day is the instant's date in ``zone``. Null, empty and unreadable texts
    give null in all but {prefix}plain, which is false.
    """
    zone = F.coalesce(zone, F.lit("UTC"))
    names = df.columns
    out = df.withColumns({"_t": F.trim(F.col(text)), "_zone": zone, "_order": order})
    out = once(out, _parts=F.split(F.when(F.col("_t").rlike(PLAIN), F.concat("_t", F.lit("|||"))).otherwise(_parts(F.col("_t"), F.col("_order"))), r"\|"))
    part = lambda k: F.when(F.size("_parts") == 4, F.get(F.col("_parts"), F.lit(k)))
    out = once(out, _p0=part(0), _p1=part(1), _p2=part(2), _p3=part(3))
    p = lambda k: F.col(f"_p{k}")
    clock = F.when(p(1) == "", "00:00:00").when(F.length(p(1)) <= 5, F.concat(p(1), F.lit(":00"))).otherwise(p(1))
    hour = F.substring_index(p(1), ":", 1).try_cast("int")
    mark = F.upper(p(2))
    half = F.when((mark == "PM") & (hour < 12), 12).when((mark == "AM") & (hour == 12), -12).otherwise(0)
    fits = (mark == "") | hour.between(1, 12)
    epoch = p(0) == "epoch"
    local = F.concat(_date(p(0)), F.lit(" "), clock, F.lit("Z")).try_cast("timestamp")
    digits = F.regexp_replace(p(3), "[^0-9]", "")
    sign = F.when(F.substring(p(3), 1, 1) == "-", -1).otherwise(1)
    named = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    offset = F.when(digits != "", sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))).otherwise(named[p(3)])
    out = once(out, _local=F.when(~epoch & fits, F.unix_micros(local) + half.cast("long") * 3_600_000_000), _off=F.when(p(3) != "", offset.cast("long")))
    own = F.coalesce(p(3), F.lit("")) != ""
    utc = (
        F.when(epoch, p(1).try_cast("long"))
        .when(own, F.col("_local") - F.col("_off") * 60_000_000)
        .otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_local"), F.col("_zone"))))
    )
    out = once(out, **{f"{prefix}utc_micros": utc})
    micros = F.col(f"{prefix}utc_micros")
    in_zone = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), F.col("_zone")))
    day = F.when(epoch | own, in_zone).otherwise(F.col("_local"))
    out = out.withColumns({
        f"{prefix}day": F.when(micros.isNotNull(), F.date_from_unix_date(F.floor(day / DAY).cast("int"))),
        f"{prefix}has_clock": F.when(micros.isNotNull(), epoch | (p(1) != "")),
        f"{prefix}has_zone": F.when(micros.isNotNull(), epoch | own),
        f"{prefix}plain": F.coalesce(F.col("_t").rlike(PLAIN), F.lit(False)),
    })
    return out.select(*names, *[f"{prefix}{x}" for x in ("utc_micros", "day", "has_clock", "has_zone", "plain")])
