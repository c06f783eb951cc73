"""Text functions: name and amount normalisers, similarity, directions, tables in HTML, patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The endings that a name loses, one after the other in this order.
SUFFIXES = ("ltd", "limited", "pvt", "private", "inc", "incorporated", "llp", "llc", "corp", "corporation", "co", "company")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_name(name: Column) -> Column:
    """Lower case without legal endings, signs and repeated blanks: each ending goes once, in the order of SUFFIXES."""
    out = F.lower(F.trim(name))
    for s in SUFFIXES:
        out = F.regexp_replace(out, rf"\s{s}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\w\s]", " "), r"\s+", " "))


def plain_name_sql(column: str) -> str:
    out = f"lower(trim({column}))"
    for s in SUFFIXES:
        out = f"regexp_replace({out}, '\\s{s}$', '')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def compared_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def first_word(name: Column) -> Column:
    """The first word without signs at its ends."""
    return F.regexp_replace(F.split(F.lower(F.trim(name)), r"\s+")[0], r"^[^a-z0-9]+|[^a-z0-9]+$", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for equal texts, 0 if one is empty or null."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def lenient_amount(text: Column) -> Column:
    """The number a text begins with once currency signs, commas and other characters are gone; brackets make it negative; 0 for none."""
    t = F.trim(text)
    bracketed = t.rlike(r"^\(.*\)$")
    digits = F.regexp_extract(F.regexp_replace(t, r"[^0-9.\-]", ""), r"^-?\d*\.?\d*", 0)
    value = F.coalesce(digits.try_cast("double"), F.lit(0.0))
    return F.when(bracketed, -F.abs(value)).otherwise(value)


def lenient_number(text: Column) -> Column:
    """A currency text as a double; 0 where it is none."""
    return F.coalesce(F.regexp_replace(text, "[,₹]", "").try_cast("double"), F.lit(0.0))


def direction(text: Column) -> Column:
    """DR or CR of a word for a side, null where neither is told."""
    t = F.upper(F.trim(text))
    debit = t.isin("DR", "DEBIT", "D") | t.contains("WITHDRAW") | t.rlike(r"\b(DR|DEBIT)\b")
    credit = t.isin("CR", "CREDIT", "C") | t.contains("DEPOSIT") | t.contains("RECEIV") | t.rlike(r"\b(CR|CREDIT)\b")
    return F.when(debit, "DR").when(credit, "CR")


def without_tags(html: Column) -> Column:
    """A text without tags, its entities decoded, blanks collapsed."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def table_rows(html: Column) -> Column:
    """The rows of HTML tables: an array of arrays of cell texts."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), without_tags))


def usable(patterns: Sequence[str]) -> list[str]:
    """The patterns that compile and hold a group, flags in them taken off: user patterns, checked before they meet a row."""
    out = []
    for p in patterns:
        p = re.sub(r"\(\?[imsux]+\)", "", p)
        try:
            if re.compile(p).groups:
                out.append(p)
        except re.error:
            continue
    return out


def first_capture(text: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern, in order, whose group isn't blank, over the text in lower case; null for none."""
    low = F.lower(text)
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(low, p, 1)), F.lit("")) for p in usable(patterns)], F.lit(None).cast("string"))


#: Usual names of statement columns, the most specific first.
WANTED = {
    "DATE": ("DATE", "TXN DATE", "TRANSACTION DATE", "VALUE DATE", "POSTING DATE", "TXN_DATE", "TRANSACTION_DATE", "VALUE_DATE", "POSTING_DATE"),
    "DESCRIPTION": ("DESCRIPTION", "PARTICULARS", "NARRATION", "DETAILS", "TRANSACTION DETAILS", "TXN DETAILS", "TRANSACTION_DETAILS", "TXN_DETAILS"),
    "DEBIT": ("DEBIT", "DR", "DEBIT AMOUNT", "WITHDRAWAL", "OUTGOING", "DEBIT_AMOUNT", "DR_AMOUNT"),
    "CREDIT": ("CREDIT", "CR", "CREDIT AMOUNT", "DEPOSIT", "INCOMING", "CREDIT_AMOUNT", "CR_AMOUNT"),
    "AMOUNT": ("AMOUNT", "TRANSACTION AMOUNT", "TXN AMOUNT", "TRANSACTION_AMOUNT", "TXN_AMOUNT"),
    "DIRECTION": ("DR/CR", "DR - CR", "DR CR", "CR/DR", "CREDIT/DEBIT", "DEBIT/CREDIT", "TYPE", "TRANSACTION TYPE", "TXN TYPE", "DR_CR", "DRCR"),
}
#: Names that hold DATE and are none.
NO_DATES = ("NO_DATE", "UPDATE_DATE", "CREATE_DATE")


def _stands(name: str, column: str, wanted: str) -> bool:
    """Whether a header in upper case may stand for a wanted name: a date by any name that holds the word, others by the name within other signs."""
    if column == "DATE":
        return "DATE" in name and (name.endswith(" DATE") or name.startswith("DATE ") or not any(x in name for x in NO_DATES))
    return re.search(rf"(?<![A-Z0-9]){re.escape(wanted)}(?![A-Z0-9])", name) is not None


def parts(names: Sequence[str]) -> dict[str, str]:
    """The header that stands for each wanted column: of equal names the first wanted one, else the first that may stand for it."""
    upper = [(n, n.upper().strip()) for n in names]
    found: dict[str, str] = {}
    for column, wanted in WANTED.items():
        tests = [lambda n, w: n == w, lambda n, w, c=column: _stands(n, c, w)]
        hit = next((raw for test in tests for w in wanted for raw, n in upper if test(n, w)), None)
        if hit is not None:
            found[column] = hit
    return found


def header_mapping(names: Sequence[str]) -> tuple[bool, list[str], dict[str, str]]:
    """Whether a header suffices (date, description, and debit with credit or an amount), what it lacks, and the mapping."""
    found = parts(names)
    lacking = [c for c in ("DATE", "DESCRIPTION") if c not in found] + [c for c in ("DEBIT", "CREDIT") if c not in found and "AMOUNT" not in found]
    return not lacking, lacking, found
