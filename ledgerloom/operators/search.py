"""Case search: predicates put together from optional filters, summaries, pages, classifiers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CASH_WORDS = ("CASH", "ATM", "WITHDRAWAL", "CHQ")
#: Fixed values, in order of precedence: the words of a description that tell a payment's type.
TYPE_WORDS = (
    ("NEFT", ("NEFT", "NATIONAL ELECTRONIC FUND TRANSFER")),
    ("RTGS", ("RTGS", "REAL TIME GROSS SETTLEMENT", "REAL-TIME")),
    ("IMPS", ("IMPS", "IMMEDIATE PAYMENT")),
    ("UPI", ("UPI", "UNIFIED PAYMENTS INTERFACE", "@", "UPI/")),
    ("CHQ", ("CHEQUE", "CHQ", "CHEQUE NO", "CHEQUE NO.", "CHQ NO")),
    ("CASH", ("CASH", "ATM", "WITHDRAWAL", "DEPOSIT")),
    ("DD", ("DEMAND DRAFT", "DD", "DD NO", "DD NO.")),
    ("MOB", ("MOBILE", "MOB", "MOBILE BANKING")),
    ("NET", ("NET BANKING", "NETBANKING", "INTERNET BANKING", "ONLINE")),
    ("CARD", ("CARD", "DEBIT CARD", "CREDIT CARD", "ATM CARD")),
    ("WIRE", ("WIRE", "WIRE TRANSFER")),
    ("ACH", ("ACH", "AUTOMATIC CLEARING HOUSE")),
    ("SWIFT", ("SWIFT", "MT103", "MT202")),
)
#: What tells the type of a transfer that names none.
TRANSFER_WORDS, TRANSFER_TYPES = ("TRANSFER", "TRF"), (("IMPS", ("IMMEDIATE", "INSTANT")), ("RTGS", ("REAL", "GROSS")))


def has_word(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of the words, whatever its case; words are taken literally."""
    return text.rlike("(?i)" + "|".join(re.escape(w) for w in words))


def payment_type(text: Column) -> Column:
    """The type of the first word list that a description holds, in order of precedence; a transfer that none fits may tell its
    type by other words; OTHER for anything else, empty and null."""
    up = F.upper(F.coalesce(text, F.lit("")))
    holds = lambda words: up.rlike("|".join(re.escape(w) for w in words))
    chain = None
    for name, words in TYPE_WORDS:
        chain = F.when(holds(words), name) if chain is None else chain.when(holds(words), name)
    for name, words in TRANSFER_TYPES:
        chain = chain.when(holds(TRANSFER_WORDS) & holds(words), name)
    return chain.otherwise("OTHER")


#: The same rule in SQL, written out by itself.
TYPE_SQL = """CASE WHEN contains(u, 'NEFT') OR contains(u, 'NATIONAL ELECTRONIC FUND TRANSFER') THEN 'NEFT' WHEN contains(u, 'RTGS') OR contains(u, 'REAL TIME GROSS SETTLEMENT') OR contains(u, 'REAL-TIME') THEN 'RTGS'
 WHEN contains(u, 'IMPS') OR contains(u, 'IMMEDIATE PAYMENT') THEN 'IMPS' WHEN contains(u, 'UPI') OR contains(u, 'UNIFIED PAYMENTS INTERFACE') OR contains(u, '@') THEN 'UPI' WHEN contains(u, 'CHEQUE') OR contains(u, 'CHQ') THEN 'CHQ'
 WHEN contains(u, 'CASH') OR contains(u, 'ATM') OR contains(u, 'WITHDRAWAL') OR contains(u, 'DEPOSIT') THEN 'CASH' WHEN contains(u, 'DEMAND DRAFT') OR contains(u, 'DD') THEN 'DD' WHEN contains(u, 'MOB') THEN 'MOB'
 WHEN contains(u, 'NET BANKING') OR contains(u, 'NETBANKING') OR contains(u, 'INTERNET BANKING') OR contains(u, 'ONLINE') THEN 'NET' WHEN contains(u, 'CARD') THEN 'CARD' WHEN contains(u, 'WIRE') THEN 'WIRE' WHEN contains(u, 'ACH') OR contains(u, 'AUTOMATIC CLEARING HOUSE') THEN 'ACH'
 WHEN contains(u, 'SWIFT') OR contains(u, 'MT103') OR contains(u, 'MT202') THEN 'SWIFT' WHEN (contains(u, 'TRANSFER') OR contains(u, 'TRF')) AND (contains(u, 'IMMEDIATE') OR contains(u, 'INSTANT')) THEN 'IMPS' WHEN (contains(u, 'TRANSFER') OR contains(u, 'TRF')) AND (contains(u, 'REAL') OR contains(u, 'GROSS')) THEN 'RTGS' ELSE 'OTHER' END"""


def type_sql(column: str) -> str:
    return re.sub(r"\bu\b", f"upper(coalesce({column}, ''))", TYPE_SQL)


def label(counterparty: Column, description: Column) -> Column:
    """A counterparty's label: its name, else the description, else 'Unknown'; an empty text counts as none."""
    return F.coalesce(F.nullif(counterparty, F.lit("")), F.nullif(description, F.lit("")), F.lit("Unknown"))


def search(
    df: DataFrame, *, entity_ids: Sequence[str] | None = None, account_ids: Sequence[str] | None = None, date_from: str | None = None, date_to: str | None = None,
    amount_min: float | None = None, amount_max: float | None = None, direction: str | None = None, status: str | None = None, description: str | None = None,
    counterparty: str | None = None, any_text: str | None = None, any_entity_ids: Sequence[str] | None = None,
) -> DataFrame:
    """The rows that meet all given filters and one of the ``any_`` ones, if any is given. Dates are inclusive.

    status 'Failed' is a blank counterparty, 'Success' any other. Texts match as parts, whatever their case. A null value
    meets no filter on its column.
    """
    tests: list[Column] = []
    part = lambda c, x: F.contains(F.lower(F.col(c)), F.lit(x.lower()))
    if entity_ids is not None:
        tests.append(F.col("entity_id").isin(list(entity_ids)))
    if account_ids is not None:
        tests.append(F.col("account_id").isin(list(account_ids)))
    if date_from:
        tests.append(F.col("DATE") >= F.lit(date_from).cast("date"))
    if date_to:
        tests.append(F.col("DATE") < F.date_add(F.lit(date_to).cast("date"), 1))
    if amount_min is not None:
        tests.append(F.col("amount") >= amount_min)
    if amount_max is not None:
        tests.append(F.col("amount") <= amount_max)
    if direction:
        tests.append(F.col("direction") == direction)
    if status:
        blank = F.trim(F.coalesce("counterparty", F.lit(""))) == ""
        tests.append(blank if status == "Failed" else ~blank)
    if description:
        tests.append(part("DESCRIPTION", description))
    if counterparty:
        tests.append(part("counterparty", counterparty))
    either: list[Column] = []
    if any_text:
        either += [part("DESCRIPTION", any_text), part("counterparty", any_text), F.contains(F.lower(F.col("transaction_id").cast("string")), F.lit(any_text.lower()))]
    if any_entity_ids is not None:
        either.append(F.col("entity_id").isin(list(any_entity_ids)))
    if either:
        whole = either[0]
        for e in either[1:]:
            whole = whole | e
        tests.append(whole)
    for t in tests:
        df = df.where(t)
    return df


def summary(df: DataFrame) -> DataFrame:
    """total_count and total_amount of a search; 0 and 0 for no rows."""
    return df.agg(F.count("*").alias("total_count"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """The rows of one page, counted from 0. The order must be total: the page then is the same each time."""
    return df.orderBy(*order).offset(number * size).limit(size)


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key, the last in order: what upserts leave."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def renamed(df: DataFrame, pairs: Sequence[tuple[str, str]], column: str = "counterparty") -> DataFrame:
    """df with a column's values renamed by pairs, one after the other, so that renames chain in their order."""
    final: dict[str, str] = {}
    for old, new in pairs:
        for k, v in list(final.items()):
            if v == old:
                final[k] = new
        final[old] = new
    if not final:
        return df
    mapping = F.create_map(*[F.lit(x) for kv in final.items() for x in kv])
    return df.withColumn(column, F.coalesce(mapping[F.col(column)], F.col(column)))
