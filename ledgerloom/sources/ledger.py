"""The canonical ledger, and its forms over the tables of a data folder.

Columns: transaction_id, entity_id, account_id, DATE, DESCRIPTION, amount, direction, DEBIT, CREDIT, counterparty, balance,
original_index. The total order of a ledger is (DATE, original_index, transaction_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.instants import with_days
from ledgerloom.sources.tables import table

REQUIRED = {"DATE": "timestamp", "DEBIT": "double", "CREDIT": "double", "DESCRIPTION": "string"}
DESCRIPTIONS = {"purchase": "UPI/PAY", "view": "ATM WITHDRAWAL", "error": "CHQ RETURN", "signup": "NEFT CR", "click": "CASH DEPOSIT"}


def debit_credit(amount: Column, direction: Column) -> tuple[Column, Column]:
    """DEBIT and CREDIT of an amount: the side of its direction, 0 on the other (and on both for another direction or a null)."""
    side = lambda d: F.when(direction == d, F.coalesce(amount, F.lit(0.0))).otherwise(F.lit(0.0))
    return side("DR"), side("CR")


def standardised(df: DataFrame) -> DataFrame:
    """The canonical columns: null texts become empty, null balances and positions 0; extra columns stay as they are."""
    debit, credit = debit_credit(F.col("amount"), F.col("direction"))
    return df.withColumns({
        "DEBIT": debit, "CREDIT": credit, "DESCRIPTION": F.coalesce("DESCRIPTION", F.lit("")), "counterparty": F.coalesce("counterparty", F.lit("")),
        "balance": F.coalesce("balance", F.lit(0.0)), "original_index": F.coalesce("original_index", F.lit(0)),
    })


def backfilled(df: DataFrame) -> DataFrame:
    """df with every required column: absent ones get a typed default, others are cast where their text allows it, else default."""
    default = {"timestamp": F.lit(None).cast("timestamp"), "double": F.lit(0.0), "string": F.lit("")}
    return df.withColumns({c: F.coalesce(F.col(c).try_cast(t), default[t]) if c in df.columns else default[t] for c, t in REQUIRED.items()})


def event_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The events as per-user ledgers with real timestamps: whole table, one row an event."""
    e = table(spark, folder, "events")
    text = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])[F.col("event_type")]
    k = F.regexp_extract("props", r'"k": *(\d+)', 1)
    raw = e.select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("entity_id"), F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp").alias("DATE"),
        text.alias("DESCRIPTION"), F.round(F.col("value") * 1000, 2).alias("amount"), F.when(F.col("event_type").isin("signup", "click"), "CR").otherwise("DR").alias("direction"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("CP_"), k)).alias("counterparty"), F.lit(None).cast("double").alias("balance"), F.col("event_id").alias("original_index"),
    )
    return standardised(raw)


def store_ledger(spark: SparkSession, folder: str, dated: bool = True) -> DataFrame:
    """The transactions of the store joined with their entities and accounts.

    DATE is the row's day in its file's zone, whatever its notation, and null where tx_date can't be read; without
    ``dated`` it is left out, and no date is read.
    """
    t, e, a = (table(spark, folder, n) for n in ("transactions", "entities", "accounts"))
    columns = {
        "transaction_id": F.col("transaction_id"), "entity_id": F.col("entity_id"), "account_id": F.col("account_id"), "statement_id": F.col("statement_id"), "DESCRIPTION": F.col("description"),
        "amount": F.col("amount").cast("double"), "direction": F.col("direction"), "counterparty": F.col("counterparty_merged"), "balance": F.col("balance").cast("double"), "original_index": F.col("original_index"),
    }
    if dated:
        t = with_days(t, table(spark, folder, "bank_statements"), *columns.values()).toDF(*columns, "DATE")
    else:
        t = t.select(*[c.alias(n) for n, c in columns.items()])
    e = e.select("entity_id", "entity_name", "entity_type")
    a = a.select("account_id", "account_number", "account_name", "bank_name")
    return standardised(t.join(e, "entity_id").join(a, "account_id"))


#: The same ledgers in SQL, for the oracle; T in the second are the transactions with the day of their date.
EVENT_SQL = """L AS (SELECT event_id AS transaction_id, user_id AS entity_id, ts AS d, event_id AS oi,
 CASE event_type WHEN 'purchase' THEN 'UPI/PAY' WHEN 'view' THEN 'ATM WITHDRAWAL' WHEN 'error' THEN 'CHQ RETURN' WHEN 'signup' THEN 'NEFT CR' ELSE 'CASH DEPOSIT' END AS descr,
 round(value * 1000, 2) AS amount, CASE WHEN event_type IN ('signup','click') THEN 'CR' ELSE 'DR' END AS direction,
 CASE WHEN event_type = 'error' THEN '' ELSE 'CP_' || regexp_extract(props, '"k": *([0-9]+)', 1) END AS cp,
 CASE WHEN event_type IN ('signup','click') THEN 0.0 ELSE round(value * 1000, 2) END AS debit,
 CASE WHEN event_type IN ('signup','click') THEN round(value * 1000, 2) ELSE 0.0 END AS credit FROM events)"""
STORE_SQL = """S AS (SELECT t.transaction_id, t.entity_id, t.account_id, t.statement_id,
 t.day AS d, coalesce(t.description, '') AS descr,
 CAST(t.amount AS DOUBLE) AS amount, t.direction, coalesce(t.counterparty_merged, '') AS cp, coalesce(CAST(t.balance AS DOUBLE), 0.0) AS balance, coalesce(t.original_index, 0) AS oi,
 e.entity_name, e.entity_type, a.account_number, a.account_name, a.bank_name,
 CASE WHEN t.direction = 'DR' THEN CAST(t.amount AS DOUBLE) ELSE 0.0 END AS debit, CASE WHEN t.direction = 'CR' THEN CAST(t.amount AS DOUBLE) ELSE 0.0 END AS credit
 FROM T t JOIN entities e USING (entity_id) JOIN accounts a ON a.account_id = t.account_id)"""
