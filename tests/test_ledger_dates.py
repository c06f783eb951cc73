"""Searches of the store's ledger by date, where dates are in any notation: brute force over a small folder."""

import datetime as dt

from ledgerloom.plans import registry

#: tx_date, zone and day order of its file, and the day it is there; None: it can't be read.
DATES = [
    ("2023-06-01", "Asia/Kolkata", "DMY", "2023-06-01"),
    (" 2024-06-30 ", "UTC", "DMY", "2024-06-30"),
    ("30/06/2024", "UTC", "DMY", "2024-06-30"),
    ("06/07/2023", "UTC", "MDY", "2023-06-07"),
    ("06/07/2023", "UTC", None, "2023-07-06"),
    ("01-Jun-23", None, None, "2023-06-01"),
    ("June 30, 2024", "UTC", None, "2024-06-30"),
    ("30 Jun 2024 11:30 PM", "Asia/Kolkata", "DMY", "2024-06-30"),
    # an instant of its own zone falls on another day in the file's
    ("2024-06-30T23:30:00Z", "Asia/Kolkata", "DMY", "2024-07-01"),
    ("2023-06-01T02:00:00Z", "America/New_York", "DMY", "2023-05-31"),
    ("1718961040", "Asia/Kolkata", "DMY", "2024-06-21"),
    ("45408", "UTC", "DMY", "2024-04-26"),
    ("20230531", "UTC", "DMY", "2023-05-31"),
    ("2024-07-01", "UTC", "DMY", "2024-07-01"),
    ("31/12/2024", "UTC", "DMY", "2024-12-31"),
    ("1 Jan 2025", "UTC", "DMY", "2025-01-01"),
    ("2023-02-30", "UTC", "DMY", None),
    ("30 Feb 2024", "UTC", "DMY", None),
    ("pending", "UTC", "DMY", None),
    (None, "UTC", "DMY", None),
]


def folder(spark, path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    put("bank_statements", [(f"s{k}", z or "UTC", o, dt.datetime(2025, 2, 1)) for k, (_, z, o, _) in enumerate(DATES) if z], "statement_id string, zone_name string, day_order string, upload_date timestamp")
    put("entities", [("e", "Anil Patel", "person")], "entity_id string, entity_name string, entity_type string")
    put("accounts", [("a", "1", "Anil", "Bank")], "account_id string, account_number string, account_name string, bank_name string")
    rows = [(f"t{k}", "a", "e", f"s{k}", t, "UPI/PAY", 2000.0, "DR", "Shop", None, 1) for k, (t, *_) in enumerate(DATES)]
    put("transactions", rows, "transaction_id string, account_id string, entity_id string, statement_id string, tx_date string, description string, amount double, direction string, counterparty_merged string, balance double, original_index int")
    return str(path)


def test_searches_by_date_find_every_notation(spark, tmp_path):
    at, queries = folder(spark, tmp_path / "in"), registry.queries()
    for name, low, high in (("s01_ledger_scan", "2023-06-01", "2024-06-30"), ("pred_p09_case_search", "2023-01-01", "2024-12-31")):
        got = {r.transaction_id: r.tx_day for r in queries[name](spark, at).collect()}
        assert got == {f"t{k}": day for k, (*_, day) in enumerate(DATES) if day and low <= day <= high}, name


def test_rows_without_a_readable_date_stay_in_the_ledger(spark, tmp_path):
    at, queries = folder(spark, tmp_path / "in"), registry.queries()
    assert queries["s03_standardise"](spark, at).count() == len(DATES)
    assert queries["j01_ledger_join"](spark, at).first().n == len(DATES)
