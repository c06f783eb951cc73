"""Rejected records, instants, drift and trailing periods, against brute force."""

import datetime as dt
import random
from decimal import Decimal
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.dates import with_instant
from ledgerloom.operators import drift, instants, rejects, rolling
from ledgerloom.sources.headers import roles_of

LINES = "line_id long, statement_id string, line_no int, raw_text string, zone string"


def lines(spark, *texts, statement="f", start=1):
    return spark.createDataFrame([(start + k, statement, k + 1, t, "extra") for k, t in enumerate(texts)], LINES)


HEAD = "Date,Description,Debit,Credit,Balance"
CASES = [
    ("2024-01-01,plain,5.00,,1", None),
    ('2024-01-01,"a ""b"" c",,"1,00,000.50",1', None),
    ('2024-01-01,"two\nlines",5,,1\r', None),
    ('2024-01-01,7" pipes,+5,0.00,1', None),
    ("2024-01-01,x,₹ 5,,1", None),
    ("2024-01-01,x, Rs. 5 ,,1", None),
    ('2024-01-01,"open,5,,1', "quoting"),
    ('2024-01-01,"closed"x,5,,1', "quoting"),
    ('2024-01-01,"open,too', "quoting"),
    ("2024-01-01,x,5,,1,", "column_count"),
    ("2024-01-01,x", "column_count"),
    ("", "column_count"),
    (None, "column_count"),
    ("2024-01-01,x,-5,,1", "invalid_value"),
    ("2024-01-01,x,five,,1", "invalid_value"),
    ("2024-01-01,x,0.00,,1", "invalid_value"),
    ("2024-01-01,x,1..2,,1", "invalid_value"),
    ("2024-01-01,  ,5,,1", "invalid_value"),
    ('2024-01-01,"after, all",5,,1', None),
]


def test_reasons(spark):
    got = {r.line_id: r.reason for r in rejects.checked(lines(spark, HEAD, *[c for c, _ in CASES])).collect()}
    assert [got[k + 2] for k in range(len(CASES))] == [r for _, r in CASES]


def test_no_header_empty_and_unknown_width(spark):
    df = spark.createDataFrame([(1, "a", 2, "1,2", ""), (2, None, 2, '"x', ""), (3, "b", 1, '"broken', ""), (4, "b", 2, "1", "")], LINES)
    assert {r.line_id: r.reason for r in rejects.checked(df).collect()} == {1: "column_count", 2: "quoting", 4: "column_count"}
    assert rejects.rejects(df.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='ab15.₹",\n -', max_size=14), min_size=1, max_size=25), st.sampled_from([("date",), ("debit", "credit"), ("description", "debit", "credit"), ("x", "amount", "description")]))
def test_the_reader_and_the_check_after_it_agree_with_plain_rules(texts, roles):
    for text, got in zip(texts, rejects.judged(texts, [roles] * len(texts)), strict=True):
        want = rejects.exact(rejects.trimmed(text), roles)
        assert (got[0], got[2]) == (want[0], want[2]), text


def test_the_reject_table_decides(monkeypatch):
    """What the reader says is what comes out, for records it can tell: another verdict of the reader is another result."""
    roles = ("description", "debit", "credit")
    texts = ["a,1,", "a,1", "a,1,2,3", '"a"b,1,2', "a,x,2", "b,1,0"]
    plain = [r for r, _, _ in rejects.judged(texts, [roles] * 6)]
    assert plain == [None, "column_count", "column_count", "quoting", "invalid_value", None]
    good, bad = rejects.read_batch([(i, t, roles) for i, t in enumerate(texts)])
    assert bad == {1: "MISSING COLUMNS", 2: "TOO MANY COLUMNS", 3: "UNQUOTED VALUE"} and good[4][1] == "debit is no amount"
    monkeypatch.setattr(rejects, "_scan", lambda con, rows, width: ({5: (["b", "1", "0"], "told so")}, {n: "UNQUOTED VALUE" for n, _, _ in rows if n != 5}))
    assert [r for r, _, _ in rejects.judged(texts, [roles] * 6)] == [None, "quoting", "quoting", "quoting", "quoting", "invalid_value"]


def test_a_record_that_the_reader_gives_up_on_hides_no_other():
    texts = ["a", 'b"\r"', "c,d", '\r\r"', "e"]
    assert [r for r, _, _ in rejects.judged(texts, [("x",)] * 5)] == [None, None, "column_count", None, None]


def test_roles():
    assert roles_of(["Value Date", "Narration", "Dr Amount", "Paid In", "Closing"]) == ["date", "description", "debit", "credit", "balance"]
    assert roles_of(["Tran Dt", "Val Dt", "Txn_Text", "Payments", "Receipts", "Sol Id", "TXN_UID", "Mode", "Zzz"]) == ["date", "value_date", "description", "debit", "credit", "branch", "txn_id", "channel", "other:zzz"]
    assert roles_of(["Credit", "Cr Amount"]) == ["credit", "credit#2"]


DATES = [
    ("2024-03-10", "Asia/Kolkata", "DMY", "2024-03-09T18:30:00"),
    ("10/03/2024", "UTC", "DMY", "2024-03-10T00:00:00"),
    ("10/03/2024", "UTC", "MDY", "2024-10-03T00:00:00"),
    ("3.6.2024", "Europe/Berlin", "DMY", "2024-06-02T22:00:00"),
    ("10-Mar-24", "UTC", None, "2024-03-10T00:00:00"),
    ("March 1, 2024", "UTC", None, "2024-03-01T00:00:00"),
    ("08/04/24 14:00", "Europe/Berlin", "DMY", "2024-04-08T12:00:00"),
    ("01 Apr 2023 12:46 AM", "UTC", None, "2023-04-01T00:46:00"),
    ("01 Apr 2023 12:46 PM", "UTC", None, "2023-04-01T12:46:00"),
    ("Fri, 01 Dec 2023 06:13:59 GMT", "Asia/Kolkata", None, "2023-12-01T06:13:59"),
    ("2024-05-06T11:53:54.931-04:00", "UTC", None, "2024-05-06T15:53:54.931"),
    ("2024-03-31 03:21:06 +0200", "UTC", None, "2024-03-31T01:21:06"),
    ("2023-11-27 13:46:09 IST", "UTC", None, "2023-11-27T08:16:09"),
    ("20240506T113914Z", "Asia/Kolkata", None, "2024-05-06T11:39:14"),
    ("20240506", "UTC", None, "2024-05-06T00:00:00"),
    ("45408", "UTC", None, "2024-04-26T00:00:00"),
    ("1718961040", "Asia/Kolkata", None, "2024-06-21T09:10:40"),
    ("1712158261763", "UTC", None, "2024-04-03T15:31:01.763"),
    ("1711543708819434", "UTC", None, "2024-03-27T12:48:28.819434"),
    # occurs twice: the offset before the change; never: the same
    ("2024-11-03 01:30:00", "America/New_York", None, "2024-11-03T05:30:00"),
    ("2024-03-10 02:30:00", "America/New_York", None, "2024-03-10T07:30:00"),
    ("30 Feb 2024", "UTC", None, None),
    ("31/02/2024", "UTC", "DMY", None),
    ("13/13/2024", "UTC", "DMY", None),
    ("pending", "UTC", None, None),
    ("", "UTC", None, None),
    (None, None, None, None),
]


def test_notations(spark):
    df = spark.createDataFrame([(k, a, b, c) for k, (a, b, c, _) in enumerate(DATES)], "k int, t string, z string, o string")
    got = {r.k: r.at_utc_micros for r in with_instant(df, "t", F.col("z"), F.col("o")).collect()}
    for k, (text, *_, want) in enumerate(DATES):
        micros = None if want is None else (dt.datetime.fromisoformat(want).replace(tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
        assert got[k] == micros, text


def test_local_times_against_zoneinfo(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(300):
        zone = rnd.choice(["Asia/Kolkata", "America/New_York", "Europe/London", "Australia/Sydney"])
        rows.append((k, (dt.datetime(2023, 1, 1) + dt.timedelta(minutes=rnd.randrange(1_300_000))).strftime("%Y-%m-%d %H:%M:%S"), zone))
    df = spark.createDataFrame(rows, "k int, t string, z string")
    got = {r.k: r.at_utc_micros for r in with_instant(df, "t", F.col("z"), F.lit(None).cast("string")).collect()}
    for k, t, zone in rows:
        at = dt.datetime.fromisoformat(t).replace(tzinfo=ZoneInfo(zone), fold=0)
        assert got[k] == round(at.timestamp() * 1_000_000)


def test_missing_zone_is_estimated_from_order_and_ingestion(spark):
    files = spark.createDataFrame([("a", "Asia/Kolkata", "DMY", dt.datetime(2024, 1, 5)), ("b", "Asia/Kolkata", "DMY", dt.datetime(2024, 1, 5)), ("c", "America/New_York", "DMY", dt.datetime(2024, 1, 5)), ("x", None, "DMY", dt.datetime(2024, 1, 1, 12, 0))], "statement_id string, zone_name string, day_order string, upload_date timestamp")
    rows = spark.createDataFrame([("x", "2024-01-01 06:30:00", 1), ("x", "2024-01-01T06:45:00Z", 2), ("x", "2024-01-01 06:50:00", 3), ("x", None, 4)], "statement_id string, text string, position int")
    # in New York 06:30 is 11:30 UTC, before row 2's 06:45 UTC runs the order backwards; in Kolkata it is 01:00 UTC
    got = {r.statement_id: r.zone_name for r in instants.zoned(files, rows).collect()}
    assert got == {"a": "Asia/Kolkata", "b": "Asia/Kolkata", "c": "America/New_York", "x": "Asia/Kolkata"}


def files(spark, *rows):
    return spark.createDataFrame([(i, "acc", dt.datetime(2024, 1, k + 1), "UTC", "DMY", None) for k, i in enumerate(rows)], "statement_id string, account_id string, upload_date timestamp, zone_name string, day_order string, bank_key string")


def test_changes(spark):
    one = lines(spark, "Date,Particulars,Withdrawal,Deposit,Mode", "2024-01-01,x,5.00,,A", "2024-01-02,x,6.50,,", statement="s1")
    two = lines(spark, "DATE ,Narration,Withdrawal,Deposit,Chq No", "2024-01-01 10:00:00,x,5,,7", "2024-01-01 10:00:00,x,broken,,7", statement="s2", start=100)
    got = {(r.change, r.old_field, r.new_field) for r in drift.changes(one.unionByName(two), files(spark, "s1", "s2")).collect()}
    assert got == {("renamed", "Particulars", "Narration"), ("type_changed", "Date", "DATE"), ("type_changed", "Withdrawal", "Withdrawal"), ("added", "", "Chq No"), ("removed", "Mode", "")}
    assert drift.changes(one, files(spark, "s1")).count() == 0


def test_fields_that_no_rule_knows_are_told_by_what_they_hold(spark):
    """A field of sums is the balance, whatever its name; what is lost and gained and holds the same is renamed; others are not."""
    one = lines(spark, "Date,Narration,Debit,Credit,Left over,Zeta,Omega", "2024-01-01,x,5.00,,1.50 Cr,ab,1", "2024-01-02,x,6.50,,2.00,cd,2", statement="s1")
    two = lines(spark, "Date,Narration,Debit,Credit,Position,Theta", "2024-01-01,x,5.00,,9.50 Dr,xy", "2024-01-02,x,5.00,,8.00,zz,", statement="s2", start=100)
    both = one.unionByName(two)
    got = {(r.change, r.old_field, r.new_field) for r in drift.changes(both, files(spark, "s1", "s2")).collect()}
    assert got == {("renamed", "Left over", "Position"), ("renamed", "Zeta", "Theta"), ("removed", "Omega", "")}
    table = {r.line_id: r for r in drift.unified(both, files(spark, "s1", "s2")).collect()}
    assert table[2].balance == Decimal("1.50") and table[101].balance == Decimal("-9.50")


def test_a_banks_mapping_goes_before_the_rules(spark):
    df = lines(spark, "Value Date,Odd Bit,Amount", "2024-01-01,x,5", "2024-01-01,,5", statement="s1")
    own = files(spark, "s1").withColumn("bank_key", F.lit("B"))
    mapping = spark.createDataFrame([("B", "Value Date", "Odd Bit", None), (None, None, None, None)], "bank_key string, date_header string, description_header string, debit_header string")
    assert rejects.headers(df, own, mapping).first().roles == ["date", "description", "amount"]
    assert {r.line_id: r.reason for r in rejects.checked(df, rejects.headers(df, own, mapping)).collect()} == {2: None, 3: "invalid_value"}
    assert {r.line_id: r.reason for r in rejects.checked(df).collect()} == {2: None, 3: None}


def test_unified_table_reports_failed_casts(spark):
    df = lines(spark, "Date,Description,Debit,Credit,Balance", "2024-01-01,x,5.00,,12 Cr", "30 Feb 2024,y,,6,oops", "03/01/2024,z,\"1,000\",0,(5.50)", statement="s1")
    got = {r.line_id: r for r in drift.unified(df, files(spark, "s1")).collect()}
    assert got[2].balance == Decimal("12.00") and got[2].failed == [] and got[2].credit is None
    assert sorted(got[3].failed) == ["balance", "date"]
    assert got[4].debit == Decimal("1000.00") and got[4].balance == Decimal("-5.50")


def test_rolling_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), dt.date(2024, 1, 1) + dt.timedelta(days=int(rnd.random() ** 2 * 400)), Decimal(rnd.randrange(1, 10**7)) / 100, rnd.choice(["DR", "CR"])) for _ in range(300)]
    rows += [("lone", dt.date(2024, 5, 5), Decimal("1.00"), "DR"), (None, dt.date(2024, 5, 5), Decimal("1.00"), "DR"), ("a", None, Decimal("1.00"), "DR"), ("a", dt.date(2024, 1, 1), None, "DR")]
    df = spark.createDataFrame(rows, "entity_id string, day date, amount decimal(15,2), direction string")
    sums = rolling.daily(df)
    got = {(r.entity, r.day): r for r in rolling.trailing(sums, (7, 30), tile=16).collect()}
    quiet = {(r.entity, r.day) for r in rolling.quiet(sums, 30, tile=16).collect()}
    want = set()
    for e in ("a", "b", "c", "lone"):
        own = [r for r in rows if r[0] == e and r[1]]
        day, last = min(r[1] for r in own), max(r[1] for r in own)
        while day <= last:
            for w in (7, 30):
                inside = [r for r in own if day - dt.timedelta(days=w - 1) <= r[1] <= day]
                r = got[e, day]
                assert r[f"n_{w}"] == len(inside)
                assert r[f"dr_{w}"] == sum(int((x[2] or 0) * 100) for x in inside if x[3] == "DR")
                assert r[f"cr_{w}"] == sum(int((x[2] or 0) * 100) for x in inside if x[3] == "CR")
            if not inside:
                want.add((e, day))
            day += dt.timedelta(days=1)
        assert len([1 for k in got if k[0] == e]) == (last - min(r[1] for r in own)).days + 1
    assert quiet == want
    assert rolling.trailing(rolling.daily(df.where("false"))).count() == 0


def test_sums_beyond_doubles_stay_exact(spark):
    big = Decimal("9999999999999.99")
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=k), big, "DR") for k in range(30)]
    out = rolling.trailing(rolling.daily(spark.createDataFrame(rows, "entity_id string, day date, amount decimal(15,2), direction string"))).where("day = date'2024-01-30'").first()
    assert out.dr_30 == int(big * 100) * 30


@pytest.mark.parametrize("text, want", [("1,00,000.50", Decimal("100000.50")), (" +5 ", Decimal(5)), ("₹5", Decimal(5)), ("Rs 5", Decimal(5)), ("", Decimal(0)), ("-5", None), ("5-x", None), ("1e5", None), ("١", None), (",5", None)])
def test_amounts(text, want):
    assert rejects.amount_of(text) == want
