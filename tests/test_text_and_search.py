"""Text functions, search, streaming, and the registry."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import resolve
from ledgerloom.operators import search as S

ROOT = Path(__file__).resolve().parent.parent


def one(spark, f, *values):
    return [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(f(F.col("v")).alias("x")).collect()]


def test_names(spark):
    assert one(spark, X.plain_name, "Acme Trading Pvt Ltd", "ACME TRADING", "Acme-Trading Co.", None) == ["acme trading", "acme trading", "acme trading co", None]
    assert one(spark, X.first_word, " (Acme) Trading", "", None) == ["acme", "", None]
    sim = spark.createDataFrame([("acme corp", "acme corps"), ("a", "a"), ("", "a"), (None, "a")], "a string, b string").select(X.similarity(F.col("a"), F.col("b")).alias("x")).collect()
    assert [round(r.x, 6) for r in sim] == [0.9, 1.0, 0.0, 0.0]


def test_amounts_directions_tags(spark):
    assert one(spark, X.lenient_amount, "(1,200.50)", "₹ 5", "-3", "abc", "", None) == [-1200.5, 5.0, -3.0, 0.0, 0.0, 0.0]
    assert one(spark, X.direction, "Dr", "withdrawal", "CR", "deposit", "by cr", "other", None) == ["DR", "DR", "CR", "CR", "CR", None, None]
    assert one(spark, X.without_tags, "<b>a&amp;b</b>  c", None) == ["a&b c", None]
    assert one(spark, X.table_rows, "<table><tr><td>1</td><th>a b</th></tr><tr><td></td></tr></table>") == [[["1", "a b"], [""]]]
    assert one(spark, S.payment_type, "upi/1", "NEFT UPI", "pos x", "instant trf", "", None) == ["UPI", "NEFT", "OTHER", "IMPS", "OTHER", "OTHER"]


def test_patterns(spark):
    assert X.usable(["(a)", "(", "b", "(?i)(c)"]) == ["(a)", "(c)"]
    assert one(spark, lambda c: X.first_capture(c, [r"x/([^/]*)", r"(y+)"]), "X/ /yy", "x/B", "n", None) == ["yy", "b", None, None]
    t = spark.createDataFrame([("UPI/1",), ("UPI/1",), ("a UPI",), (None,)], "text string")
    r = resolve.pattern_coverage(t, ["(upi)"]).first()
    assert (r.texts, r.matched, r.accuracy) == (2, 1, 50.0)


def test_headers():
    ok, lacking, found = X.header_mapping(["Transaction Date", "Particulars", "Withdrawal", "Deposit", "Running Balance"])
    assert ok and not lacking and found["DEBIT"] == "Withdrawal" and found["CREDIT"] == "Deposit"
    assert X.header_mapping(["Date", "Narration"])[1] == ["DEBIT", "CREDIT"]


def test_search_and_renames(spark):
    df = spark.createDataFrame([("1", "a", "UPI x", 5.0, ""), ("2", "b", None, None, "Q"), ("3", None, "cash", 7.0, None)], "transaction_id string, entity_id string, DESCRIPTION string, amount double, counterparty string")
    assert [r.transaction_id for r in S.search(df, status="Failed").orderBy("transaction_id").collect()] == ["1", "3"]
    assert [r.transaction_id for r in S.search(df, any_text="q", any_entity_ids=["a"]).orderBy("transaction_id").collect()] == ["1", "2"]
    assert S.search(df, amount_min=6).count() == 1
    assert S.summary(df.where("false")).first().asDict() == {"total_count": 0, "total_amount": 0.0}
    assert [r.counterparty for r in S.renamed(df, [("Q", "R"), ("R", "S")]).orderBy("transaction_id").collect()] == ["", "S", None]


def test_merge_pairs(spark):
    c = spark.createDataFrame([("acme trading company limited x", 9), ("acme trading company limitedx", 1), ("acme other", 1), ("solo", 1), (None, 1)], "name string, n long")
    assert [(r.name, r.target) for r in resolve.merge_pairs(c).collect()] == [("acme trading company limitedx", "acme trading company limited x")]


def test_streaming_sums(spark, tmp_path):
    from ledgerloom.streaming.rollups import period_sums

    df = spark.createDataFrame([("a", "2024-01-01 10:00:00", 1.0, 0.0), ("a", "2024-01-01 11:00:00", 0.0, 2.0), ("a", "2024-01-09 11:00:00", 0.0, 2.0)], "entity_id string, d string, DEBIT double, CREDIT double").withColumn("DATE", F.col("d").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = period_sums(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("sums").collect()
    assert [(r.debit_sum, r.credit_sum, r.n) for r in rows] == [(1.0, 2.0, 2)]


def test_core_stands_without_the_subpackage():
    code = "import sys; sys.modules['ledgerloom.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'p3_found' in q and 'p1_found' not in q\nassert set(e.oracle_sql()) <= set(q)\n"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_in_the_core_imports_the_subpackage():
    for p in (ROOT / "ledgerloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "ledgerloom.llm" not in p.read_text(), p
