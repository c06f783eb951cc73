"""Guards, chunks, pattern stores, statement tables, groups."""

import pytest

from ledgerloom.operators import grouping, stores


def test_requests():
    assert stores.checked_request(["a"], "2024-01-01", "2024-01-02", 1) == ["a"]
    for bad in (([],), ([" "],), (["a"], "2024-02-01", "2024-01-01"), (["a", "b"], None, None, 1)):
        with pytest.raises(ValueError):
            stores.checked_request(*bad)


def test_chunks(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("a", 3, 9), ("a", 4, 1), ("b", 1, None)], "g string, i int, size int")
    got = {(r.g, r.i): r.chunk for r in stores.chunks(df, "g", ["i"], "size", 6).collect()}
    assert got == {("a", 1): 0, ("a", 2): 0, ("a", 3): 1, ("a", 4): 2, ("b", 1): 0}


def test_patterns_and_flags(spark):
    s = spark.createDataFrame([("w", "(a)", True, 2, 0.5), ("w", "(b)", True, 1, 0.1), ("w", "(c)", False, 1, None)], "workspace string, pattern string, active boolean, priority int, success_rate double")
    assert [r.pattern for r in stores.active_patterns(stores.with_pattern(s, "w", "(d)", 0), "w").collect()] == ["(d)", "(b)", "(a)"]
    with pytest.raises(ValueError):
        stores.with_pattern(s, "w", "(")
    assert stores.pattern_summary(s).first().asDict() == {"patterns": 3, "active": 2, "mean_success": 0.3}
    f = spark.createDataFrame([("t", "d", "low"), ("t", "d", "High"), ("u", "d", "medium"), ("v", "d", None)], "type string, description string, severity string")
    assert [(r.type, r.severity) for r in stores.by_severity(f).collect()] == [("t", "High"), ("u", "medium"), ("v", None)]


def test_tables_and_export(spark, tmp_path):
    t = spark.createDataFrame([(1, ["Date", "Particulars", "Debit", "Credit"], [["01/02/2024", "x", "5.00", ""], ["02/02/2024", "y", "", "1,000.00"]]), (2, ["a", "b"], [["x", "y"]]), (3, None, None)], "id int, header array<string>, rows array<array<string>>")
    assert {r.id: bool(r.is_statement) for r in stores.statement_tables(t).collect()} == {1: True, 2: False, 3: False}
    assert stores.padded(["a"], 3) == ["a", "", ""] and stores.padded(["a", "b"], 1) == ["a"]
    df = spark.createDataFrame([("a,b", 'say "x"'), (None, "two\nlines")], "k string, v string")
    stores.export(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert sorted((r.k or "", r.v) for r in back.collect()) == [("", "two\nlines"), ("a,b", 'say "x"')]


def test_groups(spark):
    rows = [(f"e{k}", float(k % 2) * 100, 1.0, "c", None) for k in range(12)]
    led = spark.createDataFrame(rows, "entity_id string, DEBIT double, CREDIT double, counterparty string, DATE timestamp")
    g = grouping.grouped(grouping.entity_features(led), 2)
    kinds = {}
    for r in g.collect():
        kinds.setdefault(int(r.entity_id[1:]) % 2, set()).add(r.group)
    assert all(len(v) == 1 for v in kinds.values()) and kinds[0] != kinds[1]
    assert grouping.silhouette(g) > 0.9
