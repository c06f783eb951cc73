"""The page rank query runs on the network of entities and counterparties."""

import datetime as dt

import pytest

from ledgerloom.plans import registry


def test_page_rank_is_of_entities_and_counterparties(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 1, at, "view", 5.0, '{"k": 7}'), (2, 2, at, "purchase", 5.0, '{"k": 7}'), (3, 1, at, "click", 2.0, '{"k": 8}'), (4, 3, at, "error", 1.0, '{"k": 9}')]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    rank = {r.node: r["rank"] for r in registry.queries()["g13_page_rank"](spark, str(tmp_path)).collect()}
    assert set(rank) == {"entity_1", "entity_2", "external_CP_7", "external_CP_8"}  # an event without a counterparty is no edge
    assert sum(rank.values()) == pytest.approx(1) and max(rank, key=rank.get) == "external_CP_7"
