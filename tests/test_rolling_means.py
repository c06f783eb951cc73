"""Averages by direction over trailing days, against brute force."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from ledgerloom.plans import registry


def test_averages_by_direction_against_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    start = dt.date(2024, 1, 1)
    rows = [(rnd.choice("ab"), start + dt.timedelta(days=int(rnd.random() ** 2 * 120)), Decimal(rnd.randrange(1, 10**6)) / 100, rnd.choice(["DR", "CR"])) for _ in range(80)]
    # neither a null amount nor another direction counts in an average
    rows += [("a", start, None, "DR"), ("b", start, None, "CR"), ("a", start, Decimal("5.00"), "XX"), ("b", start, Decimal("5.00"), None), ("none", start, None, "DR"), ("one", start, Decimal("7.00"), "CR")]
    at = str(tmp_path / "in")
    spark.createDataFrame([(e, "s", d.isoformat(), 1, a, x) for e, d, a, x in rows], "entity_id string, statement_id string, tx_date string, original_index int, amount decimal(15,2), direction string").write.parquet(f"{at}/transactions.parquet")
    spark.createDataFrame([("s", "UTC", "DMY", dt.datetime(2025, 1, 1))], "statement_id string, zone_name string, day_order string, upload_date timestamp").write.parquet(f"{at}/bank_statements.parquet")
    got = registry.queries()["p7_rolling"](spark, at).collect()
    assert {r.entity_id for r in got} == {"a", "b", "none", "one"}
    for r in got:
        for w in (7, 30):
            inside = [x for x in rows if x[0] == r.entity_id and r.day - dt.timedelta(days=w - 1) <= x[1] <= r.day]
            paid = {c: [x[2] for x in inside if x[3] == c and x[2] is not None] for c in ("DR", "CR")}
            for name, own in (("dr_mean", paid["DR"]), ("cr_mean", paid["CR"]), ("mean", paid["DR"] + paid["CR"])):
                assert r[f"{name}_{w}d"] == (pytest.approx(float(sum(own)) / len(own)) if own else None), (name, w, r)
            assert r[f"rows_{w}d"] == len(inside)
