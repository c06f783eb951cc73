"""Pairing, pass-through scores, networks and flows: fixtures and serial forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import counterparty, flows, graph, mule, pairing
from ledgerloom.operators import timeseries as T
from ledgerloom.sources.ledger import backfilled, standardised

T0 = dt.datetime(2024, 1, 1)
RAW = "transaction_id long, entity_id string, account_id string, DATE timestamp, DESCRIPTION string, amount double, direction string, counterparty string, balance double, original_index long, extra string"


def ledger(spark, rows):
    """rows: (entity, hours from the start or None, amount, direction, counterparty)"""
    return standardised(spark.createDataFrame([(k, e, e, None if h is None else T0 + dt.timedelta(hours=h), None, a, d, c, None, k, "x") for k, (e, h, a, d, c) in enumerate(rows)], RAW))


def some(seed, n=160):
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), rnd.randrange(0, 400) / 2, float(rnd.choice([1000, 1010, 1040, 2000, 2050, 5000, 5100])), rnd.choice(["DR", "CR"]), rnd.choice(["p", "q", "", None])) for _ in range(n)]


def serial_round_trips(rows, tol=5.0, days=30, least=1000):
    out = set()
    for key in {(r[0], r[4]) for r in rows if (r[4] or "").strip()}:
        own = sorted(((r[1], k, r) for k, r in enumerate(rows) if (r[0], r[4]) == key and r[1] is not None))
        used = set()
        for h, k, r in own:
            if r[3] == "DR" and r[2] >= least:
                for h2, k2, r2 in own:
                    if r2[3] == "CR" and r2[2] >= least and k2 not in used and 0 < h2 - h <= days * 24 and abs(r[2] - r2[2]) / r[2] * 100 <= tol:
                        used.add(k2)
                        out.add((k, k2))
                        break
    return out


def serial_rapid(rows, hours=24, tol=5.0, least=1000):
    out = set()
    for e in {r[0] for r in rows}:
        own = sorted((r[1], k, r) for k, r in enumerate(rows) if r[0] == e and r[1] is not None)
        used = set()
        for i, (h, k, r) in enumerate(own):
            if r[3] != "CR" or r[2] < least:
                continue
            fits = [(abs(r[2] - r2[2]) / r[2] * 100, j, k2) for j, (h2, k2, r2) in enumerate(own) if i < j <= i + 19 and r2[3] == "DR" and k2 not in used and h2 - h <= hours and abs(r[2] - r2[2]) / r[2] * 100 <= tol]
            if fits:
                used.add(min(fits)[2])
                out.add((k, min(fits)[2]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matchers_equal_the_serial_form(spark, seed):
    rows = some(seed)
    led = ledger(spark, rows)
    assert {(r.l_id, r.r_id) for r in pairing.round_trips(led).collect()} == serial_round_trips(rows)
    assert {(r.l_id, r.r_id) for r in pairing.rapid_movements(led).collect()} == serial_rapid(rows)


def test_first_fit_best_fit_and_look_ahead(spark):
    first = ledger(spark, [("a", 0, 1000.0, "DR", "p"), ("a", 24, 1000.0, "DR", "p"), ("a", 48, 1000.0, "CR", "p"), ("a", 72, 1000.0, "CR", "p")])
    assert {(r.l_id, r.r_id) for r in pairing.round_trips(first).collect()} == {(0, 2), (1, 3)}
    same = ledger(spark, [("a", 0, 1000.0, "DR", "p"), ("a", 0, 1000.0, "CR", "p")])
    assert pairing.round_trips(same).count() == 0
    best = ledger(spark, [("a", 0, 10000.0, "CR", "p"), ("a", 1, 9600.0, "DR", "p"), ("a", 2, 9900.0, "DR", "p"), ("a", 3, 9990.0, "DR", "p")])
    assert [(r.l_id, r.r_id) for r in pairing.rapid_movements(best).collect()] == [(0, 3)]
    far = lambda n: ledger(spark, [("a", 0, 10000.0, "CR", "p")] + [("a", 0.1, 1.0, "CR", "p")] * (n - 1) + [("a", 0.2, 10000.0, "DR", "p")])
    assert pairing.rapid_movements(far(19)).count() == 1 and pairing.rapid_movements(far(20)).count() == 0
    once = ledger(spark, [("a", 0, 10000.0, "CR", "p"), ("a", 1, 10000.0, "CR", "p"), ("a", 2, 10000.0, "DR", "p")])
    assert pairing.rapid_movements(once).count() == 1


@pytest.mark.parametrize("debit, points", [(1.0, 0.70), (0.96, 0.60), (0.90, 0.45), (0.82, 0.45), (0.70, 0.25), (0.5, 0.0)])
def test_balance_edges(spark, debit, points):
    led = ledger(spark, [("a", 0, 100.0, "CR", "p"), ("a", 24 * 90, 100.0 * debit, "DR", "p")])
    r = mule.pass_through(led).first()
    assert r.score == pytest.approx(points) and r.alert == (points >= 0.4 and r.ratio <= 0.25)


def test_thresholds_and_periods(spark):
    near = ledger(spark, [("a", k, x, "CR", "p") for k, x in enumerate((8500.0, 9999.99, 10000.0))])
    assert mule.threshold_avoidance(near).first().score == pytest.approx(2 / 3)
    weekly = ledger(spark, [("a", 24 * 7 * k, 100.0, "DR", "p") for k in range(5)])
    r = mule.periodic(weekly).first()
    assert (r.period, r.strength, r.periodic) == (7, 1.0, True)


def edge_rows(spark, *pairs):
    return spark.createDataFrame([(a, b, 1000.0, T0, k) for k, (a, b) in enumerate(pairs)], "src string, dst string, amount double, DATE timestamp, transaction_id long")


def test_cycles_and_components(spark):
    e = graph.folded(edge_rows(spark, ("A", "B"), ("B", "C"), ("C", "A"), ("B", "A"), ("X", "Y"), ("Y", "Y")))
    found = graph.cycles(e, 3, 5)
    assert [(r.path, r.length) for r in found.collect()] == [(["A", "B", "C"], 3)]
    s = graph.cycle_scores(found, e).first()
    assert s.total == 3000.0 and s.net == 0.0 and s.confidence == 1.0
    assert {r.node: r.component for r in graph.components(e).collect()} == {"A": "A", "B": "A", "C": "A", "X": "X", "Y": "X"}
    ranks = {r.node: r["rank"] for r in graph.page_rank(e).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks["Y"] > ranks["X"]


def test_flows(spark):
    ev = spark.createDataFrame([(1, 0, "A", "B", 10.0), (2, 1, "B", "C", 10.0), (3, 2, "B", "D", 5.0), (4, 3, "C", "E", 10.0), (5, 4, "D", "E", 5.0), (6, 5, "E", "F", 1.0)], "id long, t long, source string, target string, amount double")
    adj = flows.adjacency(ev, 100)
    assert {(r.a, r.b) for r in adj.collect()} == {(1, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 6)}
    b = {r.id: (r.splits, r.merges) for r in flows.branches(adj).collect()}
    assert b[1] == (True, False) and b[6] == (False, True)
    chains = {r.path for r in flows.chains(ev, 100, most=4).collect()}
    assert {"1>2", "1>2>4", "1>2>4>6", "1>3>5>6"} <= chains
    hub = {r.node: r.chains for r in flows.hubs(flows.chains(ev, 100, most=3), ev).collect()}
    assert hub["B"] >= 2
    islands = spark.createDataFrame([(1, 0, "A", "B", 1.0), (2, 1, "B", "C", 1.0), (3, 2, "X", "Y", 1.0), (4, 3, "Y", "Z", 1.0), (5, 4, "Q", "R", 1.0)], "id long, t long, source string, target string, amount double").withColumn("g", F.lit(1))
    assert {(r.first, r.events) for r in flows.runs(islands, 100, "g").collect()} == {(1, 2), (3, 2)}


def test_empty_and_null_ledgers(spark):
    none = ledger(spark, [("a", 0, 1.0, "DR", "p")]).where("false")
    odd = ledger(spark, [("a", None, None, None, None), (None, 1, 5.0, "DR", None), ("a", 2, 0.0, "CR", "p")])
    for led in (none, odd):
        for df in (pairing.round_trips(led), pairing.rapid_movements(led), pairing.transfer_patterns(led), pairing.dwell(led), mule.pass_through(led), mule.classic(led), mule.periodic(led), mule.rolling_balance(led, 7), mule.debit_timing(led), T.periods(led), T.zero_crossings(T.daily_series(led)), T.trend(T.daily_series(led), "activity"), counterparty.risk(led), counterparty.trends(led, 1), graph.cycles(graph.edges(led), 3, 4), graph.overview(graph.edges(led)), graph.concentration(graph.edges(led), "total")):
            df.collect()


def test_backfill(spark):
    out = backfilled(spark.createDataFrame([("x", "12.5", "k"), (None, "bad", "k")], "DESCRIPTION string, DEBIT string, other string")).collect()
    assert [(r.DESCRIPTION, r.DEBIT, r.CREDIT, r.DATE) for r in out] == [("x", 12.5, 0.0, None), ("", 0.0, 0.0, None)]
