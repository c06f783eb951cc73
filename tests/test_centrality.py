"""Path measures against brute force, bursts against the serial rule."""

import datetime as dt
import itertools
import random

import pytest

from ledgerloom.operators import centrality as Z


def test_betweenness_and_closeness(spark):
    rnd = random.Random(7)
    nodes = [f"n{k}" for k in range(7)]
    hop = {(a, b) for a, b in itertools.permutations(nodes, 2) if rnd.random() < 0.3}
    got = {r.node: r for r in Z.centralities(spark.createDataFrame(sorted(hop), "src string, dst string")).collect()}
    nodes = sorted(got)
    n = len(nodes)

    def paths(s, t):
        for k in range(1, n):
            found = [p for p in itertools.product(nodes, repeat=k - 1) if all(x in hop for x in zip((s, *p), (*p, t), strict=True))]
            if found:
                return k, found
        return None, []

    between = dict.fromkeys(nodes, 0.0)
    into = {t: [] for t in nodes}
    for s, t in itertools.permutations(nodes, 2):
        d, found = paths(s, t)
        if d:
            into[t].append(d)
        for p in found:
            for v in p:
                between[v] += 1 / len(found)
    for v in nodes:
        assert got[v].betweenness == pytest.approx(between[v] / ((n - 1) * (n - 2)))
        assert got[v].closeness == pytest.approx(len(into[v]) ** 2 / sum(into[v]) / (n - 1) if into[v] else 0.0)


def test_bursts(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h)) for h in (0, 1, 2, 50, 80, 81, 82, 83)] + [("b", t0), ("b", None)]
    got = {(r.g, r.start, r.n) for r in Z.bursts(spark.createDataFrame(rows, "g string, t timestamp"), "g", "t", 24, 3).collect()}
    micros = lambda h: int((t0 + dt.timedelta(hours=h)).replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
    assert got == {("a", micros(0), 3), ("a", micros(80), 4)}
