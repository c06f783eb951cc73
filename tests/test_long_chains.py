"""Chains of any length, against brute force."""

from ledgerloom.operators import flows

SCHEMA = "id long, t long, source string, target string, amount double"


def brute(events, gap):
    """All chains without a repeated event, as tuples of ids."""
    out, level = [], [(e,) for e in events]
    while level:
        level = [(*c, e) for c in level for e in events if e not in c and c[-1][3] == e[2] and 0 <= e[1] - c[-1][1] <= gap]
        out += level
    return out


def same(spark, events):
    ev = spark.createDataFrame(events, SCHEMA)
    found = flows.chains(ev, 100, beam=1000)
    want = brute(events, 100)
    got = {r.path: (r.events, r.total) for r in found.collect()}
    assert got == {">".join(str(e[0]) for e in c): (len(c), sum(e[4] for e in c)) for c in want}
    hub = {r.node: (r.chains, r.passes) for r in flows.hubs(found, ev).collect()}
    inner = [(c[k][3], c) for c in want for k in range(len(c) - 1)]
    assert hub == {n: (len({c for m, c in inner if m == n}), sum(m == n for m, _ in inner)) for n, _ in inner}
    return want


def test_a_line_of_nine(spark):
    assert max(map(len, same(spark, [(k, 10 * k, f"n{k}", f"n{k + 1}", 1.0 + k) for k in range(9)]))) == 9


def test_events_of_one_moment_that_run_in_a_circle_end(spark):
    want = same(spark, [(k, 5, f"n{k}", f"n{(k + 1) % 6}", 1.0 + k) for k in range(6)] + [(9, 60, "n0", "n3", 4.0)])
    assert max(map(len, want)) >= 7
