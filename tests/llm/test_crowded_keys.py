"""Links and matches are the same however many other names share a key with theirs."""

import itertools
import random
from decimal import Decimal

import pytest

from ledgerloom.llm import matching, names

CLASS = "cid long, rare string, frequent array<string>, legal string, kind string, sure int, names long"


def found(spark, rows):
    cls = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], CLASS)
    return {(r.a, r.b): r.strong for r in names.links(cls).collect()}


def words(pattern, n, seed=3):
    """n words, a * being a random letter."""
    rnd, out = random.Random(seed), set()
    while len(out) < n:
        out.add("".join(rnd.choice("bcdfghjkmnprstvyz") if c == "*" else c for c in pattern))
    return sorted(out)


PERSON = lambda rare, *frequent: (rare, list(frequent), "", "person", 4 if len(frequent) == 1 else 1)
CROWDS = {
    "cut end": (PERSON("lori", "ramesh"), PERSON("lorituzu", "ramesh"), [PERSON(w, "ramesh") for w in words("lori****", 320)]),
    "slip of six letters": (PERSON("lorema", "ramesh"), PERSON("lxorema", "ramesh"), [PERSON(w, "ramesh") for w in words("******ema", 320)]),
    "without given name": (("lorituzu", [], "", "bare", 0), PERSON("lorituzu", "ramesh"), [PERSON("lorituzu", w) for w in words("r****", 320)]),
    "slip without given name": (("loritumu", [], "", "bare", 0), PERSON("lorituzu", "ramesh"), [PERSON("lorituzu", w) for w in words("r****", 320)]),
    "slip with an initial": (PERSON("loritumu", "ramesh", "rajesh"), PERSON("lorituzu", "ramesh"), [PERSON("lorituzu", w) for w in words("k****", 320)]),
}


@pytest.mark.parametrize("case", CROWDS)
def test_a_crowd_takes_no_link(spark, case):
    a, b, crowd = CROWDS[case]
    alone = found(spark, [a, b])
    assert set(alone) == {(0, 1)}
    assert {k: v for k, v in found(spark, [a, b, *crowd]).items() if k == (0, 1)} == alone


def test_every_link_meets_by_its_keys():
    """Of two readings that link_of accepts one asks by a key that the other is found by."""
    rnd = random.Random(5)
    rows = []
    for n in range(3, 12):
        word = "".join(rnd.choice("abdeghikmorstu") for _ in range(n))
        forms = names.worn(word) | {word[:k] for k in range(3, n)} | {word[:k] + c + word[k:] for k in range(n + 1) for c in "aeo"} | {word[:k] + c + word[k + 1 :] for k in range(n) for c in ("ee", "oo", "t")}
        for form in sorted(forms - {""}):
            given = rnd.choice([[], ["ramesh"], ["kavita"], ["rajesh", "ramesh"]])
            rows.append((form, given, rnd.choice(["", "", "pvt", "pvtltd", "llp"]), rnd.choice(["person", "firm"]) if given else "bare", rnd.choice([1, 4]) if len(given) == 1 else 1))
    keys = [names.link_keys(r, f) for r, f, *_ in rows]
    asks, by = ([{k for k, v in ks.items() if v[side]} for ks in keys] for side in (0, 1))
    n = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        if names.link_of(rows[i], rows[j]) is not None:
            n += 1
            assert asks[i] & by[j] or asks[j] & by[i], (rows[i], rows[j])
    assert n > 1000


def test_a_surname_of_many_meets_few(spark):
    """Readings that are only found by a key don't meet each other."""
    rows = [PERSON("lorituzu", w) for w in words("r****", 320)] + [("lorituzu", [], "", "bare", 0)]
    cls = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], CLASS)
    assert names.meetings(names.link_index(cls)).count() == 320


def test_matches_stay_when_names_are_added(spark):
    e = spark.createDataFrame([("e1", "Ramesh Lorema", None, None, "5500000001", None, None)], "entity_id string, entity_name string, pan string, gstin string, primary_phone string, primary_email string, registered_address string")
    acc = spark.createDataFrame([], "entity_id string, account_number string, ifsc_code string, branch_name string")
    t = [("t1", "Ramesh Lxorema", "UPI/1/5500000001@upx/RAMESH"), *[(f"c{k}", f"Ramesh {w.title()}", "UPI/1/x") for k, w in enumerate(words("******ema", 320))]]
    tx = spark.createDataFrame([(i, "a", d, Decimal(1), n, None, None) for i, n, d in t], "transaction_id string, account_id string, description string, amount decimal(15,2), counterparty_merged string, mapped_entity_id string, mapping_verified boolean")
    nick = spark.createDataFrame([("Ramesh", "Ramu")], "given_name string, short_form string")
    for some in (tx.where("transaction_id = 't1'"), tx):
        named = names.parties(names.distinct_names(some.select("counterparty_merged"), e.select("entity_name")), nick)
        assert {(r.transaction_id, r.mapped_entity_id) for r in matching.matches(some, e, acc, named).collect()} == {("t1", "e1")}
