"""Blocking of names: every pair that link_of accepts is a candidate."""

import itertools
import random

import pytest

from ledgerloom.llm import names

CLASS = "cid long, rare string, frequent array<string>, legal string, kind string, sure int, names long"


def found(spark, rows):
    cls = spark.createDataFrame([(k, r, f, "", kind, sure, 1) for k, (r, f, kind, sure) in enumerate(rows)], CLASS)
    return {(r.a, r.b): r.strong for r in names.links(cls).collect()}


@pytest.mark.parametrize("a, b", [("patel", "payel"), ("sharma", "shrama"), ("verma", "vrema"), ("desai", "dezai"), ("petil", "peetil")])
def test_middle_slips_of_short_names(spark, a, b):
    assert found(spark, [(a, ["ramesh"], "person", 4), (b, ["ramesh"], "person", 4)]) == {(0, 1): True}


@pytest.mark.parametrize("a, b", [("lorituzu", "loritzu"), ("bivabhupu", "bivavhupu"), ("kotabadha", "kotbaadha"), ("rekijolo", "rekeejolo"), ("kotabadharum", "kotabdaharum")])
def test_middle_slips_of_bare_names(spark, a, b):
    assert found(spark, [(a, [], "bare", 0), (b, [], "bare", 0)]) == {(0, 1): False}


def test_candidates_hold_every_link(spark):
    rnd = random.Random(9)
    rows = []
    for n in range(4, 15):
        word = "".join(rnd.choice("abdeghikmorstu") for _ in range(n))
        forms = {word} | names.worn(word) | {word[:k] + word[k : k + 2][::-1] + word[k + 2 :] for k in range(n - 1)}
        forms |= {word[:k] + c + word[k + 1 :] for k in range(n) for c in "aeimnstu"} | {word[:k] + c + word[k:] for k in range(n + 1) for c in "ah"}
        forms |= {word[:k] + c + word[k + 1 :] for k in range(n) for c in ("ee", "oo")}
        for form in sorted(forms):
            rows.append((form, *rnd.choice([(["ramesh"], "person", 4), (["kavita"], "person", 4), ([], "bare", 0)])))
    full = [(r, f, "", kind, sure) for r, f, kind, sure in rows]
    want = {(i, j): g for i, j in itertools.combinations(range(len(rows)), 2) if (g := names.link_of(full[i], full[j])) is not None}
    assert len(want) > 1000 and found(spark, rows) == want


def test_refined_keys_lose_no_link(spark):
    """Where a key is too common, pairs but for a letter still meet, and so do a cut end and what it was cut from where few have it."""
    rows = [("lorituzu", "ramesh"), ("lorituxu", "ramesh"), ("lori", "ramesh"), ("lorigaba", "ramesh"), ("mekituzu", "ramesh"), ("lorituzu", "kavita"), ("lorabech", "ramesh"), ("loredogu", "ramesh")]
    cls = spark.createDataFrame([(k, r, [w], "", "person", 4, 1) for k, (r, w) in enumerate(rows)], CLASS)
    met = lambda common: {tuple(r) for r in names.candidates(names.suffix_index(cls), common).collect()}
    every, refined = met(99), met(5)
    assert refined < every and {(0, 1), (0, 2), (1, 2), (2, 3)} <= refined and (0, 6) in every - refined
    assert (0, 1) in met(1)
