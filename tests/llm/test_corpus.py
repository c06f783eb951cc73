"""Encoding, mixing and repair of documents."""

import base64
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, mixing, mojibake

FILE = Path(bpe.TOKENIZERS) / "byte_bpe_50k.tiktoken"
needs_file = pytest.mark.skipif(not FILE.exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(FILE.read_bytes())


@pytest.fixture(scope="module")
def other():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_file
@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="ab aA1\n₹é", max_size=80))
def test_encoding_equals_the_public_library(own, other, text):
    text = text.encode("utf-8", "replace").decode()
    assert own.ids(text) == other.encode_ordinary(text)


@needs_file
def test_one_very_long_piece(own, other):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh") for _ in range(20_000))
    assert own.ids(text) == other.encode_ordinary(text)
    assert own.ids("a" * 50_000) == other.encode_ordinary("a" * 50_000)


@needs_file
def test_encoded_frame(spark, own):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in bpe.encoded(df, "doc_id").collect()))
    assert got == [(0, own.ids("a")), (1, own.ids("Hello world")), (2, []), (3, []), (3, [])]
    assert bpe.encoded(df.where("false"), "doc_id").count() == 0


def counts(spark, rows):
    return spark.createDataFrame([(k, s, k * 7, t) for k, (s, t) in enumerate(rows)], "doc_id long, source string, text_hash long, tokens long")


def test_mix_reaches_targets_and_never_repeats_too_often(spark):
    rnd = random.Random(2)
    rows = [(rnd.choices(["big", "mid", "small"], [90, 9, 1])[0], rnd.randrange(1, 40)) for _ in range(6000)] + [(None, 5), ("unlisted", 5), ("big", 0)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(counts(spark, rows), targets, buckets=64)
    got = {r.source: r for r in mixing.shares(mix, targets).collect()}
    total = sum(r.tokens_used for r in got.values())
    have = {s: sum(t for x, t in rows if x == s) for s in got}
    limit = min(have[s] * m / w for s, w, m in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)))
    for s, w, m in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)):
        assert got[s].most_times <= m
        assert limit * w - 40 < got[s].tokens_used <= limit * w + 1e-6
        assert abs(got[s].tokens_used / total - w) < 0.01
    assert {(r.doc_id, r.times) for r in mix.collect()} == {(r.doc_id, r.times) for r in mixing.mixed(counts(spark, rows), targets, buckets=64).collect()}


def test_mix_against_brute_force(spark):
    rows = [("a", t) for t in (5, 1, 7, 3, 9, 2)] + [("b", 4), ("b", 4)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    c = counts(spark, rows)
    order = {r.doc_id: r.h for r in c.select("doc_id", F.expr("shiftrightunsigned(xxhash64(17, cast(doc_id as string), text_hash), 54)").alias("b"), F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), F.col("text_hash")).alias("h")).collect()}
    unsigned = lambda k: order[k] % (1 << 64) >> 54
    budget, used, want = 16, 0, set()
    for k in sorted((k for k, (s, _) in enumerate(rows) if s == "a"), key=lambda k: (unsigned(k), order[k])):
        used += rows[k][1]
        if used <= budget:
            want.add((k, 1))
    got = {(r.doc_id, r.times) for r in mixing.mixed(c, targets).collect()}
    assert {x for x in got if rows[x[0]][0] == "a"} == want
    assert {x for x in got if rows[x[0]][0] == "b"} == {(6, 2), (7, 2)}


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    assert mixing.mixed(counts(spark, [("a", 5)]), targets).count() == 0
    assert [r.actual_share for r in mixing.shares(mixing.mixed(counts(spark, [("a", 5)]), targets), targets).collect()] == [None, None]


CLEAN = ["L’employé affirme avoir été forcé de prêter sa carte.", "Größere Bareinzahlungen über 5 €", "A DECLARAÇÃO NÃO CONFERE. OPERAÇÕES", "El señor pagó £5 ¿no?", "खाते से ₹5,000 निकाले", "“as usual” – ½ day at 5°C", "naïve façade ✅ 👍", "Москва и Санкт-Петербург", "price 1 234,50 €", "Âgé de 5 ans, à l’été"]
WAYS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850")]


def garble(text, way):
    written, read = way
    to_char = mojibake._tables()[1][read]
    return "".join(to_char[b] for b in text.encode(written))


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert mojibake.Mender().mend(text) == (False, False, text)


@pytest.mark.parametrize("way", WAYS)
def test_round_trips(way):
    for text in CLEAN[:7]:
        bad = garble(text, way)
        if bad != text:
            found, whole, got = mojibake.Mender().mend(bad)
            assert found and got == text, (bad, got)


def test_twice_garbled_partly_garbled_and_lost():
    text = "réelle et société"
    assert mojibake.Mender().mend(garble(garble(text, WAYS[0]), WAYS[0]))[2] == text
    assert mojibake.Mender().mend("début " + garble("réelle", WAYS[0]))[2] == "début réelle"
    assert mojibake.Mender().mend("caf� here") == (True, False, "caf� here")


def test_garbled_frame(spark):
    df = spark.createDataFrame([(1, "plain", "x"), (2, None, "x"), (3, "", "x"), (4, "rÃ©elle", "x"), (5, "été", "x"), (4, "rÃ©elle", "x")], "doc_id long, text string, restorable string")
    assert sorted((r.doc_id, r.restorable, r.text) for r in mojibake.garbled(df).collect()) == [(4, True, "réelle"), (4, True, "réelle")]
    assert mojibake.garbled(df.where("false")).count() == 0
