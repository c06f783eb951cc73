"""Deduplication against history, names, and matching of entities."""

import datetime as dt
import itertools
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import history, matching, names
from ledgerloom.llm.history import History, clusters, pairs

TX = "transaction_id string, account_id string, entity_id string, statement_id string, tx_date string, description string, amount decimal(15,2), direction string, counterparty_merged string, mapped_entity_id string, mapping_verified boolean, balance decimal(15,2), original_index int, batch_no int, score string"
FILES = "statement_id string, account_id string, zone_name string, day_order string, upload_date timestamp"


def made(seed, n=220):
    """Movements, some recorded again in later batches: rows, and the true pairs."""
    rnd = random.Random(seed)
    rows, truth = [], set()
    for k in range(n):
        account, day = rnd.choice("AB"), dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(200))
        amount, balance = Decimal(rnd.randrange(100, 10**6)) / 100, Decimal(rnd.randrange(10**5, 10**8)) / 100
        text = f"UPI/{rnd.randrange(10**11, 10**12)}/NAME {rnd.randrange(99)}/rent"
        base = [account, "e", "f", day.isoformat(), text, amount, "DR", None, None, None, balance, k, 1]
        copies = [(str(uuid.UUID(int=rnd.getrandbits(128))), *base)]
        for _ in range(rnd.choice([0, 0, 0, 1, 2])):
            c = list(base)
            how = rnd.randrange(5)
            if how == 0:
                c[4] = text.lower().replace("/", " | ")
            elif how == 1:
                c[3] = (day + dt.timedelta(days=1)).strftime("%d/%m/%Y")
            elif how == 2:
                c[10] = None
            elif how == 3:
                c[5] = Decimal(round(amount))
            c[12] = rnd.choice([1, 2, 3])
            copies.append((str(uuid.UUID(int=rnd.getrandbits(128))), *c))
        rows += copies
        truth |= {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(copies, 2)}
    return rows, truth


def frames(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], TX), spark.createDataFrame([("f", "A", "UTC", "DMY", dt.datetime(2024, 1, 1))], FILES)


def test_batches_one_by_one_equal_one_load_and_find_the_truth(spark):
    rows, truth = made(1)
    t, f = frames(spark, rows)
    one = History(spark)
    one.accept(t, f)
    got = {tuple(r) for r in pairs(one.mapping()).collect()}
    assert len(got & truth) / len(truth) > 0.97 and len(got - truth) / len(got) < 0.02
    many = History(spark)
    many.weights = one.weights
    for k in (1, 2, 3):
        many = History(spark, many.path) if k > 1 else many  # opened again each time
        many.accept(t.where(f"batch_no = {k}"), f)
    assert {tuple(r) for r in pairs(many.mapping()).collect()} == got
    loaded = History(spark)
    loaded.weights = one.weights
    for batch in loaded.load(t, f, F.col("batch_no")):
        loaded.take(batch)
    loaded.settle()
    assert {tuple(r) for r in pairs(loaded.mapping()).collect()} == got
    assert [x["batch"] for x in loaded.log][:3] == [1, 2, 3]
    sizes = {r.transaction_id: r.copies for r in clusters(many.mapping()).collect()}
    assert all(v >= 2 for v in sizes.values()) and set(sizes) == {x for p in got for x in p}


def test_other_movements_are_kept_apart(spark):
    day = "2024-03-01"
    base = ("A", "e", "f", day, "ATM WDL TOWN", Decimal(500), "DR", None, None, None)
    rows = [("a", *base, Decimal(900), 1, 1), ("b", *base, Decimal(400), 2, 1), ("c", "A", "e", "f", day, "REV ATM WDL TOWN", Decimal(500), "CR", None, None, None, Decimal(900), 3, 1), ("d", "B", *base[1:], Decimal(900), 1, 1)]
    more, _ = made(2)
    t, f = frames(spark, rows + more)
    h = History(spark)
    h.accept(t, f)
    assert not {x for p in pairs(h.mapping()).collect() for x in p} & set("abcd")


def test_a_copy_met_by_balance_joins_all(spark):
    copies = [(f"k{k}", "A", "e", "f", "2024-03-01", "NEFT/123456789012/X", Decimal(5), "DR", None, None, None, Decimal(7), 1, 1) for k in range(4)]
    lone = ("n", "A", "e", "f", "unreadable", "NEFT/123456789012/X", Decimal(5), "DR", None, None, None, Decimal(7), 1, 1)
    t, f = frames(spark, [*copies, lone])
    h = History(spark)
    h.accept(t, f)
    assert [(r.transaction_id, r.copies) for r in clusters(h.mapping()).orderBy("transaction_id").collect()] == [(k, 5) for k in ("k0", "k1", "k2", "k3", "n")]


def test_history_of_nulls_copies_and_nothing(spark):
    same = [(f"k{k:03}", "A", "e", "f", "2024-03-01", "NEFT/123456789012/X", Decimal(5), "DR", None, None, None, Decimal(7), 1, 1) for k in range(300)]
    odd = [("n1", None, None, None, None, None, Decimal(1), None, None, None, None, None, None, None), (None, "A", None, None, None, None, None, None, None, None, None, None, None, 1), ("n2", "A", None, None, "never", None, Decimal(5), "DR", None, None, None, None, None, 1)]
    t, f = frames(spark, same + odd)
    h = History(spark)
    h.accept(t, f)
    assert {r.copies for r in clusters(h.mapping()).collect()} == {300}
    assert pairs(h.mapping()).count() == 300 * 299 // 2
    h.accept(t.where("false"), f)
    assert pairs(h.mapping()).count() == 300 * 299 // 2
    again = History(spark, h.path)
    assert again.weights.score(0) == pytest.approx(h.weights.score(0)) and pairs(again.mapping()).count() == 300 * 299 // 2


def test_a_batch_reads_only_the_days_it_reaches(spark, monkeypatch):
    """The bytes a batch probes depend on the days of its rows, not on how much was accepted before."""
    monkeypatch.setattr(history, "BULK", 10)
    rnd = random.Random(9)
    day = lambda k: (dt.date(2020, 1, 1) + dt.timedelta(days=k)).isoformat()
    row = lambda b, k: (str(uuid.UUID(int=rnd.getrandbits(128))), "A", "e", "f", day(k), f"NEFT/{rnd.randrange(10**9, 10**10)}", Decimal(rnd.randrange(100, 10**6)) / 100, "DR", None, None, None, Decimal(rnd.randrange(10**6)), 1, b)
    rows = [row(1 + k // 60, k) for k in range(1200)]
    t, f = frames(spark, rows)
    h = History(spark)
    for batch in h.load(t, f, F.col("batch_no")):
        h.take(batch)
    assert len(h.log) == 20 and h.log[-1]["history_rows"] == 1140
    assert max(x["probed_rows"] for x in h.log) <= 3 * 64 and len(h.maps) <= 16


def test_undated_records_meet_by_reference_and_text(spark):
    base = ("A", "e", "f")
    rows = [("a", *base, "2024-03-01", "NEFT/123456789012/X", Decimal(5), "DR", None, None, None, Decimal(7), 1, 1), ("b", *base, None, "neft 123456789012 x", Decimal(5), "DR", None, None, None, None, 1, 1), ("c", *base, None, "OTHER/999999999999", Decimal(5), "DR", None, None, None, None, 1, 1)]
    t, f = frames(spark, rows)
    h = History(spark)
    h.accept(t, f)
    assert {tuple(r) for r in pairs(h.mapping()).collect()} == {("a", "b")}


@pytest.mark.parametrize("a, b, same", [("lunobobhe", "lunobobe", True), ("toshebisho", "tosehbisho", True), ("mezipake", "mezipakke", True), ("bubikode", "bivikode", False), ("lorituzu", "lorituxu", True), ("katherine", "kathereene", True), ("ramesh", "dinesh", False), ("abc", "abcdef", False), ("", "", True)])
def test_a_letter_astray(a, b, same):
    assert names.astray(a, b) is names.astray(b, a) is same


def test_the_ratio_decides(monkeypatch):
    x, y = (("lorituzu", ["ramesh"], "", "person", 4), ("lorigabu", ["ramesh"], "", "person", 4))
    assert names.link_of(x, y) is None and names.link_of(x, ("lorituxu", *y[1:])) is True
    monkeypatch.setattr(names, "ratio", lambda a, b: 1.0)
    assert names.link_of(x, y) is True
    monkeypatch.setattr(names, "ratio", lambda a, b: 0.5)
    assert names.link_of(x, ("lorituxu", *y[1:])) is None


@pytest.mark.parametrize("name, legal", [("Kota Agcs", "agy"), ("Kota Enterpri", "ent"), ("Kota P Ltd", "pvtltd"), ("Kota Pvt. Limi", "pvtltd"), ("Kota L.L.P.", "llp"), ("Kota Comp", "co"), ("Kota Rubber", "")])
def test_legal_forms_cut_short(name, legal):
    assert names.words_of(name)[0] == legal


def test_lcs_against_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert names.lcs(a, b) == table[-1][-1]


GIVEN, SURNAMES = ["Ramesh", "Rajesh", "Kavita", "Frederick", "Katherine"], ["Bhamuhera", "Zesitadu", "Lunobobhe", "Toshebisho", "Rekujolo", "Mozareri", "Vipesede", "Lorituzu"]


#: Kin share a surname: each surname goes with two given names.
GRID = [f"{GIVEN[(k + j) % len(GIVEN)]} {s}" for k, s in enumerate(SURNAMES + ["Kyabheziyo", "Dhohusaha", "Bivabhupu", "Sepotuho", "Chubhobhebo", "Nokiditu", "Kurodavi"]) for j in (0, 1)]


def corpus():
    out = GRID + [f"{c} {t} {x}" for c, t, x in zip(["Kotabadha", "Mamubheya", "Suyusoche", "Labhigedu", "Jiyegeku", "Zobhupesa"], ["Rubber", "Tractors", "Rubber", "Tractors", "Rubber", "Tractors"], ["Ltd", "LLP", "Enterprises", "Pvt Ltd", "and Sons", "Agencies"], strict=True)]
    return out + ["ramesh  bhamuhera", "Bhamuhera, Ramesh", "Ramesh Bhamuherra", "Mr. Ramesh K. Bhamuhera", "FREDERICK LORITUZZU", "Fred Lorituzu", "Kotabadha Rubber Limited", "KOTABADHA RUBBER LTD.", "Rubber Kotabadha Ltd", "Kotabadha", "M/s Mamubheya Tractors L.L.P.", "Suyusoche Rubber Entp", "Pehochayo Rubber LLP", "Ravehazu Rubber & Co", "Pipunaja Tractors LLP", "Hosiboko Tractors Ltd", "ATM", "atm", None, " "]


def test_parties(spark):
    df = spark.createDataFrame([(n,) for n in corpus()], "n string")
    nick = spark.createDataFrame([("Frederick", "Fred"), ("Rajendra", "Raju"), (None, "x")], "given_name string, short_form string")
    every = names.distinct_names(df)
    party = {r.name: r.party for r in names.parties(every, nick).collect()}
    assert set(party) == {n for n in corpus() if n and n.strip()}
    same = lambda *x: len({party[n] for n in x}) == 1
    assert same("Ramesh Bhamuhera", "ramesh  bhamuhera", "Bhamuhera, Ramesh", "Ramesh Bhamuherra", "Mr. Ramesh K. Bhamuhera")
    assert same("Frederick Lorituzu", "FREDERICK LORITUZZU", "Fred Lorituzu")
    assert same("Kotabadha Rubber Ltd", "Kotabadha Rubber Limited", "KOTABADHA RUBBER LTD.", "Rubber Kotabadha Ltd", "Kotabadha")
    assert same("Mamubheya Tractors LLP", "M/s Mamubheya Tractors L.L.P.") and same("Suyusoche Rubber Enterprises", "Suyusoche Rubber Entp") and same("ATM", "atm")
    assert len({party[n] for n in GRID}) == len(GRID)
    rows = names.name_pairs(names.parties(every, nick)).collect()
    assert all(r.name_a < r.name_b for r in rows) and ("ATM", "atm") in {tuple(r) for r in rows}
    assert names.parties(every.where("false"), nick).count() == 0


def test_matching(spark):
    ent = "entity_id string, entity_name string, pan string, gstin string, primary_phone string, primary_email string, registered_address string, name string"
    e = spark.createDataFrame([("e1", "Ramesh Bhamuhera", "P1", None, "5500000001", "ramesh.b@x.example", "1, Road, Oravur", "clash"), ("e2", "Rajesh Bhamuhera", "P2", None, "5500000002", None, None, "clash"), ("e3", "Kotabadha Rubber Ltd", None, None, "5500000003", None, None, "clash"), ("e4", "Kotabadha Rubber Limited", None, None, None, None, None, "clash")], ent)
    acc = spark.createDataFrame([("e1", "111122223333", "ABCD0000001", "Oravur"), ("e1", None, None, None), (None, "1", None, None)], "entity_id string, account_number string, ifsc_code string, branch_name string")
    t = [("t1", "RAMESH BHAMUHERA", "UPI/1/5500000001@upx/RAMESH"), ("t2", "Ramesh Bhamuhera", "UPI/1/5599999999@upx/RAMESH"), ("t3", "Bhamuhera Ramesh", "IMPS-1/Fund Trf/Bank/RAMESH/XX3333"), ("t4", "ATM", "ATM WDL"), ("t5", "Kotabadha Rubber Ltd", "UPI/1/5500000003@upx/K"), ("t6", None, "x"), ("t7", "Ramesh Bhamuhera", None)]
    rows = [(i, f"a{k}", "h", "f", None, d, Decimal(1), "DR", n, None, None, None, 1, 1) for k, (i, n, d) in enumerate(t)]
    tx = frames(spark, rows)[0]
    every = names.distinct_names(spark.createDataFrame([(n,) for n in corpus()], "n string"), tx.select("counterparty_merged"), e.select("entity_name"))
    named = names.parties(every, spark.createDataFrame([], "given_name string, short_form string"))
    got = {r.transaction_id: r.mapped_entity_id for r in matching.matches(tx, e, acc, named).collect()}
    assert got.get("t1") == "e1" and got.get("t3") == "e1"
    assert "t2" not in got and "t4" not in got and "t5" not in got and "t6" not in got  # another phone, a label, registered twice, null
    assert matching.matches(tx.where("false"), e, acc, named).count() == 0
