"""Matching the counterparties of transactions with entities, without a shared key.

Many heuristic functions vote on each candidate (a transaction and an entity whose name is of the counterparty's party):
how the names agree, a phone or mail handle, the tail of an account number and a branch code, a town in the description,
what was mapped before, and how the other rows of the same account and party vote. A generative model learns, from the
counts of vote patterns alone, how often each function votes so on true and on false candidates, and which functions hang
together. The posterior is the confidence of the match.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stored

#: The functions and their votes. 0 agrees, 1 contradicts, 2 abstains, unless said otherwise.
VOTES = {
    "name": ("same words", "a slip or a cut", "left out"),
    "handle": ("agrees", "contradicts", "abstains"),
    "account": ("both agree", "tail agrees", "branch agrees", "tail contradicts", "abstains", "branch contradicts"),
    "town": ("agrees", "contradicts", "abstains"),
    "mapped": ("agrees", "contradicts", "abstains"),
    "others": ("agree", "contradict", "mixed", "abstain"),
}
START_TRUE = {
    "name": [0.75, 0.15, 0.1], "handle": [0.4, 0.01, 0.59], "account": [0.12, 0.1, 0.12, 0.005, 0.645, 0.01], "town": [0.15, 0.08, 0.77],
    "mapped": [0.05, 0.03, 0.92], "others": [0.6, 0.01, 0.02, 0.37],
}
START_FALSE = {
    "name": [0.7, 0.15, 0.15], "handle": [0.003, 0.4, 0.597], "account": [0.001, 0.004, 0.01, 0.3, 0.585, 0.1], "town": [0.02, 0.25, 0.73],
    "mapped": [0.02, 0.05, 0.93], "others": [0.005, 0.6, 0.02, 0.375],
}


def clues(t: DataFrame) -> DataFrame:
    """What a description tells beside the name: phone, mail (the part before the sign), tail, branch code, town; null where nothing."""
    d = F.col("description")
    some = lambda p, k=1: F.nullif(F.regexp_extract(d, p, k), F.lit(""))
    handle = F.lower(some(r"([A-Za-z0-9._]+)@[A-Za-z]+"))
    return t.withColumns({
        "_phone": F.when(handle.rlike(r"^\d{10}$"), handle),
        "_mail": F.when(~handle.rlike(r"^\d+$|^q\d+$"), handle),
        "_tail": some(r"(?i)(?:A/C )?\bXX(\d{4})\b"),
        "_branch": F.upper(some(r"(?i)/([A-Z]{4}0\d{6})\b")),
        "_town": F.upper(F.coalesce(some(r"(?i)^CASH DEPOSIT AT ([A-Za-z-]+) BY "), some(r"(?i)/([A-Za-z-]+) BR$"), some(r"(?i)A/C XX\d{4} ([A-Za-z-]{4,})$"))),
    })


def facts(entities: DataFrame, accounts: DataFrame) -> DataFrame:
    """entity_id, phone, mail, town and the tails, branch codes and branch towns of its accounts."""
    own = accounts.where("entity_id is not null").groupBy("entity_id").agg(
        F.collect_set(F.substring("account_number", -4, 4)).alias("tails"), F.collect_set(F.upper("ifsc_code")).alias("branches"), F.collect_set(F.upper("branch_name")).alias("towns"),
    )  # an entity has few accounts
    e = entities.select("entity_id", F.regexp_replace("primary_phone", r"\D", "").alias("phone"), F.lower(F.substring_index("primary_email", "@", 1)).alias("mail"), F.upper(F.trim(F.element_at(F.split("registered_address", ","), -1))).alias("town"))
    none = F.array().cast("array<string>")
    return e.join(own, "entity_id", "left").select("entity_id", "phone", "mail", "town", *[F.coalesce(c, none).alias(c) for c in ("tails", "branches", "towns")])


def registered_once(entities: DataFrame, named: DataFrame) -> DataFrame:
    """entity_id, party of the entities that aren't registered twice.

    Two entities of one party are one, registered twice, unless an identifier that both have tells them apart (PAN, GSTIN,
    phone, mail); namesakes stay. Comparisons are within a party of names, by equi-join.
    """
    e = entities.where("entity_id is not null").join(named.select(F.col("name").alias("entity_name"), "party"), "entity_name").select("entity_id", "party", "pan", "gstin", F.col("primary_phone").alias("phone"), F.lower("primary_email").alias("mail")).dropDuplicates(["entity_id"])
    x, y = e.alias("x"), e.alias("y")
    differs = lambda c: F.coalesce(F.col(f"x.{c}") != F.col(f"y.{c}"), F.lit(False))
    agrees = F.coalesce(F.col("x.phone") == F.col("y.phone"), F.lit(False)) | F.coalesce(F.col("x.pan") == F.col("y.pan"), F.lit(False))
    same = agrees | ~(differs("pan") | differs("gstin") | differs("phone") | differs("mail"))
    twice = x.join(y, F.col("x.party") == F.col("y.party")).where("x.entity_id <> y.entity_id").where(same).select(F.col("x.entity_id").alias("entity_id")).distinct()
    return e.join(twice, "entity_id", "left_anti").select("entity_id", "party")


def _vote(agree: Column, known: Column) -> Column:
    return F.when(~known, 2).when(agree, 0).otherwise(1)


def candidates(transactions: DataFrame, entities: DataFrame, accounts: DataFrame, named: DataFrame) -> DataFrame:
    """transaction_id, account_id, party, entity_id and the votes of all functions but ``others``.

    Rows whose counterparty is null or whose mapping is verified are no questions. Names that are no party of an entity,
    labels and shops among them, drop out at the join.
    """
    once = registered_once(entities, named)
    own_name = entities.select("entity_id", F.col("entity_name")).dropDuplicates(["entity_id"])
    reading = named.select(F.col("name").alias("entity_name"), F.col("rare").alias("e_rare"), F.col("frequent").alias("e_frequent"))
    target = once.join(own_name, "entity_id").join(reading, "entity_name").join(facts(entities, accounts).dropDuplicates(["entity_id"]), "entity_id")
    pairs = named.select("name", "party", "rare", "frequent").join(target, "party")
    name_vote = F.when(F.size("frequent") == 0, 2).when((F.col("rare") == F.col("e_rare")) & (F.size("frequent") == 1), 0).when(F.size("frequent") == 1, 1).otherwise(2)
    pairs = pairs.withColumn("v_name", name_vote).drop("rare", "frequent", "e_rare", "e_frequent", "entity_name")
    pairs = stored(pairs, "name-candidates")  # grows with the names: Spark broadcasts it only within its own bound on bytes
    t = transactions.where("transaction_id is not null and counterparty_merged is not null and not coalesce(mapping_verified, false)")
    t = clues(t.select("transaction_id", F.coalesce("account_id", F.lit("")).alias("account_id"), F.col("counterparty_merged").alias("name"), "description", "mapped_entity_id")).drop("description")
    met = t.join(pairs, "name")
    has = lambda c: F.col(c).isNotNull()
    phone, mail = has("_phone") & has("phone"), has("_mail") & has("mail")
    handle = F.when(phone, _vote(F.col("_phone") == F.col("phone"), phone)).otherwise(_vote(F.col("_mail") == F.col("mail"), mail))
    tail, branch = has("_tail") & (F.size("tails") > 0), has("_branch") & (F.size("branches") > 0)
    tail_ok, branch_ok = tail & F.array_contains("tails", F.col("_tail")), branch & F.array_contains("branches", F.col("_branch"))
    account = F.when(tail_ok & branch_ok, 0).when(tail_ok, 1).when(branch_ok & ~tail, 2).when(tail, 3).when(branch, 5).otherwise(4)
    towns = F.array_compact(F.array_append(F.col("towns"), F.col("town")))
    cut = F.exists(towns, lambda x: x.startswith(F.col("_town")))
    town = _vote(cut, has("_town") & (F.size(towns) > 0))
    mapped = F.when(F.col("mapped_entity_id").isNull(), 2).when(F.col("mapped_entity_id") == F.col("entity_id"), 0).otherwise(1)
    return met.select("transaction_id", "account_id", "party", "entity_id", "v_name", handle.alias("v_handle"), account.alias("v_account"), town.alias("v_town"), mapped.alias("v_mapped"))


def with_others(c: DataFrame) -> DataFrame:
    """c with the vote of the other rows of the same account and party on the same entity, summed before it is joined back.

    Sums over all accounts are made from those of each, and joined to them, so that rows meet sums by (account, party,
    entity) alone: a party that holds a third of all rows is spread over its accounts.
    """
    good = ((F.col("v_handle") == 0) | F.col("v_account").isin(0, 1)).cast("long")
    bad = ((F.col("v_handle") == 1) | (F.col("v_account") == 3)).cast("long")
    group = ["account_id", "party", "entity_id"]
    sums = c.groupBy(*group).agg(F.sum(good).alias("g"), F.sum(bad).alias("b"))
    all_sums = sums.groupBy("party", "entity_id").agg(F.sum("g").alias("pg"), F.sum("b").alias("pb"))
    j = c.join(sums.join(all_sums, ["party", "entity_id"]), group)
    g, b = F.col("g") - good, F.col("b") - bad
    # an account deals with one party of a name: its own rows say more than those of other accounts
    lone = F.when((F.col("pg") > 0) & (F.col("pb") == 0), 0).when((F.col("pb") > 0) & (F.col("pg") == 0), 1).when((F.col("pg") > 0) & (F.col("pb") > 0), 2).otherwise(3)
    vote = F.when((g > 0) & (g > 3 * b), 0).when((b > 0) & (b > 3 * g), 1).when(g + b > 0, 2).otherwise(lone)
    return j.select(*c.columns, vote.alias("v_others"))


Table = dict[int, list[float]]  # by the parent's vote (0 where there is none): the rate of each vote


@dataclass
class Model:
    """Rates of each function's votes on true and on false candidates, given the vote of the function it hangs on most, if any."""

    true: dict[str, Table]
    false: dict[str, Table]
    parent: dict[str, str | None]
    share: float

    def posterior(self, votes: dict[str, int]) -> float:
        odds = math.log(self.share / (1 - self.share))
        for f, k in votes.items():
            given = votes[self.parent[f]] if self.parent[f] else 0
            odds += math.log(self.true[f][given][k] / self.false[f][given][k])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


Counts = list[tuple[dict[str, int], int]]


def _expected(model: Model, counts: Counts, prior: float, rounds: int) -> Model:
    """Expectation maximisation from a model, with its own rates as a prior of ``prior`` rows for each table."""
    start, total = model, sum(n for _, n in counts)
    for _ in range(rounds):
        t, u = ({f: {g: [prior * p for p in row] for g, row in side[f].items()} for f in VOTES} for side in (start.true, start.false))
        yes = prior * start.share
        for votes, n in counts:
            p = model.posterior(votes)
            yes += n * p
            for f, k in votes.items():
                given = votes[model.parent[f]] if model.parent[f] else 0
                t[f][given][k] += n * p
                u[f][given][k] += n * (1 - p)
        rates = lambda side: {f: {g: [x / sum(row) for x in row] for g, row in tables.items()} for f, tables in side.items()}
        model = Model(rates(t), rates(u), model.parent, min(0.99, max(0.01, yes / (total + prior))))
    return model


def dependences(model: Model, counts: Counts) -> dict[tuple[str, str], float]:
    """How much two functions' votes tell of each other once it is known whether a candidate is true: the conditional mutual information, in nats."""
    total = sum(n for _, n in counts) or 1
    weights = [(votes, n * p / total, n * (1 - p) / total) for votes, n in counts for p in (model.posterior(votes),)]
    out = {}
    for f, g in itertools.combinations(VOTES, 2):
        told = 0.0
        for side in (1, 2):
            both, one, two = Counter(), Counter(), Counter()
            for w in weights:
                x, y = w[0][f], w[0][g]
                both[x, y] += w[side]
                one[x] += w[side]
                two[y] += w[side]
            mass = sum(both.values())
            told += sum(v * math.log(v * mass / (one[x] * two[y])) for (x, y), v in both.items() if v > 0)
        out[f, g] = told
    return out


def learned(counts: Counts, rounds: int = 30, least: float = 0.002) -> Model:
    """The model from counts of vote patterns (at most 1,944): accuracies first, as if functions were independent; then which hang
    together, as the tree over functions of the largest conditional mutual information (links of ``least`` nats or more); then
    accuracies again, each function's given the vote of the one it hangs on, so that evidence counted twice weighs once.

    The prior is one part in fifty, of 200 rows at least. Without rows the start rates are returned.
    """
    none = dict.fromkeys(VOTES)
    model = Model({f: {0: START_TRUE[f]} for f in VOTES}, {f: {0: START_FALSE[f]} for f in VOTES}, none, 0.7)
    total = sum(n for _, n in counts)
    if not total:
        return model
    model = _expected(model, counts, max(200.0, 0.02 * total), rounds)
    parent, joined = dict(none), {next(iter(VOTES))}
    links = dependences(model, counts)
    while len(joined) < len(VOTES):
        told, _, up, f = max((links.get((a, b), links.get((b, a), 0.0)), -i, a, b) for i, a in enumerate(VOTES) if a in joined for b in VOTES if b not in joined)
        joined.add(f)
        parent[f] = up if told >= least else None
    spread = lambda side: {f: dict.fromkeys(range(len(VOTES[parent[f]])) if parent[f] else (0,), side[f][0]) for f in VOTES}
    return _expected(Model(spread(model.true), spread(model.false), parent, model.share), counts, max(200.0, 0.02 * total), rounds)


def matches(transactions: DataFrame, entities: DataFrame, accounts: DataFrame, named: DataFrame, least: float = 0.5) -> DataFrame:
    """transaction_id, mapped_entity_id, mapping_confidence: the best entity of each transaction, if its posterior reaches ``least``.

    named: name, party, rare, frequent as from ``names.parties``. Of entities with equal posteriors none is taken: they
    are namesakes that nothing tells apart. No candidates give no rows.
    """
    names_ = [f"v_{f}" for f in VOTES]
    voted = stored(with_others(stored(candidates(transactions, entities, accounts, named), "candidates")), "voted")
    patterns = voted.groupBy(*names_).agg(F.count("*").alias("n")).collect()
    counts = [({f: r[f"v_{f}"] for f in VOTES}, r["n"]) for r in patterns]
    model = learned(counts)
    code = F.lit(0)
    for f, v in VOTES.items():
        code = code * len(v) + F.col(f"v_{f}")

    def number(votes: dict[str, int]) -> int:
        out = 0
        for f, v in VOTES.items():
            out = out * len(v) + votes[f]
        return out

    spark = transactions.sparkSession
    table = spark.createDataFrame([(number(v), float(model.posterior(v))) for v, _ in counts], "code int, p double")
    scored = voted.withColumn("code", code).join(F.broadcast(table), "code").where(F.col("p") >= least)  # at most 1,944 rows
    best = scored.groupBy("transaction_id").agg(F.max("p").alias("p"), F.max_by("entity_id", "p").alias("entity_id"), F.sort_array(F.collect_set(F.struct("p", "entity_id")), False).alias("all"))
    tied = (F.size("all") > 1) & (F.get(F.col("all"), F.lit(0))["p"] == F.get(F.col("all"), F.lit(1))["p"])
    return best.where(~tied).select("transaction_id", F.col("entity_id").alias("mapped_entity_id"), F.round("p", 4).alias("mapping_confidence"))
