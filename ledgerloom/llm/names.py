"""Variant spellings of names typed by people, linked to the party they name.

A name is read into a rare part (a surname, a firm's own word), a frequent part (a given name, a trade) and a legal form.
Which words are frequent is counted over all names. Rare parts are blocked by their suffixes above a minimum length,
backward, and by what is left of them without a letter, each with the frequent word; every pair that may be linked meets,
however many share a key. Pairs are compared by the ratio of their longest common subsequence: one letter may be astray.
Links that need no guess come first and make parties; a spelling that leaves something
out (an initial, a nickname, a firm's word alone, a cut end) joins a party only if there is just one it fits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import stored

#: Forms of address, and the words of legal forms with their usual abbreviations.
TITLES = {"mr", "mrs", "ms", "miss", "shri", "sri", "shree", "smt", "dr", "kum", "kumari", "messrs", "prof", "md"}
LEGAL = {"pvt": "pvt", "pte": "pvt", "ltd": "ltd", "llp": "llp", "inc": "inc", "corp": "corp", "co": "co", "sons": "sons", "bros": "bros", "agcy": "agy"}
#: The words themselves; a word that is one of them cut short or its consonants stands for it.
WRITTEN_OUT = {"private": "pvt", "limited": "ltd", "company": "co", "brothers": "bros", "sons": "sons", "enterprises": "ent", "enterprise": "ent", "agencies": "agy", "agency": "agy"}
CUT = 4  # letters of the shortest rare part that may be another cut short
SLIP, BARE_SLIP = 5, 7  # letters of the shortest rare part in which a slip is forgiven, with a frequent part and without


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        m = where.get(c, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def astray(a: str, b: str) -> bool:
    """Whether two words are one but for a letter: their longest-common-subsequence ratio, as written or with long vowels and
    double letters written short, is what one letter changed, moved, added or left out leaves of the longer, at least."""
    least = 1 - 1 / max(len(a), len(b), 1) - 1e-9
    return ratio(a, b) >= least or ratio(sounded(a), sounded(b)) >= least


@lru_cache(maxsize=200_000)
def sounded(word: str) -> str:
    """A word with long vowels written short (ee, oo, aa) and double letters once."""
    return re.sub(r"(.)\1", r"\1", word.replace("ee", "i").replace("oo", "u"))


def folded(text: str) -> list[str]:
    """The words of a name in lower case without marks; what stands in brackets counts as words, dots within a word don't."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    text = re.sub(r"\bm/s\b\.?", " ", text).replace("&", " and ")
    text = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m.group().replace(".", ""), text)
    return [w for w in re.split(r"[^a-z0-9ऀ-￿]+", text) if w]


@lru_cache(maxsize=100_000)
def written_short(word: str, after_private: bool) -> str | None:
    """The legal form that a word is, or of which it is a cut end or the consonants; after 'private' one or two letters of limited will do."""
    return next((kind for full, kind in WRITTEN_OUT.items() if word == full or (len(word) > 2 and shortened(word, full)) or (after_private and full == "limited" and full.startswith(word))), None)


def legal_of(words: list[str]) -> tuple[str, list[str]]:
    """The legal form of a name ('' for none) and its other words."""
    kinds: list[str] = []
    rest: list[str] = []
    for k, w in enumerate(words):
        if w in ("and", "n") and len(words) > 1:
            continue
        if w == "p" and k + 1 < len(words) and words[k + 1] in ("ltd", "limited", "l"):
            kinds.append("pvt")
        elif w == "l" and kinds[-1:] == ["pvt"]:
            kinds.append("ltd")
        elif w in LEGAL and (k or len(words) == 1):
            kinds.append(LEGAL[w])
        elif k and (kind := written_short(w, kinds[-1:] == ["pvt"])):
            kinds.append(kind)
        else:
            rest.append(w)
    if "llp" in kinds:
        return "llp", rest
    if "ltd" in kinds:
        return ("pvtltd" if "pvt" in kinds else "ltd"), rest
    return (kinds[-1] if kinds else ""), rest


def words_of(name: str) -> tuple[str, list[str]]:
    """The legal form and the words of a name, without titles at its head."""
    words = folded(name)
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    return legal_of(words)


class Lexicon:
    """The frequent words of all names, which of them are trades, and nicknames."""

    def __init__(self, given: list[str], trades: list[str], nicknames: dict[str, list[str]]):
        self.given, self.trades, self.nicknames = set(given), set(trades), nicknames
        self.by_letter: dict[str, list[str]] = {}
        for w in given:
            self.by_letter.setdefault(w[0], []).append(w)
        self.kept: dict[tuple[str, bool, bool], tuple[list[str], int]] = {}

    def near(self, word: str, trades: bool, given: bool) -> tuple[list[str], int]:
        """The frequent words that a word may stand for, and how sure: 4 the word itself, 3 a known nickname, 2 a slip, 1 a cut."""
        got = self.kept.get((word, trades, given))
        if got is None:
            got = self.kept[word, trades, given] = self._near(word, trades, given)
        return got

    def _near(self, word: str, trades: bool, given: bool) -> tuple[list[str], int]:
        pool = (self.trades if trades else set()) | (self.given if given else set())
        if word in pool:
            return [word], 4
        if given and word in self.nicknames:
            return [w for w in self.nicknames[word]], 3
        if len(word) >= SLIP - 1:
            own = set(word)
            # a letter astray leaves all but one or two of the letters: a cheap test before the ratio
            found = [w for w in pool if abs(len(w) - len(word)) <= 2 and max(len(w), len(word)) >= SLIP and len(own.symmetric_difference(w)) <= 3 and astray(word, w)]
            if found:
                return found, 2
        if len(word) >= 3 or (trades and not given and len(word) == 2):
            found = [w for w in pool if len(w) > len(word) and (w.startswith(word) or (trades and w in self.trades and shortened(word, w)))]
            if len(found) == 1 and found[0] in self.trades:
                return found, 2
            if not found and given and 4 <= len(word) <= 6:
                found = [w for w in self.given if len(w) > len(word) and w[:3] == word[:3] and word[-1] in "uyia" + w]
                found = found if len(found) == 1 else []
            if found:
                return found, 1
        return [], 0


def read_name(name: str, lexicon: Lexicon) -> tuple[str, list[str], str, int, str]:
    """(rare part, frequent words it may go with, legal form, sureness of these, kind) of a name.

    Kind: person, firm, bare (a rare part alone), label (frequent words alone). An initial stands for every given name it begins.
    """
    legal, words = words_of(name)
    letters = [w for w in words if len(w) == 1]
    full = [w for w in words if len(w) > 1]
    if not full:
        return " ".join(words) or name, [], legal, 0, "label"
    firm = bool(legal)
    sure = [lexicon.near(w, trades=firm or w in lexicon.trades, given=not firm) for w in full]
    if not firm and len(full) > 1 and not any(s[1] for s in sure):  # a firm whose legal form was cut off
        sure = [lexicon.near(w, trades=True, given=False) if k and len(w) >= 4 else s for k, (w, s) in enumerate(zip(full, sure, strict=True))]
    exact = [k for k, s in enumerate(sure) if s[1] == 4]
    if len(exact) == len(full):
        if len(full) == 1 and letters and not firm:  # a frequent word with an initial
            return full[0], [], legal, 0, "label"
        if not (firm and len(full) == 2):
            return " ".join(sorted(full)) if not firm else " ".join(full), [], legal, 0, "label"
    best = None
    if exact:
        best = exact[-1] if firm else exact[0]
        if len(full) == 1:
            best = None
    elif len(full) > 1:
        order = sorted(range(len(full)), key=lambda k: (-sure[k][1], -k if firm else k))
        if sure[order[0]][1] > 0:
            best = order[0]
    if best is not None:
        rare = "".join(w for k, w in enumerate(full) if k != best)
        if full[best] in lexicon.trades or (sure[best][0] and sure[best][0][0] in lexicon.trades):
            return rare, sure[best][0], legal, sure[best][1], "firm"
        return rare, sure[best][0], legal, sure[best][1], "firm" if firm else "person"
    rare = "".join(full)
    if len(full) == 1 and not firm:
        for w in sorted(lexicon.given, key=len, reverse=True):
            if len(w) >= 5 and len(rare) - len(w) >= 4 and (rare.startswith(w) or rare.endswith(w)):
                return (rare[len(w) :] if rare.startswith(w) else rare[: -len(w)]), [w], legal, 4, "person"
        if letters:
            return rare, lexicon.by_letter.get(letters[0], []), legal, 1, "person"
        return rare, [], legal, 0, "bare"
    return rare, [], legal, 0, "firm" if firm else "bare"


READ = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("rare", T.StringType()), T.StructField("frequent", T.ArrayType(T.StringType())),
    T.StructField("legal", T.StringType()), T.StructField("sure", T.IntegerType()), T.StructField("kind", T.StringType()),
])
WORDS = T.StructType([T.StructField("partner", T.StringType()), T.StructField("word", T.StringType()), T.StructField("firm", T.BooleanType())])


def distinct_names(*columns: DataFrame) -> DataFrame:
    """name: the distinct strings of one-column DataFrames, without nulls and blanks. Case and blanks tell strings apart."""
    out = None
    for df in columns:
        one = df.select(F.col(df.columns[0]).alias("name")).where("name is not null and trim(name) <> ''").distinct()
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def lexicon_of(names: DataFrame, nicknames: DataFrame, share: float = 0.0002, least: int = 4) -> Lexicon:
    """The frequent words of names: those that go with at least ``share`` times as many different words as there are names, and ``least``.

    A given name or a trade goes with many rare parts, a surname with the given names of its kin, however often and however
    variously it is written. At most words-per-name / share words pass, some thousands whatever the corpus, so they may come
    to the driver. A word that goes with a legal form in a third of its pairs or more is a trade. nicknames: given_name,
    short_form, a table of fixed size; known given names are frequent words too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                legal, words = words_of(name)
                words = sorted({w for w in words if len(w) > 2})
                rows += [(v, w, bool(legal)) for w in words for v in words if v != w]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))], WORDS.names)

    total = names.count()
    pairs = names.mapInArrow(run, WORDS).groupBy("word", "partner").agg(F.max(F.col("firm").cast("int")).alias("firm"))
    counted = pairs.groupBy("word").agg(F.count("*").alias("n"), F.sum("firm").alias("f"))
    frequent = counted.where(F.col("n") >= max(least, share * total)).collect()
    short: dict[str, list[str]] = {}
    known = set()
    for g, s in nicknames.select(F.lower("given_name"), F.lower("short_form")).where("given_name is not null and short_form is not null").distinct().collect():
        short.setdefault(s, []).append(g)
        known.add(g)
    trades = [r["word"] for r in frequent if r["f"] * 3 >= r["n"] and r["word"] not in known and r["word"] not in short]
    given = [r["word"] for r in frequent if r["f"] * 3 < r["n"] and r["word"] not in short]
    n = {r["word"]: r["n"] for r in frequent}
    cut = {t for t in trades if any(shortened(t, w) and n[w] > n[t] for w in trades)}
    first = Lexicon(sorted(set(given) | known), sorted(set(trades) - cut), {k: sorted(v) for k, v in short.items()})
    return with_learned_nicknames(names, first, known, n)


def shortened(word: str, full: str) -> bool:
    """Whether a word is a full one cut short, or its consonants: mach or mchns for machines."""
    if len(word) >= len(full) or word[0] != full[0]:
        return False
    return full.startswith(word) or full.startswith(word.removesuffix("s")) or (not set(word[1:]) & set("aeiou") and lcs(word, full) == len(word))


def with_learned_nicknames(names: DataFrame, lexicon: Lexicon, known: set[str], partners: dict[str, int], share: float = 0.3) -> Lexicon:
    """The lexicon with nicknames learned from the names: a frequent short word is one of a given name if, of the rare parts
    it goes with, at least ``share`` also go with that given name, which goes with at least twice as many words.

    Counts are over all names; what comes to the driver are pairs of frequent words.
    """
    asked = [w for w in lexicon.given if len(w) <= 6 and w not in known]
    if not asked:
        return lexicon
    read = readings(names, lexicon).where("kind = 'person' and size(frequent) = 1 and sure = 4").select("rare", F.col("frequent")[0].alias("w")).distinct()
    one = read.where(F.col("w").isin(asked)).select("rare", F.col("w").alias("short"))
    total = {r["short"]: r["n"] for r in one.groupBy("short").agg(F.count("*").alias("n")).collect()}
    met = one.join(read.withColumnRenamed("w", "full"), "rare").where("short <> full").groupBy("short", "full").agg(F.count("*").alias("n")).collect()
    more = {k: list(v) for k, v in lexicon.nicknames.items()}
    for r in met:
        if r["n"] >= max(2, share * total[r["short"]]) and len(r["full"]) >= len(r["short"]) and partners.get(r["full"], 0) >= 2 * partners.get(r["short"], 0):
            more.setdefault(r["short"], []).append(r["full"])
    gone = {w for w in asked if w in more}
    return Lexicon(sorted(lexicon.given - gone), sorted(lexicon.trades), {k: sorted(set(v) - gone) for k, v in more.items() if set(v) - gone})


def readings(names: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The reading of each name, as ``read_name`` gives it."""
    made = names.sparkSession.sparkContext.broadcast((sorted(lexicon.given), sorted(lexicon.trades), lexicon.nicknames))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*made.value)
        for b in batches:
            got = [read_name(n, lex) for n in b.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("name"), *[pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string()))]], READ.names)

    return names.select("name").mapInArrow(run, READ)


def classes(read: DataFrame) -> DataFrame:
    """One row for each distinct reading: cid (a hash of it), rare, frequent, legal, kind, names (how many)."""
    same = F.xxhash64("kind", "rare", F.array_join("frequent", ","), "legal")
    return read.withColumn("cid", same).groupBy("cid").agg(F.first("rare").alias("rare"), F.first("frequent").alias("frequent"), F.first("legal").alias("legal"), F.first("kind").alias("kind"), F.max("sure").alias("sure"), F.count("*").alias("names"))


KEYS = T.StructType([T.StructField("cid", T.LongType()), T.StructField("key", T.LongType()), T.StructField("asks", T.BooleanType()), T.StructField("found", T.BooleanType())])


def worn(rare: str) -> set[str]:
    """The rare part and what is left of it without each of its letters: any two that are one but for a letter share one of these."""
    return {rare} | {rare[:k] + rare[k + 1 :] for k in range(len(rare))}


def slips(rare: str, least: int) -> set[str]:
    """What any two rare parts that are ``astray`` share, if both have ``least`` letters; of a shorter one the rare part itself."""
    return worn(rare) | worn(sounded(rare)) if len(rare) >= least else {rare}


def link_keys(rare: str, frequent: list[str]) -> dict[str, tuple[bool, bool]]:
    """The keys of a reading, and whether it asks for others by each and is found by others: a pair of readings meets where
    one asks by a key that the other is found by.

    They follow ``link_of``, so that every pair it accepts meets, and few others do. Equal rare parts and slips meet with
    a frequent word. A cut end asks for what it may have been cut from, which is found by its backward suffixes from CUT
    letters on, with a frequent word. A reading without a frequent part asks by the rare part and its slips alone.
    """
    out: dict[str, tuple[bool, bool]] = {f"{v}|": (not frequent, True) for v in slips(rare, BARE_SLIP)}
    own = slips(rare, SLIP)
    for w in frequent:
        out |= {f"{v}|{w}": (True, True) for v in own}
        out |= {f"<{rare[:n]}|{w}": (False, True) for n in range(CUT, len(rare))}
        if len(rare) >= CUT:
            out[f"<{rare}|{w}"] = (True, False)
    return out


def link_index(cls: DataFrame) -> DataFrame:
    """cid, key (hashes of the keys of ``link_keys``), asks and found. Labels have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            ids, keys, asks, found = [], [], [], []
            for cid, rare, frequent, kind in zip(*[b.column(c).to_pylist() for c in ("cid", "rare", "frequent", "kind")], strict=True):
                if kind != "label":
                    for key, (ask, find) in link_keys(rare, frequent).items():
                        ids.append(cid)
                        keys.append(xxhash.xxh64_intdigest(key) - (1 << 63))
                        asks.append(ask)
                        found.append(find)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((ids, pa.int64()), (keys, pa.int64()), (asks, pa.bool_()), (found, pa.bool_()))], KEYS.names)

    return cls.select("cid", "rare", "frequent", "kind").mapInArrow(run, KEYS)


def meetings(index: DataFrame) -> DataFrame:
    """a, b: the pairs of classes of which one asks by a key that the other is found by.

    No key is refined or dropped, whatever its size. Readings that are only found by a key, as the many of a surname or of
    a beginning are, don't meet each other, so pairs grow with the links and not with the square of a key.
    """
    x, y = index.where("asks").alias("x"), index.where("found").alias("y")
    return x.join(y, F.col("x.key") == F.col("y.key")).where("x.cid <> y.cid").select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("strong", T.BooleanType())])


def link_of(x: tuple, y: tuple) -> bool | None:
    """True: the two readings are one party for sure; False: one may be the other with something left out; None: they differ.

    x, y: (rare, frequent, legal, kind, sure).
    """
    (ra, fa, la, ka, sa), (rb, fb, lb, kb, sb) = x, y
    if "label" in (ka, kb):
        return None
    if la and lb and la != lb and {la, lb} != {"pvtltd", "pvt"}:
        return None
    if bool(fa) and bool(fb) and not set(fa) & set(fb):
        return None
    if {ka, kb} == {"person", "firm"}:
        return None
    short, long = (ra, rb) if len(ra) <= len(rb) else (rb, ra)
    if ra == rb:
        key = 2
    elif len(short) >= SLIP and astray(ra, rb):
        key = 1
    elif len(short) >= CUT and long.startswith(short) and fa and fb:
        key = 0
    else:
        return None
    full = len(fa) == 1 and len(fb) == 1 and sa >= 2 and sb >= 2
    if full and key and (la == lb or {la, lb} == {"pvtltd", "pvt"}):
        return True
    if not fa or not fb:  # a rare part alone, only if it is written right or almost
        return False if key == 2 or (key == 1 and len(short) >= BARE_SLIP) else None
    return False


def links(cls: DataFrame) -> DataFrame:
    """a, b, strong: all links between classes."""
    pairs = meetings(stored(link_index(cls), "suffixes"))
    side = lambda n: cls.select(F.col("cid").alias(n), F.struct("rare", "frequent", "legal", "kind", "sure").alias(f"r{n}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column("ra").to_pylist(), b.column("rb").to_pylist()
            got = [link_of(tuple(x.values()), tuple(y.values())) for x, y in zip(xs, ys, strict=True)]
            keep = [k for k, g in enumerate(got) if g is not None]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at), pa.array([got[k] for k in keep], pa.bool_())], LINKS.names)

    return full.mapInArrow(run, LINKS)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 30) -> DataFrame:
    """cid and party: the least node that edges (a, b) reach. Labels go to the neighbours' least label, then to the label's own.

    Each round is written to the shared folder; rounds end when no label changes. A class has few neighbours, so joins are even.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    linked = both.select(F.col("a").alias("cid")).distinct().withColumn("party", F.col("cid"))
    linked = stored(linked, "labels")
    for _ in range(rounds):
        least = both.join(linked.select(F.col("cid").alias("b"), "party"), "b").groupBy("a").agg(F.min("party").alias("p"))
        step = linked.join(least, linked.cid == least.a, "left").select("cid", F.col("party").alias("old"), F.least("party", F.coalesce("p", "party")).alias("party"))
        jump = step.select(F.col("cid").alias("party"), F.col("party").alias("pp"))
        after = stored(step.join(jump, "party", "left").select("cid", "old", F.coalesce("pp", "party").alias("party")), "labels")
        linked = after.select("cid", "party")
        if after.where("old <> party").isEmpty():
            break
    return nodes.select("cid").join(linked, "cid", "left").select("cid", F.coalesce("party", "cid").alias("party"))


def parties(names: DataFrame, nicknames: DataFrame) -> DataFrame:
    """name and party (a number) of each distinct name; names of one party have the same number.

    Strong links are closed first. Then each class that something was left out of joins the one party its weak links
    reach; with none or several it stays a party of its own. Classes of weak links alone join each other by the same rule.
    """
    lexicon = lexicon_of(names, nicknames)
    read = stored(readings(names, lexicon), "readings")
    cls = stored(classes(read), "classes")
    found = stored(links(cls), "links")
    firm = stored(components(cls, found.where("strong")), "parties")
    # what is left out makes a class the weak side: the fuller class is the one it may join
    full = (F.col("kind") != "bare") & (F.size("frequent") == 1) & (F.col("sure") >= 2) & ((F.col("kind") == "person") | (F.col("legal") != ""))
    level = cls.select("cid", full.cast("int").alias("full"), F.length("rare").alias("len"), F.size("frequent").alias("many"), (F.col("legal") != "").cast("int").alias("has_legal"), "sure")
    rank = F.struct("full", "has_legal", (-F.col("many")).alias("many"), "len", "sure")
    weak = found.where("not strong").join(level.select(F.col("cid").alias("a"), rank.alias("la")), "a").join(level.select(F.col("cid").alias("b"), rank.alias("lb")), "b")
    weak = weak.select(F.when(F.col("la") < F.col("lb"), F.col("a")).otherwise(F.col("b")).alias("cid"), F.when(F.col("la") < F.col("lb"), F.col("b")).otherwise(F.col("a")).alias("other"))
    target = weak.join(firm.select(F.col("cid").alias("other"), "party"), "other").join(firm.select("cid", F.col("party").alias("own")), "cid").where("own <> party")
    sizes = firm.groupBy("party").agg(F.count("*").alias("n"))
    fullness = firm.join(level, "cid").groupBy("party").agg(F.max("full").alias("full"))
    target = target.join(fullness, "party")
    only = target.groupBy("own").agg(F.countDistinct(F.when(F.col("full") == 1, F.col("party"))).alias("fulls"), F.min(F.when(F.col("full") == 1, F.col("party"))).alias("full_party"), F.countDistinct("party").alias("all"), F.min("party").alias("any_party"))
    joins = only.select("own", F.when(F.col("fulls") == 1, F.col("full_party")).when((F.col("fulls") == 0) & (F.col("all") == 1), F.col("any_party")).alias("to")).where("to is not null")
    merged = stored(components(sizes.select(F.col("party").alias("cid")), joins.select(F.col("own").alias("a"), F.col("to").alias("b"))), "merged")
    final = firm.join(merged.select(F.col("cid").alias("party"), F.col("party").alias("root")), "party").select("cid", F.col("root").alias("party"))
    of = read.withColumn("cid", F.xxhash64("kind", "rare", F.array_join("frequent", ","), "legal"))
    return of.join(final, "cid").select("name", "party", "kind", "rare", "frequent", "legal")


def name_pairs(named: DataFrame) -> DataFrame:
    """name_a, name_b: all pairs of different strings of one party, the smaller first."""
    a = named.select("party", F.col("name").alias("name_a"))
    b = named.select("party", F.col("name").alias("name_b"))
    return a.join(b, "party").where("name_a < name_b").select("name_a", "name_b").distinct()


# The blocking by suffixes that was used before. No query calls it, as what its refined keys drop depends on how many classes
# share a key; an existing test holds it.
LEAST = 3  # letters of the shortest suffix
FREE = 6  # letters of the shortest suffix that is used without the frequent part
COMMON = 300  # classes of a key beyond which it is refined
SUFFIX_KEYS = T.StructType([T.StructField("cid", T.LongType()), T.StructField("key", T.LongType()), T.StructField("finer", T.LongType())])


def keys_of(rare: str, frequent: list[str]) -> dict[str, str]:
    """The keys of a reading and what refines each where it is too common.

    Suffixes of LEAST letters, forward, and all from LEAST letters on, backward (a cut end leaves these), go with a frequent word
    and are refined by the letters beside them; suffixes of FREE letters, the rare part and what a letter astray leaves of it (of a short
    one with a frequent word) go alone and are refined by the frequent word.
    """
    out: dict[str, str] = {}
    first = frequent[0] if len(frequent) == 1 else ""
    back = rare[::-1]
    for w in frequent:
        out[f"{rare}|{w}"] = ""
        out[f"{rare[-LEAST:]}|{w}"] = rare[-2 * LEAST : -LEAST]
        for n in range(min(LEAST, len(rare)), len(rare) + 1):
            out[f"<{back[-n:]}|{w}"] = back[-n - LEAST : -n]
    out[f"{rare}|"] = first
    if len(rare) >= FREE:
        out[f"{rare[-FREE:]}|"] = out[f"<{back[-FREE:]}|"] = first
    if len(rare) >= SLIP:
        left = worn(rare) | worn(sounded(rare))
        if len(rare) >= BARE_SLIP:
            out |= {f"~{v}|": first for v in left}
        else:
            out |= {f"~{v}|{w}": "" for v in left for w in frequent}
    return out


def suffix_index(cls: DataFrame) -> DataFrame:
    """cid, key and finer: hashes of the keys of ``keys_of`` and of what refines them. Labels have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        number = lambda x: xxhash.xxh64_intdigest(x) - (1 << 63)
        for b in batches:
            ids, keys, finer = [], [], []
            for cid, rare, frequent, kind in zip(*[b.column(c).to_pylist() for c in ("cid", "rare", "frequent", "kind")], strict=True):
                if kind != "label":
                    found = keys_of(rare, frequent)
                    ids += [cid] * len(found)
                    keys += map(number, found)
                    finer += map(number, found.values())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, keys, finer)], SUFFIX_KEYS.names)

    return cls.select("cid", "rare", "frequent", "kind").mapInArrow(run, SUFFIX_KEYS)


def candidates(index: DataFrame, common: int = COMMON) -> DataFrame:
    """a, b: the pairs of classes that share a key; of a key that more than ``common`` classes have, those that also agree in what refines it.

    What a refined key drops is no link or decides nothing: two rare parts but for a letter share a key of their own, so do a
    cut end and what it was cut from, and a spelling that leaves the frequent word out fits more than one of so many.
    """
    counts = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    index = index.join(counts, "key").select("cid", F.when(F.col("n") > common, F.xxhash64("key", "finer")).otherwise(F.col("key")).alias("key"))
    return index.alias("x").join(index.alias("y"), F.col("x.key") == F.col("y.key")).where("x.cid < y.cid").select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
