"""Garbled text from a wrong character encoding: found, and restored where possible.

A word with characters beyond ASCII is the start of a best-first search. Its moves encode the word in one charset and decode
the bytes in another, or undo an HTML or backslash escape; visited states are kept by hash, and a cost of how implausible a
word's characters are picks the next state. The cheapest state reached is the word as it was written. Words repeat, so each
worker keeps the answers it has found. Texts are read whole, word by word, and words that ASCII alone spells are never touched.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bpe import spread

WORD = re.compile(r"[^ \t\n\r\f\v]*[^\x00-\x7f][^ \t\n\r\f\v]*|[^ \t\n\r\f\v]*(?:&[A-Za-z]{2,8};|&#\d{2,6};|\\u[0-9a-f]{4})[^ \t\n\r\f\v]*")
SPACE = re.compile(r"[ \t\n\r\f\v]+")
ESCAPE = re.compile(r"&[A-Za-z]{2,8};|&#\d{2,6};|\\u[0-9a-f]{4}")
#: Quotation marks of one charset read in another look like letters: where no word of the languages has such letters.
QUOTES = re.compile(r"^[A-Za-z]*(?:nít|[tpydkfghbw]ís|[A-Za-z]í(?:ll|re|ve))\W*$|^\W*ì[A-Za-z]|[A-Za-z]î\W*$")
CORE = re.compile(r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*")
#: Charsets a text may wrongly have been decoded in.
WRONG = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850")
#: Charsets a text may have been written in, besides UTF-8.
WRITTEN = ("cp1252",)
MOVES = 24
KEPT = 300_000
#: Signs that stand in ordinary writing, at a word's edge or alone.
USUAL = set("₹€£¥’‘“”–—…°½¼¾§¡¿«»·•≈→©®™²³।ªº\u00a0\u202f\u2009\u200b\u200d\ufe0f\ufeff\u00ad")
#: Letters of the languages that use the Latin script with marks, in lower case; rarer ones cost more.
LATIN = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß")


@lru_cache(maxsize=None)
def _tables() -> tuple[dict[str, dict[str, bytes]], dict[str, list[str]]]:
    """By charset: character to byte and byte to character; bytes that a charset leaves undefined stand for themselves."""
    to_byte, to_char = {}, {}
    for name in {*WRONG, *WRITTEN}:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        to_char[name] = chars
        to_byte[name] = {c: bytes([b]) for b, c in enumerate(chars)}
    return to_byte, to_char


def encoded_in(word: str, charset: str) -> bytes | None:
    table = _tables()[0][charset]
    try:
        return b"".join([table[c] for c in word])
    except KeyError:
        return None


@lru_cache(maxsize=4096)
def _kind(c: str) -> str:
    """l, u: lower and upper Latin letter; o: letter or mark of another script; d: digit; x: never in writing; s: sign."""
    n = ord(c)
    if n < 128:
        return "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "p"
    if 0x80 <= n < 0xA0 or c == "�" or 0xE000 <= n <= 0xF8FF or 0x2500 <= n < 0x25A0:
        return "x"
    category = unicodedata.category(c)
    if category[0] == "M":
        return "m"
    if category[0] == "L" and c not in "ªº":
        if "LATIN" in unicodedata.name(c, ""):
            return "l" if c.islower() else "u"
        return "o"
    return "s"


#: Signs that may follow a letter, stand between two letters, or be followed by another sign.
CLOSING = set("’”…»–—\u00a0\u202f\u200b\u00ad\u2009\ufeff")
BETWEEN = set("’‘–—\u00a0\u202f\u200b\u00ad\u2009")
PAIRED = set("’”“‘…¡¿–—\u00a0\u202f\u200b\ufeff\u2009")
OPENING = set("’“«‘¡¿–—\u00a0\u202f\u200b\u00ad\ufeff\u2009")


def cost(word: str) -> float:
    """How implausible a word's characters are: 0 for ASCII, little for letters with marks where they belong."""
    total, before = 0.0, "p"
    kinds = [_kind(c) for c in word]
    last = len(word) - 1
    others = [unicodedata.name(c, "?").split()[0] for c, k in zip(word, kinds, strict=True) if k == "o"]
    # words of another script alone are ordinary; single letters of it, or letters among signs and Latin ones, aren't
    foreign = 0.1 if set(others) == {"DEVANAGARI"} else 0.3 if len(others) > 2 and len(set(others)) == 1 and not {"l", "u", "x", "s", "d"} & set(kinds) else 3.0
    script = None
    for i, (c, k) in enumerate(zip(word, kinds, strict=True)):
        after = kinds[i + 1] if i < last else "p"
        following = word[i + 1] if i < last else " "
        if k in "lupd" and ord(c) < 128:
            pass
        elif k == "x":
            total += 6
        elif k == "m":
            total += 0.1 if before in "om" else 1.2 if before in "lu" else 4
        elif k == "o":
            name = unicodedata.name(c, "?").split()[0]
            total += foreign
            if before in "lu" or after in "lu" or (script and script != name):
                total += 4
            script = name
        elif k in "lu":
            total += 0.3 if c.lower() in LATIN else 2.0
            if k == "u" and (before == "l" or (after == "l" and before in "lu")):
                total += 3
            if (before in "so" and word[i - 1] not in OPENING) or (after in "os" and following not in CLOSING):
                total += 2
            if c in "ÃÂ" and (after == "s" or (after == "p" and before in "pd")):
                total += 2.5
            if c == "Â" and before == "l":
                total += 1
            if (c in "ÿßœ" and before not in "lum") or (c == "œ" and after == "s"):
                total += 2
        else:
            total += 0.4 if c in USUAL else 0.6 if ord(c) >= 0x1F300 or 0x2600 <= ord(c) < 0x27C0 else 2.5
            if before in "lu" and after in "lu" and c not in BETWEEN:
                total += 3
            elif c in "©®™ªº§²³¼½¾·•¥«" and (before in "lus" or after in "lu"):
                total += 2.5 if c in "·•" else 1.5
            if after == "s" and c not in PAIRED and following not in CLOSING:
                total += 2
        before = k
    marked = sum(ord(c) > 127 and k in "lu" for c, k in zip(word, kinds, strict=True))
    if marked > 2 and not any(ord(c) < 128 and k in "lu" for c, k in zip(word, kinds, strict=True)):
        total += 1.5
    return total + 2.5 if QUOTES.search(word) else total


def _moves(word: str):
    """(next word, its price) for each move from a word."""
    for wrong in WRONG:
        raw = encoded_in(word, wrong)
        if raw is None:
            continue
        try:
            got = raw.decode("utf-8")
            if got != word:
                yield got, 0.2
        except UnicodeDecodeError:
            pass
        for right in WRITTEN:
            if wrong != right and wrong != "latin-1":
                yield "".join(map(_tables()[1][right].__getitem__, raw)), 0.9
    if "&" in word and (got := html.unescape(word)) != word:
        yield got, 0.2
    if "\\u" in word:
        yield re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), word), 0.2
    # bytes that a charset leaves undefined were lost or became another sign: put each one back that makes a character whole
    for lost, backs in (("Ã?", ("Ã\x81", "Ã\x8d")), ("à¥?", ("à¥\x8d",)), ("à¤?", ("à¤\x8f", "à¤\x81")), ("â€?", ("â€\x9d",)), ("ðŸ™?", ("ðŸ™\x8f",)), ("ðŸ‘?", ("ðŸ‘\x8d",))):
        if lost in word:
            for back in backs:
                yield word.replace(lost, back), 0.6
    if word.endswith("Â"):
        yield word[:-1] + "\xa0", 0.4
    if word.endswith("â€") or "â€" in word and "â€\x9d" not in word:
        yield re.sub("â€(?![\x80-\x9f‐-™Œ-ƒˆ˜ -¿])", "â€\x9d", word), 0.6
    if re.search("Ã(?![\x80-\xbfŒ-™])(?=[^A-Za-z]|$)", word):
        yield re.sub("Ã(?![\x80-\xbfŒ-™])(?=[^A-Za-z]|$)", "Ã\xa0", word), 0.6


def restored(word: str) -> str:
    """The cheapest word that the search reaches from a word; the word itself where none is clearly cheaper."""
    start = cost(word)
    best, best_cost = word, start
    heap = [(start, 0.0, word)]
    seen = {hash(word)}
    for _ in range(MOVES):
        if not heap:
            break
        _, spent, state = heapq.heappop(heap)
        for got, price in _moves(state):
            if hash(got) in seen:
                continue
            seen.add(hash(got))
            value = cost(got) + spent + price
            if value < best_cost:
                best, best_cost = got, value
            heapq.heappush(heap, (value, spent + price, got))
    return best if best_cost <= start - 1.0 else word


@lru_cache(maxsize=100_000)
def script_of(word: str, least: int = 3) -> str | None:
    """The script, neither Latin nor Devanagari, of a word's letters if they are all of one and at least ``least``."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) < least or any(ord(c) < 0x370 for c in letters):
        return None
    names = {unicodedata.name(c, "?").split()[0] for c in letters}
    return names.pop() if len(names) == 1 and "DEVANAGARI" not in names and all(_kind(c) in "op" for c in word) else None


class Mender:
    """Mends texts; keeps the answers for up to KEPT words."""

    def __init__(self) -> None:
        self.seen: dict[str, str] = {}

    def word(self, word: str) -> str:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= KEPT:
                self.seen.clear()
            lead = CORE.match(word).end()
            got = self.seen[word] = word[:lead] + self._parts(word[lead:])
        return got

    def _parts(self, core: str) -> str:
        got = restored(core)
        if got != core or "�" in core:
            return got
        # part of a word may be garbled and part not: runs of signs between ASCII ones are tried by themselves
        pieces = re.split(r"([\x00-\x7f]+)", core)
        if len(pieces) > 3 and cost(core) >= 3:
            return "".join(restored(p) if k % 2 == 0 and len(p) > 1 else p for k, p in enumerate(pieces))
        return got

    def mend(self, text: str) -> tuple[bool, bool, str]:
        """Whether a text is garbled, whether all of it could be restored, and the text restored as far as it could be."""
        lost = "�" in text
        words = {w for w in SPACE.split(text) if not w.isascii()}
        if ESCAPE.search(text):
            words |= {m.group() for m in WORD.finditer(text)}
        # a text in another script has words of it that stand: its single letters then are no garbled ones
        scripts = {x for w in words if (x := script_of(w)) and self.word(w) == w}
        changed = False
        for w in words:
            if scripts and (script_of(w, 1) or "") in scripts:
                continue
            if self.word(w) != w:
                changed = True
                break
        if not changed:
            left = lost or any("\x80" <= c < "\xa0" for c in text)
            return left, False, text
        out = WORD.sub(lambda m: m.group() if scripts and (script_of(m.group(), 1) or "") in scripts else self.word(m.group()), text)
        left = lost or any("\x80" <= c < "\xa0" for c in out)
        return True, not left, out


_MENDER = Mender()
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("restorable", T.BooleanType()), T.StructField("text", T.StringType())])


def garbled(df: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """key, restorable and text (restored as far as possible) of each garbled text of df.

    Null and empty texts and texts of ASCII alone, but for escapes, give no row: they are filtered before Python sees them.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("restorable", T.BooleanType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                keys, texts = b.column(0), b.column(1).to_pylist()
                got = [(i, *_MENDER.mend(x)) for i, x in enumerate(texts)]
                got = [x for x in got if x[1]]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([x[0] for x in got], pa.int64())), pa.array([x[2] for x in got], pa.bool_()), pa.array([x[3] if keep_text else None for x in got], pa.string())], schema.names)

    worth = df.select(key, text).where(F.col(text).rlike(r"[^\x00-\x7F]|&[A-Za-z]{2,8};|&#[0-9]{2,6};|\\u[0-9a-f]{4}"))
    return spread(worth).mapInArrow(run, schema)
