"""Garbled text from wrong character encoding: found through clean near-twins, restored by learned mappings.

Words are compared with their twins: words of other texts that are equal once all non-ASCII
characters are stripped. Where two twins are aligned, the characters of one turn into those of
the other by writing them in one charset and reading the bytes in another. The pairs of charsets
that explain enough twins, with the clean form in more texts than the garbled one, are learned.

From a learned pair that ends in UTF-8 follows the sequence that stands for each character known
in the corpus; one such sequence in a text shows that it is garbled. A pair of single-byte
charsets changes single characters, which prove nothing alone; there a text is garbled if its
words become clearly likelier, under the letter pairs of the clean words, by applying the mapping.
"""

from __future__ import annotations

import codecs
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.http import declared_text
from weftline.session import cut_lineage

#: Charsets whose bytes are tried as UTF-8, and single-byte charsets that are tried against each other.
AS_UTF8 = ("cp1252", "latin-1", "cp1251", "mac_roman", "koi8-r", "cp1250", "cp437")
SINGLE = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "cp1250", "mac_roman")
CHARSETS = tuple(dict.fromkeys(AS_UTF8 + SINGLE))
WAYS = [(a, "utf-8") for a in AS_UTF8] + [(a, b) for a in SINGLE for b in SINGLE if a != b]
#: Twins that a pair of charsets must explain, and the share of them whose clean form is in more texts.
MIN_UTF8, MIN_SINGLE, CLEAN_SHARE = 3, 5, 0.8
#: Texts in which a character must stand to be known.
MIN_KNOWN = 5
#: Mean gain per letter pair and whole gain, in nats, from which a text is garbled by a single-byte pair.
MEAN_GAIN, WHOLE_GAIN = 1.0, 12.0
#: Letters whose pairs are counted: those below this code point (Latin, Greek, Cyrillic).
LETTERS_BELOW = 0x530

_WORD = re.compile(r"[0-9A-Za-z]*[^\x00-\x7f][0-9A-Za-z\x80-\U0010ffff]*")
_RUN = re.compile(r"[^\x00-\x7f]+")
#: Runs longer than this are no words of a script with spaces; they are divided at blanks and punctuation beyond ASCII.
WORD_CHARS = 40
_INNER = re.compile("[\u00a0\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
_LOST = re.compile("�|[\x80-\x84\x86-\x9f]")


class Mapping(NamedTuple):
    """What was learned: pairs ending in UTF-8, pairs of single-byte charsets, known characters, letter pairs."""

    utf8: list[str]
    single: list[tuple[str, str]]
    known: list[str]
    pairs: dict[str, int]


@lru_cache(maxsize=32)
def _table(charset: str) -> tuple[str, object]:
    """Character of each byte, and the map back; bytes without a character stand for themselves."""
    back = []
    for b in range(256):
        try:
            back.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            back.append(chr(b))
    return "".join(back), codecs.charmap_build("".join(back))


def _written(text: str, charset: str) -> bytes | None:
    """``text`` in a charset; None where a character is missing. ASCII stays as it is."""
    try:
        return codecs.charmap_encode(text, "strict", _table(charset)[1])[0]
    except UnicodeEncodeError:
        return None


def _as_read(data: bytes, charset: str) -> str | None:
    """Bytes read in a charset; None where they are none of it."""
    if charset != "utf-8":
        return codecs.charmap_decode(data, "strict", _table(charset)[0])[0]
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def rewrite(run: str, written: str, read: str) -> str | None:
    """``run`` written in one charset and read in another; None where that is not possible."""
    data = _written(run, written)
    return None if data is None else _as_read(data, read)


def rewrite_word(word: str, written: str, read: str) -> str | None:
    """``rewrite`` of a word with ASCII in it; None where nothing changes."""
    out = rewrite(word, written, read)
    return None if out == word else out


def _texts(df: DataFrame, key: str, body: str, charset: Column) -> DataFrame:
    return df.select(df[key].alias("k"), df[body].alias("b"), charset.alias("c")).where(F.length(df[body]) > 0)


def shown(body: bytes, charset: str | None) -> str:
    """The declared text with character references resolved."""
    return html.unescape(declared_text(body, charset))


def _words_of(text: str) -> Iterator[tuple[str, bool]]:
    """Words with a non-ASCII character; long runs, as of scripts without spaces, in their parts and (marked) whole."""
    for word in _WORD.findall(text):
        if len(word) > WORD_CHARS:
            parts = [w for part in _INNER.split(word) for w in _WORD.findall(part)]
            yield from ((w, False) for w in parts)
            if parts == [word]:
                continue
        yield word, len(word) > WORD_CHARS


def _words(rows: DataFrame) -> DataFrame:
    """(w, word, run, texts): every word with a non-ASCII character, its hash, whether it is a divided run, and the number of texts it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, bool]] = []
            for b, c in zip(batch.column(1), batch.column(2)):
                text = shown(b.as_py(), c.as_py())
                if not text.isascii():
                    out.extend(set(_words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([r for _, r in out], pa.bool_())], ["word", "run"])

    counted = rows.mapInArrow(run, "word string, run boolean").groupBy("word", "run").agg(F.count("*").alias("texts"))
    return counted.select(F.xxhash64("word").alias("w"), "word", "run", "texts")


def _rewritten(words: DataFrame) -> DataFrame:
    """(w, texts, way, clean): every word under every pair of charsets that is possible for it; divided runs as UTF-8 only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, way, clean = [], [], []
            for i, (word, divided) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if len(word) < 3:
                    continue
                data = {a: _written(word, a) for a in (AS_UTF8 if divided else CHARSETS)}
                for n, (a, b) in enumerate(WAYS):
                    raw = data.get(a)
                    new = _as_read(raw, b) if raw is not None else None
                    if new is None or new == word or _LOST.search(new):
                        continue
                    for part in {new} if len(new) <= WORD_CHARS else {p for p, whole in _words_of(new) if not whole}:
                        index.append(i)
                        way.append(n)
                        clean.append(part)
            take = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(3).take(take), pa.array(way, pa.int32()), pa.array(clean, pa.string())],
                ["w", "texts", "way", "clean"],
            )

    # A small checkpoint may be one partition, but each row costs some fifty conversions.
    n, cores = words.count(), words.sparkSession.sparkContext.defaultParallelism
    parts = max(min(2 * cores, n // 500 + 1), n // 200_000 + 1)
    return words.repartition(parts, "w").mapInArrow(run, "w bigint, texts bigint, way int, clean string")


def _characters(words: DataFrame) -> DataFrame:
    """(c, n): every character beyond ASCII and the texts that it is in, as far as words tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for word, texts, divided in zip(*(c.to_pylist() for c in batch.columns)):
                if divided:  # all but what divides it stands in its parts
                    word = "".join(_INNER.findall(word))
                if texts == 1:
                    counts.update(word)
                else:
                    for c in word:
                        counts[c] += texts
        rows = [(c, n) for c, n in counts.items() if c > "\x7f"]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["c", "n"])

    return words.select("word", "texts", "run").mapInArrow(run, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, key: str, body: str, charset: Column) -> Mapping:
    """Learn the mappings from all rows. What reaches the driver is bounded by the number of charsets,
    of characters in Unicode, and of pairs of letters below ``LETTERS_BELOW``.
    """
    words = cut_lineage(_words(_texts(df, key, body, charset)))
    known = words.where(~F.col("run"))
    twins = known.select(F.col("w").alias("c"), F.col("word").alias("clean"), F.col("texts").alias("clean_texts"))
    twins = cut_lineage(_rewritten(words).join(twins, "clean").drop("clean"))
    ways = WAYS

    def support(found: DataFrame) -> list[tuple[str, str, int, int]]:
        better = F.count_if(F.col("clean_texts") > F.col("texts")).alias("better")
        return [(*ways[r["way"]], r["n"], r["better"]) for r in found.groupBy("way").agg(F.count("*").alias("n"), better).collect()]

    utf8 = [a for a, b, n, _ in support(twins.where(F.col("way") < len(AS_UTF8))) if n >= MIN_UTF8]
    bad = twins.where(F.col("way").isin([n for n, (a, b) in enumerate(ways) if b == "utf-8" and a in utf8])).select("w").distinct()
    # Words that are garbled UTF-8 are no twins of each other.
    rest = twins.where(F.col("way") >= len(AS_UTF8)).join(bad, "w", "left_anti")
    rest = rest.join(bad.withColumnRenamed("w", "c"), "c", "left_anti")
    single = [(a, b) for a, b, n, better in support(rest) if better >= MIN_SINGLE and better >= CLEAN_SHARE * n]
    chosen = [n for n, w in enumerate(ways) if w in single]
    worse = rest.where(F.col("way").isin(chosen) & (F.col("clean_texts") > F.col("texts"))).select("w")
    clean = words.join(bad.union(worse).distinct(), "w", "left_anti")
    chars = sorted(r["c"] for r in _characters(clean).where(f"n >= {MIN_KNOWN}").collect())
    pairs: dict[str, int] = {}
    if single:
        letter = f"^[\\x{{41}}-\\x{{5a}}\\x{{61}}-\\x{{7a}}\\x{{a0}}-\\x{{{LETTERS_BELOW - 1:x}}}^$]{{2}}$"
        marked = clean.where(~F.col("run")).select(F.concat(F.lit("^"), "word", F.lit("$")).alias("m"), "texts")
        two = marked.select(F.expr("explode(transform(sequence(1, length(m) - 1), i -> substr(m, i, 2)))").alias("p"), "texts")
        pairs = {r["p"]: r["n"] for r in two.where(F.col("p").rlike(letter)).groupBy("p").agg(F.sum("texts").alias("n")).collect()}
    return Mapping(sorted(utf8), sorted(single), chars, pairs)


def _trie(sequences: list[str]) -> re.Pattern:
    """Pattern of the longest of the sequences at a place; branches by character, so it does not grow slower with their number."""
    root: dict = {}
    for s in sequences:
        node = root
        for c in s:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        ends = [c for c, below in node.items() if c and below.keys() == {""}]
        out = ["[" + "".join(map(re.escape, ends)) + "]"] if ends else []
        out += [re.escape(c) + write(below) for c, below in node.items() if c and below.keys() != {""}]
        return "(?:" + "|".join(out) + ")" + ("?" if "" in node else "")

    return re.compile(write(root))


class Finder:
    """Applies a mapping to texts."""

    def __init__(self, mapping: Mapping) -> None:
        self.single = mapping.single
        self.clean_of: dict[str, str] = {}
        known, seen = set(mapping.known), set()
        while known:  # the characters of garbled sequences are garbled again in turn; code pages are finite
            seen |= known
            for charset in mapping.utf8:
                back = _table(charset)[0]
                for c in sorted(known):
                    self.clean_of.setdefault("".join(back[b] for b in c.encode("utf-8")), c)
            known = {c for g in self.clean_of for c in g if ord(c) > 127} - seen
        self.sequence = _trie(sorted(self.clean_of)) if self.clean_of else None
        total: dict[str, int] = {}
        for p, n in mapping.pairs.items():
            total[p[0]] = total.get(p[0], 0) + n
        self.pair, self.total = mapping.pairs, total
        self.kinds = len({p[1] for p in mapping.pairs}) or 1

    def _likely(self, word: str) -> float:
        marked = f"^{word}$"
        pair, total, kinds = self.pair, self.total, self.kinds
        return sum(
            math.log((pair.get(marked[i : i + 2], 0) + 0.1) / (total.get(marked[i], 0) + 0.1 * kinds)) for i in range(len(marked) - 1)
        )

    def way(self, text: str) -> tuple[str, str] | None:
        """The single-byte pair that makes the words of the text clearly likelier, if there is one."""
        words = _WORD.findall(text) if self.single else []
        best, found = 0.0, None
        for a, b in self.single:
            gain, n = 0.0, 0
            for w in words:
                new = rewrite_word(w, a, b)
                if new is not None:
                    gain += self._likely(new) - self._likely(w)
                    n += len(w) + 1
            if n and gain > max(best, WHOLE_GAIN, MEAN_GAIN * n):
                best, found = gain, (a, b)
        return found

    def restore(self, text: str) -> tuple[bool, bool, str]:
        """(garbled, characters lost, restored text) of a shown text."""
        if text.isascii():
            return False, False, text
        lost = _LOST.search(text) is not None
        new, changed = text, False
        while self.sequence is not None:  # as often as it was garbled; every turn makes the text shorter
            again = self.sequence.sub(lambda m: self.clean_of[m.group()], new)
            if again == new:
                break
            new, changed = again, True
        way = self.way(new)
        if way is not None:
            new, changed = _RUN.sub(lambda m: rewrite(m.group(), *way) or m.group(), new), True
        return changed or lost, _LOST.search(new) is not None, new


def garbled(df: DataFrame, key: str, body: str, charset: Column, mapping: Mapping | None = None, *, with_text: bool = True) -> DataFrame:
    """(key, lost[, restored]) of every row whose shown text is garbled.

    ``lost``: characters are missing or unreadable even after restoring. Null and empty bodies are
    never garbled. Repeated rows give repeated results, other columns are left behind. ``mapping``
    is learned from ``df`` itself if none is given. Applying it is row-local.
    """
    rows = _texts(df, key, body, charset)
    shipped = df.sparkSession.sparkContext.broadcast(mapping or learn(df, key, body, charset))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shipped.value)
        for batch in batches:
            index, lost, restored = [], [], []
            for i, (b, c) in enumerate(zip(batch.column(1), batch.column(2))):
                bad, gone, text = finder.restore(shown(b.as_py(), c.as_py()))
                if bad:
                    index.append(i)
                    lost.append(gone)
                    restored.append(text)
            arrays = [batch.column(0).take(pa.array(index, pa.int64())), pa.array(lost, pa.bool_())]
            if with_text:
                arrays.append(pa.array(restored, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["k", "lost", "restored"][: len(arrays)])

    out = rows.mapInArrow(run, f"k {kind}, lost boolean" + (", restored string" if with_text else ""))
    return out.withColumnRenamed("k", key)
