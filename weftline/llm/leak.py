"""Passages of held-out items inside documents, by the q-gram lemma.

Texts are reduced to their words: case, accents, punctuation, mark-up tags, bracketed reference
numbers and line layout are dropped. A stretch of an item of w characters that stands in a
document with at most e edits shares at least w - q + 1 - e * q of its q-grams with it, all within
e diagonals. So the q-grams that a document shares with an item are counted in overlapping bands of
diagonals; bands below the bound are dropped, and what is left is verified by an alignment
restricted to the band, and last by whole words where exact agreement is asked. ``passages``
reports the edits of the best stretch and the longest run of whole words that agree exactly.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.hashing import Rolling, code_points

#: Items are indexed in blocks of at most so many characters, one pass over the documents each.
BLOCK_CHARS = 8_000_000
#: Shared q-grams that are counted at a time; counts of one part are added to those of the next.
PART_HITS = 4_000_000
_DROP = re.compile(r"</?[A-Za-z][^<>\x00]*>|\[\s?\d{1,4}(?:\s?[,;–-]\s?\d{1,4})*\s?\]")
#: A word divided at a line end: what stands between its halves.
_DIVIDED = re.compile(r"(?<=\w)(?:[-‐‑]|­)[ \t]*\r?\n[ \t>|]*(?=\w)|­")
_SEP, _SEAM = "\x00", "\x01"

_KIND: np.ndarray | None = None


def _kind() -> np.ndarray:
    """Of each code point: 1 letter or digit, 2 combining mark, 0 other."""
    global _KIND
    if _KIND is None:
        kind = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalnum():
                kind[c] = 1
            elif unicodedata.combining(ch):
                kind[c] = 2
        _KIND = kind
    return _KIND


class Words(NamedTuple):
    """Letters and digits of a batch of texts, all else dropped."""

    points: np.ndarray  # code points
    first: np.ndarray  # 1 where a word begins, 2 where the second half of a divided word begins
    begin: np.ndarray  # where each text begins; one entry more than texts


def reduce_words(texts: list[str]) -> Words:
    """Words of each text without case, accents, tags and reference numbers."""
    joined = _SEP.join(t.replace(_SEP, " ").replace(_SEAM, " ") for t in texts)
    joined = _DIVIDED.sub(_SEAM, _DROP.sub(" ", joined))
    if not joined.isascii():
        joined = unicodedata.normalize("NFKD", joined.casefold())
    else:
        joined = joined.lower()
    raw = code_points(joined)
    kind = _kind()[raw]
    raw, kind = raw[kind != 2], kind[kind != 2]
    keep = kind == 1
    before = np.concatenate([[False], keep[:-1]])
    seam = np.concatenate([[False], raw[:-1] == 1])
    first = np.where(keep & ~before, np.where(seam, 2, 1), 0).astype(np.uint8)
    count = np.concatenate([[0], np.cumsum(keep)])
    ends = np.flatnonzero(raw == 0)
    begin = np.concatenate([[0], count[ends], [count[-1]]]).astype(np.int64)
    if len(begin) != max(1, len(texts)) + 1:
        raise AssertionError("a text lost its separator")
    return Words(raw[keep], first[keep], begin)


class ItemIndex:
    """q-grams of the items of one block, sorted by hash."""

    def __init__(self, ids: list, texts: list[str], words: int, edits: int, q: int) -> None:
        self.ids, self.words, self.edits = ids, words, edits
        self.reduced = reduce_words(texts)
        points, first, begin = self.reduced
        self.strings = [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(begin[:-1], begin[1:])]
        self.starts = [np.append(np.flatnonzero(first[a:b] == 1), b - a) for a, b in zip(begin[:-1], begin[1:])]
        #: Least length of a stretch of ``words`` words of each item; items with fewer words never match.
        self.least = np.array([(s[words:] - s[:-words]).min() if len(s) > words else 1 << 40 for s in self.starts], np.int64)
        shortest = int(self.least.min()) if len(ids) else q
        # The lemma says nothing below (edits + 1) * q characters, so q shrinks with short stretches.
        self.q = q = max(1, min(q, shortest // (edits + 1)))
        self.bound = np.where(self.least < 1 << 39, np.maximum(1, self.least - q + 1 - edits * q), 1 << 40)
        hashes = Rolling(points).all(q)
        place = np.arange(len(hashes))
        item = np.searchsorted(begin, place, "right") - 1
        inside = place + q <= begin[item + 1]
        hashes, place, item = hashes[inside], place[inside], item[inside]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item = hashes[order], item[order]
        self.place = (place - begin[item])[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def candidates(self, doc: Words) -> list[tuple[int, int, int, int, int]]:
        """(document, item, diagonal, low, high): bands that reach the bound, low and high in the document."""
        q = self.q
        hashes = Rolling(doc.points).all(q)
        hit = np.flatnonzero(self.seen[(hashes >> np.uint64(42)).astype(np.int64)])
        if not len(hit) or not len(self.hashes):
            return []
        lo = np.searchsorted(self.hashes, hashes[hit], "left")
        hi = np.searchsorted(self.hashes, hashes[hit], "right")
        owner = np.searchsorted(doc.begin, hit, "right") - 1
        ok = (hi > lo) & (hit + q <= doc.begin[owner + 1])
        hit, lo, hi, owner = hit[ok], lo[ok], hi[ok], owner[ok]
        # A document with fewer hits than the smallest bound has no band that reaches it.
        many = np.bincount(owner, minlength=len(doc.begin))[owner] >= self.bound.min()
        hit, lo, hi, owner = hit[many], lo[many], hi[many], owner[many]
        if not len(hit):
            return []
        size = hi - lo
        total = np.cumsum(size)
        parts: tuple[list, list] = ([], [])
        at_hit = 0
        while at_hit < len(hit):
            done = total[at_hit - 1] if at_hit else 0
            upto = max(at_hit + 1, int(np.searchsorted(total, done + PART_HITS, "right")))
            some = slice(at_hit, upto)
            at = np.repeat(np.arange(at_hit, upto), size[some])
            entry = np.arange(len(at)) - np.repeat(total[some] - size[some] - done, size[some]) + np.repeat(lo[some], size[some])
            item, d, spot = self.item[entry], owner[at], hit[at] - doc.begin[owner[at]]
            diagonal = spot - self.place[entry]
            # Bands of 2 * (edits + 1) diagonals every edits + 1: any edits + 1 neighbours lie in one band.
            half = self.edits + 1
            for k, off in enumerate((0, half)):
                band = (diagonal + np.int64(1 << 36) + off) // (2 * half)
                parts[k].append(_per_band(d, item, band, np.ones(len(d), np.int64), spot, spot, diagonal))
            at_hit = upto
        found = []
        for part in parts:
            d, item, _, count, low, high, diag = _per_band(*(np.concatenate(c) for c in zip(*part))) if len(part) > 1 else part[0]
            good = count >= self.bound[item]
            found += [(int(a), int(i), int(g), int(s), int(e) + q) for a, i, g, s, e in zip(d[good], item[good], diag[good], low[good], high[good])]
        return found


def _per_band(d, item, band, count, low, high, diagonal) -> tuple[np.ndarray, ...]:
    """Rows of one document, item and band added up: (document, item, band, count, low, high, least diagonal)."""
    order = np.lexsort((band, item, d))
    d, item, band = d[order], item[order], band[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]))
    low, high, diagonal = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), np.minimum.reduceat(diagonal[order], first)
    return d[first], item[first], band[first], np.add.reduceat(count[order], first), low, high, diagonal


def _agree(a: str, i: int, b: str, j: int) -> int:
    """How many characters of ``a`` from ``i`` and of ``b`` from ``j`` agree; compared in stretches that double."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 16
    while n < most:
        if a[i + n : i + min(n + step, most)] == b[j + n : j + min(n + step, most)]:
            n = min(n + step, most)
            step *= 2
        elif step == 1:
            break
        else:
            step //= 2
    return n


def banded_alignment(item: str, text: str, band: int, limit: int) -> tuple[int, int, int]:
    """Fewest edits between ``item`` and the best stretch of ``text``, within ``band`` diagonals.

    Returns (edits, start, end) in ``text``; edits is ``limit`` + 1 where the limit is passed.
    Furthest-reaching: per number of edits and diagonal only the last row reached is stored.
    """
    n, m = len(item), len(text)
    best: dict[int, tuple[int, int]] = {}
    for d in range(-band, max(0, m - n) + band + 1):
        if 0 <= d <= m:
            best[d] = (0, d)
    for edits in range(limit + 1):
        for d, (row, start) in list(best.items()):
            row += _agree(item, row, text, row + d)
            best[d] = (row, start)
            if row == n:
                return edits, start, row + d
        following: dict[int, tuple[int, int]] = {}
        for d, (row, start) in best.items():
            for nd, nrow in ((d, row + 1), (d + 1, row), (d - 1, row + 1)):
                nrow = min(nrow, n)
                if 0 <= nrow + nd <= m and nrow > following.get(nd, (-1, 0))[0]:
                    following[nd] = (nrow, start)
        best = following
    return limit + 1, 0, 0


def _exact_words(index: ItemIndex, i: int, doc: Words, d: int, low: int, high: int) -> int:
    """Most consecutive words of item ``i`` that stand in the region of document ``d``, up to the needed number and beyond."""
    a = doc.begin[d]
    end = int(doc.begin[d + 1] - a)
    item, starts, need = index.strings[i], index.starts[i], index.words
    low, high = max(0, low - len(item)), min(end, high + len(item))
    text = doc.points[a + low : a + high].tobytes().decode("utf-32-le")
    first = doc.first[a + low : a + high]
    longest = 0
    for w in range(len(starts) - need):
        if longest > need and w + longest >= len(starts) - 1:
            break
        piece = item[starts[w] : starts[w + need]]
        p = text.find(piece)
        while p >= 0:
            size = need
            while _fits(first, starts, w, size, p, low, a, doc, d) and w + size < len(starts):
                longest = max(longest, size)
                size += 1
                if w + size >= len(starts) or not text.startswith(item[starts[w] : starts[w + size]], p):
                    break
            p = text.find(piece, p + 1)
    return longest


def _fits(first, starts, w, size, p, low, a, doc, d) -> bool:
    """Whether the words of the item begin and end where words of the text do."""
    begin = starts[w : w + size] - starts[w] + p
    stop = int(starts[w + size] - starts[w]) + p
    if not first[begin].all():
        return False
    whole = first[p:stop] == 1
    if whole.sum() != (first[begin] == 1).sum():
        return False
    after = low + stop
    total = int(doc.begin[d + 1] - a)
    return after >= total or doc.first[a + after] != 0


def _aligned(index: ItemIndex, i: int, doc: Words, d: int, diagonal: int, low: int, high: int) -> int:
    """Fewest edits between ``words`` whole words of item ``i`` and document ``d``, within the band; more than allowed if none fits.

    Every stretch of the item that lies opposite the shared q-grams is tried, up to the first without an edit.
    """
    a, b = int(doc.begin[d]), int(doc.begin[d + 1])
    item, starts, need, most = index.strings[i], index.starts[i], index.words, index.edits
    best = most + 1
    # Stretches that begin up to one stretch before the first shared gram and no later than the last one.
    from_ = int(np.searchsorted(starts, low - diagonal - 2 * (most + 1) - int((starts[need:] - starts[:-need]).max()), "left"))
    for w in range(max(0, from_), len(starts) - need):
        if starts[w] + diagonal > high:
            break
        piece = item[starts[w] : starts[w + need]]
        begin = max(a, a + int(starts[w]) + diagonal - most)
        text = doc.points[begin : max(begin, min(b, begin + len(piece) + 4 * (most + 1)))].tobytes().decode("utf-32-le")
        edits, _, _ = banded_alignment(piece, text, 2 * (most + 1), min(most, best))
        best = min(best, edits)
        if best == 0:
            break
    return best


def _verified(index: ItemIndex, doc: Words, exact: bool) -> dict[tuple[int, int], tuple[int, int]]:
    """Pairs (document, item) that verification leaves: longest run of whole words, edits of the best stretch.

    Each band is aligned first; only where the alignment stays within the edits are whole words compared.
    """
    kept: dict[tuple[int, int], tuple[int, int]] = {}
    for d, i, diagonal, low, high in index.candidates(doc):
        if kept.get((d, i), (0, 0))[0] >= index.words:
            continue
        edits = _aligned(index, i, doc, d, diagonal, low, high)
        if edits > (0 if exact else index.edits):
            continue
        run = _exact_words(index, i, doc, d, low, high)
        if exact and run < index.words:
            continue
        best = kept.get((d, i))
        if best is None or (run, -edits) > (best[0], -best[1]):
            kept[(d, i)] = (run, edits)
    return kept


def _blocks(items: DataFrame, key: str, text: str, block_chars: int) -> int:
    total = items.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    return max(1, -(-int(total) // block_chars))


def passages(
    documents: DataFrame,
    key: str,
    text: str,
    items: DataFrame,
    item_key: str,
    item_text: str,
    *,
    words: int = 13,
    edits: int = 1,
    q: int = 16,
    exact: bool = False,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(document key, item key, run, edits): documents that contain ``words`` consecutive words of an item.

    ``run`` is the longest run of consecutive whole words of the item found in the region that
    agree exactly (0 if there is none of ``words`` words), ``edits`` the edits of the best stretch
    otherwise. ``exact`` keeps only pairs with run >= words. Null and empty texts match nothing,
    items of fewer words neither. Repeated rows give one result. The two keys must have different
    names; other columns are left behind.

    The items are the query set: their size is measured first, and they are shipped in blocks of at
    most ``block_chars`` characters, one pass over the documents for each block. Row-local apart
    from the final distinct over found pairs.
    """
    picked = items.select(items[item_key].alias("i"), items[item_text].alias("t")).where("t is not null").dropDuplicates(["i"])
    n = _blocks(picked, "i", "t", block_chars)
    rows = documents.select(documents[key].alias("k"), documents[text].alias("t")).where(F.length(documents[text]) > 0)
    kind, item_kind = rows.schema["k"].dataType.simpleString(), picked.schema["i"].dataType.simpleString()
    item_type = pa.string() if item_kind == "string" else pa.int64()
    sc = documents.sparkSession.sparkContext
    out = None
    for block in range(n):
        part = picked.where(F.pmod(F.xxhash64("i"), F.lit(n)) == block).orderBy("i").collect()
        shipped = sc.broadcast(([r["i"] for r in part], [r["t"] for r in part]))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*shipped.value, words, edits, q)
            for batch in batches:
                for at in range(0, batch.num_rows, 1500):
                    piece = batch.slice(at, 1500)
                    kept = _verified(index, reduce_words(piece.column(1).to_pylist()), exact)
                    take = pa.array([d for d, _ in kept], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column(0).take(take),
                            pa.array([index.ids[i] for _, i in kept], item_type),
                            pa.array([r for r, _ in kept.values()], pa.int32()),
                            pa.array([e for _, e in kept.values()], pa.int32()),
                        ],
                        ["k", "i", "run", "edits"],
                    )

        found = rows.mapInArrow(run, f"k {kind}, i {item_kind}, run int, edits int")
        out = found if out is None else out.union(found)
    best = out.groupBy("k", "i").agg(F.max("run").alias("run"), F.min("edits").alias("edits"))
    return best.withColumnsRenamed({"k": key, "i": item_key})
