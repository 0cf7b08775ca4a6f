"""Splitting oversized texts at natural boundaries by packing a structure tree.

A text is read as a tree. Its marks, from the outside in, are headings (by their depth), block-level
markup (by its nesting), blank lines, list entries (by their indentation), lines, sentences and words;
a node is divided at the outermost marks inside it. Subtrees that fit are never opened. Of an oversized
node the children are packed first, then neighbouring siblings are merged as long as they fit, and the
result is merged again among the siblings one level up. Only a word that alone is larger than a piece is
cut between characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.http import declared_text

#: Unicode's white space and the marks that end a sentence; both are natural boundaries.
WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ENDS = ".!?。！？"
#: Nesting deeper than this is read as this deep.
DEEPEST = 60

_BOUNDARY = re.compile(f"[{WHITE}{ENDS}]")
_LINES = r"\r\n?|[\n\x0b\x0c\x85" + chr(0x2028) + chr(0x2029) + r"]"
_HEADING = re.compile(r"(?m)^(?:(?P<hash>#{1,6})[ \t]|<h(?P<tag>[1-6])[ >]|(?P<rule>\*{3,}|-{3,}|_{3,})[ \t]*$|(?P<under>[^\s=-][^\n]{0,118}\n(?:={3,}|-{3,})[ \t]*$))", re.I)
_MARKUP = re.compile(r"<(/?)(?:div|section|article|main|aside|nav|header|footer|ul|ol|dl|table|tbody|tr|blockquote|figure|form)\b[^<>]*>", re.I)
_BLANK = re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+|</(?:p|h[1-6]|pre)>\s+", re.I)
_ENTRY = re.compile(r"(?m)^([ \t]*)(?:[-*+•‣–]|\(?\d{1,3}[.)]|\(?[a-z][.)]|<li\b[^<>]*>|<d[td]\b[^<>]*>)[ \t]*", re.I)
_LINE = re.compile(_LINES)
_SENTENCE = re.compile(f"(?<![{ENDS}])[{ENDS}]++[\"'”’»)\\]]*[{WHITE}]+|[。！？]+")


def _headings(text: str) -> Iterator[tuple[int, int]]:
    for m in _HEADING.finditer(text):
        if m["hash"]:
            yield m.start(), len(m["hash"])
        elif m["tag"]:
            yield m.start(), int(m["tag"])
        else:
            yield m.start(), 0 if m["rule"] else 1 if m["under"].rstrip().endswith("=") else 2


def _elements(text: str) -> Iterator[tuple[int, int]]:
    depth = 0
    for m in _MARKUP.finditer(text):
        if m[1]:
            depth = max(0, depth - 1)
            yield m.end(), depth
        else:
            yield m.start(), depth
            depth += 1


def _entries(text: str) -> Iterator[tuple[int, int]]:
    for m in _ENTRY.finditer(text):
        yield m.start(), len(m[1].expandtabs(4))


def _after(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: ((m.end(), 0) for m in pattern.finditer(text))


#: Marks of each level, from the outside in: (place, depth).
_LEVELS = (_headings, _elements, _after(_BLANK), _entries, _after(_LINE), _after(_SENTENCE), _after(_BOUNDARY))


class Tree:
    """Divides the nodes of one text; the marks of a level are only looked for once a node needs them."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._marks: dict[int, tuple[list[int], list[int]]] = {}

    def _level(self, level: int) -> tuple[list[int], list[int]]:
        if level not in self._marks:
            depth: dict[int, int] = {}
            for p, d in _LEVELS[level](self.text):
                if 0 < p < len(self.text) and _BOUNDARY.match(self.text, p - 1):
                    depth[p] = min(d, DEEPEST, depth.get(p, DEEPEST))
            places = sorted(depth)
            self._marks[level] = places, [depth[p] for p in places]
        return self._marks[level]

    def children(self, a: int, b: int, level: int) -> tuple[list[int], int]:
        """Where the children of the node begin, and end at last, and their level; a node without marks is its own child."""
        while level < len(_LEVELS):
            places, depths = self._level(level)
            lo, hi = bisect_right(places, a), bisect_left(places, b)
            if lo < hi:
                least = min(depths[lo:hi])
                return [a, *(places[k] for k in range(lo, hi) if depths[k] == least), b], level
            level += 1
        return [a, b], level


def _merge(parts: list[tuple[int, int, int]], room: Callable[[int], int]) -> list[tuple[int, int, int]]:
    """Neighbours joined from the left as long as they fit; a part that ends inside a word stays alone."""
    out = parts[:1]
    for a, b, cut in parts[1:]:
        start = out[-1][0]
        if not cut and b - start <= room(start):
            out[-1] = (start, b, 0)
        else:
            out.append((a, b, cut))
    return out


def pack(text: str, limit: int = 4000, overlap: int = 200) -> list[tuple[int, int, int]]:
    """Pieces of ``text`` as (start, end, cut); each starts ``overlap`` before the last one's end.

    ``cut`` is 0 if the piece ends at a natural boundary or with the text, else the length of the run
    without a boundary inside which it ends. An empty text has no piece.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0)] if n else []
    tree = Tree(text)
    room = lambda start: limit - min(start, overlap)
    # Each frame: bounds of the children still to do, their level, and the packed parts of those done.
    frames: list[tuple[list[int], int, list]] = [([0, n], 0, [])]
    while True:
        bounds, level, done = frames[-1]
        if len(bounds) == 1:
            frames.pop()
            merged = _merge(done, room)
            if not frames:
                break
            frames[-1][2].extend(merged)
            continue
        a, b = bounds[0], bounds[1]
        del bounds[0]
        if b - a <= room(a):
            done.append((a, b, 0))
            continue
        inner, below = tree.children(a, b, level)
        if len(inner) > 2:
            frames.append((inner, below, []))
            continue
        at = a
        while b - at > room(at):
            done.append((at, at + room(at), b - a))
            at = done[-1][1]
        done.append((at, b, 0))
    # Pieces near the beginning have less overlap: a run that fits there whole is not cut.
    k = 0
    while k + 1 < len(merged) and merged[k][0] < overlap:
        start, end, own = merged[k]
        run = end + merged[k + 1][2]
        if not own and end < run <= start + room(start):
            merged[k] = (start, run, 0)
            merged[k + 1 :] = [(max(s, run), e, cut) for s, e, cut in merged[k + 1 :] if e > run]
        k += 1
    return [(s if k == 0 else max(0, s - overlap), e, cut) for k, (s, e, cut) in enumerate(merged)]


def split_oversized(
    df: DataFrame,
    key: str,
    text: str | None = None,
    *,
    body: str | None = None,
    charset: Column | None = None,
    limit: int = 4000,
    overlap: int = 200,
    with_text: bool = True,
) -> DataFrame:
    """Pieces of every text, one row per piece: (key, piece, start, end, cut_run[, piece_text]).

    Give ``text`` (a string column) or ``body`` (binary, decoded by ``charset``). All other columns
    are left behind, so their names cannot clash. A null or empty text gives no piece; a text within
    ``limit`` gives one. Repeated rows give repeated pieces. ``start`` and ``end`` count code points;
    consecutive pieces share exactly ``overlap`` characters. ``cut_run`` is 0 where a piece ends at a
    natural boundary, else the length of the run without one inside which it had to end.
    Row-local: no shuffle, one Arrow pass over two columns.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if (text is None) == (body is None):
        raise ValueError("give text or body")
    source = df[text] if body is None else df[body]
    declared = F.lit(None).cast("string") if charset is None else charset
    rows = df.select(df[key].alias("k"), source.alias("v"), declared.alias("c")).where(F.length(source) > 0)
    kind = rows.schema["k"].dataType.simpleString()
    out = f"k {kind}, piece int, start int, end int, cut_run int" + (", piece_text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            picked: list[int] = []
            for i, (v, c) in enumerate(zip(batch.column(1), batch.column(2))):
                value = v.as_py()
                whole = value if isinstance(value, str) else declared_text(value, c.as_py())
                for k, (a, b, cut) in enumerate(pack(whole, limit, overlap)):
                    picked.append(i)
                    found.append((k, a, b, cut, whole[a:b]) if with_text else (k, a, b, cut))
            types = [pa.int32()] * 4 + [pa.string()] * with_text
            cols = list(zip(*found)) or [()] * len(types)
            arrays = [batch.column(0).take(pa.array(picked, pa.int64()))]
            arrays += [pa.array(col, kind) for col, kind in zip(cols, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "piece", "start", "end", "cut_run", "piece_text"][: len(arrays)])

    return rows.mapInArrow(run, out).withColumnRenamed("k", key)
