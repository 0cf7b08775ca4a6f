"""Documents: extraction from bodies, chunks at boundaries, duplicates by connected components."""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.safety import decode_cascade
from weftline.session import cut_lineage

#: Elements that never hold readable text, and those that open a block.
_DROPPED = frozenset("script style noscript template svg nav footer aside form button".split())
_BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 td th tr table ul ol section article main header blockquote pre br hr dd dt body".split())
#: Pages with less text in both measures have no content; a linked article so many times as long replaces the blocks.
LEAST_CHARS, LEAST_WORDS, MUCH_LONGER = 80, 10, 1.5
#: Largest content stream of a PDF file that is read.
PDF_BYTES = 1 << 26
_LINKED = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script", re.I | re.S)
_STREAM = re.compile(rb"<<((?:[^<>]|<[^<]|>[^>])*)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_TEXT_OBJECT = re.compile(rb"\bBT\b(.*?)\bET\b", re.S)
_SHOWN = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\[\]()]|\((?:[^()\\]|\\.)*\))*)\]\s*TJ|(?:T\*|(?:Td|TD|Tm)\b)", re.S)
_CHUNK_TOKEN = re.compile(r"\w+|[^\w\s]")
_BOUNDARY = re.compile(r"\n\s*\n|(?<=[.!?。！？])\s+")


class _Readable(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.dropped, self.heading, self.title, self.in_title = 0, "", "", False
        self.level = ""

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            if self.level:
                self.heading = text
            self.blocks.append((self.heading, text))

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED:
            self.dropped += 1
        elif tag == "title":
            self.in_title = True
        elif tag in _BLOCKS:
            self.flush()
            self.level = tag if tag[0] == "h" and tag[1:].isdigit() else ""

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in _BLOCKS:
            self.flush()
            self.level = ""

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.dropped:
            self.parts.append(data)


def read_html(page: str) -> tuple[str, list[tuple[str, str]]]:
    """Title and readable blocks of a page, each with the heading it stands under."""
    parser = _Readable()
    parser.feed(page)
    parser.close()
    parser.flush()
    return " ".join(parser.title.split()), parser.blocks


def article_of(page: str) -> tuple[str, str]:
    """Headline and text of the first article that a page carries as linked data; empty without one."""
    for m in _LINKED.finditer(page):
        try:
            todo = [json.loads(html.unescape(m[1]))]
        except (ValueError, RecursionError):
            continue
        while todo:
            value = todo.pop()
            if isinstance(value, list):
                todo += reversed(value)
            elif isinstance(value, dict):
                if isinstance(value.get("articleBody"), str) and value["articleBody"].strip():
                    return str(value.get("headline") or ""), value["articleBody"]
                todo += [v for v in value.values() if isinstance(v, (list, dict))]
    return "", ""


def read_page(page: str) -> tuple[str, str, list[tuple[str, str]]]:
    """(status, title, blocks): the readable blocks, or the linked article where the blocks are few or it is much longer.

    A page with hardly any text either way has too little content.
    """
    title, blocks = read_html(page)
    size = sum(len(t) for _, t in blocks)
    headline, article = article_of(page)
    if article and (size < LEAST_CHARS or len(article) > MUCH_LONGER * size):
        blocks = [("", " ".join(p.split())) for p in re.split(r"\n\s*\n", article) if p.strip()]
        title = title or headline
    text = " ".join(t for _, t in blocks)
    if len(text) < LEAST_CHARS and len(text.split()) < LEAST_WORDS:
        return "too_little_content", title, blocks
    return "ok", title, blocks


def read_pdf(body: bytes) -> list[str]:
    """Text of the content streams of a PDF file, a block for each text object; empty where none can be read.

    Plain and deflated streams with text shown in single-byte strings are understood; encrypted files and
    fonts with maps of their own are not.
    """
    out: list[str] = []
    for m in _STREAM.finditer(body):
        data = m[2]
        if b"FlateDecode" in m[1]:
            try:
                data = zlib.decompressobj().decompress(data, PDF_BYTES)
            except zlib.error:
                continue
        for block in _TEXT_OBJECT.findall(data):
            parts = []
            for token in _SHOWN.finditer(block):
                if token[1] is not None:
                    parts.append(_pdf_string(token[1]))
                elif token[2] is not None:
                    parts.append("".join(_pdf_string(t) for t in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", token[2], re.S)))
                else:
                    parts.append(" ")
            text = " ".join("".join(parts).split())
            if text:
                out.append(text)
    return out


def _pdf_string(raw: bytes) -> str:
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}

    def sub(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else named.get(c, b"" if c in b"\r\n" else c)

    return re.sub(rb"\\([0-7]{1,3}|.)", sub, raw, flags=re.S).decode("cp1252", "replace")


def walk_json(value, path: str = "") -> list[str]:
    """A line ``path: value`` for each scalar of a JSON value."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in walk_json(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in walk_json(v, f"{path}[{i}]")]
    return [] if value is None else [f"{path}: {json.dumps(value, ensure_ascii=False) if not isinstance(value, str) else value}"]


def read_body(body: bytes, charset: str | None, media: str) -> tuple[str, str, list[tuple[str, str]]]:
    """(status, title, blocks) of a body by its media type and its first bytes: HTML, plain text, JSON and PDF are read."""
    if b"%PDF-" in body[:1024] or media == "application/pdf":
        blocks = [("", t) for t in read_pdf(body)]
        return ("ok" if blocks else "malformed"), "", blocks
    if media.split("/")[0] in ("image", "audio", "video", "font"):
        return "unsupported", "", []
    text, _ = decode_cascade(body, charset)
    if media == "application/json":
        try:
            return "ok", "", [("", line) for line in walk_json(json.loads(text))]
        except ValueError:
            return "malformed", "", []
    if media == "text/html" or text.lstrip()[:9].lower().startswith(("<!doctype", "<html")):
        return read_page(text)
    blocks = [" ".join(html.unescape(p).split()) for p in re.split(r"\n\s*\n", text)]
    return "ok", "", [("", b) for b in blocks if b]


def extract(df: DataFrame, key: str, body: str, charset: Column, media: Column) -> DataFrame:
    """(key, status, title, clean_text, blocks): readable blocks with running offsets, two characters between blocks."""
    rows = df.select(df[key].alias("k"), df[body].alias("b"), charset.alias("c"), media.alias("m")).where(F.length(df[body]) > 0)
    kind = rows.schema["k"].dataType.simpleString()
    block = pa.struct([("section", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, titles, texts, all_blocks = [], [], [], []
            for b, c, m in zip(batch.column(1), batch.column(2), batch.column(3)):
                s, title, blocks = read_body(b.as_py(), c.as_py(), m.as_py())
                at, out = 0, []
                for section, text in blocks:
                    out.append({"section": section or None, "text": text, "start": at, "end": at + len(text)})
                    at += len(text) + 2
                status.append(s)
                titles.append(title or None)
                texts.append("\n\n".join(t for _, t in blocks))
                all_blocks.append(out)
            arrays = [batch.column(0), pa.array(status), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(all_blocks, pa.list_(block))]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "status", "title", "clean_text", "blocks"])

    schema = f"k {kind}, status string, title string, clean_text string, blocks array<struct<section:string,text:string,start:int,end:int>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def chunk_spans(text: str, size: int, overlap: int, least: float) -> list[tuple[int, int, int, int]]:
    """Chunks of at most ``size`` tokens as (first token, end token, start, end in characters).

    A chunk ends at the last sentence or paragraph end in its last part, from ``least`` of its size
    on, if there is one; the next begins ``overlap`` tokens before its end.
    """
    spans = [m.span() for m in _CHUNK_TOKEN.finditer(text)]
    n = len(spans)
    starts = [s for s, _ in spans]
    from bisect import bisect_left, bisect_right

    ends = sorted({bisect_left(starts, m.end()) for m in _BOUNDARY.finditer(text)})
    out, at = [], 0
    while at < n:
        target = min(n, at + size)
        if target < n:
            k = bisect_right(ends, target) - 1
            if k >= 0 and ends[k] >= at + max(1, -int(-least * size // 1)):
                target = ends[k]
        out.append((at, target, spans[at][0], spans[target - 1][1]))
        if target >= n:
            break
        at = max(at + 1, target - overlap)
    return out


def chunk(df: DataFrame, key: str, text: str, size: int = 384, overlap: int = 64, least: float = 0.7) -> DataFrame:
    """(key, chunk, token_start, token_end, char_start, char_end, passage): boundary-aware overlapping passages."""
    rows = df.select(df[key].alias("k"), df[text].alias("t")).where(F.length(df[text]) > 0)
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows_out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for n, (a, b, s, e) in enumerate(chunk_spans(t, size, overlap, least)):
                    index.append(i)
                    rows_out.append((n, a, b, s, e, t[s:e]))
            cols = list(zip(*rows_out)) if rows_out else [()] * 6
            arrays = [pa.array(c, pa.int32()) for c in cols[:5]] + [pa.array(cols[5], pa.string())]
            names = ["k", "chunk", "token_start", "token_end", "char_start", "char_end", "passage"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *arrays], names)

    schema = f"k {kind}, chunk int, token_start int, token_end int, char_start int, char_end int, passage string"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def components(df: DataFrame, key: str, *links: str, most: int = 50) -> DataFrame:
    """(key, component): rows that are tied by an equal value in any of ``links``, directly or through others.

    The component is the smallest key in it. Labels are passed through values: each value takes the
    smallest label of its rows, each row the smallest of its values; both are partial aggregates, so
    a value that a third of all rows have is no single task. Each round is cut off by a checkpoint.
    """
    rows = df.select(key, *[F.col(c).cast("string").alias(c) for c in links])
    ties = reduce(DataFrame.union, [rows.where(F.col(c).isNotNull() & (F.col(c) != "")).select(F.col(key).alias("k"), F.concat(F.lit(f"{c}="), c).alias("v")) for c in links])
    ties = cut_lineage(ties.distinct())
    labels = cut_lineage(rows.select(F.col(key).alias("k"), F.col(key).alias("label")).distinct())
    for _ in range(most):
        best = ties.join(labels, "k").groupBy("v").agg(F.min("label").alias("label"))
        seen = ties.join(best, "v").groupBy("k").agg(F.min("label").alias("new"))
        # A shortcut through the label's own label halves the rounds on long chains.
        jump = labels.select(F.col("k").alias("new"), F.col("label").alias("further"))
        step = labels.join(seen, "k", "left").join(jump, "new", "left")
        after = cut_lineage(step.select("k", "label", F.least("label", "new", "further").alias("after")))
        changed = after.where("after < label").limit(1).count()
        labels = after.select("k", F.col("after").alias("label"))
        if not changed:
            return labels.select(F.col("k").alias(key), F.col("label").alias("component"))
    raise RuntimeError(f"no fixpoint after {most} rounds")
