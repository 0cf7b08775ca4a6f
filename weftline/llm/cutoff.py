"""Values cut off by field limits or in transfer.

The length of every value that has no proper ending is taken under several encodings: characters,
UTF-8 bytes, UTF-16 units, Latin-1, HTML and JSON escapes, line ends as CRLF or LF. Grouped by field
and encoding, lengths at which far more such values end than nearby expose hidden storage limits.
Then the endings are inspected: values that stop inside a tag, an escape or a string; words that
occur nowhere else; names that stop where names do not end; last words that no sentence, line or
block of the corpus ends with.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.http import declared_text
from weftline.llm.blocks import INLINE
from weftline.llm.skew import join_counted
from weftline.session import cut_lineage

#: Encodings under which lengths are taken.
ENCODINGS = ("chars", "utf8", "utf16", "latin1", "html", "html_refs", "json", "json_ascii", "crlf", "lf")
#: A limit: at least so long, so many unfinished values of one length, so large a share of the open values of that
#: length, which are so many times as many as at a mean nearby length.
LIMIT_SIZE, LIMIT_VALUES, LIMIT_BAD, LIMIT_TIMES, NEARBY = 50, 5, 0.5, 4, 10
#: Whole sentences that must end with the same two words, places where a word must stand, share of
#: its places at the end of a sentence below which it ends none.
ATTESTED, KNOWN, NEVER_ENDS = 2, 4, 0.004
#: A short unit that ends values properly: so many whole units of its shape, and so large a share of all units that begin with it.
REPEATED, WHOLE = 3, 0.1
#: Share of names ending with the same three letters below which a name is taken as broken off.
NAME_END = 0.12
#: What counts as a short unit: a line or block of so many characters and words at most. Others are judged by their last words.
SHORT_CHARS, SHORT_WORDS = 60, 6

#: Marks that end a sentence, closing marks after them, and marks of a cut.
_STOP = ".!?。！？"
_CLOSERS = "\"'”’»)]}`*"
_MARK = re.compile(r"(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\[truncated\]|\(truncated\))\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d[\d.,]*")
#: Scripts that set no spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Chinese characters.
_CJK = re.compile(r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_UNIT = re.compile(r"(?<=[.!?。！？])[\"'”’»)\]]*\s+|(?<=[。！？])|\n+")
_MARKUP = re.compile(r"<[A-Za-z!/?]")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)[^<>]*>")
#: Beginnings of named character references.
_REFERENCES = frozenset(name[:n] for name in html5 for n in range(1, len(name.rstrip(";")) + 1))
_NUMBER = re.compile(r"#(?:[0-9]*|[xX][0-9A-Fa-f]*)\Z")
#: Elements whose content is not visible.
_HIDDEN = ("script", "style", "noscript", "title")
_TAG = re.compile(r"<[^>]*>")
_DECODER = json.JSONDecoder(strict=False)
_REASON = re.compile(r"\"(?:rationale|explanation|reason|reasoning|justification)\"\s*:\s*\"((?:[^\"\\]|\\.)*)\"", re.S)


def lengths(text: str) -> list[int]:
    """Length of a value under each of ``ENCODINGS``."""
    utf8 = len(text.encode("utf-8", "surrogatepass"))
    lf = text.replace("\r\n", "\n")
    return [
        len(text),
        utf8,
        len(text.encode("utf-16-le", "surrogatepass")) // 2,
        len(text.encode("latin-1", "replace")),
        len(html.escape(text)),
        len(text.encode("ascii", "xmlcharrefreplace")),
        len(json.dumps(text, ensure_ascii=False)) - 2,
        len(json.dumps(text)) - 2,
        len(lf) + lf.count("\n"),
        len(lf),
    ]


class Ending(NamedTuple):
    """How a value ends: ``closed`` (properly), ``cut`` (certainly), or ``open`` with what it ends with."""

    state: str
    key: str = ""  # last two words, names and numbers masked
    last: str = ""  # last word, or its last three letters for a name
    name: str = ""  # the name
    unit: str = ""  # the last line or block if it is short, names and numbers masked


def _mask(word: str) -> str:
    if word[0].isdigit():
        return "9"
    return "N" if word[0].isupper() else word


def _unit(line: str) -> str:
    words = _WORD.findall(line) if len(line) <= SHORT_CHARS else []
    return " ".join(map(_mask, words)) if len(words) <= SHORT_WORDS else ""


def _last_words(line: str) -> list[str]:
    """At least the last two words of a line, or all of them; reads back as far as they reach."""
    n = 120
    while True:
        words = _WORD.findall(line[-n:])
        if len(words) > 2 or n >= len(line):
            return words
        n *= 4


def _beginnings(unit: str, whole: bool) -> list[str]:
    """Shapes with which a unit begins and goes on, short enough for ``_unit``; ``whole`` if it ends with its last word."""
    shape, out = "", []
    found = list(islice(_WORD.finditer(unit), SHORT_WORDS + 1))
    for n, m in enumerate(found[:SHORT_WORDS], 1):
        if m.end() > SHORT_CHARS or whole and n == len(found):
            break
        shape = f"{shape} {_mask(m.group())}" if shape else _mask(m.group())
        out.append(shape)
    return out


def ending(text: str) -> Ending:
    """Ending of prose."""
    text = text.rstrip(" \t\r\n ​﻿")
    marked = _MARK.search(text)
    if marked:
        text = text[: marked.start()].rstrip()
        if not any(c.isalnum() for c in text):
            return Ending("closed")
        return Ending("closed" if text[-1] in _STOP else "cut")
    bare = text.rstrip(_CLOSERS)
    if text.endswith("\ufffd") and "\ufffd" not in text.rstrip("\ufffd"):
        return Ending("cut")  # nothing else is unreadable: the bytes stop inside a character
    if not bare or bare[-1] in _STOP:
        return Ending("closed")
    if text != bare and bare[-1].isalnum() and text[-1] in ")]}\"”»*":
        return Ending("closed")
    if bare[-1] in ",;:(–" or (bare[-1] == "-" and len(bare) > 1 and bare[-2].isalpha()):
        return Ending("cut")
    line = bare[bare.rfind("\n") + 1 :]
    if not bare[-1].isalnum() or "\ufffd" in bare[-2:] or not any(c.isalpha() and not c.isupper() for c in line):
        return Ending("closed")
    if "\t" in line or "|" in line:
        return Ending("open", "=", "=")  # a row of a table; only a limit tells
    if _CJK.match(bare[-1]):
        return Ending("open", bare[-2:], bare[-2:])
    words = _last_words(line)
    if not words or not line.endswith(words[-1]):
        return Ending("open", "=", "=")
    if len(words) == 1 and line == bare:
        return Ending("closed")  # a word alone is no sentence
    last = words[-1]
    unit = _unit(line)
    key = f"{_mask(words[-2]) if len(words) > 1 else '^'} {_mask(last)}"
    if last[0].isdigit():
        return Ending("open", key, "9", "", unit)
    if last[0].isupper():
        return Ending("open", key, last[-3:].lower(), last, unit)
    return Ending("open", key, last, "", unit)


def _open_json(text: str) -> bool:
    """Whether brackets or a string are open at the end of a JSON text."""
    try:
        _DECODER.raw_decode(text)
        return False
    except (ValueError, RecursionError):
        pass
    depth, inside, escaped = 0, False, False
    for c in text:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return False
    return depth > 0 or inside


def reason_of(output: str) -> str | None:
    """The rationale inside a model output; None if it has none."""
    m = _REASON.search(output)
    if m is None:
        return None
    try:
        return json.loads(f'"{m.group(1)}"', strict=False)
    except ValueError:
        return m.group(1)


def output_ending(text: str) -> tuple[Ending, str]:
    """Ending of a model output and the text that it was taken from."""
    bare = _MARK.sub("", text.strip(" \t\r\n​﻿")) if _MARK.search(text) else text.strip(" \t\r\n​﻿")
    inner = re.sub(r"^```[a-z]*\s*", "", bare)
    if inner[:1] in ("{", "["):
        if _open_json(inner):
            return Ending("cut"), text
        reason = reason_of(inner)
        return (ending(reason), reason) if reason else (Ending("closed"), "")
    if bare.startswith("```"):
        return Ending("closed" if bare.endswith("```") or inner == "" else "cut"), text
    return ending(text), text


def body_ending(text: str, media: str) -> tuple[Ending, str]:
    """Ending of a body and the text that it was taken from."""
    if media == "application/json":
        return Ending("cut" if text.lstrip()[:1] in ("{", "[") and _open_json(text.lstrip()) else "closed"), text
    if media != "text/html" or not _MARKUP.search(text):
        return ending(text), text
    tail = text.rstrip()
    if tail.endswith(">"):
        return Ending("closed"), ""
    if _cut_markup(tail):
        return Ending("cut"), text
    return ending(html.unescape(_TAG.sub("", _last_block(tail)))), text


def _last_block(tail: str) -> str:
    """What stands behind the last tag that is not inline."""
    at = tail.rfind("<")
    while at >= 0:
        m = _NAME.match(tail, at)
        if m is not None and m[1].lower() not in INLINE:
            return tail[tail.find(">", at) + 1 :]
        at = tail.rfind("<", 0, at)
    return tail


def _cut_markup(tail: str) -> bool:
    """Whether a page ends inside a tag, a character reference or an element that is not visible."""
    at = tail.rfind("<")
    if at > tail.rfind(">") and (at == len(tail) - 1 or _MARKUP.match(tail, at)):
        return True
    at = tail.rfind("&")
    if at >= 0 and len(tail) - at <= 40 and (tail[at + 1 :] in _REFERENCES or at == len(tail) - 1 or _NUMBER.match(tail, at + 1)):
        return True
    low = tail.lower()
    return any(low.rfind(f"<{name}") > low.rfind(f"</{name}") for name in _HIDDEN if f"<{name}" in low)


def _texts(results: DataFrame | None, bodies: DataFrame | None) -> DataFrame:
    """(field, id, source, body, charset, media, text) of all values; the media of a result is what it is about."""
    parts = []
    if bodies is not None:
        parts.append(bodies.select(F.lit("body").alias("field"), "id", "source", "body", "charset", "media", F.lit(None).cast("string").alias("text")))
    if results is not None:
        for field in ("rationale", "raw_model_output"):
            none = F.lit(None)
            parts.append(
                results.select(
                    F.lit(field).alias("field"),
                    "id",
                    "source",
                    none.cast("binary").alias("body"),
                    none.cast("string").alias("charset"),
                    F.col("about").alias("media"),
                    F.col(field).alias("text"),
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where((F.length("body") > 0) | (F.length("text") > 0))


def _value(row: dict) -> tuple[str, str]:
    """Text and media of a row."""
    if row["field"] == "body":
        return declared_text(row["body"], row["charset"]), row["media"]
    return row["text"], row["media"] or ""


def _units(text: str, field: str, media: str) -> list[str]:
    """Complete sentences, lines and blocks of a value; the last, which may be cut, is left out."""
    if field == "raw_model_output":
        text = reason_of(text) or ""
    if media == "text/html":
        text = html.unescape(re.sub(r"<[^>]*>", "\n", re.sub(r"</?(?:b|i|em|strong|span|a)\b[^>]*>", "", text)))
    units = _UNIT.split(text)
    if units and units[-1].rstrip()[-1:] not in tuple(_STOP):
        units.pop()
    return [u for u in units if not _MARK.search(u)]


def _statistics(texts: DataFrame) -> DataFrame:
    """(kind, key, n): endings of whole sentences, words inside units, ends and insides of names by three letters,
    short units, beginnings of longer units, last words of units without a stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends: Counter[str] = Counter()
            last: Counter[str] = Counter()
            inside: Counter[str] = Counter()
            name_end: Counter[str] = Counter()
            name_any: Counter[str] = Counter()
            short: Counter[str] = Counter()
            begin: Counter[str] = Counter()
            tail: Counter[str] = Counter()
            for row in batch.to_pylist():
                text, media = _value(row)
                for unit in _units(text, row["field"], media):
                    words = _WORD.findall(unit)
                    if not words:
                        continue
                    shut = unit.rstrip(" \t\r" + _CLOSERS)
                    bare = shut.rstrip(_STOP)
                    begin.update(_beginnings(unit.strip(), bare == shut))
                    if bare == shut:
                        tail[words[-1]] += 1
                    if bare != shut:  # a whole sentence
                        if bare and _CJK.match(bare[-1]):
                            ends[bare[-2:]] += 1
                            last[bare[-2:]] += 1
                            continue
                        ends[f"{_mask(words[-2]) if len(words) > 1 else '^'} {_mask(words[-1])}"] += 1
                        last[_mask(words[-1])] += 1
                    elif (whole := _unit(unit.strip())) != "":
                        short[whole] += 1
                    inside.update(w for w in words[:-1] if w[0].isalpha() and not w[0].isupper())
                    for w in words:
                        if w[0].isupper() and len(w) > 3:
                            low = w.lower()
                            name_end[low[-3:]] += 1
                            name_any.update([low[i : i + 3] for i in range(len(low) - 2)])
            rows = [(k, w, n) for k, c in (("end", ends), ("last", last), ("in", inside), ("name_end", name_end), ("name", name_any), ("unit", short), ("begin", begin), ("tail", tail)) for w, n in c.items()]
            kinds, keys, counts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())], ["kind", "key", "n"]
            )

    return texts.mapInArrow(run, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _open_values(texts: DataFrame) -> DataFrame:
    """(field, id, source, state, key, last, name, unit, sizes) of every value that is not properly closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, row in enumerate(batch.to_pylist()):
                text, media = _value(row)
                field = row["field"]
                if field == "body":
                    found, of = body_ending(text, media)
                elif field == "rationale":
                    found, of = ending(text), text
                else:
                    found, of = output_ending(text)
                if found.state != "closed":
                    # A name that is the beginning of another word of what the value is about.
                    if found.name and field != "body" and any(w != found.name and w.startswith(found.name) for w in _WORD.findall(media)):
                        found = Ending("cut")
                    index.append(i)
                    rows.append((found.state, found.key, found.last, found.name != "", found.unit, lengths(of)))
            take = pa.array(index, pa.int64())
            cols = list(zip(*rows)) if rows else [()] * 6
            types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(take) for k in range(3)] + [pa.array(c, t) for c, t in zip(cols, types)],
                ["field", "id", "source", "state", "key", "last", "name", "unit", "sizes"],
            )

    return texts.mapInArrow(
        run, "field string, id bigint, source string, state string, key string, last string, name boolean, unit string, sizes array<bigint>"
    )


def hidden_limits(open_values: DataFrame) -> DataFrame:
    """(field, encoding, size, n): lengths at which far more open values end than nearby, most of them unfinished."""
    each = open_values.select("field", "unfinished", F.posexplode("sizes").alias("encoding", "size"))
    counts = each.groupBy("field", "encoding", "size").agg(F.count("*").alias("n"), F.count_if("unfinished").alias("bad"))
    spread = counts.select("field", "encoding", F.explode(F.sequence(F.col("size") - NEARBY, F.col("size") + NEARBY)).alias("size"), "n")
    near = spread.groupBy("field", "encoding", "size").agg(F.sum("n").alias("around"))
    both = counts.join(near, ["field", "encoding", "size"])
    enough = f"size >= {LIMIT_SIZE} and bad >= {LIMIT_VALUES} and bad >= {LIMIT_BAD} * n"
    return both.where(f"{enough} and n >= {LIMIT_TIMES} * ((around - n) / {2 * NEARBY} + 0.5)").select("field", "encoding", "size", "n")


def _judged(values: DataFrame, stats: DataFrame) -> DataFrame:
    """(field, id, source, sizes, why): what the statistics say of every open value; null if nothing.

    Equal endings are judged once: values are counted by ending first, the statistics are joined with
    the different endings only, and lookups that cannot tell are left out. Endings that many values
    have go back to them by broadcast, all others by a join.
    """
    ending_of = ["key", "last", "name", "unit"]
    undecided = values.where((F.col("state") == "open") & (F.col("last") != "="))
    counted = cut_lineage(undecided.groupBy(*ending_of).agg(F.count("*").alias("values")))
    of = lambda kind, name: stats.where(F.col("kind") == kind).select(F.col("key").alias(f"{name}_key"), F.col("n").alias(name))

    # Where a lookup cannot tell, its key is one that no statistic has and that differs from row to row, so nothing gathers.
    none = F.concat(F.lit("\x00"), F.xxhash64(*ending_of).cast("string"))

    def looked_up(rows: DataFrame, kind: str, name: str, by: str, where: Column) -> DataFrame:
        asked = rows.withColumn("asked", F.when(where, F.col(by)).otherwise(none))
        return asked.join(of(kind, name), F.col("asked") == F.col(f"{name}_key"), "left").drop(f"{name}_key", "asked")

    plain = ~F.col("name") & (F.col("last") != "9")
    short = F.col("unit") != ""
    rows = looked_up(counted, "end", "ends", "key", ~plain)
    for kind, name in (("last", "lasts"), ("in", "inside"), ("tail", "tails")):
        rows = looked_up(rows, kind, name, "last", plain)
    for kind, name in (("name_end", "name_ends"), ("name", "names")):
        rows = looked_up(rows, kind, name, "last", F.col("name"))
    for kind, name in (("unit", "units"), ("begin", "begins")):
        rows = looked_up(rows, kind, name, "unit", short)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = short & (zero("units") >= REPEATED) & (zero("units") >= WHOLE * (zero("units") + zero("begins")))
    why = (
        F.when(plain & (zero("lasts") + zero("inside") + zero("tails") < KNOWN), "word")
        .when(F.col("name") & (zero("name_ends") < NAME_END * F.greatest(zero("names"), F.lit(1))), "name")
        .when(whole, None)
        .when(plain & (zero("lasts") < NEVER_ENDS * (zero("lasts") + zero("inside"))), "sentence")
        .when(~plain & (zero("ends") < ATTESTED), "sentence")
    )
    verdicts = cut_lineage(rows.select(*ending_of, "values", why.alias("why")))
    told = join_counted(undecided, verdicts, ending_of, "values")
    columns = ["field", "id", "source", "sizes", "why"]
    rest = values.where((F.col("state") != "open") | (F.col("last") == "="))
    rest = rest.withColumn("why", F.when(F.col("state") == "cut", "structure"))
    return rest.select(*columns).unionByName(told.select(*columns))


def cut_values(results: DataFrame | None, bodies: DataFrame | None) -> DataFrame:
    """(field, id, source, why): every value that was cut; why is ``structure``, ``limit``, ``word``, ``name`` or ``sentence``.

    ``results`` has id, source, about, rationale and raw_model_output; ``bodies`` has id, source, body,
    charset and media. Null and empty values are never cut. Repeated rows give one result.

    Shuffles: counts of endings and words (aggregated in each batch first), lengths, and the open
    values by their endings (frequent endings are broadcast); texts are not shuffled.
    """
    texts = _texts(results, bodies)
    values = cut_lineage(_open_values(texts).dropDuplicates(["field", "id"]))
    stats = cut_lineage(_statistics(texts))
    judged = _judged(values, stats)
    judged = cut_lineage(judged.withColumn("unfinished", F.col("why").isNotNull()))
    at_limit = (
        judged.select("field", "id", F.posexplode("sizes").alias("encoding", "size"))
        .join(hidden_limits(judged), ["field", "encoding", "size"], "left_semi")
        .select("field", "id")
        .distinct()
        .withColumn("limit", F.lit(True))
    )
    both = judged.join(at_limit, ["field", "id"], "left")
    both = both.withColumn("why", F.when(F.col("limit") & F.col("why").isNull(), "limit").otherwise(F.col("why")))
    return both.where("why is not null").select("field", "id", "source", "why")
