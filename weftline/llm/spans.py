"""Long exact spans shared between records.

First pass: lines and paragraphs, and the whole record as one unit, are digested and the digests
grouped over the whole corpus. Units of at least the least length that stand in several records are
classes; records that are the same as a whole are one text from here on.

Second pass, for runs that hold no whole unit: passages of half the least length that begin at a line or
sentence boundary, or where there is none at a place chosen by content. In every window of the other
half one of them is chosen by smallest digest, boundaries first, so two texts with a common run of the
least length always share a passage (winnowing). Around each shared passage the digests of wider
windows tell which texts have a chance, and the regions around the passages, never whole texts, are
compared character by character. Where many different regions meet in one window, the windows of full
length are grouped first, and only the texts of equal windows are taken as a class; both ways decide on
the characters and give the same result.

Of each unit and run the occurrence in the record with the smallest key is kept, the others are removed,
with their offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.hashing import Rolling, code_points, sliding_min
from weftline.llm.skew import join_counted
from weftline.session import cut_lineage

#: Line ends, and sentence ends that count where white space follows.
_LINE = (0x0A, 0x0D, 0x2028, 0x2029)
_STOP = (0x2E, 0x21, 0x3F)
_FULL = (0x3002, 0xFF01, 0xFF1F)
_BLANK = (0x20, 0x09, 0x0A, 0x0D, 0xA0)
#: Different regions in one window that are compared pair by pair; where more meet, windows of full length are grouped
#: first. The way changes, the result does not.
PAIR_ROWS = 64
#: Characters worked on at a time; longer texts are read in overlapping stretches.
_STRETCH = 8_000_000


class Shared(NamedTuple):
    """Results of ``shared_spans``. A text is named by the smallest key of the records that have it."""

    copies: DataFrame  # (key, text): records whose whole text another record has too
    links: DataFrame  # (a, b): pairs of different texts with a common run, a < b
    classes: DataFrame  # (class, text): texts that all have one unit or window of at least the least length
    spans: DataFrame  # (key, start, end, first): stretches that stand elsewhere; first: this is the earliest record


def _anchors(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling, np.ndarray]:
    """Chosen units of texts of at least ``least`` characters: text number, offset, digest; hashes; text starts."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    points = code_points("".join(texts))
    rolling = Rolling(points)
    unit = least // 2
    width = least - unit + 1
    digest = rolling.all(unit)
    following = np.append(points[1:], 0)
    starts = np.isin(points, _LINE) | np.isin(points, _FULL) | (np.isin(points, _STOP) & np.isin(following, _BLANK))
    # Order of choice: boundary first, then digest, then place; all decided by the unit's own characters.
    place = np.arange(len(digest), dtype=np.uint64)
    order = ((digest >> np.uint64(25)) << np.uint64(24)) | (place & np.uint64(0xFFFFFF))
    order |= (~starts[: len(digest)]).astype(np.uint64) << np.uint64(63)
    smallest = sliding_min(order, width)
    if not len(smallest):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64), rolling, begin
    inside = np.zeros(len(points) + 1, np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + size - least + 1, -1)
    valid = np.cumsum(inside)[: len(smallest)] > 0
    chosen = np.unique(smallest[valid] & np.uint64(0xFFFFFF)).astype(np.int64)
    owner = np.searchsorted(begin, chosen, "right") - 1
    return owner, chosen, digest[chosen], rolling, begin


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _line_units(least: int):
    """Digests of the whole text and of its lines of at least ``least`` characters, white space around them left out."""
    line = re.compile(rf"[^\n]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, digest, start, end, whole = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = [(0, len(t), True)]
                for m in line.finditer(t):
                    a, b = m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip())
                    if b - a >= least and (a, b) != (0, len(t)):
                        found.append((a, b, False))
                for a, b, w in found:
                    take.append(i)
                    digest.append(_digest(t[a:b]))
                    start.append(a)
                    end.append(b)
                    whole.append(w)
            arrays = [batch.column(0).take(pa.array(take, pa.int64())), pa.array(digest, pa.binary()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(whole, pa.bool_())], ["k", "unit", "start", "end", "whole"])

    return run


def _passages(least: int):
    """Chosen passages of each text: the text's digest, the passage's digest and place; texts that repeat in a batch are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(dict.fromkeys(batch.column(0).to_pylist()))
            done = 0
            while done < len(texts):
                part, size = [], 0
                while done < len(texts) and size < 4_000_000 and len(texts[done]) <= _STRETCH:
                    part.append(texts[done])
                    size += len(texts[done])
                    done += 1
                if part:
                    yield _passage_batch([_digest(t) for t in part], part, least)
                elif done < len(texts):
                    # A very long text in stretches that overlap by two runs, so no window is missed.
                    t, name = texts[done], _digest(texts[done])
                    for at in range(0, max(1, len(t) - 2 * least), _STRETCH):
                        yield _passage_batch([name], [t[at : at + _STRETCH + 2 * least]], least, at)
                    done += 1

    return run


def _passage_batch(names: list[bytes], texts: list[str], least: int, shift: int = 0) -> pa.RecordBatch:
    owner, at, digest, _, begin = _anchors(texts, least)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.binary()).take(pa.array(owner)), pa.array(digest.view(np.int64)), pa.array(at - begin[owner] + shift)], ["text", "digest", "pos"]
    )


def _regions(least: int, step: int):
    """Around each passage: the region that any run of the least length through it lies in, and digests of wider windows."""
    unit = least // 2
    wide = least - step
    back = np.arange(0, least - unit + 1, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["t", "at"]).to_pylist()):
                t, at = row["t"], np.array(sorted(row["at"]), np.int64)
                starts = np.maximum(0, at - (least - unit))
                regions = [t[a : p + least] for a, p in zip(starts.tolist(), at.tolist())]
                rolling = Rolling(code_points(t))
                first = at[:, None] - back[None, :]
                fits = (first >= 0) & (first + wide <= len(t))
                flat = rolling.at(first[fits], wide).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(fits.sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.full(len(at), i))),
                        pa.array(at),
                        pa.array(starts),
                        pa.array(regions, pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    ["k", "pos", "from", "region", "wide"],
                )

    return run


def _common_run(a: str, b: str, pa_: int, pb: int, unit: int) -> tuple[int, int]:
    """Start in ``a`` and length of the maximal common run through a[pa_:pa_+unit] == b[pb:pb+unit]; length 0 if they differ."""
    if a[pa_ : pa_ + unit] != b[pb : pb + unit]:
        return pa_, 0
    lo = 0
    step = 64
    while True:
        n = min(step, pa_ - lo, pb - lo)
        if n <= 0:
            break
        if a[pa_ - lo - n : pa_ - lo] == b[pb - lo - n : pb - lo]:
            lo += n
            step *= 2
        elif n == 1:
            break
        else:
            step = max(1, n // 2)
    hi, step = unit, 64
    while True:
        n = min(step, len(a) - pa_ - hi, len(b) - pb - hi)
        if n <= 0:
            break
        if a[pa_ + hi : pa_ + hi + n] == b[pb + hi : pb + hi + n]:
            hi += n
            step *= 2
        elif n == 1:
            break
        else:
            step = max(1, n // 2)
    return pa_ - lo, lo + hi


def _compare(least: int):
    """Common runs through two passages, as far as their regions reach."""
    unit = least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, starts_a, starts_b, lengths = [], [], [], []
            for i, row in enumerate(batch.select(["pa", "pb", "fa", "fb", "ra", "rb"]).to_pylist()):
                start, size = _common_run(row["ra"], row["rb"], row["pa"] - row["fa"], row["pb"] - row["fb"], unit)
                if size >= least:
                    keep.append(i)
                    starts_a.append(start + row["fa"])
                    starts_b.append(start + row["fa"] + row["pb"] - row["pa"])
                    lengths.append(size)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, pa.int64()) for x in (starts_a, starts_b, lengths))],
                ["a", "b", "start_a", "start_b", "size"],
            )

    return run


def _full_windows(least: int):
    """All windows of the full length in each region, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, region in enumerate(batch.column(3).to_pylist()):
                window = Rolling(code_points(region)).all(least).view(np.int64)
                if len(window):
                    same = pa.array(np.full(len(window), i))
                    start = batch.column(2)[i].as_py() + np.arange(len(window))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(same), batch.column(1).take(same), pa.array(window), pa.array(start)], ["k", "pos", "window", "start"]
                    )

    return run


def shared_spans(df: DataFrame, key: str, text: str, *, least: int = 400, step: int = 50) -> Shared:
    """Texts that have a run of at least ``least`` characters in common, character by character.

    ``key`` must be unique. Null texts and texts shorter than ``least`` share nothing. Other
    columns are left behind. ``spans`` has the stretches of each record that stand in another record
    too, possibly overlapping. Nothing is expanded into all pairs here; ``found_pairs`` does that.

    Shuffles: digests of units, digests of passages (about one per ``least`` / 4 characters), then the
    texts that may share a run, once, and the regions around their shared passages. Grouping is by
    partial aggregates, and groups that hold many rows are joined by broadcast of their digests.
    """
    if least < 16 or not 0 < step <= least // 4:
        raise ValueError("least must be at least 16 and step at most a quarter of it")
    rows = df.select(df[key].alias("k"), df[text].alias("t")).where(F.length(df[text]) >= least)
    kind = rows.schema["k"].dataType.simpleString()

    # First pass: whole records and their lines.
    units = cut_lineage(rows.mapInArrow(_line_units(least), f"k {kind}, unit binary, start bigint, end bigint, whole boolean"))
    whole = units.where("whole").groupBy("unit").agg(F.min("k").alias("text"), F.count("*").alias("n"))
    whole = cut_lineage(whole)
    copies = cut_lineage(join_counted(units.where("whole").select("k", "unit", "end"), whole.where("n > 1"), ["unit"], "n").select("k", "text", "end"))
    copy_spans = copies.select("k", F.lit(0).cast("bigint").alias("start"), "end", (F.col("k") == F.col("text")).alias("first"))
    others = units.join(copies.where("k != text").select("k"), "k", "left_anti")
    groups = others.groupBy("unit").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("unit", "lo", "n")
    same_units = cut_lineage(join_counted(others, cut_lineage(groups), ["unit"], "n"))
    unit_classes = same_units.select(F.hex("unit").alias("class"), F.col("k").alias("text"))
    unit_spans = same_units.select("k", "start", "end", (F.col("k") == F.col("lo")).alias("first"))

    # Second pass: passages of different texts.
    passages = cut_lineage(rows.select("t").mapInArrow(_passages(least), "text binary, digest bigint, pos bigint"))
    many = passages.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("digest", "n")
    asked = join_counted(passages, cut_lineage(many), ["digest"], "n").groupBy("text").agg(F.collect_set("pos").alias("at"))
    asked = asked.join(whole.select(F.col("unit"), F.col("text").alias("k")), F.col("text") == F.col("unit")).select("k", "at")
    regions = rows.join(asked, "k").select("k", "t", "at").mapInArrow(_regions(least, step), f"k {kind}, pos bigint, from bigint, region string, wide array<bigint>")
    regions = cut_lineage(regions)
    wide = regions.select("k", "pos", F.explode("wide").alias("w"))
    groups = wide.groupBy("w").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("w", "n")
    members = cut_lineage(join_counted(wide, cut_lineage(groups), ["w"], "n").select("w", "k", "pos", (F.col("n") > PAIR_ROWS).alias("hot")))
    region = regions.select("k", "pos", "from", "region")

    # Few regions in a window: each two passages once, their regions compared character by character.
    small = members.where(~F.col("hot"))
    left, right = small.select("w", F.col("k").alias("a"), F.col("pos").alias("pa")), small.select("w", F.col("k").alias("b"), F.col("pos").alias("pb"))
    met = left.join(right, "w").where("a < b").select("a", "b", "pa", "pb").distinct()
    of = lambda s: region.select(F.col("k").alias(s), F.col("pos").alias(f"p{s}"), F.col("from").alias(f"f{s}"), F.col("region").alias(f"r{s}"))
    both = met.join(of("a"), ["a", "pa"]).join(of("b"), ["b", "pb"]).select("a", "b", "pa", "pb", "fa", "fb", "ra", "rb")
    runs = cut_lineage(both.mapInArrow(_compare(least), f"a {kind}, b {kind}, start_a bigint, start_b bigint, size bigint"))

    # Many regions in a window: windows of the full length; equal sets of texts are kept once, by their characters.
    hot = members.where("hot").select("k", "pos").distinct().join(region, ["k", "pos"]).select("k", "pos", "from", "region")
    windows = cut_lineage(hot.mapInArrow(_full_windows(least), f"k {kind}, pos bigint, window bigint, start bigint"))
    sets = windows.select("window", "k").distinct().groupBy("window").agg(
        F.min("k").alias("lo"), F.count("*").alias("n"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("sig")
    ).where("n > 1")
    sets = cut_lineage(sets)
    one = sets.groupBy("n", "sig", "lo").agg(F.min("window").alias("window")).select("window")
    kept = windows.join(one, "window", "left_semi").join(region, ["k", "pos"])
    text_of = F.substring("region", (F.col("start") - F.col("from") + 1).cast("int"), F.lit(least))
    window_classes = kept.select(F.sha2(text_of, 256).alias("class"), F.col("k").alias("text")).distinct()
    window_spans = windows.join(sets.select("window", "lo"), "window").select("k", "start", (F.col("start") + least).alias("end"), (F.col("k") == F.col("lo")).alias("first"))

    own = runs.select(F.col("a").alias("k"), F.col("start_a").alias("start"), (F.col("start_a") + F.col("size")).alias("end"), F.lit(True).alias("first"))
    other = runs.select(F.col("b").alias("k"), F.col("start_b").alias("start"), (F.col("start_b") + F.col("size")).alias("end"), F.lit(False).alias("first"))
    spans = copy_spans.union(unit_spans).union(own).union(other).union(window_spans).withColumnRenamed("k", key)
    return Shared(
        copies.select(F.col("k").alias(key), "text"), runs.select("a", "b").distinct(), unit_classes.union(window_classes).distinct(), spans
    )


def found_pairs(shared: Shared, key: str) -> DataFrame:
    """(a, b): each pair of keys with a common run, a < b; classes and copies are expanded, so the output may be large."""
    texts = shared.classes
    together = texts.withColumnRenamed("text", "a").join(texts.withColumnRenamed("text", "b"), "class").where("a < b").select("a", "b")
    linked = shared.links.union(together).distinct()
    keys = shared.copies
    for side in ("a", "b"):
        linked = linked.join(keys.select(F.col(key).alias(f"key_{side}"), F.col("text").alias(side)), side, "left")
    a, b = F.coalesce("key_a", "a"), F.coalesce("key_b", "b")
    linked = linked.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    same = keys.withColumnRenamed(key, "a").join(keys.withColumnRenamed(key, "b"), "text").where("a < b").select("a", "b")
    return linked.union(same)


def link_counts(shared: Shared, key: str) -> DataFrame:
    """(key, text, links): every record that shares a run, its text and to how many other texts that one is linked.

    Texts of a class count each other without being paired: a text has one link less than its largest
    class has members, or as many as it has pairs, whichever is more (a lower bound where classes differ).
    """
    sizes = shared.classes.groupBy("class").agg((F.count("*") - 1).alias("n"))
    by_class = shared.classes.join(sizes, "class").groupBy("text").agg(F.max("n").alias("n"))
    by_link = shared.links.select(F.explode(F.array("a", "b")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    links = by_class.union(by_link).groupBy("text").agg(F.max("n").alias("links"))
    with_copies = shared.copies.join(links, "text", "left").select(key, "text", F.coalesce("links", F.lit(0)).alias("links"))
    alone = links.join(shared.copies.select("text"), "text", "left_anti").select(F.col("text").alias(key), "text", "links")
    return with_copies.unionByName(alone)


def covered(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end): the union of overlapping or touching stretches of each text."""
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(key, "start", "end").distinct().withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    island = marked.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def shared_share(df: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """(key, n_chars, shared_chars, share) of every row of ``df``; share is null for null and empty texts."""
    shared = covered(spans, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    base = df.select(df[key], F.length(df[text]).cast("bigint").alias("n_chars"))
    out = base.join(shared, key, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("bigint")))
    return out.withColumn("share", F.try_divide(F.col("shared_chars").cast("double"), F.col("n_chars").cast("double")))


def removed_spans(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end): what is removed when only the occurrence in the earliest text is kept."""
    return covered(spans.where(~F.col("first")), key)
