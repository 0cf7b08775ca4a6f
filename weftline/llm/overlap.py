"""Same or nearly the same records on two sides, by an exact prefix-filter join on rare shingles.

Records are compared in a canonical form of tokens. Near equality keeps every word in its place, so a
shingle is a token with its place, the number of tokens, and those tokens that must agree exactly. The
shingles of a record are ordered from rare to common over all records. Two records with m free tokens
of which at most s differ share at least m - s of them, so their s + 1 rarest (the prefixes) have one in
common: the prefixes of the evaluation side are indexed, those of the training side probe them. The
places of the shared shingle in both orders bound the overlap that is still possible; what passes is
verified token by token.

Equal canonical forms are one class each, so copies are joined once and expanded at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut_lineage

#: Shingles in more than this share of the records are ranked through a broadcast table; since a
#: record has few tokens, at most (tokens per record / HOT_SHARE) shingles can be that common.
HOT_SHARE = 1 / 500


def allowed_slips(n: int) -> int:
    """Tokens that may differ in a record of ``n`` tokens; one at least must agree."""
    return min(n - 1, max(1, (3 * n) // 10))


def _canonical_rows(df: DataFrame, key: str, text: str, side: Column, canonical: Callable[[str | None], list[str]]) -> DataFrame:
    rows = df.select(df[key].alias("k"), df[text].alias("t"), side.alias("side")).where(F.trim(df[text]) != "")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [canonical(t) for t in batch.column(1).to_pylist()]
            forms = pa.array([" ".join(t) if t else None for t in tokens], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), forms], ["k", "side", "form"])

    return rows.mapInArrow(run, f"k {kind}, side boolean, form string").where("form is not null")


def _shingles(classes: DataFrame, must_agree: Callable[[str], bool]) -> DataFrame:
    """(id, evaluation, training, slips, block, place, word): the free tokens of each class with their places.

    ``block`` is the number of tokens with those that must agree and their places. Where no free token
    need be shared, the block itself is a shingle (place -1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, slips, blocks, places, words = [], [], [], [], []
            for i, form in enumerate(batch.column(3).to_pylist()):
                tokens = form.split(" ")
                fixed = [must_agree(t) for t in tokens]
                block = f"{len(tokens)} " + " ".join(f"{p}={t}" for p, t in enumerate(tokens) if fixed[p])
                free = [(p, t) for p, t in enumerate(tokens) if not fixed[p]]
                s = min(allowed_slips(len(tokens)), len(free))
                if free and len(free) <= s:
                    free.append((-1, ""))
                for p, t in free:
                    take.append(i)
                    slips.append(s)
                    blocks.append(block)
                    places.append(p)
                    words.append(t)
            at = pa.array(take, pa.int64())
            arrays = [batch.column(k).take(at) for k in range(3)]
            arrays += [pa.array(slips, pa.int32()), pa.array(blocks, pa.string()), pa.array(places, pa.int32()), pa.array(words, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "evaluation", "training", "slips", "block", "place", "word"])

    rows = classes.select(F.xxhash64("form").alias("id"), "evaluation", "training", "form")
    out = rows.mapInArrow(run, "id bigint, evaluation boolean, training boolean, slips int, block string, place int, word string")
    return out.withColumn("shingle", F.xxhash64("block", "place", "word")).drop("block", "place", "word")


def _prefixes(shingles: DataFrame) -> DataFrame:
    """(id, evaluation, training, slips, m, at, shingle): the rarest ``slips`` + 1 shingles of each class with their places in its order."""
    counts = shingles.groupBy("shingle").agg(F.count("*").alias("df"), F.max("evaluation").alias("e"), F.max("training").alias("t"))
    counts = cut_lineage(counts)
    total = F.broadcast(counts.agg(F.sum("df").alias("all")))
    hot = F.broadcast(counts.crossJoin(total).where(F.col("df") > F.greatest(F.lit(50.0), F.col("all") * HOT_SHARE)).select("shingle", "df", "e", "t"))
    marked = shingles.join(hot, "shingle", "left")
    rare = marked.where("df is null").drop("df", "e", "t").join(counts, "shingle")
    both = rare.unionByName(marked.where("df is not null"))
    order = F.array_sort(F.collect_list(F.struct("df", "shingle", "e", "t"))).alias("order")
    ranked = both.groupBy("id", "evaluation", "training", "slips").agg(order)
    head = ranked.select("id", "evaluation", "training", "slips", F.size("order").alias("m"), F.posexplode(F.expr("slice(order, 1, slips + 1)")).alias("at", "x"))
    # A shingle that stands on one side only meets nothing.
    return head.where("x.e and x.t").withColumn("shingle", F.col("x.shingle")).drop("x")


def same_records(
    df: DataFrame,
    key: str,
    text: str,
    is_evaluation: Column,
    *,
    canonical: Callable[[str | None], list[str]],
    verify: Callable[[list[str], list[str], int], bool],
    must_agree: Callable[[str], bool] = lambda token: False,
) -> DataFrame:
    """(a, b): every pair of one evaluation and one training record that are the same or nearly so, smaller key first.

    ``is_evaluation`` is a boolean column: true for the evaluation side, false for the training
    side; rows where it is null belong to neither. ``canonical`` maps a text to its tokens. Records are
    nearly the same if they have as many tokens, agree wherever ``must_agree`` holds for a token of
    either, differ in at most ``allowed_slips`` places, and ``verify`` (two token lists, number of
    tokens that may differ) says so. Null, blank and token-less texts match nothing. Keys that repeat
    count once. Other columns are left behind.

    Shuffles: shingle counts (partial aggregates), prefixes as hashes, candidate pairs as ids, and
    the found classes by form. A collision of hashes only adds a candidate.
    """
    rows = cut_lineage(_canonical_rows(df, key, text, is_evaluation, canonical).where("side is not null").dropDuplicates(["k"]))
    classes = rows.groupBy("form").agg(F.max("side").alias("evaluation"), F.max(~F.col("side")).alias("training"))
    prefixes = cut_lineage(_prefixes(cut_lineage(_shingles(classes, must_agree))))
    index = prefixes.where("evaluation").select("shingle", F.col("id").alias("e"), "m", "slips", F.col("at").alias("at_e"))
    probe = prefixes.where("training").select("shingle", F.col("id").alias("r"), F.col("m").alias("m_r"), F.col("at").alias("at_r"))
    met = (
        index.join(probe, "shingle")
        .where("e != r and m = m_r and least(at_e, at_r) + m - greatest(at_e, at_r) >= m - slips")
        .select("e", "r")
        .distinct()
    )
    forms = classes.select(F.xxhash64("form").alias("id"), "form")
    asked = met.join(forms.select(F.col("id").alias("e"), F.col("form").alias("fe")), "e").join(forms.select(F.col("id").alias("r"), F.col("form").alias("fr")), "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for e, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = e.split(" "), r.split(" ")
                keep.append(len(a) == len(b) and verify(a, b, allowed_slips(len(a))))
            yield batch.filter(pa.array(keep, pa.bool_()))

    near = asked.select(F.col("fe").alias("e"), F.col("fr").alias("r")).mapInArrow(run, "e string, r string")
    equal = classes.where("evaluation and training").select(F.col("form").alias("e"), F.col("form").alias("r"))
    found = near.union(equal)
    left = rows.where("side").select(F.col("form").alias("e"), F.col("k").alias("ke"))
    right = rows.where("not side").select(F.col("form").alias("r"), F.col("k").alias("kr"))
    return found.join(left, "e").join(right, "r").select(F.least("ke", "kr").alias("a"), F.greatest("ke", "kr").alias("b"))
