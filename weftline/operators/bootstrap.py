"""Cluster bootstrap: replicates as a table of multiplicities, ratios of sums, percentile intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from weftline.operators.sampling import numbered
from weftline.session import cut_lineage

#: Fixed values of the draw formula (SplitMix64): any engine with 64-bit integers that wrap gives the same draws.
_STEP, _FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Draws that are made at a time, and clusters whose rows are sent to the workers at a time.
CHUNK, BLOCK = 1 << 18, 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def first_state(seed: int) -> int:
    """The state that a seed begins with."""
    return int(_mix(np.array([seed % 2**64], np.uint64) + _STEP)[0])


def places(seed: int, replicate: int, size: int) -> Iterator[np.ndarray]:
    """The ``size`` places that a replicate draws among ``size``, in chunks.

    Draw ``n`` is number ``n`` of the stream whose state is mixed from seed and replicate: all 64 bits of it,
    modulo the size, so every place can be drawn and neither draws nor replicates are an affine walk.
    """
    state = _mix(np.array([first_state(seed)], np.uint64) + np.array([replicate + 1], np.uint64) * _STEP)
    for start in range(0, size, CHUNK):
        n = np.arange(start + 1, min(size, start + CHUNK) + 1, dtype=np.uint64)
        yield (_mix(state + n * _STEP) % np.uint64(size)).astype(np.int64)


def draws(spark, clusters: DataFrame, key: str, samples: int, seed: int) -> DataFrame:
    """(replicate, key): ``samples`` resamples of as many clusters as there are, drawn with replacement.

    ``places`` says which clusters, by their place in key order.
    The draws are as many as clusters times samples; they are made and joined in parallel.
    """
    each = clusters.select(key).distinct()
    size = each.count()
    if not size:
        return each.select(F.lit(0).cast("bigint").alias("replicate"), key)
    placed = numbered(each, "place", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                for place in places(seed, b, size):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), b)), pa.array(place)], ["replicate", "place"])

    drawn = spark.range(samples).mapInArrow(run, "replicate bigint, place bigint")
    return drawn.join(placed, "place").select("replicate", key)


def intervals(stats: DataFrame, drawn: DataFrame, key: str, by: list[str], value: Column, parts: list[str], name: str) -> DataFrame:
    """Percentile interval of ``value`` over the replicates; ``parts`` are summed per replicate, weighted by how often each cluster was drawn."""
    weights = drawn.groupBy("replicate", key).agg(F.count("*").alias("times"))
    sums = weights.join(stats, key).groupBy("replicate", *by).agg(*[F.sum(F.col(p) * F.col("times")).alias(p) for p in parts])
    return _percentiles(sums, by, value, name)


def resampled(stats: DataFrame, key: str, by: list[str], value: Column, parts: list[str], name: str, samples: int, seed: int, digits: int = 6) -> DataFrame:
    """``intervals`` over ``draws``, without a row for each draw: the draws stay in Arrow batches as multiplicities.

    Each task makes whole replicates and sends on their sums only. The clusters' rows are broadcast in
    blocks of ``BLOCK`` places; beyond one block each block counts all draws again for its own places.
    """
    spark = stats.sparkSession
    stats = cut_lineage(stats.select(key, *by, *[F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias(p) for p in parts]))
    each = stats.select(key).distinct()
    size = each.count()
    schema = StructType([StructField("replicate", LongType()), *[stats.schema[c] for c in by], *[StructField(p, DoubleType()) for p in parts]])
    if not size:
        return _percentiles(spark.createDataFrame([], schema), by, value, name, digits)
    rows = cut_lineage(stats.join(numbered(each, "place", key), key).select("place", *by, *parts))
    out = None
    for low in range(0, size, BLOCK):
        high = min(size, low + BLOCK)
        block = rows.where(F.col("place").between(low, high - 1)).toArrow()
        codes: dict[tuple, int] = {}
        group = np.array([codes.setdefault(g, len(codes)) for g in zip(*[block.column(c).to_pylist() for c in by])] if by else [0] * len(block), np.int64)
        if not len(group):
            continue
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
        # In the order of their codes, as the rows are.
        names = [pa.array([g[k] for g in codes] if by else [], block.schema.field(c).type) for k, c in enumerate(by)]
        amounts = np.column_stack([block.column(p).to_numpy() for p in parts])[order]
        shipped = spark.sparkContext.broadcast((block.column("place").to_numpy()[order] - low, starts, names, amounts))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, low=low, high=high) -> Iterator[pa.RecordBatch]:
            place, starts, names, amounts = shipped.value
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    times = np.zeros(high - low, np.int64)
                    for p in places(seed, b, size):
                        times += np.bincount(p[(p >= low) & (p < high)] - low, minlength=high - low)
                    mine = times[place]
                    sums = np.add.reduceat(amounts * mine[:, None], starts)
                    drawn = np.add.reduceat(mine, starts) > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(drawn.sum(), b)), *[n.filter(pa.array(drawn)) for n in names], *[pa.array(c) for c in sums[drawn].T]],
                        ["replicate", *by, *parts],
                    )

        found = spark.range(samples).mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return _percentiles(spark.createDataFrame([], schema), by, value, name, digits)
    if size > BLOCK:
        out = out.groupBy("replicate", *by).agg(*[F.sum(p).alias(p) for p in parts])
    return _percentiles(out, by, value, name, digits)


def _percentiles(sums: DataFrame, by: list[str], value: Column, name: str, digits: int = 6) -> DataFrame:
    per = sums.withColumn(name, value).where(F.col(name).isNotNull())
    return per.groupBy(*by).agg(
        F.count("*").alias("replicates"),
        F.round(F.percentile(name, F.lit(0.025)), digits).alias("low"),
        F.round(F.percentile(name, F.lit(0.975)), digits).alias("high"),
    )
