"""Deterministic selections: stratified samples by hash, bounded top rows, K-grids of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut_lineage


def hash_order(key: str, stratum: str, seed: str):
    """Order of a row in its stratum: SHA-256 of seed, stratum and key."""
    return F.sha2(F.concat_ws("|", F.lit(seed), F.col(stratum).cast("string"), F.col(key).cast("string")), 256)


def stratified(df: DataFrame, key: str, stratum: str, total: int, seed: str) -> DataFrame:
    """(stratum, key, place): about ``total`` rows, each stratum in proportion but at least one, by hash order."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    whole = df.count()
    quota = F.greatest(F.lit(1), F.round(total * F.col("size") / F.lit(max(1, whole))).cast("int"))
    wanted = sizes.select(stratum, quota.alias("quota"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("h", key))
    rows = df.select(stratum, key, hash_order(key, stratum, seed).alias("h")).withColumn("place", place)
    # No quota is above the total, so each stratum is cut to that many rows per task before it is sorted as a whole.
    return rows.where(F.col("place") <= max(1, total)).join(wanted, stratum).where("place <= quota").select(stratum, key, "place")


def top_per_group(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The first ``n`` rows of each group; Catalyst limits each group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


def f1_at_k(scores: DataFrame, claims: str, supported: str, k: str) -> DataFrame:
    """Precision, recall at K (supported up to K) and their F1 per row; 0 without support."""
    precision = F.when(F.col(claims) > 0, F.col(supported) / F.col(claims)).otherwise(0.0)
    recall = F.least(F.col(supported) / F.col(k), F.lit(1.0))
    both = scores.withColumn("precision", precision).withColumn("recall", recall)
    return both.withColumn("f1", F.when(F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with the place of each row in ``order``, counted from 0, without a single task that sees all rows.

    Rows are sorted by ranges and kept; each range begins where the counts of the ranges before it end.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut_lineage(rows.withColumn("_range", F.spark_partition_id()).withColumn("_local", local))
    sizes = sorted((r["_range"], r["count"]) for r in rows.groupBy("_range").count().collect())  # one row per range
    starts, at = [], 0
    for n, size in sizes:
        starts.append((n, at))
        at += size
    begin = df.sparkSession.createDataFrame(starts, "_range int, _begin bigint")
    return rows.join(F.broadcast(begin), "_range").withColumn(name, F.col("_begin") + F.col("_local")).drop("_range", "_local", "_begin")


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """(k): the value at place n div 2 of the sorted values, counted from 0."""
    middle = df.count() // 2
    return numbered(df.select(value), "place", value).where(F.col("place") == middle).agg(F.min(value).alias("k"))
