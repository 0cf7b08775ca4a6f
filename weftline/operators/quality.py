"""Constraints as queries: each returns the rows that break it, none if it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    """(key, n) of keys that are not unique."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def broken_ranks(run: DataFrame, query_key: str) -> DataFrame:
    """Queries whose ranks are not 1..n, each once."""
    got = run.groupBy(query_key).agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("rank").alias("different"))
    return got.where("low <> 1 or high <> n or different <> n")


def drift(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, a, b): keys on one side only and fields that differ, null-safe."""
    left = a.select(F.col(key), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("l"))
    right = b.select(F.col(key), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("r"))
    both = left.join(right, key, "full_outer")
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").alias("a"), F.col(f"r.{f}").alias("b")) for f in fields]
    return both.select(key, F.explode(F.array(*cells)).alias("x")).where(~F.col("x.a").eqNullSafe(F.col("x.b"))).select(key, "x.*")


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b, both): sizes of the parts of two key sets."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(1)), b.select(key).distinct().withColumn("in_b", F.lit(1))
    met = left.join(right, key, "full_outer")
    return met.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
        F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both"),
    )


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): rows for which a rule does not hold; an unknown outcome counts as broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def forbidden_columns(df: DataFrame, allowed: set[str]) -> list[str]:
    """Columns that are not on the list; the data are not read."""
    return sorted(set(df.columns) - allowed)


def pending(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units without a good result yet: what a resumed run has to work on."""
    return units.join(done.where("status = 'ok'").select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of ``new``; columns of ``keep`` are taken over from ``old`` where it has the key."""
    before = old.select(key, *[F.col(c).alias(f"_{c}") for c in keep])
    cols = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns]
    return new.join(before, key, "left").select(*cols)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Concatenation by name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
