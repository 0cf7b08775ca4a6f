"""Abstention-aware classification metrics over predictions in long form (setting, label, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("FACTUAL", "NON_FACTUAL")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the last in ``order``.

    A window with a rank limit: columns that are not used afterwards are neither read nor shuffled, and a
    key of many rows is cut down to one row per task before the shuffle.
    """
    if not order:
        return df.dropDuplicates([key])
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def state(label: Column, prediction: Column, status: Column) -> Column:
    """correct, incorrect, abstained or failed."""
    return (
        F.when(status.isNull() | (status != "ok") | prediction.isNull(), "failed")
        .when(prediction == "UNKNOWN", "abstained")
        .when(prediction == label, "correct")
        .otherwise("incorrect")
    )


def counts(df: DataFrame, *by: str) -> DataFrame:
    """Sufficient statistics per group of rows with label, prediction and state."""
    aggs = [F.count("*").alias("total"), F.count_if(F.col("state") == "correct").alias("correct")]
    aggs.append(F.count_if(F.col("state").isin("correct", "incorrect")).alias("answered"))
    aggs.append(F.count_if(F.col("state") == "abstained").alias("abstained"))
    for c in CLASSES:
        good = F.col("state").isin("correct", "incorrect", "abstained") & (F.col("prediction") == c)
        short = c[0].lower()
        aggs += [
            F.count_if((F.col("label") == c) & good).alias(f"tp_{short}"),
            F.count_if((F.col("label") != c) & good).alias(f"fp_{short}"),
            F.count_if((F.col("label") == c) & ~F.coalesce(good, F.lit(False))).alias(f"fn_{short}"),
        ]
    return df.groupBy(*by).agg(*aggs)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of a class: null without gold rows, 0 without a hit."""
    return F.when(tp + fn == 0, None).when(tp == 0, 0.0).otherwise(2.0 * tp / (2.0 * tp + fp + fn))


def rates(stats: DataFrame, *by: str) -> DataFrame:
    """Accuracy, coverage, selective accuracy, abstention, balanced accuracy and macro-F1 of ``counts``."""
    c = F.col
    recalls = [ratio(c(f"tp_{s}"), c(f"tp_{s}") + c(f"fn_{s}")) for s in "fn"]
    scores = [f1(c(f"tp_{s}"), c(f"fp_{s}"), c(f"fn_{s}")) for s in "fn"]
    mean = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a + b) / 2)
    r6 = lambda x, n: F.round(x, 6).alias(n)
    return stats.select(
        *by,
        "total",
        r6(ratio(c("correct"), c("total")), "accuracy"),
        r6(ratio(c("answered"), c("total")), "coverage"),
        r6(ratio(c("correct"), c("answered")), "selective_accuracy"),
        r6(ratio(c("abstained"), c("total")), "abstention"),
        r6(mean(*recalls), "balanced_accuracy"),
        r6(mean(*scores), "macro_f1"),
    )


def transitions(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(before, after, n) over the keys that both settings have; four states each, zero-filled."""
    states = ("correct", "incorrect", "abstained", "failed")
    a = df.where(F.col("setting") == before).select(key, F.col("state").alias("before"))
    b = df.where(F.col("setting") == after).select(key, F.col("state").alias("after"))
    met = a.join(b, key).groupBy("before", "after").agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(x, y) for x in states for y in states], "before string, after string")
    return grid.join(met, ["before", "after"], "left").select("before", "after", F.coalesce("n", F.lit(0)).alias("n"))
