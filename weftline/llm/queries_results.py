"""Queries over verifier results and bodies: defective answers (p2), cut values (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.http import charset, host, media_type
from weftline.llm.answers import defects
from weftline.llm.cutoff import cut_values


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/verifier_result.parquet")


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    named = [F.col("result_id").alias("id"), F.col("model").alias("source"), F.col("gold_claim").alias("about")]
    results = _results(spark, sf_dir).select(*named, "rationale", "raw_model_output")
    fetches = spark.read.parquet(f"{sf_dir}/fetch_result.parquet")
    media = media_type(fetches.headers)
    where = F.coalesce(host(fetches.requested_url), host(fetches.final_url))
    bodies = fetches.where(media.startswith("text/") | (media == "application/json")).select(
        F.col("fetch_id").alias("id"), where.alias("source"), "body", charset(fetches.headers).alias("charset"), media.alias("media")
    )
    return results, bodies


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, record_id): values that were cut off."""
    return cut_values(*_sources(spark, sf_dir)).select("field", F.col("id").alias("record_id"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, source, n_values, cut, rate): how often each host and each model truncates."""
    results, bodies = _sources(spark, sf_dir)
    cut = cut_values(results, bodies).groupBy("field", "source").agg(F.count("*").alias("cut"))
    all_bodies = bodies.where(F.length("body") > 0).dropDuplicates(["id"]).select(F.lit("body").alias("field"), "source")
    one = results.dropDuplicates(["id"])
    fields = [one.where(F.length(f) > 0).select(F.lit(f).alias("field"), "source") for f in ("rationale", "raw_model_output")]
    values = all_bodies.union(fields[0]).union(fields[1]).groupBy("field", "source").agg(F.count("*").alias("n_values"))
    out = values.join(cut.withColumnRenamed("field", "f").withColumnRenamed("source", "s"), (F.col("field") == F.col("f")) & F.col("source").eqNullSafe(F.col("s")), "left")
    out = out.select("field", "source", "n_values", F.coalesce("cut", F.lit(0)).alias("cut"))
    return out.withColumn("rate", F.col("cut") / F.col("n_values"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(result_id, defect): results whose answer is defective, with the first defect that applies."""
    answers = _results(spark, sf_dir).where("status is distinct from 'request_error'")
    return defects(answers, "result_id", "raw_model_output", "gold_claim", "model", "prediction")


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_rates": p5_rates}
#: Neither has a SQL form; tests compare with values cut on purpose.
SQL: dict[str, str] = {}
