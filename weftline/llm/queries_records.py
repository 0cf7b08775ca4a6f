"""Queries over bodies and claims: pieces of oversized texts (p1), claims on both sides of a split (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.http import charset, media_type
from weftline.llm.claims import canonical, must_agree, same_statement
from weftline.llm.overlap import same_records
from weftline.llm.split import split_oversized

#: Production parameters of p1.
P1_LIMIT, P1_OVERLAP = 4000, 200


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    fetches = spark.read.parquet(f"{sf_dir}/fetch_result.parquet")
    rows = fetches.where(media_type(fetches.headers) == "text/plain")
    return split_oversized(rows, "fetch_id", body="body", charset=charset(rows.headers), limit=P1_LIMIT, overlap=P1_OVERLAP, with_text=with_text)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the plain-text bodies; a fetch delivered again counts once."""
    return _pieces(spark, sf_dir, True).dropDuplicates(["fetch_id", "piece"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id, cut) of each plain-text body that came out in more than one piece.

    A piece that had to end inside a run no longer than the limit, because the run and the overlap
    before it do not fit together, is no forced cut: the run has a boundary within the limit.
    """
    found = _pieces(spark, sf_dir, False).groupBy("fetch_id").agg(F.max("piece").alias("last"), F.max("cut_run").alias("run"))
    cut = F.when(F.col("run") > P1_LIMIT, "forced").otherwise("natural")
    return found.where("last > 0").select("fetch_id", cut.alias("cut"))


def _claim_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    splits = spark.read.parquet(f"{sf_dir}/split_manifest.parquet").select("claim_id", "split").dropDuplicates(["claim_id"])
    claims = spark.read.parquet(f"{sf_dir}/gold_claim.parquet").select("claim_id", "response_id", "gold_claim").dropDuplicates(["claim_id"])
    claims = claims.join(splits, "claim_id")
    side = F.when(F.col("split") == "heldout", True).when(F.col("split") == "dev", False)
    return claims, same_records(claims, "claim_id", "gold_claim", side, canonical=canonical, verify=same_statement, must_agree=must_agree)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id_a, claim_id_b): a dev and a heldout claim that make the same statement."""
    return _claim_pairs(spark, sf_dir)[1].select(F.col("a").alias("claim_id_a"), F.col("b").alias("claim_id_b"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and response: claims that also stand on the other side, and the pairs they are in."""
    claims, pairs = _claim_pairs(spark, sf_dir)
    each = pairs.select(F.explode(F.array("a", "b")).alias("claim_id")).groupBy("claim_id").agg(F.count("*").alias("pairs"))
    out = claims.join(each, "claim_id").groupBy("split", "response_id")
    return out.agg(F.count("*").alias("claims"), F.sum("pairs").alias("pairs"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p6_found": p6_found, "p6_counts": p6_counts}
#: Neither decoding with replacement nor slips have a SQL form; tests compare with brute force.
SQL: dict[str, str] = {}
