"""Ranking passages for queries: BM25, dense vectors, reciprocal rank fusion, and the evaluation of rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import tokens

#: Fixed values of the scoring formulas.
K1, B, FUSION = 1.2, 0.75, 60
#: Largest query side that is broadcast, in terms; beyond it the term join shuffles.
BROADCAST_TERMS = 200_000
#: Query vectors that are sent to the workers at a time.
QUERY_BLOCK = 4096


def bm25_statistics(passages: DataFrame, text: str) -> tuple[int, float]:
    """Number of passages and their mean length in tokens."""
    r = passages.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("mean")).first()
    return r["n"], r["mean"] or 0.0


def bm25(passages: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int = 10) -> DataFrame:
    """(query key, passage key, rank, score): the ``k`` best passages of each query, ties by passage key.

    Scores are rounded to six digits before ranking, so that the order does not hang on the order of
    sums. Queries are the bounded side: their terms are broadcast if they are few, else shuffled.
    """
    n, mean = bm25_statistics(passages, text)
    q = queries.select(F.col(query_key).alias("q"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qf"))
    words = tokens(F.coalesce(F.col(text), F.lit("")))
    p = passages.select(F.col(key).alias("p"), words.alias("words")).withColumn("length", F.size("words"))
    tf = p.select("p", "length", F.explode("words").alias("term"))
    terms = q.select("term").distinct()
    few = q.count() <= BROADCAST_TERMS
    tf = tf.join(F.broadcast(terms) if few else terms, "term", "left_semi").groupBy("p", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = q.join(df, "term").select("q", "term", (F.col("qf") * idf).alias("weight"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    scored = tf.join(F.broadcast(weighted) if few else weighted, "term").groupBy("q", "p").agg(F.round(F.sum(part), 6).alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "p")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("p").alias(key), "rank", "score")


def dense(passages: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 10) -> DataFrame:
    """(query key, passage key, rank, score): the ``k`` nearest passages of each query by cosine, ties by passage key.

    Each batch of passages is multiplied with a block of queries and only its ``k`` best per query go
    on, so the shuffle carries k rows per batch and query.
    """
    rows = passages.select(F.col(key).cast("bigint").alias("p"), F.col(vector).alias("v"))
    spark = passages.sparkSession
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == block).select(query_key, query_vector).collect()
        if not part:
            continue
        ids = np.array([r[0] for r in part], np.int64)
        unit = np.array([r[1] for r in part], np.float64)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        shipped = spark.sparkContext.broadcast((ids, unit))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            qs, matrix = shipped.value
            for batch in batches:
                p = batch.column(0).to_numpy()
                v = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(p), -1)
                if not len(p):
                    continue
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                score = np.round(matrix @ v.T, 6)
                order = np.lexsort((np.broadcast_to(p, score.shape), -score), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(qs, order.shape[1])),
                        pa.array(p[order].ravel()),
                        pa.array(np.take_along_axis(score, order, 1).ravel()),
                    ],
                    ["q", "p", "score"],
                )

        found = rows.mapInArrow(run, "q bigint, p bigint, score double")
        out = found if out is None else out.union(found)
    if out is None:
        out = rows.select(F.col("p").alias("q"), "p", F.lit(0.0).alias("score")).where("false")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "p")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("p").alias(key), "rank", "score")


def fuse(runs: list[DataFrame], query_key: str, key: str, k: int = 10, depth: int = 100) -> DataFrame:
    """Reciprocal rank fusion of rankings: a union and one aggregate, then the ``k`` best."""
    union = None
    for run in runs:
        part = run.where(F.col("rank") <= depth).select(query_key, key, "rank")
        union = part if union is None else union.unionByName(part)
    score = union.groupBy(query_key, key).agg(F.round(F.sum(1.0 / (FUSION + F.col("rank"))), 9).alias("score"))
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def evaluate(run: DataFrame, qrels: DataFrame, query_key: str, key: str, k: int = 10) -> DataFrame:
    """Per query with judgements: first relevant rank, reciprocal rank and nDCG at ``k``.

    ``qrels`` has the query key, the passage key and a relevance above 0.
    """
    gain = (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("rank") + 1)
    ideal = qrels.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("relevance"), key))).where(F.col("rank") <= k)
    ideal = ideal.groupBy(query_key).agg(F.sum(gain).alias("ideal"))
    hits = run.where(F.col("rank") <= k).join(qrels, [query_key, key])
    got = hits.groupBy(query_key).agg(F.min("rank").alias("first_rank"), F.sum(gain).alias("dcg"))
    out = ideal.join(got, query_key, "left")
    return out.select(
        query_key,
        "first_rank",
        F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"),
    )


def evaluate_labels(run: DataFrame, labels: DataFrame, query_key: str, key: str, label: str, k: int = 10) -> DataFrame:
    """As ``evaluate`` where all other rows of a query's label are relevant: the best ranking follows from how many there are.

    ``labels`` has a row per key; queries are the keys that ``run`` ranks for. No list of relevant pairs is built.
    """
    sizes = labels.groupBy(label).agg((F.count("*") - 1).alias("relevant"))
    queries = run.select(query_key).distinct().join(labels.withColumnRenamed(key, query_key), query_key).join(sizes, label)
    gain = 1 / F.log2(F.col("rank") + 1)
    top = run.where(F.col("rank") <= k).join(labels, key).withColumnRenamed(label, "_label")
    hits = top.join(queries, query_key).where(F.col("_label") == F.col(label)).groupBy(query_key).agg(F.min("rank").alias("first_rank"), F.sum(gain).alias("dcg"))
    steps = F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant")).cast("int"))
    ideal = F.aggregate(steps, F.lit(0.0), lambda total, i: total + 1 / F.log2(i + 1))
    out = queries.where("relevant > 0").join(hits, query_key, "left")
    return out.select(
        query_key,
        "first_rank",
        F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )
