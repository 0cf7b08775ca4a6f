"""Queries over documents: encoding (p8), leaked passages (p9), shared spans (p10)."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.encoding import encode_texts
from weftline.llm.leak import passages
from weftline.llm.spans import Shared, found_pairs, link_counts, removed_spans, shared_share, shared_spans

#: Folder of the public vocabularies; a parameter, they are not part of the repository.
TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
#: Production parameters of p9 and p10.
P9_WORDS, P10_LEAST = 13, 400


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p8_ids(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    ranks = Path(tokenizers, "byte_bpe_50k.tiktoken").read_bytes()
    return encode_texts(_documents(spark, sf_dir), "doc_id", "text", ranks)


def _leaks(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/heldout_item.parquet")
    return passages(_documents(spark, sf_dir), "doc_id", "text", items, "item_id", "text", words=P9_WORDS, **how)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents with 13 consecutive words of an item."""
    return _leaks(spark, sf_dir, exact=True).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents with the passage word by word, and documents with up to one edit in it."""
    near = F.count_if(F.col("run") < P9_WORDS).alias("near_documents")
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count_if(F.col("run") >= P9_WORDS).alias("documents"), near)


def _shared(spark: SparkSession, sf_dir: str) -> Shared:
    return shared_spans(_documents(spark, sf_dir), "doc_id", "text", least=P10_LEAST)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id_a, doc_id_b): documents with a run of 400 characters in common."""
    return found_pairs(_shared(spark, sf_dir), "doc_id").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, links): each sharing document, the document that stands for its text, and the links of that text."""
    return link_counts(_shared(spark, sf_dir), "doc_id")


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): how much of each document stands elsewhere."""
    return shared_share(_documents(spark, sf_dir), "doc_id", "text", _shared(spark, sf_dir).spans)


def p10_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, end): stretches to remove so that only the earliest occurrence stays."""
    return removed_spans(_shared(spark, sf_dir).spans, "doc_id")


QUERIES = {
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_links": p10_links,
    "p10_share": p10_share,
    "p10_removed": p10_removed,
}
#: None has a SQL form that ends in useful time on whole tables; tests compare with brute force.
SQL: dict[str, str] = {}
