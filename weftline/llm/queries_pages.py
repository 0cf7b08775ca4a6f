"""Queries over fetched bodies: garbled text (p3), main content (p4), residue (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.http import charset, media_type
from weftline.llm.blocks import main_blocks, train
from weftline.llm.garble import garbled
from weftline.llm.residue import Index, build_index, frequencies, harvest, is_residue, read_pages, read_texts


def _fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/fetch_result.parquet")


def _text_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fetches(spark, sf_dir)
    return rows.where(media_type(rows.headers).startswith("text/"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id): text bodies that show garbled or lost characters."""
    rows = _text_bodies(spark, sf_dir)
    return garbled(rows, "fetch_id", "body", charset(rows.headers), with_text=False).select("fetch_id").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id, lost, restored): garbled bodies with their original text as far as it can be recovered."""
    rows = _text_bodies(spark, sf_dir)
    return garbled(rows, "fetch_id", "body", charset(rows.headers)).dropDuplicates(["fetch_id"])


def _is_page(rows: DataFrame):
    return media_type(rows.headers) == "text/html"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fetches(spark, sf_dir)
    return rows.where(_is_page(rows))


def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fetches(spark, sf_dir)
    media = media_type(rows.headers)
    return rows.where(media.startswith("text/") | (media == "application/json"))


def _read(spark: SparkSession, sf_dir: str, keys: bool = True) -> tuple[DataFrame, Index]:
    """Every page read, and the index: p4 and p7 share labeller, weights and so what is residue."""
    readable, pages = _readable(spark, sf_dir), _pages(spark, sf_dir)
    seen = harvest(pages, "fetch_id", "body", charset(pages.headers), pages.status_code)
    index = build_index(*frequencies(readable, "body", charset(readable.headers), seen), seen)
    model = train(pages, "body", charset(pages.headers), "fetch_id")
    return read_pages(pages, "fetch_id", "body", charset(pages.headers), model, index, keys), index


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id, block_key): main blocks of the pages that are no residue."""
    read = _read(spark, sf_dir)[0].where(~is_residue())
    return read.dropDuplicates(["fetch_id"]).select("fetch_id", F.explode("block_keys").alias("block_key"))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id, place, block_key, block): main blocks of every page with their text, in order."""
    rows = _pages(spark, sf_dir)
    return main_blocks(rows, "fetch_id", "body", charset(rows.headers)).dropDuplicates(["fetch_id", "place"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id): bodies whose content is residue."""
    read, index = _read(spark, sf_dir, keys=False)
    readable = _readable(spark, sf_dir)
    texts = readable.where(~_is_page(readable))
    other = read_texts(texts, "fetch_id", "body", charset(texts.headers), index).where(is_residue()).select("fetch_id")
    return read.where(is_residue()).select("fetch_id").union(other).distinct()


QUERIES = {
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_text": p4_text,
    "p7_found": p7_found,
}
#: None has a SQL form; tests compare with texts garbled, pages composed and residue planted on purpose.
SQL: dict[str, str] = {}
