"""Fused rankings to depth 100, against DuckDB and a plain sum of reciprocal ranks."""

import math
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans.catalog_retrieval import _DENSE

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
DEPTH = 100


@pytest.fixture(scope="module")
def plain():
    """Fused ranking of each query, ids best first; the first relevant rank and nDCG of each, and the labels."""
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet{'/*.parquet' if (DATA / 'embeddings.parquet').is_dir() else ''}'")
    score = defaultdict(float)
    for run in ("ra", "rb"):
        for q, v, rank in con.execute(f"{_DENSE} select query_id, vec_id, rank from {run} where rank <= {DEPTH}").fetchall():
            score[q, v] += 1 / (60 + rank)
    order = defaultdict(list)
    for (q, v), x in sorted(score.items(), key=lambda p: (p[0][0], -round(p[1], 9), p[0][1])):
        order[q].append(v)
    label = dict(con.execute("select vec_id, label from embeddings").fetchall())
    return order, label


def rows(spark, name):
    return entry.queries()[name](spark, str(DATA)).collect()


def test_top(spark, plain):
    order, _ = plain
    got = defaultdict(dict)
    for r in rows(spark, "rrf_topk"):
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    assert {q: [v for _, v in sorted(x.items())] for q, x in got.items()} == {q: x[:10] for q, x in order.items()}


def test_evaluation(spark, plain):
    order, label = plain
    ndcg, first = {}, {}
    for q, x in order.items():
        relevant = sum(v != q and label[v] == label[q] for v in label)
        hits = [k for k, v in enumerate(x[:10], 1) if label[v] == label[q]]
        ndcg[q] = sum(1 / math.log2(k + 1) for k in hits) / sum(1 / math.log2(k + 1) for k in range(1, min(10, relevant) + 1))
        first[q] = hits[0] if hits else None
    got = {r["query_id"]: r["ndcg"] for r in rows(spark, "ndcg")}
    assert set(got) == set(ndcg) and all(abs(got[q] - ndcg[q]) < 2e-6 for q in got)
    fused = next(r for r in rows(spark, "retriever_compare") if r["retriever"] == "fused")
    assert fused["queries"] == len(first)
    assert abs(fused["mrr"] - sum(round(1 / f, 6) if f else 0 for f in first.values()) / len(first)) < 2e-6
    assert abs(fused["recall_5"] - sum(f is not None and f <= 5 for f in first.values()) / len(first)) < 2e-6
