"""Queries of ranking and its evaluation, over held-out items, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import quality as Q
from weftline.operators import retrieval as R
from weftline.plans.common import TOKENS, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Ranks of each run that fusion takes.
DEPTH = 100


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_P = f"p as (select doc_id, {TOKENS.format('coalesce(text, chr(32))')} as w from documents)"
_BM25 = f"""with {_P}, n as (select count(*) as n, avg(len(w)) as mean from p), t as (select doc_id, len(w) as l, unnest(w) as term from p), tf as (select doc_id, l, term, count(*) as tf from t group by all),
df as (select term, count(*) as df from tf group by 1), q as (select item_id, term, count(*) as qf from (select item_id, unnest({TOKENS.format('text')}) as term from heldout_item) group by all),
sc as (select q.item_id, tf.doc_id, round(sum(qf * ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / n.mean))), 6) as score from q join df using (term) join tf using (term) cross join n group by 1, 2),
rk as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from sc)"""


def _items_run(s, d, k=10):
    return R.bm25(table(s, d, "documents"), "doc_id", "text", table(s, d, "heldout_item"), "item_id", "text", k)


@query("bm25_stats", f"with {_P} select (select count(*) from p) as n, (select round(avg(len(w)), 6) from p) as mean_length, count(distinct term) as terms from (select unnest(w) as term from p)")
def _stats(s, d):
    docs = table(s, d, "documents")
    n, mean = R.bm25_statistics(docs, "text")
    terms = docs.select(F.explode(T.tokens(F.col("text"))).alias("term")).agg(F.count_distinct("term").alias("terms"))
    return terms.select(F.lit(n).cast("bigint").alias("n"), F.round(F.lit(mean), 6).alias("mean_length"), "terms")


@query("bm25_topk", f"{_BM25} select item_id, doc_id, rank from rk where rank <= 10")
def _bm25(s, d):
    return _items_run(s, d).select("item_id", "doc_id", "rank")


@query("evidence_topk", f"{_BM25} select item_id, doc_id, rank, length(coalesce(text, '')) as chars from rk join documents using (doc_id) where rank <= 3")
def _evidence(s, d):
    docs = table(s, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"))
    return _items_run(s, d, 3).join(docs, "doc_id").select("item_id", "doc_id", "rank", "chars")


_E = "e as (select vec_id, label, embedding::double[] as v from embeddings), h as (select vec_id, label, embedding[1:32]::double[] as v from embeddings)"
_RUN = """{n} as (select q.vec_id as query_id, b.vec_id, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.v, b.v), 6) desc, b.vec_id)::int as rank
 from {t} q join {t} b on q.vec_id % 20 = 0 and q.vec_id <> b.vec_id)"""
_DENSE = f"with {_E}, {_RUN.format(n='ra', t='e')}, {_RUN.format(n='rb', t='h')}"


def _dense_run(s, d, half: bool = False, k: int = 10):
    """Nearest vectors of every twentieth vector among all others, by all or by the first half of the dimensions."""
    v = F.slice("embedding", 1, 32) if half else F.col("embedding")
    rows = table(s, d, "embeddings").select("vec_id", v.alias("v"))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")
    run = R.dense(rows, "vec_id", "v", queries, "query_id", "v", k + 1).where("query_id <> vec_id")
    from pyspark.sql import Window

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return run.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


@query("dense_topk", f"{_DENSE} select * from ra where rank <= 10")
def _dense(s, d):
    return _dense_run(s, d).select("query_id", "vec_id", "rank")


_RRF = "u as (select query_id, vec_id, rank from ra where rank <= 100 union all select query_id, vec_id, rank from rb where rank <= 100), f as (select query_id, vec_id, round(sum(1.0 / (60 + rank)), 9) as score from u group by 1, 2), rr as (select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from f)"


def _fused(s, d, k: int = 10):
    """The ``k`` best of both dense runs, fused to the surveyed depth."""
    return R.fuse([_dense_run(s, d, k=DEPTH), _dense_run(s, d, True, DEPTH)], "query_id", "vec_id", k, DEPTH)


@query("rrf_topk", f"{_DENSE}, {_RRF} select * from rr where rank <= 10")
def _rrf(s, d):
    return _fused(s, d).select("query_id", "vec_id", "rank")


def _labels(s, d):
    return table(s, d, "embeddings").select("vec_id", "label")


_EVAL = """qr{x} as (select q.vec_id as query_id, b.vec_id from e q join e b on q.label = b.label and q.vec_id % 20 = 0 and q.vec_id <> b.vec_id),
id{x} as (select query_id, sum(1 / log2(rn + 1)) as ideal from (select query_id, row_number() over (partition by query_id order by vec_id) as rn from qr{x}) where rn <= 10 group by 1),
ht{x} as (select query_id, min(rank) as first_rank, sum(1 / log2(rank + 1)) as dcg from {run} join qr{x} using (query_id, vec_id) where rank <= 10 group by 1),
ev{x} as (select query_id, first_rank, round(coalesce(1.0 / first_rank, 0), 6) as reciprocal_rank, round(coalesce(dcg, 0) / ideal, 6) as ndcg from id{x} left join ht{x} using (query_id))"""


@query("retrieval_eval", f"{_DENSE}, {_EVAL.format(run='ra', x='')} select * from ev")
def _eval(s, d):
    return R.evaluate_labels(_dense_run(s, d), _labels(s, d), "query_id", "vec_id", "label")


@query("ndcg", f"{_DENSE}, {_RRF}, {_EVAL.format(run='rr', x='')} select query_id, ndcg from ev")
def _ndcg(s, d):
    return R.evaluate_labels(_fused(s, d), _labels(s, d), "query_id", "vec_id", "label").select("query_id", "ndcg")


_MEANS = "count(*) as queries, round(avg(reciprocal_rank), 6) as mrr, round(avg(case when first_rank <= 5 then 1.0 else 0.0 end), 6) as recall_5"


@query("retriever_compare", f"{_DENSE}, {_RRF}, {_EVAL.format(run='ra', x='')}, {_EVAL.format(run='rr', x='2')} select 'dense' as retriever, {_MEANS} from ev union all select 'fused', {_MEANS} from ev2")
def _compare(s, d):
    labels = _labels(s, d)
    runs = {"dense": _dense_run(s, d), "fused": _fused(s, d)}
    out = [R.evaluate_labels(run, labels, "query_id", "vec_id", "label").withColumn("retriever", F.lit(n)) for n, run in runs.items()]
    rows = Q.union_all(*out).groupBy("retriever")
    hit = F.when(F.col("first_rank") <= 5, 1.0).otherwise(0.0)
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg(hit), 6).alias("recall_5"))


@query("rank_contiguous", f"{_DENSE} select query_id, count(*) as n, min(rank) as low, max(rank) as high, count(distinct rank) as different from (select * from ra where rank <= 10) group by 1 having min(rank) <> 1 or max(rank) <> count(*)")
def _ranks(s, d):
    return Q.broken_ranks(_dense_run(s, d), "query_id")



_WIDE = 64
_ITEMS = f"""{_BM25}, hd as (select k, b, sum(n)::double as w from (select 'd' || doc_id as k, ('0x' || substr(md5(term), 1, 4))::int % {_WIDE} as b, count(*) as n from (select doc_id, unnest(w) as term from p) group by 1, 2 union all
 select 'q' || item_id, ('0x' || substr(md5(term), 1, 4))::int % {_WIDE}, sum(qf) from q group by 1, 2) group by 1, 2), hn as (select k, sqrt(sum(w * w)) as norm from hd group by 1),
hs as (select x.k as qk, y.k as dk, round(sum(x.w / nx.norm * (y.w / ny.norm)), 6) as score from hd x join hn nx on nx.k = x.k join hd y on y.b = x.b join hn ny on ny.k = y.k where x.k like 'q%' and y.k like 'd%' group by 1, 2),
rd as (select substr(qk, 2)::bigint as item_id, substr(dk, 2)::bigint as doc_id, row_number() over (partition by qk order by score desc, substr(dk, 2)::bigint)::int as rank from hs),
hu as (select item_id, doc_id, rank from rk where rank <= 100 union all select item_id, doc_id, rank from rd where rank <= 100), hf as (select item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) as score from hu group by 1, 2),
hr as (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from hf)"""


def hashed_vectors(rows, key: str, text: str):
    """(key, vector): words counted in ``_WIDE`` places by their digest, a stand-in for an embedding model; texts without words have none."""
    words = rows.select(F.col(key).alias("k"), F.explode(T.tokens(F.col(text))).alias("term"))
    place = (F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("int") % _WIDE).alias("place")
    counts = words.groupBy("k", place).agg(F.count("*").alias("n"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(_WIDE - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double"))
    maps = counts.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("m"))
    return maps.select(F.col("k").alias(key), vector.alias("v"))


def _hybrid_run(s, d, k=10):
    """Items against documents: BM25 and dense runs to the surveyed depth, fused."""
    docs, items = table(s, d, "documents"), table(s, d, "heldout_item")
    lexical = _items_run(s, d, DEPTH).select("item_id", "doc_id", "rank")
    near = R.dense(hashed_vectors(docs, "doc_id", "text"), "doc_id", "v", hashed_vectors(items, "item_id", "text"), "item_id", "v", DEPTH)
    return R.fuse([lexical, near.select("item_id", "doc_id", "rank")], "item_id", "doc_id", k, DEPTH)


@query("hybrid_topk", f"{_ITEMS} select item_id, doc_id, rank from hr where rank <= 10")
def _hybrid(s, d):
    return _hybrid_run(s, d).select("item_id", "doc_id", "rank")
