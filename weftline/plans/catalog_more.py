"""Queries of alignment, relevance lists, nested records, long and wide forms, and table summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import bootstrap as B
from weftline.operators import quality as Q
from weftline.operators import retrieval as R
from weftline.operators import sampling as P
from weftline.plans.catalog_claims import E, PROBLEM, evidence
from weftline.plans.catalog_results import _VS, _F1K, _supported
from weftline.plans.catalog_retrieval import _DENSE, _EVAL, _dense_run, _labels
from weftline.plans.common import F_, G, R as RESULTS, TOKENS, claims, draws_sql, fetches, results, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NORM = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query("sentence_score", f"""with {G}, {E}, s as (select claim_id, unnest(string_split_regex(x.text, '[.!?] +')) as t, x.text as whole from e where x.text is not null),
n as (select claim_id, {NORM.format('t')} as t from s), k as (select claim_id, {NORM.format('gold_claim')} as c from g where gold_claim is not null)
select claim_id, count(*) as sentences, count_if(contains(c, t)) as contained from n join k using (claim_id) where len(string_split(t, ' ')) >= 4 group by 1""")
def _sentence_score(s, d):
    parts = evidence(s, d).where("x.text is not null").select("claim_id", F.explode(F.split("x.text", "[.!?] +")).alias("t"))
    n = parts.select("claim_id", T.comparable(F.col("t")).alias("t")).where("size(split(t, ' ')) >= 4")
    k = claims(s, d).where("gold_claim is not null").select("claim_id", T.comparable(F.col("gold_claim")).alias("c"))
    return n.join(k, "claim_id").groupBy("claim_id").agg(F.count("*").alias("sentences"), F.count_if(F.contains("c", "t")).alias("contained"))


_OVER = "len(list_intersect(a, b))"


@query("align_best", f"""with {G}, {E}, t as (select claim_id, x.url as url, list_distinct({TOKENS.format('gold_claim')}) as a, list_distinct({TOKENS.format('x.text')}) as b from e join g using (claim_id) where x.text is not null and x.url is not null and gold_claim is not null),
s as (select claim_id, url, max(round({_OVER} / len(a), 6)) as score from t where len(a) > 0 group by 1, 2), r as (select *, max(score) over (partition by claim_id) as top, row_number() over (partition by claim_id order by score desc, url) as place from s)
select claim_id, url, score, place::int as place, count_if(top - score <= 0.03) over (partition by claim_id) > 1 as ambiguous from r where place <= 3""")
def _align(s, d):
    e = evidence(s, d).where("x.text is not null and x.url is not null").select("claim_id", F.col("x.url").alias("url"), F.array_distinct(T.tokens(F.col("x.text"))).alias("b"))
    c = claims(s, d).where("gold_claim is not null").select("claim_id", F.array_distinct(T.tokens(F.col("gold_claim"))).alias("a")).where("size(a) > 0")
    score = F.round(F.size(F.array_intersect("a", "b")) / F.size("a"), 6)
    best = e.join(c, "claim_id").groupBy("claim_id", "url").agg(F.max(score).alias("score"))
    by = Window.partitionBy("claim_id")
    r = best.withColumn("top", F.max("score").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "url"))).where("place <= 3")
    return r.select("claim_id", "url", "score", "place", (F.count_if(F.col("top") - F.col("score") <= 0.03).over(by) > 1).alias("ambiguous"))


@query("mapping_status", f"""with {G}, {E}, {F_}, u as (select distinct requested_url as url, first_value(status_code) over (partition by requested_url order by fetch_id) as status from f)
select case when x.url is null then 'missing_url' when u.url is null then 'url_manifest_missing' when u.status not between 200 and 299 then 'url_fetch_failure' else 'document_available' end as status, count(*) as n from e left join u on x.url = u.url group by 1""")
def _mapping(s, d):
    u = fetches(s, d).groupBy(F.col("requested_url").alias("url")).agg(F.min_by("status_code", "fetch_id").alias("status"))
    rows = evidence(s, d).select(F.col("x.url").alias("wanted")).join(u, F.col("wanted") == F.col("url"), "left")
    name = F.when(F.col("wanted").isNull(), "missing_url").when(F.col("url").isNull(), "url_manifest_missing").when(~F.col("status").between(200, 299), "url_fetch_failure")
    return rows.groupBy(name.otherwise("document_available").alias("status")).agg(F.count("*").alias("n"))


@query("qrel_merge", f"""with {G}, {E} select claim_id, x.url as url, max(x.rank)::int as rank, list_sort(list(distinct x.source)) as sources, case when count(distinct x.stance) > 1 then 'mixed' else max(x.stance) end as stance from e where x.url is not null group by 1, 2""")
def _merge(s, d):
    rows = evidence(s, d).where("x.url is not null").groupBy("claim_id", F.col("x.url").alias("url"))
    stance = F.when(F.count_distinct("x.stance") > 1, "mixed").otherwise(F.max("x.stance"))
    return rows.agg(F.max("x.rank").alias("rank"), F.sort_array(F.collect_set("x.source")).alias("sources"), stance.alias("stance"))


@query("cohort_filter", f"with {G}, {E}, u as (select claim_id from e where ({PROBLEM}) is null group by 1) select claim_id from g where human_label in ('FACTUAL', 'NON_FACTUAL') and claim_id in (select claim_id from u)")
def _cohort(s, d):
    usable = evidence(s, d).where(T.evidence_problem(F.col("x.text")).isNull()).select("claim_id")
    return claims(s, d).where("human_label in ('FACTUAL', 'NON_FACTUAL')").join(usable, "claim_id", "left_semi").select("claim_id")


@query("claim_ids", f"with {G} select claim_id, response_id || printf('_revised_c%03d', (row_number() over (partition by response_id order by claim_id))::int) as new_id from g")
def _claim_ids(s, d):
    # Numbered by ranges of all claims, so that a response with a tenth of them is no single task.
    rows = P.numbered(claims(s, d).select("response_id", "claim_id"), "n", "response_id", "claim_id")
    first = rows.groupBy("response_id").agg(F.min("n").alias("begin"))
    place = (F.col("n") - F.col("begin") + 1).cast("int")
    return rows.join(first, "response_id").select("claim_id", F.concat("response_id", F.format_string("_revised_c%03d", place)).alias("new_id"))


@query("zip_join", f"with {G}, a as (select claim_id, row_number() over (order by claim_id) as i from g), b as (select claim_id, row_number() over (order by claim_id desc) as i from g) select a.claim_id as one, b.claim_id as other from a join b using (i)")
def _zip(s, d):
    ids = claims(s, d).select("claim_id")
    a = P.numbered(ids, "i", "claim_id").withColumnRenamed("claim_id", "one")
    b = P.numbered(ids, "i", F.desc("claim_id")).withColumnRenamed("claim_id", "other")
    return a.join(b, "i").select("one", "other")


@query("pair_flatten", f"with {G} select claim_id, unnest(case when len(gold_evidence) > 0 then gold_evidence else [null] end).url as url from g")
def _pairs(s, d):
    return claims(s, d).select("claim_id", F.explode_outer("gold_evidence").alias("x")).select("claim_id", F.col("x.url").alias("url"))


@query("unpivot_conditions", f"with {RESULTS}, w as (select claim_id, count(prediction) as said, count(rationale) as reasoned, count(error) as failed from r group by 1) select claim_id, what, n from w unpivot (n for what in (said, reasoned, failed))")
def _unpivot(s, d):
    w = results(s, d).groupBy("claim_id").agg(F.count("prediction").alias("said"), F.count("rationale").alias("reasoned"), F.count("error").alias("failed"))
    return w.unpivot("claim_id", ["said", "reasoned", "failed"], "what", "n")


@query("coverage_summary", f"with {G}, {RESULTS}, c as (select g.response_id, count(distinct g.claim_id) as claims, count(distinct r.claim_id) as judged from g left join r on g.claim_id = r.claim_id and r.status = 'ok' group by 1) select response_id, claims, judged, round(judged / claims, 6) as coverage from c")
def _coverage(s, d):
    ok = results(s, d).where("status = 'ok'").select("claim_id").distinct().withColumn("judged_id", F.col("claim_id"))
    rows = claims(s, d).join(ok, "claim_id", "left").groupBy("response_id").agg(F.count("*").alias("claims"), F.count("judged_id").alias("judged"))
    return rows.withColumn("coverage", F.round(F.col("judged") / F.col("claims"), 6))


@query("corpus_summary", "select kind, count(*) as n, count(nullif(text, '')) as with_text, count(distinct source) as sources, sum(length(text))::bigint as chars from documents group by kind")
def _summary(s, d):
    text = F.when(F.col("text") != "", F.col("text"))
    rows = table(s, d, "documents").groupBy("kind")
    return rows.agg(F.count("*").alias("n"), F.count(text).alias("with_text"), F.count_distinct("source").alias("sources"), F.sum(F.length("text")).alias("chars"))


@query("artifact_state", f"with {RESULTS} select run_fingerprint, count(*) as n, count_if(status = 'ok') as ok, bool_and(status = 'ok') as complete from r group by 1")
def _artifact(s, d):
    rows = results(s, d).groupBy("run_fingerprint")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.bool_and(F.col("status") == "ok").alias("complete"))


@query("stage_effects", f"with {RESULTS}, m as (select setting, round(avg(case when status = 'ok' then 1.0 else 0.0 end), 6) as ok_rate from r group by 1) select a.setting as one, b.setting as other, round(b.ok_rate - a.ok_rate, 6) as difference from m a join m b on a.setting < b.setting")
def _effects(s, d):
    m = results(s, d).groupBy("setting").agg(F.round(F.avg(F.when(F.col("status") == "ok", 1.0).otherwise(0.0)), 6).alias("ok_rate"))
    a, b = m.select(F.col("setting").alias("one"), F.col("ok_rate").alias("x")), m.select(F.col("setting").alias("other"), F.col("ok_rate").alias("y"))
    return a.join(F.broadcast(b), F.col("one") < F.col("other")).select("one", "other", F.round(F.col("y") - F.col("x"), 6).alias("difference"))


@query("retrieval_ci", f"{_DENSE}, {_EVAL.format(run='ra', x='')}, cl as (select label, count(*) as n, sum(case when first_rank <= 5 then 1 else 0 end) as hits from ev join (select vec_id as query_id, label from e) using (query_id) group by 1), {draws_sql('label', 42, 5_000)}, rp as (select replicate, sum(times * hits) / sum(times * n) as v from wt join cl using (label) group by 1) select count(v) as replicates, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from rp where v is not null")
def _retrieval_ci(s, d):
    ev = R.evaluate_labels(_dense_run(s, d), _labels(s, d), "query_id", "vec_id", "label")
    labels = table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    cl = ev.join(labels, "query_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("first_rank") <= 5).alias("hits"))
    return B.resampled(cl, "label", [], F.try_divide(F.col("hits"), F.col("n")), ["hits", "n"], "v", 5_000, 42)


@query("veriscore_bootstrap", f"{_VS}, k as (select response_id, setting, claims, supported, 9 as k from v), sc as (select response_id, setting, {_F1K} as f1 from k), cl as (select response_id as label, sum(case when setting = 'oracle_evidence' then f1 else 0 end) as a, count_if(setting = 'oracle_evidence') as n from sc group by 1), {draws_sql('label', 7, 10_000)}, rp as (select replicate, sum(times * a) / nullif(sum(times * n), 0) as v from wt join cl using (label) group by 1) select count(v) as replicates, round(quantile_cont(v, 0.025), 5) as low, round(quantile_cont(v, 0.975), 5) as high from rp where v is not null")
def _veriscore_bootstrap(s, d):
    sc = P.f1_at_k(_supported(s, d).withColumn("k", F.lit(9)), "claims", "supported", "k")
    mine = F.col("setting") == "oracle_evidence"
    cl = sc.groupBy(F.col("response_id").alias("label")).agg(F.sum(F.when(mine, F.col("f1")).otherwise(0.0)).alias("a"), F.count_if(mine).alias("n"))
    ci = B.resampled(cl, "label", [], F.try_divide(F.col("a"), F.col("n")), ["a", "n"], "v", 10_000, 7, 5)
    return ci.select("replicates", "low", "high")


@query("props_json", "select event_type, count(*) as n, count_if(json_valid(props)) as valid from events group by event_type")
def _props(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("props").isNotNull()).alias("valid"))


@query("union_runs", f"with {RESULTS} select setting as run, count(*) as n from r where setting like 'retrieved%' group by 1 union all select 'all', count(*) from r")
def _union(s, d):
    r = results(s, d)
    one = r.where("setting like 'retrieved%'").groupBy(F.col("setting").alias("run")).agg(F.count("*").alias("n"))
    return Q.union_all(one, r.agg(F.count("*").alias("n")).withColumn("run", F.lit("all")))
