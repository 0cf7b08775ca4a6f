"""Queries of verdicts: metrics with abstention, transitions, bootstrap intervals, K-grids, model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import bootstrap as B
from weftline.operators import metrics as M
from weftline.operators import sampling as P
from weftline.operators import verdicts as V
from weftline.plans.common import COUNTS, F1, G, R, STATE, claims, draws_sql, results, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SEED, REPLICATES = 20260722, 10_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def states(s, d):
    g = claims(s, d).where("human_label in ('FACTUAL', 'NON_FACTUAL')").select("claim_id", F.col("human_label").alias("label"))
    r = results(s, d).select("claim_id", "response_id", "setting", "status", F.upper("prediction").alias("prediction"), "confidence", "latency_seconds")
    rows = r.join(g, "claim_id")
    return rows.withColumn("state", M.state(F.col("label"), F.col("prediction"), F.col("status")))


BASE = f"with {R}, {G}, {STATE}"
BY = COUNTS.format(by="setting")
RATES = f"""round(correct / nullif(total, 0), 6) as accuracy, round(answered / nullif(total, 0), 6) as coverage, round(correct / nullif(answered, 0), 6) as selective_accuracy, round(abstained / nullif(total, 0), 6) as abstention,
 round((tp_f / nullif(tp_f + fn_f, 0) + tp_n / nullif(tp_n + fn_n, 0)) / 2, 6) as balanced_accuracy, round(({F1.format(c='f')} + {F1.format(c='n')}) / 2, 6) as macro_f1"""


@query("cluster_counts", f"{BASE}, {COUNTS.format(by='setting, response_id')} select * from cn")
def _clusters(s, d):
    return M.counts(states(s, d), "setting", "response_id")


@query("binary_metrics", f"{BASE}, {BY} select setting, total, {RATES} from cn")
def _binary(s, d):
    return M.rates(M.counts(states(s, d), "setting"), "setting")


@query("class_f1", f"{BASE}, {BY} select setting, 'FACTUAL' as class, round({F1.format(c='f')}, 6) as f1 from cn union all select setting, 'NON_FACTUAL', round({F1.format(c='n')}, 6) from cn")
def _f1(s, d):
    c = M.counts(states(s, d), "setting")
    one = lambda k, n: c.select("setting", F.lit(n).alias("class"), F.round(M.f1(F.col(f"tp_{k}"), F.col(f"fp_{k}"), F.col(f"fn_{k}")), 6).alias("f1"))
    return one("f", "FACTUAL").union(one("n", "NON_FACTUAL"))


@query("confusion", f"{BASE} select label, count_if(state <> 'failed' and pred = 'FACTUAL') as factual, count_if(state <> 'failed' and pred = 'NON_FACTUAL') as non_factual, count_if(state = 'abstained') as unknown, count_if(state = 'failed') as failed from st group by label")
def _confusion(s, d):
    said = F.when(F.col("state") == "failed", "failed").otherwise(F.lower("prediction"))
    return states(s, d).withColumn("said", said).groupBy("label").pivot("said", ["factual", "non_factual", "unknown", "failed"]).count().na.fill(0)


@query("response_macro", f"{BASE}, {COUNTS.format(by='setting, response_id')} select setting, count(*) as responses, round(avg(correct / total), 6) as accuracy from cn group by setting")
def _macro(s, d):
    c = M.counts(states(s, d), "setting", "response_id")
    return c.groupBy("setting").agg(F.count("*").alias("responses"), F.round(F.avg(F.col("correct") / F.col("total")), 6).alias("accuracy"))


_STATES = "(values ('correct'), ('incorrect'), ('abstained'), ('failed'))"


@query("paired_transitions", f"{BASE}, p as (select a.state as before, b.state as after, count(*) as n from st a join st b on a.claim_id = b.claim_id and a.setting = 'no_evidence' and b.setting = 'oracle_evidence' group by 1, 2) select x.v as before, y.v as after, coalesce(n, 0) as n from {_STATES} x(v) cross join {_STATES} y(v) left join p on p.before = x.v and p.after = y.v")
def _transitions(s, d):
    return M.transitions(states(s, d), "claim_id", "no_evidence", "oracle_evidence")


@query("metric_diff", f"{BASE}, {BY}, m as (select setting, {RATES} from cn) select b.setting, round(b.accuracy - a.accuracy, 6) as accuracy, round(b.coverage - a.coverage, 6) as coverage, round(b.macro_f1 - a.macro_f1, 6) as macro_f1 from m a join m b on a.setting = 'no_evidence' and b.setting <> 'no_evidence'")
def _diff(s, d):
    m = M.rates(M.counts(states(s, d), "setting"), "setting")
    base = m.where("setting = 'no_evidence'").first()  # one row
    if base is None:
        return m.where("false").select("setting", "accuracy", "coverage", "macro_f1")
    cells = [F.round(F.col(c) - F.lit(base[c]), 6).alias(c) for c in ("accuracy", "coverage", "macro_f1")]
    return m.where("setting <> 'no_evidence'").select("setting", *cells)


@query("benefit_recovery", f"{BASE}, {BY}, m as (select setting, correct / total as a from cn) select r.setting, round((r.a - n.a) / nullif(o.a - n.a, 0), 6) as recovered from m r, m n, m o where r.setting like 'retrieved%' and n.setting = 'no_evidence' and o.setting = 'oracle_evidence'")
def _recovery(s, d):
    m = M.counts(states(s, d), "setting").select("setting", (F.col("correct") / F.col("total")).alias("a"))
    ends = {r["setting"]: r["a"] for r in m.where("setting in ('no_evidence', 'oracle_evidence')").collect()}  # two rows
    none, oracle = F.lit(ends.get("no_evidence")).cast("double"), F.lit(ends.get("oracle_evidence")).cast("double")
    return m.where("setting like 'retrieved%'").select("setting", F.round(F.try_divide(F.col("a") - none, oracle - none), 6).alias("recovered"))


@query("depth_contrasts", f"{BASE}, {COUNTS.format(by='setting')} select a.setting as deeper, b.setting as shallower, a.correct - b.correct as more_correct from cn a join cn b on a.setting > b.setting and a.setting like 'retrieved%' and b.setting like 'retrieved%'")
def _depth(s, d):
    c = M.counts(states(s, d), "setting").where("setting like 'retrieved%'").select("setting", "correct")
    a, b = c.select(F.col("setting").alias("deeper"), F.col("correct").alias("x")), c.select(F.col("setting").alias("shallower"), F.col("correct").alias("y"))
    return a.join(F.broadcast(b), F.col("deeper") > F.col("shallower")).select("deeper", "shallower", (F.col("x") - F.col("y")).alias("more_correct"))


@query("hit_strata", f"with {R}, {G}, {STATE}, h as (select claim_id, coalesce(len(gold_evidence), 0) > 0 as has_evidence from g) select setting, has_evidence, count(*) as n, count_if(state = 'correct') as correct from st join h using (claim_id) group by 1, 2")
def _strata(s, d):
    h = claims(s, d).select("claim_id", (F.coalesce(F.size("gold_evidence"), F.lit(0)) > 0).alias("has_evidence"))
    rows = states(s, d).join(h, "claim_id").groupBy("setting", "has_evidence")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("state") == "correct").alias("correct"))


@query("agreement", f"with {R}, p as (select claim_id, setting, upper(prediction) as p from r where status = 'ok') select a.p as one, b.p as other, count(*) as n from p a join p b on a.claim_id = b.claim_id and a.setting = 'retrieved_k1' and b.setting = 'retrieved_k5' group by 1, 2")
def _agreement(s, d):
    p = results(s, d).where("status = 'ok'").select("claim_id", "setting", F.upper("prediction").alias("p"))
    a, b = p.where("setting = 'retrieved_k1'").select("claim_id", F.col("p").alias("one")), p.where("setting = 'retrieved_k5'").select("claim_id", F.col("p").alias("other"))
    return a.join(b, "claim_id").groupBy("one", "other").agg(F.count("*").alias("n"))


@query("status_matrix", f"with {R}, w as (select claim_id, max(case when setting = 'no_evidence' then status end) as a, max(case when setting = 'oracle_evidence' then status end) as b from r group by 1) select a as no_evidence, b as oracle_evidence, count(*) as n from w group by 1, 2")
def _matrix(s, d):
    w = results(s, d).groupBy("claim_id").pivot("setting", ["no_evidence", "oracle_evidence"]).agg(F.max("status"))
    return w.groupBy("no_evidence", "oracle_evidence").agg(F.count("*").alias("n"))


@query("branch_pivot", f"{BASE} select claim_id, max(case when setting = 'no_evidence' then state end) as no_evidence, max(case when setting = 'retrieved_k1' then state end) as retrieved_k1, max(case when setting = 'retrieved_k3' then state end) as retrieved_k3, max(case when setting = 'retrieved_k5' then state end) as retrieved_k5, max(case when setting = 'oracle_evidence' then state end) as oracle_evidence from st group by 1")
def _pivot(s, d):
    return states(s, d).groupBy("claim_id").pivot("setting", ["no_evidence", "retrieved_k1", "retrieved_k3", "retrieved_k5", "oracle_evidence"]).agg(F.max("state"))


@query("paired_contrast", f"{BASE} select b.setting, count_if(a.state <> 'correct' and b.state = 'correct') as gains, count_if(a.state = 'correct' and b.state <> 'correct') as losses from st a join st b on a.claim_id = b.claim_id and a.setting = 'no_evidence' and b.setting <> 'no_evidence' group by 1")
def _contrast(s, d):
    st = states(s, d)
    a = st.where("setting = 'no_evidence'").select("claim_id", F.col("state").alias("before"))
    b = st.where("setting <> 'no_evidence'").select("claim_id", "setting", F.col("state").alias("after"))
    rows = a.join(b, "claim_id").groupBy("setting")
    return rows.agg(F.count_if((F.col("before") != "correct") & (F.col("after") == "correct")).alias("gains"), F.count_if((F.col("before") == "correct") & (F.col("after") != "correct")).alias("losses"))


@query("call_status", f"with {R} select model, status, count(*) as n, sum(attempt_count)::bigint as attempts from r group by 1, 2")
def _calls(s, d):
    return results(s, d).groupBy("model", "status").agg(F.count("*").alias("n"), F.sum("attempt_count").alias("attempts"))


@query("status_by_response", f"with {R} select response_id, count_if(status = 'ok') as ok, count_if(status = 'parse_error') as parse_error, count_if(status = 'request_error') as request_error from r group by 1")
def _by_response(s, d):
    return results(s, d).groupBy("response_id").pivot("status", ["ok", "parse_error", "request_error"]).count().na.fill(0)


@query("latency_stats", f"with {R} select setting, count(latency_seconds) as n, round(min(latency_seconds), 4) as low, round(max(latency_seconds), 4) as high, round(median(latency_seconds), 4) as mid, round(quantile_disc(latency_seconds, 0.95), 4) as p95 from r group by 1")
def _latency(s, d):
    x = F.col("latency_seconds")
    r4 = lambda c, n: F.round(c, 4).alias(n)
    p95 = F.expr("percentile_disc(0.95) within group (order by latency_seconds)")
    return results(s, d).groupBy("setting").agg(F.count(x).alias("n"), r4(F.min(x), "low"), r4(F.max(x), "high"), r4(F.median(x), "mid"), r4(p95, "p95"))


@query("percentile_linear", f"with {R} select model, round(quantile_cont(confidence, 0.025), 6) as low, round(quantile_cont(confidence, 0.975), 6) as high from r where confidence is not null and not isnan(confidence) group by 1")
def _percentile(s, d):
    rows = results(s, d).where("confidence is not null and not isnan(confidence)").groupBy("model")
    return rows.agg(F.round(F.percentile("confidence", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("confidence", F.lit(0.975)), 6).alias("high"))


_DRAWS = f"cl as (select * from cn), {draws_sql('response_id', SEED, REPLICATES)}"


@query("bootstrap_ci", f"{BASE}, {COUNTS.format(by='setting, response_id')}, {_DRAWS}, rp as (select replicate, setting, sum(times * correct) / nullif(sum(times * total), 0) as v from wt join cn using (response_id) group by 1, 2) select setting, count(v) as replicates, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from rp where v is not null group by 1")
def _bootstrap(s, d):
    c = M.counts(states(s, d), "setting", "response_id")
    return B.resampled(c, "response_id", ["setting"], M.ratio(F.col("correct"), F.col("total")), ["correct", "total"], "v", REPLICATES, SEED)


@query("branch_bootstrap", f"{BASE}, {COUNTS.format(by='setting, response_id')}, {_DRAWS}, rp as (select replicate, sum(case when setting = 'oracle_evidence' then times * correct end) / nullif(sum(case when setting = 'oracle_evidence' then times * total end), 0) - sum(case when setting = 'no_evidence' then times * correct end) / nullif(sum(case when setting = 'no_evidence' then times * total end), 0) as v from wt join cn using (response_id) group by 1) select count(v) as replicates, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from rp where v is not null")
def _branch(s, d):
    c = M.counts(states(s, d), "setting", "response_id")
    wide = c.groupBy("response_id").pivot("setting", ["no_evidence", "oracle_evidence"]).agg(F.sum("correct").alias("c"), F.sum("total").alias("t")).na.fill(0)
    value = M.ratio(F.col("oracle_evidence_c"), F.col("oracle_evidence_t")) - M.ratio(F.col("no_evidence_c"), F.col("no_evidence_t"))
    return B.resampled(wide, "response_id", [], value, ["oracle_evidence_c", "oracle_evidence_t", "no_evidence_c", "no_evidence_t"], "v", REPLICATES, SEED)


_VS = f"with {R}, v as (select response_id, setting, count(*) as claims, count_if(status = 'ok' and upper(prediction) = 'FACTUAL') as supported from r group by 1, 2)"


def _supported(s, d):
    rows = results(s, d).groupBy("response_id", "setting")
    return rows.agg(F.count("*").alias("claims"), F.count_if((F.col("status") == "ok") & (F.upper("prediction") == "FACTUAL")).alias("supported"))


@query("shared_k", f"{_VS} select min(claims) as k from (select claims, sum(n) over (order by claims) as upto, sum(n) over () as whole from (select claims, count(*) as n from v group by 1)) where upto > whole // 2")
def _shared_k(s, d):
    return P.upper_median(_supported(s, d), "claims")


_F1K = "case when least(supported / k, 1.0) = 0 then 0.0 else 2 * (supported / claims) * least(supported / k, 1.0) / ((supported / claims) + least(supported / k, 1.0)) end"


@query("veriscore_f1", f"{_VS}, k as (select response_id, setting, claims, supported, 9 as k from v) select response_id, setting, round({_F1K}, 9) as f1 from k")
def _veriscore(s, d):
    rows = P.f1_at_k(_supported(s, d).withColumn("k", F.lit(9)), "claims", "supported", "k")
    return rows.select("response_id", "setting", F.round("f1", 9).alias("f1"))


@query("k_sensitivity", f"{_VS}, k as (select *, unnest(range(1, 21)) as k from v) select setting, k::int as k, round(avg({_F1K}), 6) as mean_f1 from k group by 1, 2")
def _sensitivity(s, d):
    rows = _supported(s, d).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20))))
    return P.f1_at_k(rows, "claims", "supported", "k").groupBy("setting", "k").agg(F.round(F.avg("f1"), 6).alias("mean_f1"))


@query("policy_flags", f"with {R} select count_if(lower(rationale) like '%no reliable knowledge%' and upper(prediction) <> 'UNKNOWN') as says_unknown, count_if(lower(rationale) like '%contradicts%' and upper(prediction) = 'FACTUAL') as says_contradicted, setting from r where status = 'ok' group by setting")
def _policy(s, d):
    low, p = F.lower("rationale"), F.upper("prediction")
    rows = results(s, d).where("status = 'ok'").groupBy("setting")
    return rows.agg(F.count_if(low.contains("no reliable knowledge") & (p != "UNKNOWN")).alias("says_unknown"), F.count_if(low.contains("contradicts") & (p == "FACTUAL")).alias("says_contradicted"))


@query("any_direct", f"with {G}, e as (select claim_id, unnest(gold_evidence) as x from g), b as (select claim_id, bool_or(x.stance ilike '%support%') as s, bool_or(x.stance ilike '%refute%') as r from e group by 1) select case when s and not r then 'FACTUAL' when r and not s then 'NON_FACTUAL' else 'UNKNOWN' end as verdict, count(*) as n from b group by 1")
def _direct(s, d):
    has = lambda w: F.coalesce(F.bool_or(F.lower("x.stance").contains(w)), F.lit(False))
    b = claims(s, d).select("claim_id", F.explode("gold_evidence").alias("x")).groupBy("claim_id").agg(has("support").alias("s"), has("refute").alias("r"))
    return b.groupBy(F.expr("case when s and not r then 'FACTUAL' when r and not s then 'NON_FACTUAL' else 'UNKNOWN' end").alias("verdict")).agg(F.count("*").alias("n"))


@query("doc_diversity", f"with {G}, e as (select claim_id, unnest(gold_evidence) as x from g), c as (select claim_id, count(distinct x.url) as n from e group by 1) select min(n) as low, median(n) as mid, max(n) as high, count_if(n = 1) as from_one from c")
def _diversity(s, d):
    c = claims(s, d).select("claim_id", F.explode("gold_evidence").alias("x")).groupBy("claim_id").agg(F.count_distinct("x.url").alias("n"))
    return c.agg(F.min("n").alias("low"), F.median("n").alias("mid"), F.max("n").alias("high"), F.count_if(F.col("n") == 1).alias("from_one"))


@query("bounded_feedback", f"with {R} select response_id, result_id, place::int as place from (select response_id, result_id, row_number() over (partition by response_id order by confidence desc, result_id) as place from r where status = 'ok' and upper(prediction) = 'NON_FACTUAL' and confidence >= 0.95 and not isnan(confidence)) where place <= 2")
def _feedback(s, d):
    rows = results(s, d).where("status = 'ok' and upper(prediction) = 'NON_FACTUAL' and confidence >= 0.95 and not isnan(confidence)")
    return P.top_per_group(rows.select("response_id", "result_id", "confidence"), "response_id", 2, F.desc("confidence"), "result_id").select("response_id", "result_id", "place")


@query("parse_verdict")
def _parse(s, d):
    return V.parse_verdicts(results(s, d), "result_id", "raw_model_output").groupBy("outcome", "reason").agg(F.count("*").alias("n"))


@query("parse_recovered")
def _recovered(s, d):
    rows = V.parse_verdicts(results(s, d).where("status = 'parse_error'"), "result_id", "raw_model_output", recover=True)
    return rows.select("result_id", "outcome", "prediction", "confidence", "method")


@query("repair_guard", f"with {R} select count_if(len(string_split_regex(trim(rationale), '\\s+')) > 35 or length(rationale) > 240) as too_long, count(*) as n from r where rationale is not null")
def _guard(s, d):
    words = F.size(F.split(F.trim("rationale"), "\\s+"))
    rows = results(s, d).where("rationale is not null")
    return rows.agg(F.count_if((words > 35) | (F.length("rationale") > 240)).alias("too_long"), F.count("*").alias("n"))


@query("prompt_render")
def _prompt(s, d):
    text = F.replace(F.lit("Judge this claim: {claim}"), F.lit("{claim}"), F.expr("substring(to_json(array(gold_claim)), 2, length(to_json(array(gold_claim))) - 2)"))
    return claims(s, d).where("gold_claim is not null").select("claim_id", text.alias("prompt"))


@query("question_summary", "select split, count(*) as n, count_if(original_question not like '%?') as without_mark, min(length(original_question)) as low, max(length(original_question)) as high from response_manifest group by split")
def _questions(s, d):
    n = F.length("original_question")
    rows = table(s, d, "response_manifest").groupBy("split")
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.col("original_question").like("%?")).alias("without_mark"), F.min(n).cast("bigint").alias("low"), F.max(n).cast("bigint").alias("high"))


@query("near_words", f"with {G} select claim_id, len({{0}})::int as n from g where gold_claim is not null".replace("{0}", "regexp_extract_all(lower(gold_claim), '[a-z0-9]+')"))
def _near(s, d):
    return claims(s, d).where("gold_claim is not null").select("claim_id", F.size(F.regexp_extract_all(F.lower("gold_claim"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("n"))


