"""Queries of claim and evidence preparation, constraints and relational checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import quality as Q
from weftline.operators.sampling import stratified, top_per_group
from weftline.plans.common import G, R, S, claims, results, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


E = "e as (select claim_id, response_id, unnest(gold_evidence) as x from g)"
PROBLEM = r"""case when x.text is null then 'text_not_string' when trim(regexp_replace(x.text, '[ \t\n\r\f\x{A0}]+', ' ', 'g')) = '' then 'empty_or_whitespace_text'
 when regexp_matches(trim(regexp_replace(x.text, '[ \t\n\r\f\x{A0}]+', ' ', 'g')), '^(?i)(url|link)\s*:?\s*$') then 'marker_only_text'
 when regexp_matches(trim(regexp_replace(x.text, '[ \t\n\r\f\x{A0}]+', ' ', 'g')), '^(?i)(https?://|www\.)\S+$') then 'url_only_text'
 when not regexp_matches(x.text, '[\p{L}\p{N}]') then 'punctuation_only_text' end"""
LABEL = r"""case when l in ('true', 'factual', 'yes', '1') then 'FACTUAL' when l in ('false', 'non_factual', 'nonfactual', 'not_factual', 'no', '0') then 'NON_FACTUAL'
 when l in ('unknown', 'unk', 'unsure', 'uncertain', '?') then 'UNKNOWN' end"""


def evidence(s, d):
    return claims(s, d).select("claim_id", "response_id", F.posexplode("gold_evidence").alias("pos", "x"))


@query("clean_string", f"with {G} select claim_id, case when lower(trim(gold_claim)) not in ('', 'na', 'n/a', 'none', 'null', 'not available') then trim(gold_claim) end as claim from g")
def _clean(s, d):
    return claims(s, d).select("claim_id", T.clean_string(F.col("gold_claim")).alias("claim"))


@query("label_norm", rf"with {G}, t as (select regexp_replace(lower(trim(human_label_raw)), '[\s_\-]+', '_', 'g') as l from g) select {LABEL} as label, count(*) as n from t group by 1")
def _label(s, d):
    return claims(s, d).groupBy(T.normal_label(F.col("human_label_raw")).alias("label")).agg(F.count("*").alias("n"))


@query("stance_norm", f"with {G}, {E} select trim(replace(lower(x.stance), '_', '-')) as stance, count(*) as n from e group by 1")
def _stance(s, d):
    return evidence(s, d).groupBy(T.normal_stance(F.col("x.stance")).alias("stance")).agg(F.count("*").alias("n"))


_FULL = "('support', 'supports', 'completely-support', 'refute', 'refutes', 'completely-refute')"


@query("stance_relevance", f"with {G}, {E} select case when trim(replace(lower(x.stance), '_', '-')) in {_FULL} then 2 when trim(replace(lower(x.stance), '_', '-')) = 'irrelevant' then 0 else 1 end as relevance, count(*) as n from e group by 1")
def _relevance(s, d):
    return evidence(s, d).groupBy(T.stance_relevance(F.col("x.stance")).alias("relevance")).agg(F.count("*").alias("n"))


@query("stance_bucket", f"""with {G}, {E}, b as (select claim_id, bool_or(x.stance ilike '%refute%') as r, bool_or(x.stance ilike '%partial%') as p, bool_or(x.stance ilike '%support%') as u from e group by claim_id)
select case when r and (p or u) then 'mixed_with_refute' when r then 'refute_only' when p then 'partial_support_without_refute' when u then 'support_only' else 'other_or_missing' end as bucket, count(*) as n from b group by 1""")
def _bucket(s, d):
    has = lambda w: F.coalesce(F.bool_or(F.lower("x.stance").contains(w)), F.lit(False))
    b = evidence(s, d).groupBy("claim_id").agg(has("refute").alias("r"), has("partial").alias("p"), has("support").alias("u"))
    name = F.expr("case when r and (p or u) then 'mixed_with_refute' when r then 'refute_only' when p then 'partial_support_without_refute' when u then 'support_only' else 'other_or_missing' end")
    return b.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))


@query("evidence_usable", f"with {G}, {E} select {PROBLEM} as problem, count(*) as n from e group by 1")
def _usable(s, d):
    return evidence(s, d).groupBy(T.evidence_problem(F.col("x.text")).alias("problem")).agg(F.count("*").alias("n"))


@query("evidence_bundle", f"""with {G}, u as (select claim_id, unnest(gold_evidence) as x, generate_subscripts(gold_evidence, 1) as p from g), v as (select *, row_number() over (partition by claim_id order by p) as number from u where ({PROBLEM}) is null)
select claim_id, count(*) as items, sha256(string_agg(number || '. ' || x.text, chr(10) order by number)) as bundle from v group by claim_id""")
def _bundle(s, d):
    usable = evidence(s, d).where(T.evidence_problem(F.col("x.text")).isNull())
    items = F.sort_array(F.collect_list(F.struct("pos", F.col("x.text").alias("text"))))
    lines = F.transform(F.col("items"), lambda i, n: F.concat((n + 1).cast("string"), F.lit(". "), i["text"]))
    rows = usable.groupBy("claim_id").agg(items.alias("items"))
    return rows.select("claim_id", F.size("items").cast("bigint").alias("items"), F.sha2(F.array_join(lines, "\n"), 256).alias("bundle"))


@query("cohort_flags", f"""with {G}, {E}, u as (select claim_id, count_if(({PROBLEM}) is null) as usable from e group by claim_id)
select coalesce(g.human_label in ('FACTUAL', 'NON_FACTUAL'), false) as binary_label, coalesce(len(g.gold_evidence), 0) > 0 as has_bundle, coalesce(u.usable, 0) > 0 as usable_evidence, count(*) as n from g left join u using (claim_id) group by 1, 2, 3""")
def _flags(s, d):
    usable = evidence(s, d).groupBy("claim_id").agg(F.count_if(T.evidence_problem(F.col("x.text")).isNull()).alias("usable"))
    rows = claims(s, d).join(usable, "claim_id", "left")
    return rows.groupBy(
        F.coalesce(F.col("human_label").isin("FACTUAL", "NON_FACTUAL"), F.lit(False)).alias("binary_label"),
        (F.coalesce(F.size("gold_evidence"), F.lit(0)) > 0).alias("has_bundle"),
        (F.coalesce("usable", F.lit(0)) > 0).alias("usable_evidence"),
    ).agg(F.count("*").alias("n"))


@query("cohort_exclusions", f"""with {G}, {E}, u as (select claim_id, count_if(({PROBLEM}) is null) as usable from e group by claim_id)
select case when g.human_label is null or g.human_label not in ('FACTUAL', 'NON_FACTUAL') then 'non_binary_human_label' when g.gold_evidence is null then 'missing_evidence_field' when len(g.gold_evidence) = 0 then 'empty_evidence_bundle'
 when coalesce(u.usable, 0) = 0 then 'no_valid_evidence_text' end as reason, count(*) as n from g left join u using (claim_id) group by 1""")
def _exclusions(s, d):
    usable = evidence(s, d).groupBy("claim_id").agg(F.count_if(T.evidence_problem(F.col("x.text")).isNull()).alias("usable"))
    rows = claims(s, d).join(usable, "claim_id", "left")
    reason = (
        F.when(~F.coalesce(F.col("human_label").isin("FACTUAL", "NON_FACTUAL"), F.lit(False)), "non_binary_human_label")
        .when(F.col("gold_evidence").isNull(), "missing_evidence_field")
        .when(F.size("gold_evidence") == 0, "empty_evidence_bundle")
        .when(F.coalesce("usable", F.lit(0)) == 0, "no_valid_evidence_text")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("split_assign", "select response_id, case when source_record_index <= 20 then 'dev' else 'heldout' end as assigned from response_manifest")
def _assign(s, d):
    return table(s, d, "response_manifest").select("response_id", F.when(F.col("source_record_index") <= 20, "dev").otherwise("heldout").alias("assigned"))


@query("split_rollup", f"with {S} select split, count(*) as n, count_if(has_usable_oracle_evidence) as usable from s group by rollup (split)")
def _rollup(s, d):
    rows = table(s, d, "split_manifest").dropDuplicates(["claim_id"])
    return rows.rollup("split").agg(F.count("*").alias("n"), F.count_if("has_usable_oracle_evidence").alias("usable"))


@query("url_trace", f"with {G}, {E} select x.url as url, count(*) as evidence, list_sort(list(distinct response_id)) as responses from e where x.url is not null group by 1")
def _trace(s, d):
    rows = evidence(s, d).where("x.url is not null").groupBy(F.col("x.url").alias("url"))
    return rows.agg(F.count("*").alias("evidence"), F.sort_array(F.collect_set("response_id")).alias("responses"))


@query("source_qrels", f"with {G}, {E} select claim_id, x.url as url, max(case when trim(replace(lower(x.stance), '_', '-')) in {_FULL} then 2 when trim(replace(lower(x.stance), '_', '-')) = 'irrelevant' then 0 else 1 end) as relevance, count(*) as items from e where x.url is not null group by 1, 2")
def _qrels(s, d):
    rows = evidence(s, d).where("x.url is not null").groupBy("claim_id", F.col("x.url").alias("url"))
    return rows.agg(F.max(T.stance_relevance(F.col("x.stance"))).alias("relevance"), F.count("*").alias("items"))


@query("qrels_tsv", f"with {G}, {E} select claim_id || chr(9) || x.url || chr(9) || string_agg(distinct x.source, ';' order by x.source) as line from e where x.url is not null and x.source is not null group by claim_id, x.url")
def _tsv(s, d):
    rows = evidence(s, d).where("x.url is not null and x.source is not null").groupBy("claim_id", F.col("x.url").alias("url"))
    listed = rows.agg(F.array_join(F.sort_array(F.collect_set("x.source")), ";").alias("sources"))
    return listed.select(F.concat_ws("\t", "claim_id", "url", "sources").alias("line"))


@query("unit_assembly", f"with {G} select response_id, count(*) as claims, sha256(string_agg(claim_id, ',' order by claim_id)) as ids from g group by response_id")
def _units(s, d):
    rows = claims(s, d).groupBy("response_id").agg(F.sort_array(F.collect_list("claim_id")).alias("ids"))
    return rows.select("response_id", F.size("ids").cast("bigint").alias("claims"), F.sha2(F.array_join("ids", ","), 256).alias("ids"))


@query("response_manifest", f"with {G} select m.response_id, m.split, coalesce(c.n, 0) as claims from response_manifest m left join (select response_id, count(*) as n from g group by 1) c using (response_id)")
def _manifest(s, d):
    n = claims(s, d).groupBy("response_id").agg(F.count("*").alias("n"))
    return table(s, d, "response_manifest").join(n, "response_id", "left").select("response_id", "split", F.coalesce("n", F.lit(0)).alias("claims"))


@query("histograms", f"with {G} select 'human_label' as field, human_label as value, count(*) as n from g group by 2 union all select 'claim_checkworthiness', claim_checkworthiness, count(*) from g group by 2")
def _histograms(s, d):
    rows = claims(s, d).select(F.explode(F.create_map(F.lit("human_label"), "human_label", F.lit("claim_checkworthiness"), "claim_checkworthiness")).alias("field", "value"))
    return rows.groupBy("field", "value").agg(F.count("*").alias("n"))


@query("distinct_counts", f"with {G}, {E} select count(distinct response_id) as responses, count(distinct claim_id) as claims, count(distinct x.url) as urls from e")
def _distinct(s, d):
    rows = evidence(s, d)
    return rows.agg(F.count_distinct("response_id").alias("responses"), F.count_distinct("claim_id").alias("claims"), F.count_distinct("x.url").alias("urls"))


@query("unique_key", "select claim_id, count(*) as n from gold_claim group by claim_id having count(*) > 1")
def _unique(s, d):
    return Q.repeated_keys(table(s, d, "gold_claim"), "claim_id")


@query("drift_join", f"""with {G}, {S}, j as (select claim_id, g.response_id as a1, s.response_id as b1, g.source_record_index::varchar as a2, s.source_record_index::varchar as b2 from g full outer join s using (claim_id))
select claim_id, 'response_id' as field, a1 as a, b1 as b from j where a1 is distinct from b1 union all select claim_id, 'source_record_index', a2, b2 from j where a2 is distinct from b2""")
def _drift(s, d):
    return Q.drift(claims(s, d), table(s, d, "split_manifest").dropDuplicates(["claim_id"]), "claim_id", ["response_id", "source_record_index"])


@query("set_checks", f"with {G}, {R}, a as (select distinct claim_id from g), b as (select distinct claim_id from r) select count_if(b.claim_id is null) as only_a, count_if(a.claim_id is null) as only_b, count_if(a.claim_id is not null and b.claim_id is not null) as \"both\" from a full outer join b on a.claim_id = b.claim_id")
def _sets(s, d):
    return Q.set_relation(claims(s, d), results(s, d), "claim_id")


@query("count_assert", f"with {G} select response_id, count(*) as n, count(distinct sentence_id) as sentences, max(claim_index_in_sentence) as most from g group by response_id")
def _counts(s, d):
    return claims(s, d).groupBy("response_id").agg(F.count("*").alias("n"), F.count_distinct("sentence_id").alias("sentences"), F.max("claim_index_in_sentence").alias("most"))


@query("contract_check", f"""with {R} select result_id, unnest(list_filter([case when not coalesce(status in ('ok', 'parse_error', 'request_error'), false) then 'status' end, case when not coalesce(status <> 'ok' or prediction is not null, false) then 'prediction' end,
 case when not coalesce(confidence is null or confidence between 0 and 1, false) then 'confidence' end, case when not coalesce(latency_seconds >= 0, false) then 'latency' end], lambda x: x is not null)) as rule from r""")
def _contract(s, d):
    c = F.col
    rules = {
        "status": c("status").isin("ok", "parse_error", "request_error"),
        "prediction": (c("status") != "ok") | c("prediction").isNotNull(),
        "confidence": c("confidence").isNull() | c("confidence").between(0, 1),
        "latency": c("latency_seconds") >= 0,
    }
    return Q.violations(results(s, d), "result_id", rules)


@query("resume_anti", f"with {R}, {G}, done as (select distinct claim_id from r where setting = 'oracle_evidence' and status = 'ok') select claim_id from g where claim_id not in (select claim_id from done where claim_id is not null)")
def _resume(s, d):
    done = results(s, d).where("setting = 'oracle_evidence'").select("claim_id", "status")
    return Q.pending(claims(s, d).select("claim_id"), done, "claim_id")


@query("upsert_state", f"with {S}, {G} select g.claim_id, coalesce(s.split, 'pending') as split from g left join s using (claim_id)")
def _upsert(s, d):
    new = claims(s, d).select("claim_id", F.lit("pending").alias("split"))
    return Q.upsert(table(s, d, "split_manifest").dropDuplicates(["claim_id"]), new, "claim_id", ["split"])


@query("contains_join", rf"""with {G}, {E}, n as (select claim_id, trim(regexp_replace(replace(lower(x.text), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) as t from e where x.text is not null),
c as (select claim_id, trim(regexp_replace(replace(lower(gold_claim), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) as k from g where gold_claim is not null) select c.claim_id, count(*) as n from c join n using (claim_id) where k <> '' and contains(t, k) group by 1""")
def _contains(s, d):
    n = evidence(s, d).where("x.text is not null").select("claim_id", T.comparable(F.col("x.text")).alias("t"))
    c = claims(s, d).where("gold_claim is not null").select("claim_id", T.comparable(F.col("gold_claim")).alias("k")).where("k <> ''")
    return c.join(n, "claim_id").where("contains(t, k)").groupBy("claim_id").agg(F.count("*").alias("n"))


@query("exact_retained", rf"""with {G}, k as (select claim_id, response_id, trim(regexp_replace(lower(gold_claim), '\s+', ' ', 'g')) as k from g where gold_claim is not null)
select a.claim_id as claim_a, b.claim_id as claim_b from k a join k b on a.response_id = b.response_id and a.k = b.k and a.claim_id < b.claim_id and a.k <> ''""")
def _exact(s, d):
    k = claims(s, d).where("gold_claim is not null").select("claim_id", "response_id", F.trim(F.regexp_replace(F.lower("gold_claim"), "\\s+", " ")).alias("k")).where("k <> ''")
    a, b = k.withColumnRenamed("claim_id", "claim_a"), k.withColumnRenamed("claim_id", "claim_b")
    return a.join(b, ["response_id", "k"]).where("claim_a < claim_b").select("claim_a", "claim_b")


@query("stratified_sample", f"""with {G}, q as (select human_label, greatest(1, round(48 * count(*)::double / sum(count(*)) over ())::int) as quota from g group by human_label),
h as (select human_label, claim_id, row_number() over (partition by human_label order by sha256('20260731|' || human_label || '|' || claim_id), claim_id) as place from g)
select h.human_label, h.claim_id, h.place::int as place from h join q using (human_label) where place <= quota""")
def _stratified(s, d):
    return stratified(claims(s, d), "claim_id", "human_label", 48, "20260731")


@query("select_limit", f"with {G} select claim_id from (select claim_id, row_number() over (partition by response_id order by claim_id) as place from g) where place <= 2")
def _limit(s, d):
    return top_per_group(claims(s, d).select("response_id", "claim_id"), "response_id", 2, "claim_id").select("claim_id")
