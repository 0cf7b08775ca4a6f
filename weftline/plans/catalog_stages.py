"""Queries of stage outputs, alignment cascades, safe URLs, charsets and K-grid contrasts.

Outputs are composed from the given tables as the stages' models would write them, so that the SQL can state
which rule each breaks without parsing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import safety as U
from weftline.functions import text as T
from weftline.functions.http import charset, media_type
from weftline.operators import bootstrap as B
from weftline.operators import outputs as P
from weftline.operators import sampling as S
from weftline.plans.catalog_claims import E, evidence
from weftline.plans.catalog_results import _F1K, _VS, _supported
from weftline.plans.common import F_, G, R, claims, draws_sql, fetches, results, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_SPACE = r"trim(regexp_replace({0}, '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+', ' ', 'g'))"


def _listed(s, d, n: int):
    """(response_id, texts): the first ``n`` claims of each response that have a text."""
    rows = claims(s, d).where("gold_claim is not null").select("response_id", "claim_id", "gold_claim")
    top = S.top_per_group(rows, "response_id", n, "claim_id")
    return top.groupBy("response_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gold_claim"))), lambda x: x["gold_claim"]).alias("texts"))


def _list_sql(n: int, name: str, least: int, most: int, fewest: int) -> str:
    return f"""with {G}, t as (select response_id, claim_id, {_SPACE.format('gold_claim')} as c, row_number() over (partition by response_id order by claim_id) as place from g where gold_claim is not null),
l as (select response_id, count(*) as n, count(distinct replace(lower(c), 'ß', 'ss')) as different, bool_and(length(c) between {least} and {most}) as sized from t where place <= {n} group by 1)
select response_id, case when sized and n >= {fewest} and different = n then 'ok' else 'parse_error' end as outcome, case when not sized then '{name}:length' when n < {fewest} then '{name}:count' when different < n then '{name}:duplicate' end as rule from l"""


@query("parse_questions", _list_sql(8, "verification_questions", 5, 320, 5))
def _questions(s, d):
    raw = F.to_json(F.struct(F.col("texts").alias("verification_questions")))
    return P.parse_outputs(_listed(s, d, 8).withColumn("raw", raw), "response_id", "raw", P.QUESTIONS).select("response_id", "outcome", "rule")


@query("parse_claims", _list_sql(64, "claims", 3, 600, 0))
def _parse_claims(s, d):
    raw = F.to_json(F.struct(F.col("texts").alias("claims")))
    return P.parse_outputs(_listed(s, d, 64).withColumn("raw", raw), "response_id", "raw", P.CLAIMS).select("response_id", "outcome", "rule")


@query("claims_recovered", f"""with {G}, t as (select response_id, {_SPACE.format('gold_claim')} as c, row_number() over (partition by response_id order by claim_id) as place from g where gold_claim is not null),
l as (select response_id, count(*) as n, count(distinct replace(lower(c), 'ß', 'ss')) as different, bool_and(length(c) between 3 and 600) as sized from t where place <= 64 group by 1)
select response_id, case when not sized then 'parse_error' when different = n then 'ok' else 'recovered' end as outcome, case when sized then different end::int as kept from l""")
def _claims_recovered(s, d):
    raw = F.to_json(F.struct(F.col("texts").alias("claims")))
    out = P.parse_outputs(_listed(s, d, 64).withColumn("raw", raw), "response_id", "raw", P.CLAIMS, recover=True)
    return out.select("response_id", "outcome", F.size(F.from_json("fields", "claims array<string>")["claims"]).alias("kept"))


@query("parse_answer", rf"""with {R} select result_id, case when rationale is null then 'parse_error' when length({_SPACE.format('rationale')}) not between 2 and 1200 then 'parse_error' when prediction is null then 'parse_error' else 'ok' end as outcome,
 case when rationale is null then 'fields' when prediction is null then 'answer_status:not_a_choice' when length({_SPACE.format('rationale')}) not between 2 and 1200 then 'verification_answer:length' end as rule from r""")
def _answer(s, d):
    status = F.when(F.upper("prediction") == "UNKNOWN", "UNCERTAIN").when(F.col("prediction").isNotNull(), "ANSWERED").otherwise("none")
    # A null field is left out of the object, as a model that has no answer would.
    raw = F.to_json(F.struct(status.alias("answer_status"), F.col("rationale").alias("verification_answer")))
    return P.parse_outputs(results(s, d).select("result_id", raw.alias("raw")), "result_id", "raw", P.ANSWER).select("result_id", "outcome", "rule")


@query("parse_b4", rf"""with {R} select result_id, case when rationale is null then 'fields' when status <> 'ok' then 'answer_correctness:not_a_choice' when length({_SPACE.format('rationale')}) not between 3 and 480 then 'rationale:length' end as rule from r""")
def _b4(s, d):
    said = F.upper("prediction")
    raw = F.struct(
        F.lit("VALID_DIRECT").alias("alignment_validity"), F.lit("SUFFICIENT").alias("evidence_sufficiency"),
        F.when(F.col("status") != "ok", F.col("status")).when(said == "UNKNOWN", "UNVERIFIABLE").otherwise("CORRECT").alias("answer_correctness"),
        F.when(said == "FACTUAL", "SUPPORTS_CLAIM").when(said == "NON_FACTUAL", "CHALLENGES_CLAIM").otherwise("NO_POSITION").alias("answer_stance"), "rationale",
    )
    return P.parse_outputs(results(s, d).select("result_id", F.to_json(raw).alias("raw")), "result_id", "raw", P.EVALUATION).select("result_id", "rule")


@query("parse_revision", r"""with m as (select response_id, initial_response as t, right(response_id, 1) as form from response_manifest where initial_response is not null), n as (select *, length(regexp_replace(replace(replace(t, E'\r\n', E'\n'), E'\r', E'\n'), '^\s+|\s+$', '', 'g')) as size from m)
select response_id, case when size not between 20 and 30000 then 'parse_error' when form in ('1', '3', '5') then 'recovered' else 'ok' end as outcome, case when size not between 20 and 30000 then null when form = '1' then 'fence' when form = '3' then 'other_key' when form = '5' then 'text_in_braces' else 'strict' end as method from n""")
def _revision(s, d):
    rows = table(s, d, "response_manifest").where("initial_response is not null").select("response_id", F.col("initial_response").alias("t"))
    exact, form = F.to_json(F.struct(F.col("t").alias("revised_response"))), F.right("response_id", F.lit(1))
    quoted = F.expr("substring(to_json(array(t)), 2, length(to_json(array(t))) - 2)")
    raw = F.when(form == "1", F.concat(F.lit("```json\n"), exact, F.lit("\n```"))).when(form == "3", F.to_json(F.struct(F.col("t").alias("answer")))).when(form == "5", F.concat(F.lit("{"), quoted, F.lit("}")))
    out = P.parse_outputs(rows.withColumn("raw", raw.otherwise(exact)), "response_id", "raw", P.REVISION, recover=True)
    return out.select("response_id", "outcome", "method")


#: Words without content.
STOP = "a an and are as at be by for from has have in is it its of on or that the this to was were which with".split()
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_CONTENT = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda w: not list_contains({1}, w))"


def content_words(c):
    """Different words of letters and digits without those that carry no content."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))), F.array(*map(F.lit, STOP)))


@query("align_recover", f"""with {R}, {G}, a as (select claim_id, {_CONTENT.format('gold_claim', _STOPS)} as a from g where gold_claim is not null), b as (select claim_id, result_id, {_CONTENT.format('rationale', _STOPS)} as b from r where rationale is not null),
m as (select claim_id, result_id, len(list_intersect(a, b)) as met, len(a) as size from a join b using (claim_id) where len(a) >= 3), w as (select *, count_if(met = size) over (partition by claim_id) as whole from m)
select claim_id, count_if(met = size) as contained, count_if(met >= 0.75 * size) as covered, case when max(whole) = 1 then 'UNIQUE' when max(whole) > 1 then 'AMBIGUOUS' when bool_or(met >= 0.75 * size) then 'PRESENT_UNEXTRACTED' else 'ABSENT' end as relation from w group by 1""")
def _recover(s, d):
    """Relation of a claim to texts about it when the model's own alignment is unusable: by content words that they contain."""
    a = claims(s, d).where("gold_claim is not null").select("claim_id", content_words(F.col("gold_claim")).alias("a")).where("size(a) >= 3")
    b = results(s, d).where("rationale is not null").select("claim_id", content_words(F.col("rationale")).alias("b"))
    rows = a.join(b, "claim_id").select("claim_id", F.size(F.array_intersect("a", "b")).alias("met"), F.size("a").alias("n"))
    whole, most = F.count_if(F.col("met") == F.col("n")), F.count_if(F.col("met") >= 0.75 * F.col("n"))
    relation = F.when(F.col("contained") == 1, "UNIQUE").when(F.col("contained") > 1, "AMBIGUOUS").when(F.col("covered") > 0, "PRESENT_UNEXTRACTED").otherwise("ABSENT")
    return rows.groupBy("claim_id").agg(whole.alias("contained"), most.alias("covered")).withColumn("relation", relation)


@query("align_cascade")
def _cascade(s, d):
    """(claim_id, url, method, score, decision): evidence aligned with its claim by containment, then sentences, then words and common runs.

    All that contain the claim are positive; else the best of the sentence scores if one is whole; else the
    three best lexical scores from 0.55, ambiguous where another lies within 0.03 of the best.
    """
    c = claims(s, d).where("gold_claim is not null").select("claim_id", F.col("gold_claim").alias("c"), T.comparable(F.col("gold_claim")).alias("k")).where("k <> ''")
    e = evidence(s, d).where("x.text is not null and x.url is not null").select("claim_id", F.col("x.url").alias("url"), F.col("x.text").alias("t"))
    score = U.batch_udf(U.lexical_score, "double")[2]
    parts = F.filter(F.transform(F.split("t", "[.!?] +"), T.comparable), lambda p: F.size(F.split(p, " ")) >= 4)
    rows = e.join(c, "claim_id").withColumn("n", T.comparable(F.col("t"))).withColumn("parts", parts)
    inside = F.size(F.filter("parts", lambda p: F.contains(F.col("k"), p)))
    rows = rows.withColumn("whole", F.contains("n", "k")).withColumn("sentences", F.try_divide(inside, F.size("parts")))
    # Only what the first two steps leave is compared by common runs.
    rows = rows.withColumn("words", F.when(~F.col("whole") & (F.coalesce("sentences", F.lit(0.0)) < 0.5), F.round(score("c", "t"), 6)))
    method = F.when(F.col("whole"), "exact_normalized").when(F.col("sentences") >= 0.5, "sentence_substring").when(F.col("words") >= 0.55, "lexical")
    value = F.when(F.col("whole"), 1.0).when(F.col("sentences") >= 0.5, F.col("sentences")).otherwise(F.col("words"))
    tier = F.when(F.col("whole"), 1).when(F.col("sentences") >= 0.5, 2).otherwise(3)
    found = rows.select("claim_id", "url", method.alias("method"), value.alias("score"), tier.alias("tier")).where("method is not null")
    found = found.groupBy("claim_id", "url").agg(F.min_by(F.struct("method", "score", "tier"), F.struct("tier", -F.col("score"))).alias("m")).select("claim_id", "url", "m.*")
    by = Window.partitionBy("claim_id")
    best = found.withColumn("first", F.min("tier").over(by)).where("tier = first").withColumn("top", F.max("score").over(by))
    place = F.row_number().over(by.orderBy(F.desc("score"), "url"))
    kept = best.withColumn("place", place).where("tier = 1 or (tier = 2 and score = top) or (tier = 3 and place <= 3)")
    near = F.count_if(F.col("top") - F.col("score") <= 0.03).over(by) > 1
    decision = F.when((F.col("tier") == 1) | (F.col("score") >= 1.0), "positive").when(near, "ambiguous").otherwise("review")
    return kept.select("claim_id", "url", "method", "score", decision.alias("decision"))


@query("url_safety", f"""with {F_} select case when trim(coalesce(requested_url, '')) = '' then 'missing' when not regexp_matches(requested_url, '(?i)^\\s*https?://') then 'scheme' else 'safe' end as verdict, count(*) as n from f group by 1""")
def _safety(s, d):
    verdict = U.batch_udf(lambda u: U.safe_url(u)[1] or "safe", "string")[1]
    return fetches(s, d).select(F.coalesce(verdict(F.coalesce("requested_url", F.lit(""))), F.lit("missing")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("charset_cascade")
def _charsets(s, d):
    """(media, read_as, n): by which charset each body can be read without loss, the declared one first."""
    @F.pandas_udf("string")
    def read_as(body: pd.Series, declared: pd.Series) -> pd.Series:
        return pd.Series([U.decode_cascade(bytes(b), c)[1] if b is not None else None for b, c in zip(body, declared)])

    rows = table(s, d, "fetch_result").where("length(body) > 0")
    rows = rows.where(media_type(rows.headers).startswith("text/")).select("fetch_id", media_type(F.col("headers")).alias("media"), read_as("body", charset(F.col("headers"))).alias("read_as"))
    return rows.dropDuplicates(["fetch_id"]).groupBy("media", "read_as").agg(F.count("*").alias("n"))


@query("document_space")
def _document_space(s, d):
    """(doc_id, h): digest of each text in its normal white space."""
    normal = U.batch_udf(U.document_space, "string")[1]
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2(normal("text"), 256).alias("h"))


@query("fingerprints", f"""with {R} select run_fingerprint, sha256('{{"model":"' || model || '","setting":"' || setting || '"}}') as fingerprint, count(*) as n from r group by run_fingerprint, model, setting""")
def _fingerprints(s, d):
    """Fingerprint of each run's settings: the hash of their JSON with sorted keys, computed once per different setting."""
    runs = results(s, d).groupBy("run_fingerprint", "model", "setting").agg(F.count("*").alias("n"))
    hashed = U.batch_udf(lambda m, t: U.canonical_hash({"setting": t, "model": m}), "string")[2]
    return runs.select("run_fingerprint", hashed("model", "setting").alias("fingerprint"), "n")


_K = f"{_VS}, k as (select *, unnest(range(1, 21)) as k from v), fk as (select response_id, setting, k, {_F1K} as f1 from k)"
_PAIRED = "df as (select a.response_id, a.k, b.f1 - a.f1 as delta from fk a join fk b on a.response_id = b.response_id and a.k = b.k and a.setting = 'no_evidence' and b.setting = 'oracle_evidence')"


@query("k_contrasts", f"{_K}, {_PAIRED}, cl as (select distinct response_id from df), {draws_sql('response_id', 20260809, 10_000)}, rp as (select replicate, k, sum(times * delta) / sum(times) as v from wt join df using (response_id) group by 1, 2), iv as (select k, count(v) as replicates, round(quantile_cont(v, 0.025), 5) as low, round(quantile_cont(v, 0.975), 5) as high from rp where v is not null group by 1) select k::int as k, round(point, 5) as point, replicates, low, high, low <= 0 and high >= 0 as includes_zero from iv join (select k, avg(delta) as point from df group by 1) using (k)")
def _contrasts(s, d):
    """Paired difference of F1 at each K between two settings, with an interval from one set of draws for all K."""
    rows = _supported(s, d).where("setting in ('no_evidence', 'oracle_evidence')").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20))))
    f1 = S.f1_at_k(rows, "claims", "supported", "k").select("response_id", "setting", "k", "f1")
    a, b = f1.where("setting = 'no_evidence'").select("response_id", "k", F.col("f1").alias("a")), f1.where("setting = 'oracle_evidence'").select("response_id", "k", F.col("f1").alias("b"))
    delta = a.join(b, ["response_id", "k"]).select("response_id", "k", (F.col("b") - F.col("a")).alias("delta"), F.lit(1.0).alias("one"))
    ci = B.resampled(delta, "response_id", ["k"], F.try_divide(F.col("delta"), F.col("one")), ["delta", "one"], "v", 10_000, 20260809, 5)
    point = delta.groupBy("k").agg(F.round(F.avg("delta"), 5).alias("point"))
    low, high = F.col("low"), F.col("high")
    return point.join(ci, "k").select("k", "point", "replicates", low, high, ((low <= 0) & (high >= 0)).alias("includes_zero"))


@query("k_stability", f"{_K}, mn as (select setting, k, round(avg(f1), 6) as m from fk group by 1, 2), od as (select k, string_agg(setting, '>' order by m desc, setting) as ranking from mn group by 1) select ranking, count(*) as ks, min(k)::int as first_k, max(k)::int as last_k from od group by 1")
def _stability(s, d):
    """Rankings of the settings over the K-grid, and at which K each holds."""
    rows = _supported(s, d).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20))))
    m = S.f1_at_k(rows, "claims", "supported", "k").groupBy("setting", "k").agg(F.round(F.avg("f1"), 6).alias("m"))
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("x"), "setting"))), lambda x: x["setting"]), ">")
    return m.groupBy("k").agg(order.alias("ranking")).groupBy("ranking").agg(F.count("*").alias("ks"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))
