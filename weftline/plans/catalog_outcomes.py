"""Queries of what became of claims after a revision, and of why.

Stand-ins over the given tables: the results of a claim with evidence are its revised claims, each with the
prediction of its result; the result without evidence is the independent judgement; an evidence item is a
question asked about the claim; the relation of a claim to the revision follows from the stances of its evidence.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import outcomes as O
from weftline.operators import sampling as P
from weftline.plans.catalog_claims import E, PROBLEM, evidence
from weftline.plans.common import G, R, claims, results

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_S = "trim(replace(lower(x.stance), '_', '-'))"
_FULL = "(" + ", ".join(f"'{s}'" for s in T.FULL_STANCES) + ")"
_PART = "(" + ", ".join(f"'{s}'" for s in T.PARTIAL_STANCES) + ")"
RELATION = f"""rl as (select g.claim_id, g.response_id, g.human_label as label, case when count(x) = 0 then 'ABSENT' when coalesce(bool_and({_S} in {_FULL}), false) then 'EQUIVALENT'
 when coalesce(bool_or({_S} in {_PART}), false) then 'PARTIAL' when coalesce(bool_or({_S} in {_FULL}), false) then 'MODIFIED' else 'PRESENT_UNEXTRACTED' end as relation
 from g left join e using (claim_id) group by 1, 2, 3)"""
LINKED = """ln as (select rl.claim_id, any_value(rl.response_id) as response_id, any_value(rl.label) as label, any_value(rl.relation) as relation, count(r.result_id) as revised_claims,
 coalesce(bool_and(r.status = 'ok'), true) as complete, coalesce(bool_or(r.status = 'ok' and upper(r.prediction) = 'NON_FACTUAL'), false) as wrong, coalesce(bool_and(coalesce(upper(r.prediction) = 'FACTUAL', false)), false) as fine
 from rl left join r on r.claim_id = rl.claim_id and r.setting <> 'no_evidence' group by 1)"""
STATED = "sd as (select *, case when revised_claims = 0 then 'NO_REVISED_CLAIM' when not complete then 'INCOMPLETE' when wrong then 'CONTAINS_NON_FACTUAL' when fine then 'ALL_FACTUAL' else 'UNKNOWN_OR_MIXED' end as state from ln)"
_BIN = "coalesce(label in ('FACTUAL', 'NON_FACTUAL'), false)"
OUTCOME = f"""oc as (select claim_id, response_id, label, relation, revised_claims, state,
 case when relation = 'PRESENT_UNEXTRACTED' then 'EXTRACTION_OMISSION' when not {_BIN} then 'ANCHOR_REVIEW' when relation = 'EQUIVALENT' then case when label = 'FACTUAL' then 'FACTUAL_RETAINED' else 'ERROR_RETAINED' end
  when relation = 'ABSENT' then case when label = 'FACTUAL' then 'FACTUAL_DELETED' else 'ERROR_REMOVED' end else 'FACTUALITY_REQUIRED' end as provisional,
 case when relation = 'PRESENT_UNEXTRACTED' then 'UNRESOLVED_EXTRACTION_OMISSION' when not {_BIN} then 'UNRESOLVED_UNKNOWN_INITIAL_ANCHOR'
  when relation = 'ABSENT' then case when label = 'FACTUAL' then 'FACTUAL_DELETED_CANDIDATE' else 'ERROR_REMOVED_BY_DELETION_CANDIDATE' end
  when state in ('INCOMPLETE', 'UNKNOWN_OR_MIXED') then 'UNRESOLVED_REVISED_FACTUALITY'
  when state = 'ALL_FACTUAL' then case when relation = 'EQUIVALENT' then case when label = 'FACTUAL' then 'FACTUAL_RETAINED_CANDIDATE' else 'SILVER_LABEL_DISAGREEMENT_CANDIDATE' end
   else case when label = 'FACTUAL' then 'FACTUAL_PRESERVED_AFTER_CHANGE_CANDIDATE' else 'ERROR_CORRECTED_CANDIDATE' end end
  when state = 'CONTAINS_NON_FACTUAL' then case when label = 'FACTUAL' then 'FACTUAL_DAMAGED_CANDIDATE' when relation = 'EQUIVALENT' then 'ERROR_RETAINED_CANDIDATE' else 'ERROR_STILL_PRESENT_AFTER_CHANGE_CANDIDATE' end
  else 'UNRESOLVED_ALIGNMENT_OR_FACTUALITY' end as outcome from sd)"""
CASES = f"with {R}, {G}, {E}, {RELATION}, {LINKED}, {STATED}, {OUTCOME}"


def _related(s, d):
    """(claim_id, response_id, label, relation)."""
    stance = T.normal_stance(F.col("x.stance"))
    rows = claims(s, d).select("claim_id", "response_id", F.col("human_label").alias("label"), F.explode_outer("gold_evidence").alias("x"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    agg = rows.groupBy("claim_id", "response_id", "label").agg(
        F.count("x").alias("n"),
        F.coalesce(F.bool_and(stance.isin(*T.FULL_STANCES)), F.lit(False)).alias("full"),
        some(stance.isin(*T.PARTIAL_STANCES)).alias("part"),
        some(stance.isin(*T.FULL_STANCES)).alias("any_full"),
    )
    relation = F.when(F.col("n") == 0, "ABSENT").when(F.col("full"), "EQUIVALENT").when(F.col("part"), "PARTIAL").when(F.col("any_full"), "MODIFIED")
    return agg.select("claim_id", "response_id", "label", relation.otherwise("PRESENT_UNEXTRACTED").alias("relation"))


def _outcomes(s, d):
    """The outcome of every claim: its revised claims are linked by their list of ids."""
    revised = results(s, d).where("setting <> 'no_evidence'").select("claim_id", "result_id", "status", "prediction")
    ids = revised.groupBy("claim_id").agg(F.collect_list("result_id").alias("ids"))
    linked = O.link_revised(_related(s, d).join(ids, "claim_id", "left"), revised, "claim_id", "ids", "result_id").drop("ids")
    c = F.col
    return linked.withColumn("provisional", O.provisional(c("label"), c("relation"))).withColumn("outcome", O.outcome(c("label"), c("relation"), c("state")))


@query("outcome_join", f"{CASES} select * from oc")
def _outcome_join(s, d):
    return _outcomes(s, d)


@query("relation_xtab", f"with {G}, {E}, {RELATION} select label, count_if(relation = 'ABSENT') as absent, count_if(relation = 'EQUIVALENT') as equivalent, count_if(relation = 'MODIFIED') as modified, count_if(relation = 'PARTIAL') as partial, count_if(relation = 'PRESENT_UNEXTRACTED') as unextracted, round(count_if(relation in ('EQUIVALENT', 'MODIFIED', 'PARTIAL')) / count(*), 6) as matched_rate from rl group by 1")
def _xtab(s, d):
    n = lambda *names: F.count_if(F.col("relation").isin(*names))
    named = {"absent": "ABSENT", "equivalent": "EQUIVALENT", "modified": "MODIFIED", "partial": "PARTIAL", "unextracted": "PRESENT_UNEXTRACTED"}
    rate = F.round(n("EQUIVALENT", "MODIFIED", "PARTIAL") / F.count("*"), 6).alias("matched_rate")
    return _related(s, d).groupBy("label").agg(*[n(v).alias(k) for k, v in named.items()], rate)


@query("claim_summary", f"{CASES} select response_id, count(*) as claims, sum(revised_claims)::bigint as revised_claims, count_if(revised_claims = 0) as without_revised, min(case when revised_claims = 0 then claim_id end) as first_without from oc group by 1")
def _claim_summary(s, d):
    none = F.col("revised_claims") == 0
    rows = _outcomes(s, d).groupBy("response_id")
    return rows.agg(F.count("*").alias("claims"), F.sum("revised_claims").alias("revised_claims"), F.count_if(none).alias("without_revised"), F.min(F.when(none, F.col("claim_id"))).alias("first_without"))


_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_RATES = f"count_if(label = 'NON_FACTUAL') as wrong, count_if(label = 'FACTUAL') as fine, count_if(outcome in {_IN(O.GOOD)}) as corrected, count_if(outcome in {_IN(O.HARM)}) as harmed, count_if(outcome in {_IN(O.KEPT)}) as kept"


@query("branch_metrics", f"""{CASES}, pr as (select response_id, {_RATES} from oc group by 1), mi as (select sum(wrong) as w, sum(fine) as f, sum(corrected) as c, sum(harmed) as h, sum(kept) as k from pr)
select round(c / nullif(w, 0), 6) as micro_correction, round(h / nullif(f, 0), 6) as micro_harm, round(k / nullif(f, 0), 6) as micro_preservation, (c - h)::bigint as net_gain,
 (select round(avg(corrected / nullif(wrong, 0)), 6) from pr) as macro_correction, (select round(avg(harmed / nullif(fine, 0)), 6) from pr) as macro_harm from mi""")
def _branch_metrics(s, d):
    n = lambda c, *v: F.count_if(F.col(c).isin(*v))
    per = _outcomes(s, d).groupBy("response_id").agg(
        n("label", "NON_FACTUAL").alias("w"), n("label", "FACTUAL").alias("f"), n("outcome", *O.GOOD).alias("c"), n("outcome", *O.HARM).alias("h"), n("outcome", *O.KEPT).alias("k")
    )
    micro = lambda a, b: F.round(F.try_divide(F.sum(a), F.sum(b)), 6)
    macro = lambda a, b: F.round(F.avg(F.try_divide(F.col(a), F.col(b))), 6)
    return per.agg(
        micro("c", "w").alias("micro_correction"), micro("h", "f").alias("micro_harm"), micro("k", "f").alias("micro_preservation"),
        (F.sum("c") - F.sum("h")).alias("net_gain"), macro("c", "w").alias("macro_correction"), macro("h", "f").alias("macro_harm"),
    )


PAIRS = f"""b4 as (select e.claim_id || '__' || lpad(coalesce(x.rank, 0)::varchar, 3, '0') || '__' || coalesce(x.source, '') as evaluation_id, g.claim_id, g.response_id, g.human_label as label,
 case when {_S} in {_FULL} then 'VALID_DIRECT' when {_S} in {_PART} then 'VALID_PARTIAL' else 'INVALID' end as validity, case when ({PROBLEM}) is null then 'SUFFICIENT' else 'INSUFFICIENT' end as sufficiency,
 case when j.status is null or j.status <> 'ok' then 'UNVERIFIABLE' when upper(j.prediction) = g.human_label then 'CORRECT' when upper(j.prediction) = 'UNKNOWN' then 'PARTIALLY_CORRECT' else 'INCORRECT' end as correctness,
 case when {_S} like '%refute%' then 'CHALLENGES_CLAIM' when {_S} like '%support%' then 'SUPPORTS_CLAIM' else 'NO_POSITION' end as stance
 from e join g on g.claim_id = e.claim_id left join j on j.claim_id = e.claim_id),
po as (select *, case when validity = 'INVALID' then 'INVALID_ALIGNMENT' when correctness = 'UNVERIFIABLE' then 'UNVERIFIABLE' when sufficiency = 'INSUFFICIENT' then 'INSUFFICIENT_ANSWER'
 when label = 'FACTUAL' and stance = 'SUPPORTS_CLAIM' and correctness = 'CORRECT' then 'CORRECT_CONFIRMATION' when label = 'FACTUAL' and stance = 'SUPPORTS_CLAIM' and correctness = 'PARTIALLY_CORRECT' then 'PARTIAL_CORRECT_CONFIRMATION'
 when label = 'FACTUAL' and stance = 'CHALLENGES_CLAIM' then 'FALSE_CHALLENGE' when label = 'NON_FACTUAL' and stance = 'CHALLENGES_CLAIM' and correctness = 'CORRECT' then 'CORRECT_CHALLENGE'
 when label = 'NON_FACTUAL' and stance = 'CHALLENGES_CLAIM' and correctness = 'PARTIALLY_CORRECT' then 'PARTIAL_CORRECT_CHALLENGE' when label = 'NON_FACTUAL' and stance = 'SUPPORTS_CLAIM' then 'FALSE_CONFIRMATION'
 when stance = 'NO_POSITION' then 'NO_POSITION' else 'INCORRECT_OR_INCONSISTENT' end as pair_outcome from b4)"""
_J = "j as (select claim_id, max_by(status, result_id) as status, max_by(coalesce(prediction, ''), result_id) as prediction from r where setting = 'no_evidence' group by 1)"


def _pairs(s, d):
    """One row per question asked about a claim, with the labels of its evaluation."""
    stance = T.normal_stance(F.col("x.stance"))
    j = results(s, d).where("setting = 'no_evidence'").groupBy("claim_id").agg(F.max_by("status", "result_id").alias("status"), F.max_by(F.coalesce("prediction", F.lit("")), "result_id").alias("prediction"))
    g = claims(s, d).select("claim_id", F.col("human_label").alias("label"))
    rows = evidence(s, d).join(g, "claim_id").join(j, "claim_id", "left")
    said = F.upper("prediction")
    eid = F.concat_ws("__", "claim_id", F.lpad(F.coalesce("x.rank", F.lit(0)).cast("string"), 3, "0"), F.coalesce("x.source", F.lit("")))
    correctness = F.when(F.col("status").isNull() | (F.col("status") != "ok"), "UNVERIFIABLE").when(said == F.col("label"), "CORRECT").when(said == "UNKNOWN", "PARTIALLY_CORRECT").otherwise("INCORRECT")
    labelled = rows.select(
        eid.alias("evaluation_id"), "claim_id", "response_id", "label",
        F.when(stance.isin(*T.FULL_STANCES), "VALID_DIRECT").when(stance.isin(*T.PARTIAL_STANCES), "VALID_PARTIAL").otherwise("INVALID").alias("validity"),
        F.when(T.evidence_problem(F.col("x.text")).isNull(), "SUFFICIENT").otherwise("INSUFFICIENT").alias("sufficiency"),
        correctness.alias("correctness"),
        F.when(stance.contains("refute"), "CHALLENGES_CLAIM").when(stance.contains("support"), "SUPPORTS_CLAIM").otherwise("NO_POSITION").alias("stance"),
    )
    c = F.col
    return labelled.withColumn("pair_outcome", O.pair_outcome(c("label"), c("validity"), c("sufficiency"), c("correctness"), c("stance")))


@query("b4_units", f"with {R}, {G}, {E}, {_J}, {PAIRS} select * from po")
def _b4(s, d):
    return _pairs(s, d)


_STAGES = """pc as (select claim_id, bool_or(validity <> 'INVALID') as asked, bool_or(validity <> 'INVALID' and sufficiency = 'SUFFICIENT' and correctness <> 'UNVERIFIABLE') as usable,
 bool_or(validity <> 'INVALID' and sufficiency = 'SUFFICIENT' and correctness in ('CORRECT', 'PARTIALLY_CORRECT') and stance = 'CHALLENGES_CLAIM') as broad,
 bool_or(validity <> 'INVALID' and sufficiency = 'SUFFICIENT' and correctness = 'CORRECT' and stance = 'CHALLENGES_CLAIM') as strict,
 bool_or(pair_outcome in ('CORRECT_CHALLENGE', 'PARTIAL_CORRECT_CHALLENGE', 'CORRECT_CONFIRMATION', 'PARTIAL_CORRECT_CONFIRMATION')) as success, bool_or(pair_outcome in ('FALSE_CHALLENGE', 'FALSE_CONFIRMATION')) as harm from po group by 1)"""


def _per_claim(s, d):
    """Which stages each claim reached in any of its pairs."""
    c = F.col
    asked = c("validity") != "INVALID"
    usable = asked & (c("sufficiency") == "SUFFICIENT") & (c("correctness") != "UNVERIFIABLE")
    challenge = usable & (c("stance") == "CHALLENGES_CLAIM")
    good = c("pair_outcome").isin("CORRECT_CHALLENGE", "PARTIAL_CORRECT_CHALLENGE", "CORRECT_CONFIRMATION", "PARTIAL_CORRECT_CONFIRMATION")
    return _pairs(s, d).groupBy("claim_id").agg(
        F.bool_or(asked).alias("asked"), F.bool_or(usable).alias("usable"), F.bool_or(challenge & c("correctness").isin("CORRECT", "PARTIALLY_CORRECT")).alias("broad"),
        F.bool_or(challenge & (c("correctness") == "CORRECT")).alias("strict"), F.bool_or(good).alias("success"), F.bool_or(c("pair_outcome").isin("FALSE_CHALLENGE", "FALSE_CONFIRMATION")).alias("harm"),
    )


@query("claim_funnel", f"with {R}, {G}, {E}, {_J}, {PAIRS}, {_STAGES} select human_label as label, count(*) as claims, count_if(asked is not null) as with_pairs, count_if(asked) as asked, count_if(usable) as evaluable, count_if(usable and success) as success, count_if(usable and harm) as harm, count_if(usable and success and harm) as both_ways from g left join pc using (claim_id) group by 1")
def _claim_funnel(s, d):
    n = lambda c: F.count_if(c)
    u = F.col("usable")
    rows = claims(s, d).select("claim_id", F.col("human_label").alias("label")).join(_per_claim(s, d), "claim_id", "left").groupBy("label")
    return rows.agg(
        F.count("*").alias("claims"), n(F.col("asked").isNotNull()).alias("with_pairs"), n(F.col("asked")).alias("asked"), n(u).alias("evaluable"),
        n(u & F.col("success")).alias("success"), n(u & F.col("harm")).alias("harm"), n(u & F.col("success") & F.col("harm")).alias("both_ways"),
    )


_JOINED = f"{CASES}, {_J}, {PAIRS}, {_STAGES}, fu as (select oc.*, coalesce(asked, false) as asked, coalesce(usable, false) as usable, coalesce(broad, false) as broad, coalesce(strict, false) as strict, relation in ('ABSENT', 'MODIFIED', 'PARTIAL') as acted from oc left join pc using (claim_id) where label = 'NON_FACTUAL')"


def _wrong_claims(s, d):
    """The NON_FACTUAL claims with their outcome and the stages that they reached."""
    rows = _outcomes(s, d).where("label = 'NON_FACTUAL'").join(_per_claim(s, d), "claim_id", "left")
    return rows.na.fill(False, ["asked", "usable", "broad", "strict"]).withColumn("acted", F.col("relation").isin("ABSENT", "MODIFIED", "PARTIAL"))


@query("funnel_nested", f"""{_JOINED} select count(*) as claims, count_if(asked) as asked, count_if(asked and usable) as usable, count_if(asked and usable and broad) as challenged, count_if(asked and usable and broad and acted) as acted,
 count_if(asked and usable and broad and acted and outcome = 'ERROR_CORRECTED_CANDIDATE') as corrected, count_if(asked and usable and broad and acted and outcome in {_IN(O.GOOD)}) as corrected_or_deleted,
 count_if(outcome in {_IN(O.GOOD)} and not (asked and usable and broad and acted)) as outside_path, count_if(strict) as strictly_challenged from fu""")
def _funnel(s, d):
    c = F.col
    path = [c("asked"), c("usable"), c("broad"), c("acted")]
    upto = lambda k: path[0] if k == 1 else upto(k - 1) & path[k - 1]
    good = c("outcome").isin(*O.GOOD)
    n = lambda x, name: F.count_if(x).alias(name)
    return _wrong_claims(s, d).agg(
        F.count("*").alias("claims"), n(upto(1), "asked"), n(upto(2), "usable"), n(upto(3), "challenged"), n(upto(4), "acted"),
        n(upto(4) & (c("outcome") == "ERROR_CORRECTED_CANDIDATE"), "corrected"), n(upto(4) & good, "corrected_or_deleted"), n(good & ~upto(4), "outside_path"), n(c("strict"), "strictly_challenged"),
    )


@query("taxonomy", f"""{_JOINED} select case when outcome = 'ERROR_CORRECTED_CANDIDATE' then 'STRICT_CORRECTION' when outcome = 'ERROR_REMOVED_BY_DELETION_CANDIDATE' then 'DELETION' when outcome = 'SILVER_LABEL_DISAGREEMENT_CANDIDATE' then 'EVALUATOR_LABEL_CONFLICT'
 when outcome in ('UNRESOLVED_REVISED_FACTUALITY', 'UNRESOLVED_EXTRACTION_OMISSION') then 'FINAL_FACTUALITY_UNRESOLVED' when not asked then 'PLANNER_MISS' when not usable then 'VERIFICATION_NOT_EVALUABLE'
 when not broad then 'VERIFICATION_DID_NOT_PRODUCE_SUPPORTED_CHALLENGE' when not acted then 'REVISION_OMISSION_AFTER_CHALLENGE' else 'REVISION_UNSUCCESSFUL_AFTER_CHALLENGE' end as mechanism, count(*) as n, min(claim_id) as first_claim from fu group by 1""")
def _taxonomy(s, d):
    c = F.col
    name = O.mechanism(c("outcome"), c("asked"), c("usable"), c("broad"), c("acted"))
    return _wrong_claims(s, d).groupBy(name.alias("mechanism")).agg(F.count("*").alias("n"), F.min("claim_id").alias("first_claim"))


_FLAG = "(lower(r.rationale) like '%no reliable knowledge%' and upper(r.prediction) <> 'UNKNOWN')"
TIERS = f"""ex as (select g.response_id, trim(regexp_replace(replace(lower(gold_claim), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) as k, min(human_label) as label from g where human_label in ('FACTUAL', 'NON_FACTUAL') and gold_claim is not null group by 1, 2 having count(*) > 1 and count(distinct human_label) = 1),
ti as (select r.result_id, r.claim_id, case when ex.label is not null then 'GOLD_INHERITED' when j.status = 'ok' and upper(j.prediction) in ('FACTUAL', 'NON_FACTUAL') and upper(j.prediction) = upper(r.prediction) and not coalesce({_FLAG}, false) then 'CROSS_MODEL_CONFIRMED'
 when r.status = 'ok' and upper(r.prediction) in ('FACTUAL', 'NON_FACTUAL') then 'SILVER_ONLY' else 'UNRESOLVED' end as tier
 from r left join ex on ex.response_id = r.response_id and ex.k = trim(regexp_replace(replace(lower(r.gold_claim), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) and ex.k <> '' left join j on j.claim_id = r.claim_id where r.setting <> 'no_evidence')"""


def _tiers(s, d):
    """(result_id, claim_id, tier) of every result with evidence."""
    known = claims(s, d).where("human_label in ('FACTUAL', 'NON_FACTUAL') and gold_claim is not null").groupBy(F.col("response_id").alias("of"), T.comparable(F.col("gold_claim")).alias("k"))
    exact = known.agg(F.min("human_label").alias("inherited"), F.count("*").alias("n"), F.count_distinct("human_label").alias("labels")).where("n > 1 and labels = 1 and k <> ''").select("of", "k", "inherited")
    r = results(s, d).select("result_id", "claim_id", "response_id", "setting", "status", F.upper("prediction").alias("said"), F.lower("rationale").alias("why"), T.comparable(F.col("gold_claim")).alias("key"))
    j = r.where("setting = 'no_evidence'").groupBy("claim_id").agg(F.max_by("status", "result_id").alias("other_status"), F.max_by(F.coalesce("said", F.lit("")), "result_id").alias("other"))
    rows = r.where("setting <> 'no_evidence'").join(exact, (F.col("of") == F.col("response_id")) & (F.col("k") == F.col("key")), "left").join(j, "claim_id", "left")
    flagged = F.coalesce(F.col("why").contains("no reliable knowledge") & (F.col("said") != "UNKNOWN"), F.lit(False))
    c = F.col
    return rows.select("result_id", "claim_id", O.tier(c("inherited"), c("status"), c("said"), c("other_status"), c("other"), flagged).alias("tier"))


@query("validation_tiers", f"with {R}, {G}, {_J}, {TIERS} select * from ti")
def _validation(s, d):
    return _tiers(s, d)


_CANDIDATE = "cd as (select result_id, response_id, claim_id, list_filter([case when upper(prediction) is distinct from 'NON_FACTUAL' then 'not_non_factual' end, case when confidence is null or isnan(confidence) or confidence < 0.95 then 'low_confidence' end, case when lower(rationale) like '%no reliable knowledge%' then 'policy_flag' end, case when rationale is null then 'no_rationale' end], lambda v: v is not null) as reasons from r where status = 'ok')"


def _candidates(s, d):
    """Why each ok result is no candidate for feedback; an empty list if it is one."""
    c = F.col
    reasons = F.array_compact(F.array(
        F.when(~F.upper("prediction").eqNullSafe("NON_FACTUAL"), "not_non_factual"),
        F.when(c("confidence").isNull() | F.isnan("confidence") | (c("confidence") < 0.95), "low_confidence"),
        F.when(F.lower("rationale").contains("no reliable knowledge"), "policy_flag"),
        F.when(c("rationale").isNull(), "no_rationale"),
    ))
    return results(s, d).where("status = 'ok'").select("result_id", "response_id", "claim_id", reasons.alias("reasons"))


@query("candidate_reasons", f"with {R}, {_CANDIDATE} select array_to_string(reasons, '+') as reasons, count(*) as n from cd group by 1")
def _reasons(s, d):
    return _candidates(s, d).groupBy(F.array_join("reasons", "+").alias("reasons")).agg(F.count("*").alias("n"))


@query("target_strata", f"with {R}, {G}, {_CANDIDATE}, tg as (select distinct claim_id from cd where len(reasons) = 0) select human_label as label, claim_id in (select claim_id from tg) as targeted, count(*) as n from g group by 1, 2")
def _strata(s, d):
    targets = _candidates(s, d).where(F.size("reasons") == 0).select("claim_id").distinct()
    g = claims(s, d).select("claim_id", F.col("human_label").alias("label"))
    count = lambda how, yes: g.join(targets, "claim_id", how).groupBy("label").agg(F.count("*").alias("n")).select("label", F.lit(yes).alias("targeted"), "n")
    return count("left_semi", True).union(count("left_anti", False))


_AUDIT = f"""rs as (select oc.claim_id, oc.response_id, unnest(list_filter([case when outcome in {_IN(O.GOOD)} then '1_benefit' end, case when outcome in {_IN(O.HARM)} then '2_harm' end, case when outcome like 'UNRESOLVED%' then '3_unresolved' end, case when relation = 'PARTIAL' then '4_partial' end], lambda v: v is not null)) as reason from oc),
pq as (select claim_id, min(reason) as reason, count(distinct reason) as reasons from rs where claim_id not in (select claim_id from ti where tier = 'GOLD_INHERITED') group by 1),
au as (select *, row_number() over (partition by reason order by sha256('audit|' || reason || '|' || claim_id), claim_id) as place from pq)"""


@query("audit_select", f"{CASES}, {_J}, {TIERS}, {_AUDIT} select claim_id, reason, reasons, place::int as place from au where place <= 25")
def _audit(s, d):
    """Claims to look at: their first reason by priority, claims with an inherited label left out, so many of each reason in hash order."""
    c = F.col
    why = F.array_compact(F.array(
        F.when(c("outcome").isin(*O.GOOD), "1_benefit"), F.when(c("outcome").isin(*O.HARM), "2_harm"),
        F.when(c("outcome").startswith("UNRESOLVED"), "3_unresolved"), F.when(c("relation") == "PARTIAL", "4_partial"),
    ))
    inherited = _tiers(s, d).where("tier = 'GOLD_INHERITED'").select("claim_id").distinct()
    rows = _outcomes(s, d).select("claim_id", why.alias("why")).where(F.size("why") > 0).join(inherited, "claim_id", "left_anti")
    rows = rows.select("claim_id", F.array_min("why").alias("reason"), F.size("why").cast("bigint").alias("reasons"))
    order = P.hash_order("claim_id", "reason", "audit")
    return P.top_per_group(rows.withColumn("h", order), "reason", 25, "h", "claim_id").select("claim_id", "reason", "reasons", "place")
