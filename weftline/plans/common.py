"""Tables and the SQL that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.metrics import latest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifier results, the last delivery of each."""
    return latest(table(spark, sf_dir, "verifier_result"), "result_id", "recorded_at")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold claims, each once."""
    return table(spark, sf_dir, "gold_claim").dropDuplicates(["claim_id"])


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches without their bodies, the last delivery of each."""
    cols = ["fetch_id", "requested_url", "final_url", "status_code", "headers", "attempt_count", "fetched_at", "loaded_at"]
    return latest(table(spark, sf_dir, "fetch_result").select(*cols), "fetch_id", "loaded_at")


R = "r as (select * from verifier_result qualify row_number() over (partition by result_id order by recorded_at desc) = 1)"
G = "g as (select * from gold_claim qualify row_number() over (partition by claim_id order by claim_id) = 1)"
S = "s as (select * from split_manifest qualify row_number() over (partition by claim_id order by claim_id) = 1)"
F_ = "f as (select * from fetch_result qualify row_number() over (partition by fetch_id order by loaded_at desc) = 1)"
STATE = """st as (select r.claim_id, r.response_id, r.setting, r.prediction, r.status, g.human_label as label, r.confidence, r.latency_seconds,
  case when r.status is null or r.status <> 'ok' or r.prediction is null then 'failed' when upper(r.prediction) = 'UNKNOWN' then 'abstained'
       when upper(r.prediction) = g.human_label then 'correct' else 'incorrect' end as state, upper(r.prediction) as pred
  from g join r using (claim_id) where g.human_label in ('FACTUAL', 'NON_FACTUAL'))"""
COUNTS = """cn as (select {by}, count(*) as total, count_if(state = 'correct') as correct, count_if(state in ('correct', 'incorrect')) as answered,
  count_if(state = 'abstained') as abstained,
  count_if(label = 'FACTUAL' and state <> 'failed' and pred = 'FACTUAL') as tp_f, count_if(label <> 'FACTUAL' and state <> 'failed' and pred = 'FACTUAL') as fp_f,
  count_if(label = 'FACTUAL' and not (state <> 'failed' and coalesce(pred, '') = 'FACTUAL')) as fn_f,
  count_if(label = 'NON_FACTUAL' and state <> 'failed' and pred = 'NON_FACTUAL') as tp_n, count_if(label <> 'NON_FACTUAL' and state <> 'failed' and pred = 'NON_FACTUAL') as fp_n,
  count_if(label = 'NON_FACTUAL' and not (state <> 'failed' and coalesce(pred, '') = 'NON_FACTUAL')) as fn_n
  from st group by {by})"""
F1 = "case when tp_{c} + fn_{c} = 0 then null when tp_{c} = 0 then 0.0 else 2.0 * tp_{c} / (2.0 * tp_{c} + fp_{c} + fn_{c}) end"
TOKENS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
HOST = "nullif(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"


def _times(x: str, c: int) -> str:
    """SQL of the product of a 64-bit value and a constant, modulo 2**64, from products of halves."""
    low, high, m = c & 0xFFFFFFFF, c >> 32, "4294967295::ubigint"
    upper = f"(((({x} & {m}) * {low}::ubigint) >> 32) + ((({x} >> 32) * {low}::ubigint) & {m}) + ((({x} & {m}) * {high}::ubigint) & {m})) & {m}"
    return f"(({upper}) * 4294967296::ubigint + ((({x} & {m}) * {low}::ubigint) & {m}))"


def _plus(a: str, b: str) -> str:
    """SQL of a sum modulo 2**64."""
    m = "4294967295::ubigint"
    return f"((((({a}) >> 32) + (({b}) >> 32) + (((({a}) & {m}) + (({b}) & {m})) >> 32)) & {m}) * 4294967296::ubigint + (((({a}) & {m}) + (({b}) & {m})) & {m}))"


def _mixed(source: str, keep: str) -> str:
    """SQL of a table with x mixed, from one with x; ``keep`` are its other columns."""
    one = f"select {keep}, xor(x, x >> 30) as x from ({source})"
    two = f"select {keep}, {_times('x', 0xBF58476D1CE4E5B9)} as x from ({one})"
    three = f"select {keep}, xor(x, x >> 27) as x from ({two})"
    four = f"select {keep}, {_times('x', 0x94D049BB133111EB)} as x from ({three})"
    return f"select {keep}, xor(x, x >> 31) as x from ({four})"


def draws_sql(key: str, seed: int, samples: int) -> str:
    """CTEs down to wt (replicate, key, times): how often each cluster of cn is drawn, as ``operators.bootstrap.places`` draws."""
    from weftline.operators.bootstrap import first_state

    step = 0x9E3779B97F4A7C15
    start = f"{first_state(seed)}::ubigint"
    states = _mixed(f"select r as replicate, {_plus(start, 'y')} as x from (select r, {_times('(r + 1)', step)} as y from (select unnest(range(0, {samples}))::ubigint as r))", "replicate")
    drawn = _mixed(f"select replicate, {_plus('x', 'y')} as x from ({states}) cross join (select {_times('n', step)} as y from (select unnest(range(1, (select max(size) from pl)::bigint + 1))::ubigint as n))", "replicate")
    return f"""pl as (select {key}, row_number() over (order by {key}) - 1 as place, count(*) over () as size from (select distinct {key} from cl)),
dr as (select replicate::bigint as replicate, (x % (select max(size) from pl)::ubigint)::bigint as place from ({drawn})),
wt as (select replicate, {key}, count(*) as times from dr join pl using (place) group by 1, 2)"""
