"""Queries of the text, URL and document operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.http import charset, header, media_type
from weftline.operators import documents as D
from weftline.plans.common import F_, G, HOST, TOKENS, claims, fetches, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


docs = lambda s, d: table(s, d, "documents")


@query("tokenize", f"select doc_id, len(t)::int as n_tokens, len(list_distinct(t))::int as n_different from (select doc_id, {TOKENS.format('text')} as t from documents where text is not null)")
def _tokenize(s, d):
    t = T.tokens(F.col("text"))
    return docs(s, d).where("text is not null").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_different"))


@query("token_count", r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::int as n from documents where text is not null")
def _token_count(s, d):
    return docs(s, d).where("text is not null").select("doc_id", F.size(T.chunk_tokens(F.col("text"))).alias("n"))


@query("align_norm", r"select doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g'))) as h from documents where text is not null")
def _align(s, d):
    return docs(s, d).where("text is not null").select("doc_id", F.sha2(T.comparable(F.col("text")), 256).alias("h"))


@query("ws_collapse", r"select doc_id, length(trim(regexp_replace(text, '[ \t\n\r\f\x{A0}]+', ' ', 'g')))::int as n from documents where text is not null")
def _collapse(s, d):
    return docs(s, d).where("text is not null").select("doc_id", F.length(T.collapse_space(F.col("text"))).alias("n"))


@query("sentence_split", r"select doc_id, (1 + len(regexp_extract_all(text, '[.!?。！？][ \t\n\r]+')))::int as n from documents where text is not null")
def _sentences(s, d):
    return docs(s, d).where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


@query("sha256", "select doc_id, sha256(text) as h from documents where text is not null")
def _sha(s, d):
    return docs(s, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))


@query("content_dups", "select h, count(*) as n, min(doc_id) as first_id from (select doc_id, sha256(text) as h from documents where length(text) > 0) group by h having count(*) > 1")
def _dups(s, d):
    rows = docs(s, d).where("length(text) > 0").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("text_dedup", r"select min(doc_id) as doc_id, count(*) as copies from (select doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) as k from documents) where k <> '' group by k")
def _dedup(s, d):
    rows = docs(s, d).select("doc_id", T.comparable(F.col("text")).alias("k")).where("k <> ''")
    return rows.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("length_delta", r"select response_id, (len(regexp_extract_all(coalesce(initial_response, ''), '\S+')) - len(regexp_extract_all(coalesce(original_question, ''), '\S+')))::int as words, (length(coalesce(initial_response, '')) - length(coalesce(original_question, '')))::int as chars from response_manifest")
def _delta(s, d):
    words = lambda c: F.size(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit("([^ \\t\\n\\r\\f]+)"), F.lit(1)))
    chars = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    a, b = "initial_response", "original_question"
    return table(s, d, "response_manifest").select("response_id", (words(a) - words(b)).alias("words"), (chars(a) - chars(b)).alias("chars"))


@query("lexical_overlap", f"with {G}, t as (select claim_id, list_distinct({TOKENS.format('gold_claim')}) as a, list_distinct({TOKENS.format('source_sentence')}) as b from g where gold_claim is not null and source_sentence is not null) select claim_id, len(list_intersect(a, b))::int as shared, round(len(list_intersect(a, b)) / len(a), 6) as recall from t where len(a) > 0")
def _overlap(s, d):
    rows = claims(s, d).where("gold_claim is not null and source_sentence is not null")
    a, b = F.array_distinct(T.tokens(F.col("gold_claim"))), F.array_distinct(T.tokens(F.col("source_sentence")))
    rows = rows.select("claim_id", a.alias("a"), b.alias("b")).where("size(a) > 0")
    shared = F.size(F.array_intersect("a", "b"))
    return rows.select("claim_id", shared.alias("shared"), F.round(shared / F.size("a"), 6).alias("recall"))


@query("bounded_text", r"""with c as (select doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x{A0}]+', ' ', 'g')) as s from documents where text is not null), h as (select *, substr(s, 1, 359) as head from c), p as (select *, instr(reverse(head), ' ') as q from h)
select doc_id, case when length(s) <= 360 then s when q > 0 and 360 - q - 1 >= 180 then rtrim(substr(head, 1, 360 - q - 1), ' ') || '…' else head || '…' end as text from p""")
def _bounded(s, d):
    return docs(s, d).where("text is not null").select("doc_id", T.bounded_text(F.col("text"), 360).alias("text"))


@query("rank_mentions", r"with r as (select * from verifier_result qualify row_number() over (partition by result_id order by recorded_at desc) = 1), m as (select result_id, list_distinct(regexp_extract_all(lower(rationale), '(?:passages?|items?)\s+(?:number\s+)?#?\s*(\d+)', 1)) as x from r where rationale is not null) select result_id, len(x)::int as n, list_min(list_transform(x, lambda v: v::int)) as lowest from m where len(x) > 0")
def _mentions(s, d):
    from weftline.plans.common import results

    rows = results(s, d).where("rationale is not null").select("result_id", T.mentioned_ranks(F.col("rationale")).alias("x"))
    return rows.where("size(x) > 0").select("result_id", F.size("x").alias("n"), F.array_min("x").alias("lowest"))


@query("id_format", "select doc_id, printf('doc_%08d', doc_id) as name from documents")
def _ids(s, d):
    return docs(s, d).select("doc_id", F.format_string("doc_%08d", "doc_id").alias("name"))


@query("url_domain", f"with {F_} select {HOST.format('requested_url')} as domain, count(*) as n from f group by 1")
def _domain(s, d):
    return fetches(s, d).groupBy(T.url_host(F.col("requested_url")).alias("domain")).agg(F.count("*").alias("n"))


@query("url_origin", f"""with {F_}, p as (select lower(regexp_extract(requested_url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) as sc, {HOST.format('requested_url')} as h, regexp_extract(requested_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?[^/?#:]+:(\\d+)', 1) as po from f)
select case when h is not null then sc || '://' || h || ':' || case when po <> '' then po when sc = 'https' then '443' else '80' end end as origin, count(*) as n from p group by 1""")
def _origin(s, d):
    return fetches(s, d).groupBy(T.url_origin(F.col("requested_url")).alias("origin")).agg(F.count("*").alias("n"))


@query("url_canonical", rf"""with {F_}, p as (select fetch_id, regexp_replace(trim(requested_url), '#.*$', '') as u from f),
q as (select fetch_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) as sc, {HOST.format('u')} as h, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?[^/?#:]+:(\d+)', 1) as po,
 regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as pa, regexp_extract(u, '\?(.*)$', 1) as qu from p),
k as (select *, list_filter(string_split(qu, '&'), lambda x: x <> '' and not regexp_matches(x, '^(?i)(utm_[a-z]+|fbclid|gclid|ref)=')) as parts from q)
select fetch_id, case when sc in ('http', 'https') and h is not null then sc || '://' || h || case when po = '' or (sc = 'http' and po = '80') or (sc = 'https' and po = '443') then '' else ':' || po end || pa || case when len(parts) > 0 then '?' || array_to_string(parts, '&') else '' end end as url from k""")
def _canonical(s, d):
    return fetches(s, d).select("fetch_id", T.canonical_url(F.col("requested_url")).alias("url"))


@query("url_extract", f"""with {G}, e as (select claim_id, unnest(gold_evidence) as x from g) select count(*) as n, count(nullif(u, '')) as with_url, count(distinct nullif(u, '')) as urls
from (select regexp_replace(regexp_extract(x.text, '(https?://\\S+)', 1), '[.,);\\]]+$', '') as u from e)""")
def _extract_url(s, d):
    rows = claims(s, d).select("claim_id", F.explode("gold_evidence").alias("x")).select(T.first_url(F.col("x.text")).alias("u"))
    return rows.agg(F.count("*").alias("n"), F.count("u").alias("with_url"), F.count_distinct("u").alias("urls"))


@query("status_class", f"""with {F_} select case when status_code between 200 and 299 then 'success' when status_code in (403, 404, 429) then 'http_' || status_code when status_code in (401, 407) then 'authentication_required'
when status_code in (402, 451) then 'access_restricted' when status_code between 500 and 599 then 'server_error' else 'http_error' end as class, count(*) as n from f group by 1""")
def _status(s, d):
    return fetches(s, d).groupBy(T.status_class(F.col("status_code")).alias("class")).agg(F.count("*").alias("n"))


_CT = "list_filter(map_entries(headers), lambda e: lower(e.key) = 'content-type')[1].value"


@query("media_dispatch", f"with {F_}, m as (select lower(trim(split_part({_CT}, ';', 1))) as t from f) select case when t is null or t = '' then 'text/html' else t end as media, count(*) as n from m group by 1")
def _media(s, d):
    return fetches(s, d).groupBy(media_type(F.col("headers")).alias("media")).agg(F.count("*").alias("n"))


@query("header_lookup", f"with {F_} select fetch_id, list_filter(map_entries(headers), lambda e: lower(e.key) = 'content-length')[1].value as size from f")
def _header(s, d):
    return fetches(s, d).select("fetch_id", header(F.col("headers"), "content-length").alias("size"))


@query("plain_blocks", r"select doc_id, len(list_filter(string_split_regex(text, '\n[ \t]*\n'), lambda b: trim(b, E' \t\n\r') <> ''))::int as n from documents where length(text) > 0")
def _plain(s, d):
    blocks = F.filter(F.split("text", "\\n[ \\t]*\\n"), lambda b: F.regexp_replace(b, "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "") != "")
    return docs(s, d).where("length(text) > 0").select("doc_id", F.size(blocks).alias("n"))


@query("block_offsets", r"""with b as (select doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) as t, generate_subscripts(string_split_regex(text, '\n[ \t]*\n'), 1) as p from documents where length(text) > 0)
select doc_id, (p - 1)::int as block, coalesce(sum(length(t) + 2) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding), 0)::bigint as start, length(t)::int as size from b""")
def _offsets(s, d):
    from pyspark.sql import Window

    rows = docs(s, d).where("length(text) > 0").select("doc_id", F.posexplode(F.split("text", "\\n[ \\t]*\\n")).alias("block", "t"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", "block", F.coalesce(F.sum(F.length("t") + 2).over(before), F.lit(0)).cast("bigint").alias("start"), F.length("t").alias("size"))


@query("chunk_fixed", r"""with n as (select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::int as n from documents where text is not null),
c as (select doc_id, n, unnest(range(0, n, 320))::int as token_start from n where n > 0) select doc_id, token_start, least(token_start + 384, n)::int as token_end from c where token_start = 0 or token_start + 64 < n""")
def _chunk_fixed(s, d):
    n = docs(s, d).where("text is not null").select("doc_id", F.size(T.chunk_tokens(F.col("text"))).alias("n")).where("n > 0")
    c = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(320))).alias("token_start"))
    return c.where("token_start = 0 or token_start + 64 < n").select("doc_id", "token_start", F.least(F.col("token_start") + 384, F.col("n")).alias("token_end"))


@query("chunk_passages")
def _chunk(s, d):
    return D.chunk(docs(s, d), "doc_id", "text")


@query("span_overlap", r"""with b as (select doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) as t, generate_subscripts(string_split_regex(text, '\n[ \t]*\n'), 1) as p from documents where length(text) > 0),
o as (select doc_id, p, coalesce(sum(length(t) + 2) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding), 0)::bigint as a, length(t)::bigint as n from b)
select doc_id, win::bigint as win, count(*) as blocks, min(p - 1)::int as first_block from (select doc_id, p, unnest(range(a // 500, (a + greatest(n, 1) - 1) // 500 + 1)) as win from o) group by doc_id, win""")
def _span(s, d):
    o = QUERIES["block_offsets"](s, d).select("doc_id", "block", "start", F.greatest("size", F.lit(1)).alias("size"))
    w = o.select("doc_id", "block", F.explode(F.sequence(F.expr("start div 500"), F.expr("(start + size - 1) div 500"))).alias("win"))
    return w.groupBy("doc_id", "win").agg(F.count("*").alias("blocks"), F.min("block").alias("first_block"))


@query("html_extract")
def _html(s, d):
    rows = table(s, d, "fetch_result")
    out = D.extract(rows, "fetch_id", "body", charset(rows.headers), media_type(rows.headers)).dropDuplicates(["fetch_id"])
    return out.select("fetch_id", "status", "title", F.size("blocks").alias("n_blocks"), F.length("clean_text").alias("n_chars"))


@query("json_walk")
def _json(s, d):
    rows = table(s, d, "fetch_result")
    rows = rows.where(media_type(rows.headers) == "application/json")
    out = D.extract(rows, "fetch_id", "body", charset(rows.headers), media_type(rows.headers)).dropDuplicates(["fetch_id"])
    return out.select("fetch_id", "status", F.explode_outer("blocks.text").alias("line"))


@query("dedup_components", """with recursive u as (select doc_id, canonical_url as c, sha256(text) as h, text from documents),
e as (select a.doc_id as x, b.doc_id as y from u a join u b on a.c = b.c and a.c <> '' union select a.doc_id, b.doc_id from u a join u b on a.h = b.h and length(a.text) > 0),
w(x, y) as (select x, y from e union select w.x, e.y from w join e on w.y = e.x)
select u.doc_id, coalesce(min(w.y), u.doc_id) as component from u left join w on u.doc_id = w.x group by u.doc_id""")
def _components(s, d):
    rows = docs(s, d).select("doc_id", "canonical_url", F.when(F.length("text") > 0, F.sha2("text", 256)).alias("h"))
    return D.components(rows, "doc_id", "canonical_url", "h")


@query("alias_resolve", "with c as (select sha256(text) as h, min(doc_id) as first_id from documents where length(text) > 0 group by 1) select d.doc_id, coalesce(c.first_id, d.doc_id) as resolved from documents d left join c on length(d.text) > 0 and sha256(d.text) = c.h")
def _alias(s, d):
    rows = docs(s, d).select("doc_id", F.when(F.length("text") > 0, F.sha2("text", 256)).alias("h"))
    first = rows.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "h", "left").select("doc_id", F.coalesce("first_id", "doc_id").alias("resolved"))
