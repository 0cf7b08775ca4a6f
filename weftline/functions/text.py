"""Column expressions for texts, labels, URLs and ids. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that stand for a missing value.
MISSING = ("", "na", "n/a", "none", "null", "not available")
#: Stances that are relevant evidence, with their relevance.
FULL_STANCES = ("support", "supports", "completely-support", "refute", "refutes", "completely-refute")
PARTIAL_STANCES = ("partially-support", "partial-support", "partially-refute")
TOKEN = "[\\p{L}\\p{N}]+"


def clean_string(c: Column) -> Column:
    """Trimmed text; null where it stands for a missing value."""
    return F.when(~F.lower(F.trim(c)).isin(*MISSING), F.trim(c))


def collapse_space(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, "[ \\t\\n\\r\\f\\x{a0}]+", " "))


def fold(c: Column) -> Column:
    """Lower case with the sharp s spelt out, as for comparing without case."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def tokens(c: Column) -> Column:
    """Words of letters and digits, without case."""
    return F.regexp_extract_all(fold(c), F.lit(f"({TOKEN})"), F.lit(1))


def comparable(c: Column) -> Column:
    """Text for comparison: without case, everything but letters, digits and underscore a single blank."""
    return F.trim(F.regexp_replace(fold(c), "[^\\p{L}\\p{N}_]+", " "))


def chunk_tokens(c: Column) -> Column:
    """Words, and marks one by one."""
    return F.regexp_extract_all(c, F.lit("([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s])"), F.lit(1))


def sentences(c: Column) -> Column:
    """Sentences, cut behind an end mark and white space."""
    return F.split(c, "(?<=[.!?。！？])[ \\t\\n\\r]+")


def normal_stance(c: Column) -> Column:
    """Stance in lower case with hyphens."""
    return F.trim(F.replace(F.lower(c), F.lit("_"), F.lit("-")))


def stance_relevance(c: Column) -> Column:
    """Relevance of a stance: 2 full, 1 partial or unknown, 0 irrelevant."""
    s = normal_stance(c)
    return F.when(s.isin(*FULL_STANCES), 2).when(s == "irrelevant", 0).otherwise(1)


def normal_label(c: Column) -> Column:
    """FACTUAL, NON_FACTUAL or UNKNOWN of a label in any spelling; null for anything else."""
    s = F.regexp_replace(F.lower(F.trim(c)), "[\\s_\\-]+", "_")
    return (
        F.when(s.isin("true", "factual", "yes", "1"), "FACTUAL")
        .when(s.isin("false", "non_factual", "nonfactual", "not_factual", "no", "0"), "NON_FACTUAL")
        .when(s.isin("unknown", "unk", "unsure", "uncertain", "?"), "UNKNOWN")
    )


def evidence_problem(c: Column) -> Column:
    """Why an evidence text is unusable, the first reason that applies; null if it is usable."""
    s = collapse_space(c)
    return (
        F.when(c.isNull(), "text_not_string")
        .when(s == "", "empty_or_whitespace_text")
        .when(s.rlike("^(?i)(url|link)\\s*:?\\s*$"), "marker_only_text")
        .when(s.rlike("^(?i)(https?://|www\\.)\\S+$"), "url_only_text")
        .when(~s.rlike("[\\p{L}\\p{N}]"), "punctuation_only_text")
    )


def first_url(c: Column) -> Column:
    """First http(s) URL in a text without closing marks; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(c, "(https?://\\S+)", 1), "[.,);\\]]+$", "")
    return F.when(found != "", found)


def bounded_text(c: Column, most: int) -> Column:
    """Text of at most ``most`` characters, cut at the last blank if that keeps half of it, with an ellipsis."""
    s = collapse_space(c)
    head = F.substring(s, 1, most - 1)
    at = most - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (at - 1 >= most // 2), F.expr("1")).otherwise(0)
    kept = F.when(cut == 1, F.rtrim(F.substring(head, F.lit(1), (at - 1).cast("int")))).otherwise(head)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(kept, F.lit("…")))


def mentioned_ranks(c: Column) -> Column:
    """Passage numbers that a rationale names, in order of first mention."""
    found = F.regexp_extract_all(F.lower(c), F.lit("(?:passages?|items?)\\s+(?:number\\s+)?#?\\s*(\\d+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def url_host(c: Column) -> Column:
    """Host of a URL in lower case."""
    found = F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def url_origin(c: Column) -> Column:
    """scheme://host:port of a URL, the port of the scheme if none is given."""
    scheme = F.lower(F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.\\-]*)://", 1))
    port = F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?[^/?#:]+:(\\d+)", 1)
    usual = F.when(scheme == "https", "443").otherwise("80")
    return F.when(url_host(c).isNotNull(), F.concat(scheme, F.lit("://"), url_host(c), F.lit(":"), F.when(port != "", port).otherwise(usual)))


def canonical_url(c: Column) -> Column:
    """URL without fragment and tracking parameters, scheme and host in lower case, no default port, no slash at the end."""
    bare = F.regexp_replace(F.trim(c), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.\\-]*)://", 1))
    port = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?[^/?#:]+:(\\d+)", 1)
    keep = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?i)(utm_[a-z]+|fbclid|gclid|ref)="))
    tail = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.when(scheme.isin("http", "https") & url_host(bare).isNotNull(), F.concat(scheme, F.lit("://"), url_host(bare), keep, path, tail))


def status_class(c: Column) -> Column:
    """Class of an HTTP status."""
    return (
        F.when(c.between(200, 299), "success")
        .when(c.isin(404, 403, 429), F.concat(F.lit("http_"), c.cast("string")))
        .when(c.isin(401, 407), "authentication_required")
        .when(c.isin(402, 451), "access_restricted")
        .when(c.between(500, 599), "server_error")
        .otherwise("http_error")
    )
