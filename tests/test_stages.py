"""Stage outputs, safe URLs, charsets, retry times, hashes and alignment scores, by written cases and brute force."""

import json
from datetime import UTC, datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftline.functions import safety as U
from weftline.operators import outcomes as O
from weftline.operators import outputs as P


def broken(raw, shape):
    with pytest.raises(P.Broken) as e:
        P.parse(raw, shape)
    return str(e.value)


def test_shapes():
    q = [f"Is it number {k}?" for k in range(5)]
    assert P.parse(json.dumps({"verification_questions": [" " + q[0] + "\n", *q[1:]]}), P.QUESTIONS)["verification_questions"] == q
    assert broken(json.dumps({"verification_questions": q[:4]}), P.QUESTIONS) == "verification_questions:count"
    assert broken(json.dumps({"verification_questions": [*q, q[0].upper()]}), P.QUESTIONS) == "verification_questions:duplicate"
    assert broken(json.dumps({"verification_questions": [*q, "x"]}), P.QUESTIONS) == "verification_questions:length"
    assert broken(json.dumps({"verification_questions": q, "more": 1}), P.QUESTIONS) == "fields"
    assert broken(None, P.CLAIMS) == broken("  ", P.CLAIMS) == "empty" and broken("{", P.CLAIMS) == "not_json"
    assert broken('{"claims": [], "claims": []}', P.CLAIMS) == "not_json" and broken('{"claims": {}}', P.CLAIMS) == "claims:not_a_list"
    assert P.parse('{"claims": []}', P.CLAIMS) == {"claims": []}
    answer = {"answer_status": "ANSWERED", "verification_answer": "Yes it is."}
    assert P.parse(json.dumps(answer), P.ANSWER) == answer and broken(json.dumps(answer | {"answer_status": "MAYBE"}), P.ANSWER) == "answer_status:not_a_choice"
    assert broken(json.dumps(answer | {"verification_answer": 3}), P.ANSWER) == "verification_answer:not_a_text"


def test_recovery():
    text = "A revised response\nof two lines."
    exact = json.dumps({"revised_response": text})
    got = lambda raw: (lambda r: (r[0]["revised_response"], r[1]))(P.recover_text(raw, P.REVISION))
    assert got(f"```json\n{exact}\n```") == (text, "fence") and got(json.dumps({"answer": text})) == (text, "other_key")
    assert got("{" + json.dumps(text) + "}") == (text, "text_in_braces")
    assert got(json.dumps({"one": "first part of it", "two": "second"})) == ("one: first part of it\ntwo: second", "flat_object")
    for raw in ("prose only, nothing else", json.dumps({"a": 1}), "{}", '{"short"}', "", None):
        with pytest.raises(P.Broken):
            P.recover_text(raw, P.REVISION)
    assert P.without_duplicates('{"claims": ["One thing", "Two things", "one  THING"]}', P.CLAIMS) == {"claims": ["One thing", "Two things"]}


def test_parse_outputs(spark):
    rows = [(1, '{"claims": ["abc"]}', 0), (2, None, 0), (3, '{"claims": ["abc", "ABC"]}', 0), (3, '{"claims": ["abc", "ABC"]}', 0)]
    df = spark.createDataFrame(rows, "id long, raw string, outcome int")
    got = sorted((r["id"], r["outcome"], r["rule"], r["fields"]) for r in P.parse_outputs(df, "id", "raw", P.CLAIMS, recover=True).collect())
    again = (3, "recovered", "claims:duplicate", '{"claims":["abc"]}')
    assert got == [(1, "ok", None, '{"claims":["abc"]}'), (2, "parse_error", "empty", None), again, again]
    assert P.parse_outputs(df.limit(0), "id", "raw", P.CLAIMS).collect() == []


def test_safe_urls():
    assert U.safe_url(" HTTPS://Exämple.ORG:443?q=1#x") == ("https://xn--exmple-cua.org/?q=1", None)
    assert U.safe_url("http://a.org:8080/p") == ("http://a.org:8080/p", None)
    bad = {"ftp://a.org": "scheme", "http://u:p@a.org": "userinfo", "http://localhost/": "host", "http://x.localhost": "host", "http://127.0.0.1/": "address", "http://[::1]/": "address",
           "http://[::ffff:10.0.0.1]/": "address", "http://a.org:99999": "malformed", "http://a\x01.org": "control_characters", "": "missing", None: "missing", "http://": "host"}
    assert {u: U.safe_url(u)[1] for u in bad} == bad
    assert U.safe_url("http://8.8.8.8/")[1] is None and U.public_address("8.8.8.8") and not U.public_address("224.0.0.1") and not U.public_address("a")


def test_delays_charsets_and_hashes():
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert U.retry_delay("3", 0) == 3 and U.retry_delay("300", 0) is None and U.retry_delay(None, 2) == 4 and U.retry_delay("soon", 1) == 2 and U.retry_delay("-1", 0) == 1
    assert U.retry_delay("Mon, 01 Jan 2024 00:00:07 GMT", 0, now=now) == 7 and U.retry_delay("nan", 0) == 1
    assert U.decode_cascade("ö".encode(), None) == ("ö", "utf-8") and U.decode_cascade(b"\xf6", None) == ("ö", "cp1252") and U.decode_cascade(b"\x81", None) == ("\x81", "latin-1")
    assert U.decode_cascade("я".encode("cp1251"), "windows-1251") == ("я", "cp1251") and U.decode_cascade(b"\xef\xbb\xbfa", "utf-8") == ("a", "utf-8-sig") and U.decode_cascade(b"", "nonsense") == ("", "utf-8")
    assert U.canonical_hash({"b": 1, "a": ["é", None]}) == U.canonical_hash({"a": ["é", None], "b": 1}) != U.canonical_hash({"a": ["e", None], "b": 1})
    assert U.document_space("a &amp;  b\r\n\r\n\r\n \tc\r") == "a & b\n\nc" and U.document_space(" \n ") == ""


def test_lexical_score():
    assert U.lexical_score(None, "a") == U.lexical_score("!", "a") == 0.0 and U.lexical_score("Straße &amp; ﬁre", "strasse fire") == 1.0
    for a, b in (("the old mill burnt", "the new mill stood"), ("abc def", "abd cef"), ("one two", "three"), ("kitten", "sitting")):
        x, y = U.aligned_form(a), U.aligned_form(b)
        assert U.lexical_score(a, b) >= SequenceMatcher(None, x, y, autojunk=False).ratio() - 1e-12
    assert abs(U.lexical_score("a b", "a c") - 0.6666666666) < 1e-6


def test_outcome_table(spark):
    """All labels, relations and states, against the table written out."""
    labels, relations = ["FACTUAL", "NON_FACTUAL", "UNKNOWN", None], ["EQUIVALENT", "MODIFIED", "PARTIAL", "ABSENT", "PRESENT_UNEXTRACTED"]
    states = ["NO_REVISED_CLAIM", "INCOMPLETE", "CONTAINS_NON_FACTUAL", "ALL_FACTUAL", "UNKNOWN_OR_MIXED"]

    def want(label, relation, state):
        if relation == "PRESENT_UNEXTRACTED":
            return "UNRESOLVED_EXTRACTION_OMISSION"
        if label not in ("FACTUAL", "NON_FACTUAL"):
            return "UNRESOLVED_UNKNOWN_INITIAL_ANCHOR"
        right = label == "FACTUAL"
        if relation == "ABSENT":
            return "FACTUAL_DELETED_CANDIDATE" if right else "ERROR_REMOVED_BY_DELETION_CANDIDATE"
        same = relation == "EQUIVALENT"
        return {
            "INCOMPLETE": "UNRESOLVED_REVISED_FACTUALITY", "UNKNOWN_OR_MIXED": "UNRESOLVED_REVISED_FACTUALITY", "NO_REVISED_CLAIM": "UNRESOLVED_ALIGNMENT_OR_FACTUALITY",
            "ALL_FACTUAL": ("FACTUAL_RETAINED_CANDIDATE" if same else "FACTUAL_PRESERVED_AFTER_CHANGE_CANDIDATE") if right else "SILVER_LABEL_DISAGREEMENT_CANDIDATE" if same else "ERROR_CORRECTED_CANDIDATE",
            "CONTAINS_NON_FACTUAL": "FACTUAL_DAMAGED_CANDIDATE" if right else "ERROR_RETAINED_CANDIDATE" if same else "ERROR_STILL_PRESENT_AFTER_CHANGE_CANDIDATE",
        }[state]

    rows = [(a, b, c) for a in labels for b in relations for c in states]
    df = spark.createDataFrame(rows, "label string, relation string, state string")
    got = df.withColumn("o", O.outcome(F.col("label"), F.col("relation"), F.col("state"))).collect()
    assert all(r["o"] == want(r["label"], r["relation"], r["state"]) for r in got)


def test_linked_lists(spark):
    initial = spark.createDataFrame([("a", [1, 2]), ("b", []), ("c", None), ("d", [1, 9]), ("e", [3]), ("f", [2]), ("g", [4])], "id string, ids array<long>")
    revised = spark.createDataFrame([(1, "ok", "FACTUAL"), (2, "ok", "factual"), (3, "ok", "NON_FACTUAL"), (4, "ok", "UNKNOWN")], "rid long, status string, prediction string")
    got = {r["id"]: (r["revised_claims"], r["state"]) for r in O.link_revised(initial, revised, "id", "ids", "rid").collect()}
    assert got == {"a": (2, "ALL_FACTUAL"), "b": (0, "NO_REVISED_CLAIM"), "c": (0, "NO_REVISED_CLAIM"), "d": (2, "INCOMPLETE"), "e": (1, "CONTAINS_NON_FACTUAL"), "f": (1, "ALL_FACTUAL"), "g": (1, "UNKNOWN_OR_MIXED")}
