"""Documents, verdicts, sampling, metrics and bootstrap against plain versions."""

import random

from pyspark.sql import functions as F

from weftline.operators import bootstrap as B
from weftline.operators import documents as D
from weftline.operators import metrics as M
from weftline.operators import quality as Q
from weftline.operators import retrieval as R
from weftline.operators import sampling as P
from weftline.operators.verdicts import parse_verdict


def test_html_and_json():
    title, blocks = D.read_html("<title>T</title><nav>menu</nav><h1>Head</h1><p>One <b>two</b> &amp; three<script>x</script><li>four</li><footer>f</footer>")
    assert title == "T" and blocks == [("Head", "Head"), ("Head", "One two & three"), ("Head", "four")]
    assert D.walk_json({"a": [1, {"b": "x"}], "c": None}) == ["a[0]: 1", "a[1].b: x"]
    assert D.read_body(b"%PDF-1.4", None, "text/html")[0] == "malformed"
    assert D.read_body(b"{", None, "application/json")[0] == "malformed"
    assert D.read_body(b"a\n\n b ", None, "text/plain")[2] == [("", "a"), ("", "b")]


def test_chunks():
    text = " ".join(f"word{k}." if k % 10 == 9 else f"word{k}" for k in range(500))
    spans = D.chunk_spans(text, 100, 20, 0.7)
    assert spans[0][0] == 0 and spans[-1][1] == len(D._CHUNK_TOKEN.findall(text))
    for (a, b, *_), (c, d, *_) in zip(spans, spans[1:]):
        assert b - a <= 100 and c == max(a + 1, b - 20) and d > b
    assert D.chunk_spans("", 10, 2, 0.7) == []


def test_components(spark):
    rnd = random.Random(1)
    rows = [(k, f"u{rnd.randint(0, 60)}" if rnd.random() < 0.5 else None, f"h{rnd.randint(0, 60)}" if rnd.random() < 0.5 else "") for k in range(80)]
    rows += [(1000 + k, f"c{k}", f"c{k + 1}") for k in range(30)] + [(2000 + k, "hot", None) for k in range(300)]
    chain = {}
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, *values in rows:
        for n, v in enumerate(values):
            if v:
                other = chain.setdefault((n, v), k)
                a, b = find(k), find(other)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "id long, url string, hash string")
    got = {r["id"]: r["component"] for r in D.components(df, "id", "url", "hash").collect()}
    assert got == {k: find(k) for k in parent}
    assert D.components(df.limit(0), "id", "url").collect() == []


def test_verdicts():
    good = '{"prediction": "FACTUAL", "confidence": 0.5, "rationale": "ok then"}'
    assert parse_verdict(good)[:3] == ("ok", None, "FACTUAL")
    for bad, why in (
        (good.replace("}", ', "x": 1}'), "wrong_keys"),
        (good.replace("0.5", "true"), "wrong_confidence"),
        (good.replace("0.5", "NaN"), "not_finite"),
        (good.replace("FACTUAL", "maybe"), "wrong_label"),
        (good + " bye", "not_json"),
        (good[:-1] + ', "rationale": "b"}', "duplicate_key"),
        ("[1]", "not_an_object"),
        (good.replace("ok then", "w " * 36), "rationale_too_long"),
    ):
        assert parse_verdict(bad)[:2] == ("parse_error", why)
    assert parse_verdict(None)[0] == "empty"
    fenced = "```json\n" + good.replace("prediction", "label").replace("FACTUAL", "factual") + "\n```"
    assert parse_verdict(fenced, True)[0] == "recovered" and parse_verdict("no", True)[0] == "parse_error"


def test_sampling_and_median(spark):
    df = spark.createDataFrame([(k, "a" if k < 90 else "b", k % 7) for k in range(100)], "id long, g string, v long")
    got = P.stratified(df, "id", "g", 20, "s").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"a": 18, "b": 2}
    assert P.upper_median(df, "v").first()["k"] == sorted(k % 7 for k in range(100))[50]
    assert P.top_per_group(df, "g", 3, F.desc("id")).count() == 6


def test_metrics_and_bootstrap(spark):
    rnd = random.Random(2)
    labels, said = ["FACTUAL", "NON_FACTUAL"], ["FACTUAL", "NON_FACTUAL", "UNKNOWN", None]
    rows = [(k, f"r{k % 9}", rnd.choice(labels), rnd.choice(said)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, response_id string, label string, prediction string").withColumn("status", F.when(F.col("prediction").isNotNull(), "ok").otherwise("parse_error"))
    df = df.withColumn("state", M.state(F.col("label"), F.col("prediction"), F.col("status"))).withColumn("setting", F.lit("x"))
    r = M.rates(M.counts(df, "setting"), "setting").first()
    right = sum(a == b for _, _, a, b in rows)
    assert r["total"] == 300 and abs(r["accuracy"] - right / 300) < 1e-6
    f1s = []
    for c in labels:
        tp = sum(a == c == b for _, _, a, b in rows)
        fp = sum(b == c != a for _, _, a, b in rows)
        fn = sum(a == c != b for _, _, a, b in rows)
        f1s.append(2 * tp / (2 * tp + fp + fn))
    assert abs(r["macro_f1"] - sum(f1s) / 2) < 1e-6
    stats = M.counts(df, "setting", "response_id")
    drawn = B.draws(spark, stats, "response_id", 50, 3)
    per = drawn.groupBy("replicate").count().collect()
    assert len(per) == 50 and all(p["count"] == 9 for p in per)
    low = B.intervals(stats, drawn, "response_id", ["setting"], M.ratio(F.col("correct"), F.col("total")), ["correct", "total"], "v").first()
    assert low["low"] <= right / 300 <= low["high"] and low["replicates"] == 50
    assert B.draws(spark, stats.limit(0), "response_id", 5, 3).count() == 0


def test_latest_and_quality(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, t long, v string")
    assert sorted((r["id"], r["v"]) for r in M.latest(df, "id", "t").collect()) == [(1, "b"), (2, "c")]
    assert Q.repeated_keys(df, "id").count() == 1
    assert Q.violations(df, "id", {"big": F.col("t") > 1}).count() == 2
    assert Q.forbidden_columns(df, {"id", "t"}) == ["v"]


def test_retrieval_small(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, "")], "id long, t string")
    items = spark.createDataFrame([(7, "red fox"), (8, "nothing here")], "q long, t string")
    got = R.bm25(docs, "id", "t", items, "q", "t", 5).orderBy("q", "rank").collect()
    assert [(r["q"], r["id"]) for r in got] == [(7, 1), (7, 2)]
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "id long, v array<double>")
    near = R.dense(vectors, "id", "v", vectors.where("id = 4").withColumnRenamed("id", "q"), "q", "v", 2).orderBy("rank").collect()
    assert [r["id"] for r in near] == [4, 3]
    assert R.dense(vectors, "id", "v", vectors.limit(0).withColumnRenamed("id", "q"), "q", "v", 2).collect() == []
