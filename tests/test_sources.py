"""Readers, writers, connectors and the incremental run."""

import json

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftline.sources import connectors as C
from weftline.sources import io
from weftline.streaming.ingest import ingest, windowed_rates

SCHEMA = StructType([StructField("id", LongType()), StructField("t", StringType())])


def test_records(spark, tmp_path):
    rows = [{"id": 1, "t": "a"}, {"id": 2, "t": "b"}]
    (tmp_path / "a.json").write_text("  \n" + json.dumps(rows, indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name in ("a.json", "b.jsonl"):
        got = io.read_records(spark, str(tmp_path / name), SCHEMA).orderBy("id").collect()
        assert [tuple(r) for r in got] == [(1, "a"), (2, "b")]


def test_strict_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 1, "a": 2}\n{"a": NaN}\n[1]\n{"a": 1} x\n')
    got = [r["problem"] for r in io.read_strict_lines(spark, str(tmp_path / "x.jsonl")).collect()]
    assert got == [None, "duplicate_key", "not_finite", "not_an_object", "not_json"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", [])], "id long, t string, l array<string>")
    io.write_table(df, str(tmp_path / "t"), by=["t"], key="id")
    assert io.read_or_empty(spark, str(tmp_path / "t"), df.schema).count() == 2
    assert io.read_or_empty(spark, str(tmp_path / "none"), df.schema).count() == 0
    io.write_tsv(df, str(tmp_path / "q"), ["l"])
    assert any("x;y" in p.read_text() for p in (tmp_path / "q").glob("*.csv"))
    io.write_report(spark, str(tmp_path / "r.json"), {"b": 2})
    io.write_report(spark, str(tmp_path / "r.json"), {"b": 1, "a": "ü"})
    assert (tmp_path / "r.json").read_text() == '{"a": "ü", "b": 1}'
    with pytest.raises(ValueError):
        io.write_report(spark, str(tmp_path / "r.json"), float("nan"))
    io.write_lines(spark, str(tmp_path / "l.jsonl"), [{"a": 1}, {"a": "é"}])
    assert (tmp_path / "l.jsonl").read_text() == '{"a": 1}\n{"a": "é"}\n'
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith((".r.json.", ".l.jsonl.")) and not p.name.endswith("json.crc") and not p.name.endswith("jsonl.crc")]
    io.write_decimals(spark.createDataFrame([(1, 0.5)], "k int, x double"), str(tmp_path / "d"))
    assert any("1,0.500000000000" in p.read_text() for p in (tmp_path / "d").glob("*.csv"))
    with pytest.raises(ValueError):
        io.guard_columns(df, {"id", "t"})


@pytest.fixture
def flaky():
    def make():  # nested, so that it is shipped by value
        def client(p):
            if "bad" in p:
                raise RuntimeError("no")
            return p.upper()

        return client

    return make


def test_model_stage_resumes(spark, flaky):
    units = spark.createDataFrame([(1, "one"), (2, "bad"), (3, "three")], "id long, p string")
    first = C.run_stage(units, None, "id", "p", flaky).cache()
    assert {(r["id"], r["status"], r["output"]) for r in first.collect()} == {(1, "ok", "ONE"), (2, "request_error", None), (3, "ok", "THREE")}
    fixed = units.replace("bad", "good", "p")
    again = C.run_stage(fixed, first, "id", "p", flaky).collect()
    assert sorted((r["id"], r["status"]) for r in again) == [(1, "ok"), (2, "ok"), (3, "ok")]


def test_error_budget(spark, flaky):
    units = spark.createDataFrame([(k, "bad") for k in range(6)], "id long, p string").coalesce(1)
    got = [r["status"] for r in C.call_model(units, "id", "p", flaky, retries=0, stop_after=2).collect()]
    assert got == ["request_error"] * 2 + ["skipped"] * 4


def test_embed_and_fetch(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")
    got = C.embed(rows, "id", "t", lambda: lambda texts: [[3.0, 4.0] for _ in texts]).collect()
    assert all(abs(r["embedding"][0] - 0.6) < 1e-6 for r in got)
    urls = spark.createDataFrame([("http://a.b/x",), ("http://a.b/x",), ("https://c.d",)], "u string")
    assert sorted(r["output"] for r in C.fetch(urls, "u", lambda: str.upper).collect()) == ["HTTP://A.B/X", "HTTPS://C.D"]


def test_ingest_is_idempotent(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], SCHEMA).write.parquet(src)
    ingest(spark, src, SCHEMA, out, mark, "id").awaitTermination()
    spark.createDataFrame([(2, "b"), (3, "c")], SCHEMA).write.mode("append").parquet(src)
    ingest(spark, src, SCHEMA, out, mark, "id").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_windowed_rates_is_a_streaming_plan(spark, tmp_path):
    schema = "recorded_at timestamp, status string, model string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "s"))
    assert windowed_rates(stream, "recorded_at", "1 day", "1 hour", "model").isStreaming


def test_results_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], SCHEMA)
    assert io.append_results(rows, path, {"id", "t"}, "id") == 2
    assert io.append_results(spark.createDataFrame([(2, "b"), (3, "c")], SCHEMA), path, {"id", "t"}, "id") == 3
    with pytest.raises(ValueError):
        io.append_results(rows, path, {"id"}, "id")


def test_lenient_and_nonempty_readers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "t": "a"}\n{"id": 2, "t')
    good, broken = io.read_results(spark, str(tmp_path / "x.jsonl"), SCHEMA)
    assert [tuple(r) for r in good.collect()] == [(1, "a")] and broken.count() == 1
    assert io.read_results(spark, str(tmp_path / "none.jsonl"), SCHEMA)[0].count() == 0
    (tmp_path / "e.jsonl").write_text("")
    for name in ("e.jsonl", "none.jsonl"):
        with pytest.raises(Exception):
            io.read_nonempty(spark, str(tmp_path / name), SCHEMA)


def test_seals_and_paths(spark):
    a = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    seal = io.fingerprint(a, ["id", "t"])
    assert io.fingerprint(a.orderBy("id", ascending=False).repartition(3), ["id", "t"]) == seal
    assert io.check_seal(a, ["id", "t"], seal) is a
    with pytest.raises(ValueError):
        io.check_seal(a.union(a.limit(1)), ["id", "t"], seal)
    assert io.inside("/a/b", "c/d") == "/a/b/c/d"
    for bad in ("../x", "/a/bc", "c/../../x"):
        with pytest.raises(ValueError):
            io.inside("/a/b", bad)


def test_safe_fetcher():
    pages = {
        "http://a.org/": (302, {"Location": "/b"}, []), "http://a.org/b": (200, {}, [b"ab", b"cd"]), "http://a.org/in": (301, {"Location": "http://10.0.0.1/"}, []),
        "http://a.org/loop": (302, {"Location": "/loop"}, []), "http://private.org/": (200, {}, [b"x"]),
    }
    waits, busy = [], iter([429, 503, 200])

    def transport(url, address):
        assert address == "8.8.8.8"
        return (next(busy), {"Retry-After": "3"}, [b"ok"]) if url == "http://a.org/busy" else pages[url]

    client = C.safe_fetcher(transport, lambda host: ["10.1.1.1"] if host == "private.org" else ["8.8.8.8"], most_bytes=4, redirects=2, sleep=waits.append)
    assert client("http://a.org/") == {"status_code": 200, "final_url": "http://a.org/b", "headers": {}, "body": b"abcd"}
    assert client("http://a.org/busy")["body"] == b"ok" and waits == [3.0, 3.0]
    pages["http://a.org/b"] = (200, {}, [b"ab", b"cde"])
    for url, why in (("http://a.org/in", "unsafe_url:address"), ("http://a.org/loop", "too_many_redirects"), ("http://private.org", "unsafe_address"), ("http://a.org/b", "too_large"), ("file:///x", "unsafe_url:scheme")):
        with pytest.raises(C.Refused, match=why):
            client(url)


def test_pages_and_pdf():
    import zlib

    from weftline.operators.documents import read_body

    linked = '<html><title>T</title><script type="application/ld+json">{"@graph": [{"@type": "Article", "articleBody": "%s"}]}</script><p>Short.</p></html>' % ("A sentence of the article. " * 5)
    status, title, blocks = read_body(linked.encode(), None, "text/html")
    assert (status, title) == ("ok", "T") and blocks[0][1].startswith("A sentence")
    assert read_body(b"<html><p>Nothing much</p></html>", None, "text/html")[0] == "too_little_content"
    content = zlib.compress(b"BT /F1 12 Tf (Hello \\(world\\)) Tj T* [(spl) -20 (it)] TJ ET BT (\\351t\\351) Tj ET")
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 9 /Filter /FlateDecode >>\nstream\n" + content + b"\nendstream\nendobj\n%%EOF"
    assert read_body(pdf, None, "text/html") == ("ok", "", [("", "Hello (world) split"), ("", "été")])
    assert read_body(b"%PDF-1.4 junk", None, "application/pdf")[0] == "malformed" and read_body(b"x", None, "image/png")[0] == "unsupported"
    assert read_body("größe".encode("cp1252"), None, "text/plain") == ("ok", "", [("", "größe")])
