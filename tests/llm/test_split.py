"""p1: pieces against the rules they must keep, over random and hand-made texts."""

import random

import pytest

from weftline.llm.split import ENDS, WHITE, pack, split_oversized

NATURAL = set(WHITE + ENDS)


def check(text, limit, overlap, pieces):
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    for (_, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert c == max(0, b - overlap) and d > b
    assert pieces[-1][2] == 0
    for k, (a, b, cut) in enumerate(pieces[:-1]):
        natural = cut == 0
        assert natural == (text[b - 1] in NATURAL)
        if cut:
            left = max((p for p in range(b) if text[p] in NATURAL), default=-1)
            right = next((p for p in range(b, len(text)) if text[p] in NATURAL), len(text) - 1)
            assert cut == right - left
        first_new = pieces[k - 1][1] if k else 0
        if any(text[p - 1] in NATURAL for p in range(first_new + 1, a + limit + 1)):
            assert natural, (text, a, b)


def test_random_texts_keep_the_rules():
    rnd = random.Random(1)
    for _ in range(3000):
        letters = "abc" * rnd.choice([1, 4, 20]) + " \n.。" + chr(0x2028)
        text = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 5, 30, 80, 300])))
        limit = rnd.randint(5, 40)
        overlap = rnd.randint(0, limit - 1)
        check(text, limit, overlap, pack(text, limit, overlap))


def test_paragraphs_stay_whole():
    text = "\n\n".join("word " * 20 for _ in range(30))
    pieces = pack(text, 400, 0)
    assert all(text[:b].endswith("\n\n") for _, b, _ in pieces[:-1])


def test_sections_lists_and_markup_are_nodes():
    section = lambda name, n: f"## {name}\n" + "words of a line\n" * n
    text = "# Top\nintro\n" + section("one", 10) + section("two", 10) + "# Next\n" + section("three", 10)
    pieces = [text[a:b] for a, b, _ in pack(text, 380, 0)]
    assert pieces == ["# Top\nintro\n" + section("one", 10) + section("two", 10), "# Next\n" + section("three", 10)]
    pieces = [text[a:b] for a, b, _ in pack(text, 200, 0)]
    assert pieces == ["# Top\nintro\n" + section("one", 10), section("two", 10), "# Next\n" + section("three", 10)]
    entries = "".join(f"- entry {k}\n" + f"  - below {k}\n" * 5 for k in range(4))
    size = len("- entry 0\n" + "  - below 0\n" * 5)
    assert [(a, b) for a, b, _ in pack(entries, size + 5, 0)] == [(k * size, (k + 1) * size) for k in range(4)]
    page = "<div> <div> " + "a b " * 30 + "</div> <div> " + "c d " * 30 + "</div> </div>"
    assert page[: pack(page, 150, 0)[0][1]].endswith("</div> ")


def test_deep_nesting_and_long_words():
    assert pack("<div> " * 5000, 100, 10)[-1][1] == 30000
    assert [c for _, _, c in pack("x" * 25 + " y", 10, 0)] == [26, 26, 0]
    assert pack("", 10, 0) == []


def test_operator_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "short", "a"), (3, "short", "a"), (4, "a" * 9001, "b"), (5, "w " * 5000, "c")]
    df = spark.createDataFrame(rows, "id long, text string, piece string")
    got = split_oversized(df, "id", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {3, 4, 5}
    assert len(by[3]) == 2
    assert [r["cut_run"] for r in sorted(by[4], key=lambda r: r["piece"])] == [9001, 9001, 0]
    assert all(len(r["piece_text"]) <= 4000 for r in got)
    assert split_oversized(df.limit(0), "id", "text").collect() == []


def test_bad_parameters(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(ValueError):
        split_oversized(df, "id", "text", limit=10, overlap=10)
    with pytest.raises(ValueError):
        split_oversized(df, "id")


def test_declared_charset_and_found_query(spark, tmp_path):
    body = ("é" * 4001).encode("latin-1")
    words = ("mot " * 1200).encode()
    rows = [
        (1, {"Content-Type": "Text/Plain; Charset=ISO-8859-1"}, body),
        (1, {"Content-Type": "Text/Plain; Charset=ISO-8859-1"}, body),
        (2, {"content-type": "text/plain"}, words),
        (3, {"content-type": "text/html"}, words),
        (4, {}, words),
        (5, {"content-type": "text/plain"}, None),
        (6, {"content-type": "text/plain"}, b"\xff" * 10),
    ]
    df = spark.createDataFrame(rows, "fetch_id long, headers map<string,string>, body binary")
    df.write.parquet(str(tmp_path / "fetch_result.parquet"))
    from weftline.llm.queries_records import p1_found

    assert sorted(map(tuple, p1_found(spark, str(tmp_path)).collect())) == [(1, "forced"), (2, "natural")]
