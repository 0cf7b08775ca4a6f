"""p4 and p7: pages composed on purpose, labels held out, residue planted, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm.blocks import block_key, fit, headline, label_pages, main_blocks, parse, scores, teach, features
from weftline.llm.residue import PLACEHOLDER, build_index, covered_words, frequencies, is_residue, placeholders, read_pages, read_texts, words_of

NOUNS = "harbour mill archive river tower ledger garden school bridge market".split()
VERBS = "opened closed moved repaired surveyed funded measured described".split()


def sentence(rnd):
    return f"The {rnd.choice(NOUNS)} of {rnd.choice('ABCDEFGH')}{rnd.choice(NOUNS)} was {rnd.choice(VERBS)} in {rnd.randint(1800, 1999)} after a long debate."


def page(rnd, layout, body=None):
    head = sentence(rnd)
    paragraphs = [" ".join(sentence(rnd) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(2, 5))] if body is None else body
    nav = "".join(f'<li><a href="/{w}">{w.title()}</a></li>' for w in rnd.sample(["home", "news", "shop", "jobs", "maps", "about"], 4))
    teasers = "".join(f'<li><a href="/r">{sentence(rnd)}</a></li>' for _ in range(3))
    foot = f"<p>© {rnd.randint(2000, 2024)} Media. All rights reserved.</p><a href='/p'>Privacy</a>"
    inner = "".join(f"<p>{p}</p>" for p in paragraphs)
    inner = inner.replace("</p><p>", f"</p><aside>Read also: {sentence(rnd)}</aside><p>", 1)
    title = f"<html><head><title>{head} | host</title><script>var a='<p>no</p>'</script></head><body>"
    if layout == 0:
        html = f"<nav><ul>{nav}</ul></nav><main><article><h1>{head}</h1>{inner}</article></main><p>By Ann Lee, 4 May 1999</p><aside><ul>{teasers}</ul></aside><footer>{foot}</footer>"
    elif layout == 1:
        html = f"<div class=c12ab><ul>{nav}</ul></div><div class=c34cd><h1>{head}</h1>{inner}</div><div class=c99><ul>{teasers}</ul></div><div class=c55>{foot}</div>"
    else:
        html = f"<div id=menu><ul>{nav}</ul></div><div id=content><h1>{head}</h1>{inner}</div><div id=foot>{foot}</div>"
    return title + html + "</body></html>", [head, *paragraphs]


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(4)
    return fit([parse(page(rnd, k % 3)[0]) for k in range(150)], epochs=8)


def test_parse():
    blocks, title = parse("<title>T &amp; x</title><p>a <b>b</b>c<br>d &uuml;<!-- no --></p><script>x<y</script><ul><li>e<li>f</ul>tail <a hr")
    assert title == "T & x"
    assert [b.text for b in blocks] == ["a bc", "d ü", "e", "f", "tail"]
    assert parse("") == ([], "") and parse("<")[0][0].text == "<"
    assert parse("<p " + "x" * 100_000)[0] == []
    assert block_key("Éa B-9! ü" + "x" * 60) == "ab9" + "x" * 45


def test_held_out_pages(model):
    rnd = random.Random(9)
    right = wrong = 0
    for k in range(60):
        html, main = page(rnd, k % 3)
        blocks, title = parse(html)
        got = {block_key(b.text) for b, s in zip(blocks, label_pages(model, [(blocks, title)])[0]) if s >= 0.5}
        want = {block_key(t) for t in main}
        right += len(got & want)
        wrong += len(got ^ want)
    assert wrong <= 0.03 * right


def test_gradient_and_batches_agree(model):
    rnd = random.Random(3)
    pages = [parse(page(rnd, k % 3)[0]) for k in range(7)]
    alone = [label_pages(model, [p])[0] for p in pages]
    together = label_pages(model, pages + [([], "")])
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(alone, together)) and len(together[-1]) == 0
    assert scores(model, [features(*pages[0])])[0].shape == (len(pages[0][0]),)
    assert teach([], "") is None and headline([], "x") == -1


def test_main_blocks_operator(spark, model):
    rnd = random.Random(5)
    html, main = page(rnd, 1)
    rows = [(1, html.encode(), 0), (1, html.encode(), 0), (2, None, 0), (3, b"", 0), (4, b"<p>", 0), (5, b"\xff\xfe<p>x" * 3, 0)]
    df = spark.createDataFrame(rows, "fetch_id long, body binary, block_key int")
    got = main_blocks(df, "fetch_id", "body", F.lit("utf-8"), model).collect()
    keys = [r["block_key"] for r in got if r["fetch_id"] == 1]
    assert {block_key(t) for t in main} <= set(keys) and len(keys) == 2 * len(set(keys))
    assert not [r for r in got if r["fetch_id"] in (2, 3, 4)]
    empty = df.limit(0)
    assert main_blocks(empty, "fetch_id", "body", F.lit("utf-8"), model).collect() == []


def test_residue(spark, model):
    rnd = random.Random(6)
    notice = ["Access denied", "You do not have permission to view this resource. Reference 12."]
    lorem = ["Veniam dolor sit amet lorem ipsum magna aliqua enim nostrud.", "Lorem ipsum dolor sit amet elit magna."]
    rows, want = [], set()
    for k in range(12):
        kind = k % 6
        if kind == 0:
            html = page(rnd, k % 3, notice)[0]
        elif kind == 1:
            html = page(rnd, k % 3, lorem)[0]
        elif kind == 2:
            html = page(rnd, k % 3, [sentence(rnd), "Born in {{ article.place }} and later moved.", sentence(rnd)])[0]
        elif kind == 3:
            html = page(rnd, k % 3, [sentence(rnd), "A tag such as {{ name }} is filled in by the printer.", sentence(rnd)])[0]
        elif kind == 4:
            html = "<html><body><noscript>You need to enable JavaScript to run this app.</noscript><div id=root></div></body></html>"
        else:
            html = page(rnd, k % 3)[0].replace("<body>", "<body><noscript>Please enable JavaScript to view this page.</noscript>")
        rows.append((k, html.encode()))
        if kind in (0, 1, 2, 4):
            want.add(k)
    rows += [(100, None), (101, b"")]
    df = spark.createDataFrame(rows, "fetch_id long, body binary")
    index = build_index(*frequencies(df, "body", F.lit("utf-8")))
    read = read_pages(df, "fetch_id", "body", F.lit("utf-8"), model, index)
    assert {r["fetch_id"] for r in read.where(is_residue()).collect()} == want
    texts = spark.createDataFrame([(1, b"Access denied\nYou do not have permission to view this resource."), (2, sentence(rnd).encode()), (3, None)], "fetch_id long, body binary")
    assert [r["fetch_id"] for r in read_texts(texts, "fetch_id", "body", F.lit(None), index).where(is_residue()).collect()] == [1]
    assert frequencies(df.limit(0), "body", F.lit("utf-8"))[0] == 0


def test_parts():
    assert placeholders("Dear [FIRST NAME], see ${link}") and not placeholders("costs [12] 5% or 10% more")
    assert all(PLACEHOLDER.search(t) for t in ("{{x}}", "${a}", "@@intro@@", "__BODY_TEXT__", "%TITLE%", "<%= page.title %>", "{caption}", "XX-DATE-XX", "[Insert summary here]"))
    index = build_index(0, {})
    assert covered_words([], index).tolist() == [] and covered_words(words_of("Access denied"), index).all()
    assert not covered_words(words_of("The river floods every year"), index).any()
