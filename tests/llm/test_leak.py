"""p9: passages against brute force over normalised words, and the written cases."""

import random
import re
import unicodedata

from weftline.llm import leak
from weftline.llm.leak import banded_alignment, passages, reduce_words

ITEM = "In Corixolt, the Lemeekkyn Brewery kept 38,987 musicians while Pellett Plesixolt widely measured the Boamquazz viaduct before the winter storms."


def plain_words(text):
    text = unicodedata.normalize("NFKD", re.sub(r"</?\w[^<>]*>|\[\d+\]", " ", text).casefold())
    return re.findall(r"[^\W_]+", "".join(c for c in text if not unicodedata.combining(c)))


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string, run int")
    i = spark.createDataFrame(items, "item_id long, text string")
    how = {"exact": True} | how
    return sorted((r["doc_id"], r["item_id"]) for r in passages(d, "doc_id", "text", i, "item_id", "text", **how).collect())


def test_written_cases(spark):
    words = ITEM.split()
    short = " ".join(words[3:15])  # "38,987" counts as two words
    docs = [
        (1, ITEM, 0),
        (2, "noise " + ITEM.upper().replace(",", "") + " noise", 0),
        (3, "> In Corixolt, the Leme-\n> ekkyn Brewery kept\n> 38,987 musicians while [3] Pellétt <b>Plesixolt</b> widely\n measured the Boamquazz", 0),
        (4, " ".join(words[:11]), 0),
        (5, ITEM.replace("musicians", "farmers"), 0),
        (6, None, 0),
        (7, "", 0),
        (8, "x" + ITEM, 0),
        (9, short, 0),
        (10, "filler text " * 30000 + ITEM, 0),
    ]
    assert len(plain_words(short)) == 13
    assert len(plain_words(" ".join(words[:11]))) == 12
    items = [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "only a few words")]
    assert found(spark, docs, items) == [(1, 1), (2, 1), (3, 1), (8, 1), (9, 1), (10, 1)]
    assert found(spark, docs, items, block_chars=50) == [(1, 1), (2, 1), (3, 1), (8, 1), (9, 1), (10, 1)]
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []
    # Another word alone breaks the run; with edits allowed the near passage is found as well.
    near = found(spark, [(5, ITEM.replace("musicians", "musicans"), 0)], items, exact=False)
    assert near == [(5, 1)]


def test_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = ["alpha", "beta", "gammas", "delta", "epsilon", "zeta", "etas", "theta", "iotas", "kappa"]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(20))) for k in range(12)]
    docs = []
    for k in range(150):
        w = rnd.choice(items)[1].split()
        n, a = rnd.randint(9, 17), rnd.randint(0, 3)
        filler = [rnd.choice(vocabulary) for _ in range(10)]
        docs.append((k, " ".join(filler[:5] + w[a : a + n] + filler[5:]), 0))
    want = []
    for d, t, _ in docs:
        dw = plain_words(t)
        runs = {tuple(dw[p : p + 13]) for p in range(len(dw) - 12)}
        want += [(d, i) for i, s in items if any(tuple(plain_words(s)[p : p + 13]) in runs for p in range(8))]
    assert found(spark, docs, items) == sorted(want)


def test_parts():
    r = reduce_words(["É-t é", "", "a[1]b"])
    assert r.points.tobytes().decode("utf-32-le") == "eteab"
    assert r.begin.tolist() == [0, 3, 3, 5]
    assert r.first.tolist() == [1, 1, 1, 1, 1]
    assert banded_alignment("abcdef", "xxabcdefyy", 0, 0)[0] == 0
    assert banded_alignment("abcdef", "abXdef", 1, 1)[0] == 1
    assert banded_alignment("abcdef", "abdef", 2, 1)[0] == 1
    assert banded_alignment("abcdef", "zzzzzz", 1, 2)[0] == 3


def test_open_tag_stays_in_its_text(spark):
    texts = ["it ends in an open <name", "> a quoted line", "another <b", ITEM]
    assert len(reduce_words(texts).begin) == len(texts) + 1
    docs = [(k, t, 0) for k, t in enumerate(texts)]
    assert found(spark, docs, [(100, ITEM)]) == [(3, 100)]


def test_long_tags_and_shared_grams_in_parts(spark, monkeypatch):
    words = ITEM.split()
    tagged = " ".join(words[:8]) + ' <a title="' + "z " * 2000 + '">' + " ".join(words[8:]) + "</a>"
    assert found(spark, [(1, tagged, 0)], [(1, ITEM)]) == [(1, 1)]
    # Many items share all their grams with a text; counting in small parts finds the same.
    index = leak.ItemIndex(list(range(30)), [ITEM + f" tail {k}" for k in range(30)], 13, 1, 16)
    doc = reduce_words([ITEM, "nothing of it", ITEM + " " + ITEM])
    whole = leak._verified(index, doc, True)
    monkeypatch.setattr(leak, "PART_HITS", 50)
    assert leak._verified(index, doc, True) == whole and {d for d, _ in whole} == {0, 2} and len(whole) == 60


def test_alignment_decides_before_words(monkeypatch):
    index = leak.ItemIndex([1], [ITEM], 13, 1, 16)
    doc = reduce_words([ITEM])
    assert leak._verified(index, doc, True)
    monkeypatch.setattr(leak, "banded_alignment", lambda *a: (99, 0, 0))
    assert not leak._verified(index, doc, True)
