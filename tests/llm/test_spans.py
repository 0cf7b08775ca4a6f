"""p10: shared spans against brute force, hot groups, shares and removal."""

import random

from weftline.llm.spans import found_pairs, link_counts, removed_spans, shared_share, shared_spans


def brute(texts, least):
    out = set()
    for a, ta in texts.items():
        grams = {ta[p : p + least] for p in range(len(ta) - least + 1)}
        for b, tb in texts.items():
            if a < b and any(tb[p : p + least] in grams for p in range(len(tb) - least + 1)):
                out.add((a, b))
    return out


def pairs(spark, rows, least=40, step=5):
    df = spark.createDataFrame(rows, "doc_id long, text string, a long")
    return df, shared_spans(df, "doc_id", "text", least=least, step=step)


def test_random_runs(spark):
    rnd = random.Random(7)
    texts = {}
    pool = ["".join(rnd.choice("abcd e.\n日") for _ in range(90)) for _ in range(12)]
    for k in range(120):
        parts = []
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(pool)
            a = rnd.randint(0, 50)
            parts.append(s[a : a + rnd.randint(30, 50)])
        texts[k] = "".join("".join(rnd.choice("xyz. ") for _ in range(rnd.randint(0, 30))) + p for p in parts)
    rows = [(k, t, 0) for k, t in texts.items()] + [(900, None, 0), (901, "", 0), (902, "ab" * 4000, 0), (903, "ab" * 3000, 0)]
    df, shared = pairs(spark, rows)
    texts |= {902: "ab" * 4000, 903: "ab" * 3000}
    got = [(r["a"], r["b"]) for r in found_pairs(shared, "doc_id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(texts, 40)


def test_hot_group_share_and_removal(spark):
    rnd = random.Random(8)
    common = "".join(rnd.choice("abcdefgh .") for _ in range(60))
    almost = "".join(rnd.choice("abcdefgh .") for _ in range(28))
    texts = {k: f"{k:04d}|" + common[:50] + f"|{k:04d}|{almost}|{k * 7:05d}" for k in range(90)}
    df, shared = pairs(spark, [(k, t, 0) for k, t in texts.items()])
    got = {(r["a"], r["b"]) for r in found_pairs(shared, "doc_id").collect()}
    assert got == {(a, b) for a in range(90) for b in range(90) if a < b}
    share = {r["doc_id"]: r["shared_chars"] for r in shared_share(df, "doc_id", "text", shared.spans).collect()}
    assert all(50 <= v <= 56 for v in share.values()), share
    removed = {r["doc_id"] for r in removed_spans(shared.spans, "doc_id").collect()}
    assert removed == set(range(1, 90))


def test_empty_table(spark):
    df, shared = pairs(spark, [])
    assert found_pairs(shared, "doc_id").collect() == [] and shared.spans.collect() == []
    assert shared_share(df, "doc_id", "text", shared.spans).collect() == []


def test_copies_lines_and_links(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    line, run, text = word(50), word(45), word(80)
    texts = {1: text, 2: text, 3: text, 4: word(20) + "\n" + line + " \n" + word(20), 5: line, 6: word(30) + "\n  " + line, 7: run + word(9), 8: word(9) + run, 9: text[:41] + word(5), 10: word(99)}
    df, shared = pairs(spark, [(k, t, 0) for k, t in texts.items()])
    got = [(r["a"], r["b"]) for r in found_pairs(shared, "doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, 40) == {(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (7, 8), (1, 9), (2, 9), (3, 9)}
    links = {r["doc_id"]: (r["text"], r["links"]) for r in link_counts(shared, "doc_id").collect()}
    assert links == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 2), 5: (5, 2), 6: (6, 2), 7: (7, 1), 8: (8, 1), 9: (9, 1)}
    removed = sorted(map(tuple, removed_spans(shared.spans, "doc_id").collect()))
    assert (2, 0, 80) in removed and (3, 0, 80) in removed and (5, 0, 50) in removed and not {1, 4, 7, 10} & {r[0] for r in removed}


def test_both_ways_agree(spark, monkeypatch):
    from weftline.llm import spans

    rnd = random.Random(10)
    parts = ["".join(rnd.choice("abcdefgh. ") for _ in range(60)) for _ in range(5)]
    rows = [(k, "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 20))) + rnd.choice(parts)[rnd.randint(0, 25) :] + f"|{k}", 0) for k in range(60)]
    found = []
    for most in (64, 2):
        monkeypatch.setattr(spans, "PAIR_ROWS", most)
        found.append({tuple(r) for r in found_pairs(pairs(spark, rows)[1], "doc_id").collect()})
    assert found[0] == found[1] == brute({k: t for k, t, _ in rows}, 40)
