"""p7: notices in words of no exemplar, told by where they stand; numbers, chance words and forms that misled before."""

import random

from pyspark.sql import functions as F

from weftline.llm.blocks import features, fit, parse
from weftline.llm.residue import SCORE, _may_cover, build_index, covered_words, frequencies, is_residue, line_key, placeholders, read_pages, read_texts, words_of

NOUNS = "harbour mill archive river tower ledger garden school bridge market".split()


def sentence(rnd):
    return f"The {rnd.choice(NOUNS)} of {rnd.choice('ABCDEFGH')}{rnd.choice(NOUNS)} paid {rnd.randint(100, 999)} crowns to {rnd.choice('KLMNOP')}{rnd.choice(NOUNS)}."


def page(head, body):
    inner = "".join(f"<p>{p}</p>" for p in body)
    return (
        f"<html><head><title>{head} | host</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"
        f"<main><article><h1>{head}</h1>{inner}</article></main><footer><p>All stories stay the property of their writers.</p></footer></body></html>"
    )


def test_lines_that_stand_alone(spark):
    rnd = random.Random(3)
    notice, aside = "Gleaming pebbles hum quietly beneath %s tonight.", "Nobody was hurt."
    rows, want = [], set()
    for k in range(40):
        rows.append((k, page(sentence(rnd), [*(sentence(rnd) for _ in range(4)), *([aside] if k < 30 else [])])))
    rows += [(k, page(sentence(rnd), [aside])) for k in range(40, 43)]  # an article that breaks off early
    for k in range(50, 56):
        rows.append((k, page(f"Pebbles {k}", [notice % f"town-{k}.example"])))
        want.add(k)
    rows += [(60, page(sentence(rnd), [notice % "town.example", *(sentence(rnd) for _ in range(6))]))]  # beside its content
    often = page(sentence(rnd), [sentence(rnd)])  # one short article under many keys
    rows += [(k, often) for k in range(80, 88)]
    rows += [rows[50]] * 3 + [(70, None), (71, "")]
    model = fit([parse(p) for _, p in rows[:40]], epochs=8)
    df = spark.createDataFrame([(k, p if p is None else p.encode()) for k, p in rows], "fetch_id long, body binary").withColumn("line", F.lit("x"))
    got = read_pages(df, "fetch_id", "body", F.lit(None), model, build_index(*frequencies(df, "body", F.lit(None))))
    assert {r["fetch_id"] for r in got.where(is_residue()).collect()} == want
    assert got.count() == len(rows) - 2 and got.where("block_keys is not null").count() == len(rows) - 2
    bare = read_pages(df, "fetch_id", "body", F.lit(None), model, build_index(0, {}), keys=False)
    assert bare.where("block_keys is not null").count() == 0 and bare.count() == len(rows) - 2
    assert read_pages(df.limit(0), "fetch_id", "body", F.lit(None), model, build_index(0, {})).collect() == []


def test_host_names_do_not_tell_lines_apart():
    one, two = "Allow it for old-town.example now", "Allow it for a.b.test now"
    assert line_key(one, words_of(one)) == line_key(two, words_of(two)) != line_key("Allow it now", words_of("Allow it now"))


def test_numbers_are_in_no_exemplar(spark):
    rnd = random.Random(5)
    table = "\n".join(" ".join(str(rnd.randint(1, 999)) for _ in range(9)) for _ in range(40))
    text = f"{sentence(rnd)}\n{table}\n{sentence(rnd)}"
    df = spark.createDataFrame([(1, text.encode()), (2, b"404 not found")], "fetch_id long, body binary")
    index = build_index(*frequencies(df, "body", F.lit(None)))
    assert [r["fetch_id"] for r in read_texts(df, "fetch_id", "body", F.lit(None), index).where(is_residue()).collect()] == [2]


def test_few_words_of_a_label_are_chance():
    index = build_index(4000, {"it": 1200, "did": 78, "not": 1800, "last": 79})
    assert not covered_words(words_of("It did not last."), index).any() and covered_words(words_of("Access denied"), index).all()


def test_doubled_percent_signs():
    assert placeholders("By 1989 the mill at %%TITLE%% was sold") and not placeholders("a tag such as %%TITLE%% is filled in") and not placeholders("5 %% of it")


def test_frequencies_by_word(spark):
    bodies = ["Error 404: “page” not-found", "page2x ERREUR éCHEC été", "été—page", "", None]
    df = spark.createDataFrame([(b if b is None else b.encode(),) for b in bodies], "body binary")
    total, got = frequencies(df, "body", F.lit(None), ["été 9"])
    assert total == 3 and (got["page"], got["not"], got["found"], got["error"], got["9"], got["été"]) == (3, 1, 1, 1, 2, 2)


def test_long_tables_are_not_opened():
    index = build_index(4000, {"of": 3000, "the": 3500})
    assert not _may_cover(["of", "the", *["9"] * 5000], index) and _may_cover(["x"] * 90 + words_of("You need to enable JavaScript to run this app."), index)


def test_pruned_windows_agree_with_all_windows():
    rnd = random.Random(8)
    index = build_index(500, {w: rnd.randint(0, 400) for w in ("the", "of", "page", "not", "error")})
    words = [*rnd.sample(sorted(index.weight), 60), *["the", "of", "page", "not", "9"] * 8, "unseen", "unheard"]
    for _ in range(600):
        given = [rnd.choice(words) for _ in range(rnd.randint(1, 30))]
        size, want = min(8, len(given)), [False] * len(given)
        for a in range(len(given) - size + 1):
            part = given[a : a + size]
            total = sum(index.weight.get(w, index.rare) for w in part)
            best = max((sum(index.weight[w] for w in part if e in index.of.get(w, ())) for e in range(index.given)), default=0)
            if best >= SCORE * total and 2 * part.count("9") <= size:
                want[a : a + size] = [True] * size
        assert covered_words(given, index, labels=False).tolist() == want


def test_kept_texts_give_the_same_features():
    page = "<title>A page of it</title><h1>A page of it</h1><p>In 1999 %s</p><p>_x_ y</p><p>%s</p>" % ("it was 12 years old. " * 30, "w" * 70)
    first, again = features(*parse(page)), features(*parse(page))
    assert all((a == b).all() for a, b in zip(first, again)) and first.measures[1][10] > 0
