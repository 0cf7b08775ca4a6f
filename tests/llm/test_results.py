"""p2 and p5: values cut and answers spoilt on purpose, and the written cases."""

import json
import random

from pyspark.sql import functions as F

import numpy as np

from weftline.llm.answers import LABELS, calibrate, defects, facts, features, fit, flags, is_nothing, language, overlap, read, scores
from weftline.llm.cutoff import ENCODINGS, body_ending, cut_values, ending, lengths, output_ending

NAMES = ["Garwen", "Lusano", "Teldor", "Brinmor", "Quasel", "Denham", "Wolgard"]


def reason(rnd):
    n, m = rnd.sample(NAMES, 2)
    return rnd.choice(
        [
            f"The record for {n} agrees with the 1931 date given by the {m} Survey",
            f"Reliable accounts place {n} in {m}, so the stated location is wrong",
            f"No reliable knowledge about {n} is available, so the harbour cannot be checked",
            f"Evidence item 4 contradicts the claim because it dates {n} to 1876",
        ]
    )


def claim(rnd):
    n, m = rnd.sample(NAMES, 2)
    return f"The {rnd.choice(['harbour', 'mill', 'tower'])} of {n} was {rnd.choice(['opened', 'closed'])} by the {m} Council in {rnd.randint(1800, 1999)}."


def output(text):
    return json.dumps({"prediction": "FACTUAL", "confidence": 0.8, "rationale": text}, ensure_ascii=False)


def test_endings():
    assert ending("All is well.").state == "closed" and ending("").state == "closed" and ending("none").state == "closed"
    assert ending("It was said that…").state == "cut" and ending("…").state == "closed" and ending("Done. ...").state == "closed"
    assert ending("one, two,").state == "cut" and ending("he was bo").state == "open"
    assert output_ending('{"a": "b')[0].state == "cut"
    assert output_ending('```json\n{"rationale": "It is so."}\n```')[0].state == "closed"
    assert output_ending('{"rationale": "and the"}')[0].state == "open"
    assert body_ending("<p>It ended.", "text/html")[0].state == "closed"
    assert body_ending("<p>x</p><a hr", "text/html")[0].state == "cut"
    assert body_ending('{"a": [1, 2', "application/json")[0].state == "cut"
    assert len(lengths("aé\n")) == len(ENCODINGS) and lengths("é\r\n")[:2] == [3, 4]


def test_cut_values(spark):
    rnd = random.Random(2)
    results, want = [], set()
    for k in range(400):
        text = reason(rnd) + rnd.choice([".", ".", ".", ""])
        raw = output(text)
        if k % 8 == 0:
            long = text.rstrip(".") + ", and " + reason(rnd).lower() + ", while " + reason(rnd) + "."
            text = long[:120]
            raw = output(text)
            want |= {("rationale", k), ("raw_model_output", k)}
        elif k % 8 == 1:
            raw = raw[: rnd.randint(20, len(raw) - 2)]
            text = None
            want.add(("raw_model_output", k))
        results.append((k, "m", claim(rnd), text, raw))
    results += [(900, "m", None, None, None), (901, "m", None, "", ""), (902, "m", "x", "none", "``` ```"), results[0]]
    sentences = [f"The mill of {rnd.choice(NAMES)} was opened by the {rnd.choice(NAMES)} Council in 1901." for _ in range(60)]
    bodies = [(k, "h", (" ".join(sentences[k : k + 6]) + "\n").encode(), "utf-8", "text/plain") for k in range(30)]
    bodies += [(100, "h", " ".join(sentences[:3]).encode()[:-16], "utf-8", "text/plain"), (101, "h", b"", None, "text/html"), (102, "h", None, None, "text/html")]
    bodies += [(103, "h", ("<p>" + sentences[0] + "</p><p>The mill of").encode(), "utf-8", "text/html"), (104, "h", ("<p>" + sentences[1] + "</p>").encode(), "utf-8", "text/html")]
    want |= {("body", 100), ("body", 103)}
    r = spark.createDataFrame(results, "id long, source string, about string, rationale string, raw_model_output string").withColumn("why", F.lit(1))
    b = spark.createDataFrame(bodies, "id long, source string, body binary, charset string, media string")
    got = [(x["field"], x["id"]) for x in cut_values(r, b).collect()]
    assert len(got) == len(set(got))
    missed, extra = want - set(got), set(got) - want
    assert len(missed) <= 2 and not extra, (missed, extra)
    assert cut_values(r.limit(0), b.limit(0)).collect() == []


def test_parts_of_answers():
    assert read(None).shape == "none" and read("```json\n```").prose == "" and read('["FACTUAL", 0.5, "It is so."]').prose == "It is so."
    assert read('{"label": "X", "explanation": "Why."}').prose == "Why." and read('{"rationale": "brok').shape == "broken"
    assert is_nothing(" N/A ") and is_nothing("…​") and not is_nothing("Wrong.")
    assert language("The date of the record is not known") == "en" and language("Источники подтверждают") == "ru" and language("この主張は") == "ja"
    assert language("Das Jahr ist nicht bekannt") == "de" and language("xyz") == ""
    assert overlap("the claim states that a b c", "a b c")[0] == 1.0


def test_defects(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    german = ["Das genannte Jahr passt nicht, da der Ort erst später erwähnt wird.", "Über den Ort liegt kein verlässliches Wissen vor."]
    deutsch = ["Im Frühjahr zählte die Brücke von {} etwa 40 Mitglieder aus der Stadt.", "Die Mühle von {} wurde für den Ort und die Stadt geöffnet."]
    for k in range(900):
        c, t = claim(rnd), reason(rnd) + "."
        if k % 5 == 4:
            c, t = rnd.choice(deutsch).format(rnd.choice(NAMES)), rnd.choice(german)
        raw = output(t)
        kind = k % 30
        if kind == 0:
            raw, want[k] = rnd.choice([None, "", "  ", output("-"), '{"prediction": "UNKNOWN"}']), "empty"
        elif kind == 1:
            raw, want[k] = raw[: rnd.randint(12, len(raw) - 20)], "truncated"
        elif kind == 2:
            raw, want[k] = rnd.choice(["I'm sorry, but I can't help with judging statements about Garwen.", output("My guidelines do not allow me to evaluate claims about it.")]), "refusal"
        elif kind == 3:
            raw, want[k] = rnd.choice([output("The claim states that " + c), c.lower(), json.dumps({"gold_claim": c})]), "copy"
        elif kind == 5:
            raw, want[k] = output(rnd.choice(german)), "language"
        elif kind == 6:
            raw = "The claim is FACTUAL. " + t
        elif kind == 7:
            raw = output("Well attested.")
        rows.append((k, c, raw, "m", None if read(raw).shape != "json" else "UNKNOWN" if kind == 2 else "FACTUAL"))
    rows += [(9000, None, output(reason(rnd) + "."), "m", None), rows[0]]
    df = spark.createDataFrame(rows, "result_id long, gold_claim string, raw_model_output string, model string, prediction string").withColumn("defect", F.lit("x"))
    got = {r["result_id"]: r["defect"] for r in defects(df, "result_id", "raw_model_output", "gold_claim", "model", "prediction").collect()}
    wrong = {k: (got.get(k), want.get(k)) for k in {*got, *want} if got.get(k) != want.get(k)}
    assert len(wrong) <= 0.04 * len(want), wrong
    empty = df.limit(0)
    assert defects(empty, "result_id", "raw_model_output", "gold_claim", "model", "prediction").collect() == []


def test_untrained_classifier_proposes_nothing_wrong():
    model = fit([])
    f = facts([output("It is well known that the mill was opened."), None], ["The tower of X was closed in 1900.", None])
    found = flags(f, scores(model.weights, model.bias, features(f, [None, None])), model.threshold)
    assert not found[0, 2:].any() and found[1, 0]
    none = facts([], [])
    assert scores(model.weights, model.bias, features(none, [])).shape == (0, len(LABELS))


def test_facts_agree_with_single_texts():
    rnd = random.Random(6)
    outputs = [output(reason(rnd)) for _ in range(50)] + [output("Das ist «the Mill» nicht bekannt"), "Источники", None, "", output("この主張は")]
    claims = [claim(rnd) for _ in outputs]
    f = facts(outputs, claims)
    for i, (o, c) in enumerate(zip(outputs, claims)):
        share, added = overlap(read(o).prose, c)
        assert abs(f.share[i] - share) < 1e-9 and f.added[i] == added and f.theirs[i] == language(c)
    assert f.ours[50] == "de" and f.ours[51] == "ru" and f.ours[54] == "ja" and f.nothing[52]


def test_thresholds_come_from_held_out_answers():
    rnd = np.random.default_rng(1)
    target = (rnd.random((4000, len(LABELS))) < 0.2).astype(np.float32)
    score = np.clip(0.2 + 0.6 * target + 0.05 * rnd.standard_normal(target.shape), 0.01, 0.99)
    t = calibrate(score, target)
    k = LABELS.index("refusal")
    assert (score[target[:, 0] == 0, 0] >= t[0]).mean() <= 0.021 and (score[target[:, 0] == 1, 0] >= t[0]).all()
    assert 0.4 < t[k] < 0.65 and calibrate(score[:0], target[:0]).tolist() == [0.5] * len(LABELS)


def test_whole_values_are_read():
    assert body_ending(" " * 5000 + "<p>It was said.</p><a hr", "text/html")[0].state == "cut"
    assert body_ending("<p>x</p><script>" + "var a = 1;\n" * 9000, "text/html")[0].state == "cut"
    assert body_ending("<p>x</p><a title='" + "y " * 9000, "text/html")[0].state == "cut"
    assert body_ending("<p>It ended &amp", "text/html")[0].state == "cut" and body_ending("<p>It ended &Counter", "text/html")[0].state == "cut"
    assert body_ending("<p>A rule of R & D it was.", "text/html")[0].state == "closed"
    before = "<p>He spoke of " + "<b> </b>" * 200 + "mills"
    assert body_ending(before, "text/html")[0].key == "of mills"
    assert ending("the word " + "a" * 500 + " " + "b" * 300).key == "a" * 500 + " " + "b" * 300
    assert ending(b"K\xc3\xa4se und K\xc3".decode("utf-8", "replace")).state == "cut"
    assert ending("lost � here and �").state == "closed"
    assert ending("ذهب الرجل إلى المدينة ثم عاد").state == "open" and ending("TABLE OF UNITS").state == "closed"
