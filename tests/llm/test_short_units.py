"""p5: a short shape clears a value only if it is a whole unit often enough, and never a broken word."""

from pyspark.sql import functions as F

from weftline.llm.cutoff import _beginnings, cut_values

NAMES = ["Garwen", "Lusano", "Teldor", "Brinmor", "Quasel", "Denham", "Wolgard"]


def found(spark, texts):
    rows = [(k, "h", t.encode(), "utf-8", "text/plain") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, source string, body binary, charset string, media string").withColumn("why", F.lit(1))
    return {r["id"]: r["why"] for r in cut_values(None, df).collect()}


def test_beginnings():
    assert _beginnings("The mill of Garwen", True) == ["N", "N mill", "N mill of"]
    assert _beginnings("It was so.", False) == ["N", "N was", "N was so"]
    assert _beginnings("a b c d e f g h", True) == ["a", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f"]
    assert _beginnings("Garwen", True) == []


def test_short_units(spark):
    some = [f"The mill of {n} was opened by the {m} Council after the flood had ended." for n in NAMES for m in NAMES]
    lines = [f"The mill of {n} was\nShort notes about {n}\nPlans for {n} harbou" for n in NAMES[:3]]
    texts = [" ".join(some[k : k + 5]) for k in range(40)] + [x + "\nAll is well that ended well." for x in lines]
    n = len(texts)
    ends = ["The mill of Garwen was", "Short notes about Denham", "Plans for Quasel harbou"]
    got = found(spark, texts + [f"{some[0]}\n{e}" for e in ends])
    assert got == {n: "sentence", n + 2: "word"}  # the shape begins sentences; a whole line; a broken word
