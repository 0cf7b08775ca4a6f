"""p3: texts garbled on purpose are found and restored, clean ones are not touched."""

from pyspark.sql import functions as F

from weftline.llm.garble import Finder, Mapping, garbled, learn, rewrite, rewrite_word

GERMAN = "Im Frühjahr führte die Behörde für Fähre und Straße die größere Zählung über {}."
RUSSIAN = "Жители города {} помнят, что старая площадь закрылась летом, хотя новая дорога была готова."
POLISH = "Książka, którą napisał {}, ukazała się w łodzi, gdyż należała do części."


def bodies():
    rows, truth = [], {}

    def add(data, charset, original=None, bad=False):
        rows.append((len(rows), {"content-type": f"text/plain; charset={charset}"} if charset else {}, data))
        if bad:
            truth[rows[-1][0]] = original

    for k in range(60):
        for t in (GERMAN, RUSSIAN, POLISH):
            add(t.format(f"Ort{k}").encode(), "utf-8")
    for k in range(8):
        g, r = GERMAN.format(f"Dorf{k}"), RUSSIAN.format(f"Dorf{k}")
        add(g.encode(), "windows-1252", g, True)
        add(g.encode().decode("cp1251").encode(), "utf-8", g, True)
        add(g.encode().decode("latin-1").encode().decode("cp1252").encode(), "utf-8", g, True)
        add(r.encode("cp1251"), "iso-8859-1", r, True)
        add(r.encode("koi8-r"), "windows-1251", r, True)
        add(g.encode("latin-1"), "utf-8", None, True)  # lost
    add("plain ascii, labelled wrongly".encode(), "windows-1251")
    add(GERMAN.format("Ort").encode("cp1252"), "iso-8859-1")
    add("F&#252;hrt &Uuml;ber".encode(), "utf-8")
    add(b"", "utf-8")
    add(None, None)
    return rows, truth


def test_found_and_restored(spark):
    rows, truth = bodies()
    df = spark.createDataFrame(rows, "fetch_id long, headers map<string,string>, body binary").withColumn("lost", F.lit(1))
    charset = F.regexp_extract(F.col("headers")["content-type"], "charset=(.*)", 1)
    got = {r["fetch_id"]: (r["lost"], r["restored"]) for r in garbled(df, "fetch_id", "body", charset).collect()}
    assert set(got) == set(truth)
    for k, original in truth.items():
        assert got[k][0] == (original is None)
        if original is not None:
            assert got[k][1] == original
    again = {r["fetch_id"] for r in garbled(df, "fetch_id", "body", charset, with_text=False).collect()}
    assert again == set(truth)


def test_empty_table(spark):
    df = spark.createDataFrame([], "fetch_id long, body binary, c string")
    assert learn(df, "fetch_id", "body", F.col("c")) == Mapping([], [], [], {})
    assert garbled(df, "fetch_id", "body", F.col("c")).collect() == []


def test_rewrite():
    assert rewrite("Ã¼", "cp1252", "utf-8") == "ü"
    assert rewrite("ü", "cp1252", "utf-8") is None
    assert rewrite("îò", "latin-1", "cp1251") == "от"
    assert rewrite_word("FrÃ¼hjahr", "cp1252", "utf-8") == "Frühjahr"
    assert rewrite_word("abc", "cp1252", "utf-8") is None
    assert Finder(Mapping([], [], [], {})).restore("Ã¼") == (False, False, "Ã¼")


def test_garbled_many_times():
    finder = Finder(Mapping(["cp1252", "latin-1"], [], list("üßéÄ"), {}))
    text = original = "Früh am Fuß"
    for _ in range(5):
        text = "".join(chr(b) for b in text.encode())
    assert finder.restore(text)[::2] == (True, original)


def test_trie_takes_the_longest():
    from weftline.llm.garble import _trie

    pattern = _trie(["ab", "abc", "b", "xyz", "."])
    assert pattern.findall("abcab.bxyxyz") == ["abc", "ab", ".", "b", "xyz"]


def test_long_runs_are_learned(spark):
    sentence = "这座桥在很久以前就已经建成，可是后来被河水冲走了。人们又把它重新建了起来，现在仍然使用着它，每天都有很多人从上面走过去。"
    joined = "Die größere Zählung über Fähre und Straße für Behörde"
    rows = [(k, t.encode(), "utf-8") for k, t in enumerate([sentence] * 8 + [joined] * 8)]
    rows += [(100 + k, t.encode().decode("latin-1").encode(), "utf-8") for k, t in enumerate([sentence, joined, sentence])]
    df = spark.createDataFrame(rows, "fetch_id long, body binary, c string")
    mapping = learn(df, "fetch_id", "body", F.col("c"))
    assert "latin-1" in mapping.utf8 and set(sentence) - set("，。") <= set(mapping.known) and "ö" in mapping.known
    got = {r["fetch_id"]: r["restored"] for r in garbled(df, "fetch_id", "body", F.col("c"), mapping).collect()}
    assert got == {100: sentence, 101: joined, 102: sentence}
