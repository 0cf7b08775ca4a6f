"""p6: pairs against brute force, canonical claims and edge cases."""

import random

from pyspark.sql import functions as F

from weftline.llm.claims import canonical, is_slip, must_agree, same_statement, slips
from weftline.llm.overlap import allowed_slips, same_records


def test_same_statement_cases():
    base = "The Festwen dam was completed on 20 June 1798 at a cost of 5,889 crowns in Rovik."
    same = [
        "the festwen dam was completed on June 20, 1798 at a cost of 5889 crowns in rovik",
        "- Festwen dam was completed on 20 June 1798 at a cost of 5 889 crowns in Rovik. [2]",
        "The  Festwen dam was compelted on 1798-06-20 at the cost of 5.889 crwons in Rovik .",
        "On 20 June 1798, the Festwen dam was completed at a cost of 5,889 crowns in Rovik.",
    ]
    other = [
        base.replace("5,889", "5,888"),
        base.replace("1798", "1799"),
        base.replace("Festwen", "Galbury"),
        base.replace("was", "was not"),
        base.replace("dam", "dome"),
    ]
    a = canonical(base)
    assert all(same_statement(a, canonical(t), 3) for t in same)
    assert not any(same_statement(a, canonical(t), 3) for t in other)
    assert canonical(None) == canonical("  ") == canonical("[3]") == []


def test_slips():
    assert slips("abc", "abc") == 0 and slips("survey", "surrvey") == 1 and slips("ab", "ba") == 1 and slips("abcd", "wxyz") == 3
    assert is_slip("quarry", "qaurry") and not is_slip("minor", "major") and not is_slip("northern", "southern") and not is_slip("map", "mop")


def records(n, seed):
    rnd = random.Random(seed)
    names = ["".join(rnd.choice("bdfgklmnprstv") + rnd.choice("aeiou") for _ in range(4)) for _ in range(40)]
    out = []
    for k in range(n):
        words = ["tower", rnd.choice(names), "opened", str(rnd.randint(1, 4)), "rooms", rnd.choice(names), "yearly", rnd.choice(names[:4])]
        if rnd.random() < 0.3:
            w = rnd.choice([0, 2, 4, 6])
            words[w] = words[w][:2] + words[w][1] + words[w][2:]
        out.append((k, " ".join(words), rnd.random() < 0.5))
    return out


def test_brute_force(spark):
    rows = records(400, 3)
    rows += [(900 + k, rows[0][1], k % 2 == 0) for k in range(30)]  # a hot class
    rows += [(2000 + k, f"{k % 3} 4{k % 2} rives" if k % 2 else f"{k % 3} 41 rivers", k % 4 < 2) for k in range(24)]  # few free tokens
    rows += [(1000, None, True), (1001, " ", False), (1002, "alone", None), (1003, "alone", True), (1004, "alone", False), (1004, "alone", False)]
    df = spark.createDataFrame(rows, "id long, text string, side boolean")
    got = [(r["a"], r["b"]) for r in same_records(df, "id", "text", F.col("side"), canonical=canonical, verify=same_statement, must_agree=must_agree).collect()]
    assert len(got) == len(set(got))
    unique = {r[0]: r for r in rows}
    want = set()
    for a in unique.values():
        for b in unique.values():
            if a[2] is True and b[2] is False:
                x, y = canonical(a[1]), canonical(b[1])
                if x and y and len(x) == len(y) and (x == y or same_statement(x, y, allowed_slips(len(x)))):
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert set(got) == want


def test_empty(spark):
    df = spark.createDataFrame([], "id long, text string, side boolean")
    assert same_records(df, "id", "text", F.col("side"), canonical=canonical, verify=same_statement, must_agree=must_agree).collect() == []
