"""Bootstrap: draws against a plain generator, and their spread against that of resampling."""

from collections import Counter

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.operators import bootstrap as B

_M = 2**64


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % _M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % _M
    return x ^ (x >> 31)


def drawn(seed, b, size):
    """SplitMix64 in plain integers."""
    step = 0x9E3779B97F4A7C15
    state = mixed((mixed((seed + step) % _M) + (b + 1) * step) % _M)
    return [mixed((state + (n + 1) * step) % _M) % size for n in range(size)]


def test_places_are_the_plain_ones():
    for seed, b, size in ((3, 0, 9), (20260722, 199, 600), (-1, 7, 50)):
        assert np.concatenate(list(B.places(seed, b, size))).tolist() == drawn(seed, b, size)


def test_every_place_is_drawn():
    size = 60_000
    seen = np.zeros(size, bool)
    for b in range(25):
        for p in B.places(20260722, b, size):
            seen[p] = True
    assert seen.all()


def test_spread_is_that_of_resampling():
    rnd = np.random.default_rng(5)
    for size in (600, 6_000, 60_000):
        values = rnd.normal(size=(size, 2))
        means = np.array([values[np.concatenate(list(B.places(20260722, b, size)))].mean(0) for b in range(400)])
        spread = means.std(0) / (values.std(0) / size**0.5)
        assert (abs(spread - 1) < 0.15).all(), (size, spread)  # four standard errors


def test_draws_in_spark(spark):
    df = spark.createDataFrame([(f"k{k:03d}",) for k in range(40)], "key string")
    got = Counter((r["replicate"], r["key"]) for r in B.draws(spark, df, "key", 20, 11).collect())
    assert got == Counter((b, f"k{p:03d}") for b in range(20) for p in drawn(11, b, 40))


@pytest.mark.parametrize("block", [B.BLOCK, 7])
def test_intervals_are_those_of_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    rnd = np.random.default_rng(8)
    # Setting z stands in one cluster only, so replicates that miss it have no value.
    rows = [(f"k{k:02d}", s, int(rnd.integers(0, 5)), 5) for k in range(20) for s in ("x", "y")] + [("k03", "z", 1, 2), ("k04", "y", None, 3)]
    df = spark.createDataFrame(rows, "key string, setting string, a long, n long")
    value = F.try_divide(F.col("a"), F.col("n"))
    got = {r["setting"]: tuple(r)[1:] for r in B.resampled(df, "key", ["setting"], value, ["a", "n"], "v", 300, 11).collect()}
    for s in "xyz":
        values = []
        for b in range(300):
            times = Counter(drawn(11, b, 20))
            mine = [(times[int(k[1:])] * (a or 0), times[int(k[1:])] * n) for k, t, a, n in rows if t == s]
            if sum(n for _, n in mine):
                values.append(sum(a for a, _ in mine) / sum(n for _, n in mine))
        low, high = np.quantile(values, [0.025, 0.975])
        assert got[s][0] == len(values) and abs(got[s][1] - low) < 2e-6 and abs(got[s][2] - high) < 2e-6
    old = {r["setting"]: tuple(r)[1:] for r in B.intervals(df, B.draws(spark, df, "key", 300, 11), "key", ["setting"], value, ["a", "n"], "v").collect()}
    assert old == got
    assert B.resampled(df.limit(0), "key", ["setting"], value, ["a", "n"], "v", 5, 1).collect() == []
    whole = B.resampled(df.limit(0), "key", [], value, ["a", "n"], "v", 5, 1).first()
    assert tuple(whole) == (0, None, None)


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name, samples", [("bootstrap_ci", 10_000), ("branch_bootstrap", 10_000), ("retrieval_ci", 5_000), ("veriscore_bootstrap", 10_000)])
def test_replicates_of_the_full_job(spark, name, samples):
    got = entry.queries()[name](spark, str(DATA)).collect()
    assert got and all(0.9 * samples < r["replicates"] <= samples and r["low"] <= r["high"] for r in got)
