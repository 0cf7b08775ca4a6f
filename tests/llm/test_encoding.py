"""p8: encoding against public encoders, with appends and edits."""

import base64
import random
from pathlib import Path

import pytest
import tiktoken

from weftline.llm.encoding import WORDS, PrefixBPE, PrefixTable, encode_texts
from weftline.llm.queries_text import TOKENIZERS

FILE = Path(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not FILE.exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def raw():
    return FILE.read_bytes()


@pytest.fixture(scope="module")
def bpe(raw):
    return PrefixBPE(raw)


@pytest.fixture(scope="module")
def public(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed):
    rnd = random.Random(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz ABC'  \n\t.,!?0123éü日本👍🏽½٣Ⅷ") + ["\x1c", "\x85", "\xa0", "<|endoftext|>", "'ll", "  "]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_random_texts(bpe, public):
    for t in texts(1500, 3):
        assert bpe.encode(t) == public.encode_ordinary(t)


def test_long_runs(bpe, public):
    for t in ("a" * 3000, " " * 1000 + "x", "\n" * 700, "=" * 500, "ab" * 900):
        assert bpe.encode(t) == public.encode_ordinary(t)


def test_every_prefix_appends_and_edits(bpe, public):
    word = "internationalizations"
    table = PrefixTable(bpe)
    for c in word:
        table.append(c.encode())
    for n in range(1, len(word) + 1):
        assert table.ids(n) == public.encode_ordinary(word[:n])
    table.edit(5, 8, b"XYZ")
    assert table.data == b"interXYZ" + word[8:].encode()
    assert table.ids() == public.encode_ordinary(table.data.decode())


def test_operator(spark, raw, public):
    rows = [(1, None, [0]), (2, "", [1]), (3, " \n", None), (4, "<|endoftext|> it's", [2]), (4, "<|endoftext|> it's", [2]), (5, "long word " * 20000, [3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = sorted(map(tuple, encode_texts(df, "doc_id", "text", raw).collect()))
    assert got == sorted((k, public.encode_ordinary(t or "")) for k, t, _ in rows)
    assert encode_texts(df.limit(0), "doc_id", "text", raw).collect() == []
