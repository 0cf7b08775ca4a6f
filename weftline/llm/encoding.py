"""Encoding texts with a byte-level BPE vocabulary by dynamic programming over prefixes.

Every prefix of a byte string has exactly one BPE encoding, so it is enough to store, for each
prefix, the last token of its encoding: the rest is the encoding of the prefix without that
token. The last token of a longer prefix is the one candidate suffix token that may follow the
stored last token of what is left. Two tokens may stand side by side iff encoding their joined
bytes gives just these two tokens, which the merge table decides without encoding anything.

The table of last tokens answers appends exactly (only the new bytes are worked on) and edits by
redoing the table from the first changed byte of the changed words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that cuts a text into words before byte-level BPE is applied to each.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Words kept with their ids in a worker; a full store starts anew, results do not depend on it.
CACHE_WORDS = 400_000


class PrefixBPE:
    """Encoder for one vocabulary, given as the bytes of a ranks file (base64 token, rank per line)."""

    def __init__(self, ranks_file: bytes, pattern: str = WORDS) -> None:
        pairs = (line.split() for line in ranks_file.splitlines() if line)
        self.rank: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in pairs}
        self.longest = max(map(len, self.rank))
        self.findall = regex.compile(pattern).findall
        self._parts: dict[int, tuple[int, int]] = {}
        self._joined: dict[tuple[int, int], int] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        self._merge_table()
        #: Tokens that some encoding contains, by their bytes, and the bytes of each.
        self.token_of = {t: r for t, r in self.rank.items() if r in self._parts}
        self.size = {r: len(t) for t, r in self.token_of.items()}

    def _merge_table(self) -> None:
        """The last merge of every token: its two halves, found by merging its bytes below its own rank."""
        rank = self.rank
        for token, own in rank.items():
            if len(token) == 1:
                self._parts[own] = (own, own)
                continue
            pieces = [token[i : i + 1] for i in range(len(token))]
            while len(pieces) > 2:
                best, at = own, -1
                for i in range(len(pieces) - 1):
                    r = rank.get(pieces[i] + pieces[i + 1], own)
                    if r < best:
                        best, at = r, i
                if at < 0:
                    break
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            if len(pieces) == 2:
                halves = (rank[pieces[0]], rank[pieces[1]])
                self._parts[own] = halves
                self._joined[halves] = own

    def beside(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is these two tokens.

        No merge across the seam may come before the merges that formed the inner edges of the
        two tokens. The later of the two edge merges is undone step by step, and a seam merge that
        would have been due by then refutes the pair.
        """
        key = (left, right)
        joined, parts = self._joined, self._parts
        bar = 1 << 60
        ok = True
        while True:
            if joined.get((left, right), bar) < bar:
                ok = False
                break
            l_half, r_half = parts[left][1], parts[right][0]
            whole_l, whole_r = l_half == left, r_half == right
            if whole_l and whole_r:
                break
            if whole_r or (not whole_l and left > right):
                bar, left = left, l_half
            else:
                bar, right = right + 1, r_half
        if len(self._beside) > 2_000_000:
            self._beside.clear()
        self._beside[key] = ok
        return ok

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Fill ``last[i]`` for i >= start, the last token of the encoding of data[: i + 1]."""
        get, longest, beside, known = self.token_of.get, self.longest, self.beside, self._beside
        del last[start:]
        for end in range(start + 1, len(data) + 1):
            token = get(data[:end]) if end <= longest else None
            begin = max(1, end - longest)
            while token is None:
                token = get(data[begin:end])
                if token is not None:
                    ok = known.get((last[begin - 1], token))
                    if not (beside(last[begin - 1], token) if ok is None else ok):
                        token = None
                begin += 1
            last.append(token)

    def unwind(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding of ``data`` from its table of last tokens."""
        size = self.size
        out, end = [], len(data)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        data = word.encode("utf-8", "replace")
        known = self.token_of.get(data)
        if known is not None:
            return [known]
        last: list[int] = []
        self.extend(data, last, 0)
        return self.unwind(data, last)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty text has none."""
        return [i for w in self.findall(text or "") for i in self.word(w)]


class PrefixTable:
    """The encoding of one growing byte string (one word of the pattern) under appends and edits."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b"") -> None:
        self.bpe, self.data, self._last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; work is done for the new bytes only."""
        start = len(self.data)
        self.data += more
        self.bpe.extend(self.data, self._last, start)

    def edit(self, begin: int, end: int, new: bytes) -> None:
        """Replace data[begin:end]; the table is redone from ``begin``."""
        self.data = self.data[:begin] + new + self.data[end:]
        self.bpe.extend(self.data, self._last, begin)

    def ids(self, upto: int | None = None) -> list[int]:
        """Encoding of the whole string or of its prefix of ``upto`` bytes."""
        data = self.data if upto is None else self.data[:upto]
        return self.bpe.unwind(data, self._last)


class _Words(dict):
    """word -> number of the word; ``flat[offsets[n] : offsets[n + 1]]`` are the ids of word n."""

    def __init__(self, bpe: PrefixBPE) -> None:
        super().__init__()
        self.bpe, self.flat, self.offsets = bpe, [], [0]

    def add(self, words: set[str]) -> None:
        """Encode new words."""
        bpe, table = self.bpe, []
        for word in words:
            data = word.encode("utf-8", "replace")
            own = bpe.token_of.get(data)
            if own is not None:
                self.flat.append(own)
            else:
                bpe.extend(data, table, 0)
                self.flat.extend(bpe.unwind(data, table))
            self[word] = len(self.offsets) - 1
            self.offsets.append(len(self.flat))


_STORES: dict[int, _Words] = {}


def _store(ranks_file: bytes) -> _Words:
    key = hash(ranks_file)
    store = _STORES.get(key)
    if store is None or len(store) > CACHE_WORDS:
        _STORES.clear()
        store = _STORES[key] = _Words(store.bpe if store is not None else PrefixBPE(ranks_file))
    return store


def encode_batch(texts: list[str | None], store: _Words) -> pa.ListArray:
    """Ids of each text as an Arrow list array; null and empty texts give empty lists."""
    findall = store.bpe.findall
    words: list[str] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            words.extend(findall(text))
        ends[i + 1] = len(words)
    store.add(set(words) - store.keys())
    offsets = np.asarray(store.offsets, np.int64)
    flat = np.asarray(store.flat, np.int32)
    number = np.fromiter(map(store.__getitem__, words), np.int64, len(words))
    begin, size = offsets[number], offsets[number + 1] - offsets[number]
    at = np.zeros(len(number) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    take = np.arange(at[-1]) + np.repeat(begin - at[:-1], size)
    return pa.ListArray.from_arrays(pa.array(at[ends].astype(np.int32)), pa.array(flat[take], pa.int32()))


def encode_texts(df: DataFrame, key: str, text: str, ranks_file: bytes) -> DataFrame:
    """(key, ids array<int>) of every row of ``df``.

    ``ranks_file`` is the content of the vocabulary's ranks file, read where the file is and
    shipped with the function (under 1 MB, fixed by the vocabulary). Null and empty texts get an
    empty list; blank texts are encoded as they are; strings that look like special tokens are
    ordinary text. Repeated rows give repeated results, other columns are left behind.
    Row-local: no shuffle, one Arrow pass over two columns.
    """
    rows = df.select(df[key].alias("k"), df[text].alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(ranks_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = encode_batch(part.column(1).to_pylist(), _store(shipped.value))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["k", "ids"])

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
