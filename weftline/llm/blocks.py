"""Main content of web pages: a recurrent labeller of leaf blocks.

A page is read as a sequence of leaf blocks (visible text between block-level tags). Every block
gets a vector from its tag path, its hashed words and a few measures; a bidirectional LSTM in
numpy reads the whole sequence and says for each block whether it belongs to the article.

No labels are given, so the labeller learns from pages whose structure is plain: the headline is
the block that repeats the page title, the article is what stands with it in the smallest
container, up to the author's line. Class names and tags that tell the role of a container are
disguised at random while training, so the labeller also learns from words and from context.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.http import declared_text

#: Tags that do not end a block, tags without content, elements that are not visible.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript title template".split())
#: Elements that are closed by the next one of their kind.
CLOSED_BY = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[A-Za-z/][^<>]*\Z|[^<]+|<", re.S
)
_NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*[\"']?([^\"'>]*)", re.I)
_HASHED = re.compile(r"^[a-z]{1,2}[0-9a-f]{3,8}$")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_DIGIT = re.compile(r"\d")
_DATE_END = re.compile(r"\b\d{1,2}\.? (?:de )?[^\W\d_]{3,12}\.?,? (?:de )?\d{4}$|\b\d{4}-\d\d-\d\d$")
_KEY_DROP = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))

#: Sizes of the labeller and of its training sample.
WORDS, PATHS, MEASURES = 4096, 4096, 16
WORD_SIZE, PATH_SIZE, HIDDEN_SIZE = 20, 12, 24
TRAIN_PAGES, EPOCHS = 1500, 12
#: Largest body that is trained on; with twice ``TRAIN_PAGES`` rows at most, it bounds what reaches the driver.
TRAIN_BYTES = 100_000


_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}


@lru_cache(maxsize=20_000)
def _role(attributes: str) -> str:
    return " ".join(" ".join(_NAMED.findall(attributes)).lower().split())


class Block(NamedTuple):
    """One leaf block: text, share of it in links, elements from the root to it, their names, their numbers."""

    text: str
    linked: float
    names: tuple[str, ...]
    roles: tuple[str, ...]
    nodes: tuple[int, ...]
    rule: bool  # a horizontal rule stands before it


def parse(page: str) -> tuple[list[Block], str]:
    """Leaf blocks of a page in order, and its title. A tag that is cut off is no text, a cut text is."""
    blocks: list[Block] = []
    title = ""
    stack: list[tuple[str, str, int]] = [("", "", 0)]
    parts: list[str] = []
    linked = links = count = 0
    rule = False

    def flush() -> None:
        nonlocal parts, rule
        if parts:
            raw = "".join(parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                names, roles, nodes = zip(*stack)
                blocks.append(Block(text, min(1.0, linked / max(1, len(raw.strip()))), names, roles, nodes, rule))
                rule = False
            parts = []

    pos, size = 0, len(page)
    match = _TOKEN.match
    while pos < size:
        if page[pos] != "<":
            end = page.find("<", pos)
            token = page[pos : end if end >= 0 else size]
            pos += len(token)
            if parts or not token.isspace():
                parts.append(token)
                if links:
                    linked += len(token.strip())
            continue
        m = match(page, pos)
        pos = m.end()
        name = m.group(2)
        if name is None:
            token = m.group()
            if token[0] != "<" or token == "<":
                parts.append(token)
                if links:
                    linked += len(token.strip())
            continue
        name = name.lower()
        closing = m.group(1)
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        if parts:
            flush()
        linked = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            links = 0
            continue
        if name in HIDDEN:
            end = _END[name].search(page, pos)
            if name == "title" and not title:
                title = " ".join(html.unescape(page[pos : end.start() if end else size]).split())
            pos = end.end() if end else size
            continue
        if name in VOID:
            rule |= name == "hr"
            continue
        for k in range(len(stack) - 1, max(0, len(stack) - 4), -1):
            if stack[k][0] in CLOSED_BY.get(name, ()):
                del stack[k:]
                break
            if stack[k][0] in ("ul", "ol", "table", "div"):
                break
        count += 1
        role = _role(m.group(3)) if "=" in m.group(3) else ""
        stack.append((name, role, count))
    flush()
    return blocks, title


def block_key(text: str) -> str:
    """The first 48 of the letters a-z and digits of a block, ASCII letters in lower case."""
    return text.encode("ascii", "ignore").lower().translate(None, _KEY_DROP)[:48].decode()


def headline(blocks: list[Block], title: str) -> int:
    """Number of the block that repeats the page title, else of the first h1; -1 without either."""
    want = block_key(title)
    if len(want) >= 8:
        for i, b in enumerate(blocks):
            if b.linked >= 0.9:
                continue
            key = block_key(b.text)
            if len(key) >= 8 and (want.startswith(key) or key.startswith(want)):
                return i
    return next((i for i, b in enumerate(blocks) if "h1" in b.names), -1)


def _container(blocks: list[Block], top: int) -> tuple[int, int]:
    """Depth and number of the smallest element around the headline that holds other blocks of prose."""
    nodes = blocks[top].nodes
    for depth in range(len(nodes) - 1, -1, -1):
        node = nodes[depth]
        for i in range(top + 1, len(blocks)):
            b = blocks[i]
            if len(b.nodes) > depth and b.nodes[depth] == node and b.linked < 0.6:
                return depth, node
    return 0, nodes[0]


def _is_byline(b: Block) -> bool:
    return len(b.text) < 80 and b.linked < 0.5 and _DATE_END.search(b.text) is not None and len(b.text.split()) <= 10


def teach(blocks: list[Block], title: str) -> np.ndarray | None:
    """Labels of a page of plain structure; None where the structure does not tell."""
    top = headline(blocks, title)
    if top < 0 or len(blocks) < 4:
        return None
    depth, node = _container(blocks, top)
    labels = np.zeros(len(blocks), np.float32)
    labels[top] = 1
    flat = blocks[top].names[depth] in ("", "html", "body", "tr", "table") and depth <= 3 and "td" not in blocks[top].names[: depth + 1]
    ended = False
    for i in range(top + 1, len(blocks)):
        b = blocks[i]
        if len(b.nodes) <= depth or b.nodes[depth] != node:
            if flat:
                continue
            break
        if _is_byline(b) or (flat and b.rule):
            ended = True
            break
        inner = b.names[depth + 1 :]
        if "aside" in inner or "nav" in inner or "footer" in inner or "button" in inner or (b.linked > 0.9 and "li" not in inner):
            continue
        labels[i] = 1
    if flat and not ended:
        return None
    return labels if labels.sum() >= 2 else None


def _intro(text: str) -> tuple[str, str]:
    words = _WORD.findall(text[:60].lower())
    return " ".join(words[:1]), " ".join(words[:2])


def teaser_intros(labelled: list[tuple[list[Block], str, np.ndarray]]) -> set[str]:
    """First words that mostly stand before links and asides between main blocks, as in "Read also"."""
    aside: dict[str, int] = {}
    other: dict[str, int] = {}
    for blocks, _, y in labelled:
        main = np.flatnonzero(y)
        for i in range(main[0] + 1, main[-1]):
            b = blocks[i]
            where = aside if not y[i] and (b.linked > 0.9 or "aside" in b.names) else other
            for w in set(_intro(b.text)):
                where[w] = where.get(w, 0) + 1
    return {w for w, n in aside.items() if n >= 5 and 3 * n > other.get(w, 0)}


def _bucket(s: str, size: int) -> int:
    return zlib.crc32(s.encode()) % size


class _Buckets(dict):
    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size

    def __missing__(self, s: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[s] = n = _bucket("9" if s[0].isdigit() else s, self.size)
        return n


_WORD_BUCKETS, _PATH_BUCKETS = _Buckets(WORDS), _Buckets(PATHS)
_HEADS = frozenset(("h1", "h2", "h3", "h4"))
_ROLE_TAGS = frozenset("main article nav header footer aside section".split())


@lru_cache(maxsize=20_000)
def _path_buckets(names: tuple[str, ...], roles: tuple[str, ...], hide: bool) -> tuple[int, ...]:
    """Buckets of the innermost elements of a tag path, with or without what tells their role."""
    out = []
    for k, (name, role) in enumerate(zip(names[::-1], roles[::-1])):
        out.append(_PATH_BUCKETS[f"t{k}{'div' if hide and name in _ROLE_TAGS else name}"])
        if role and not hide:
            out.extend(_PATH_BUCKETS["h" if _HASHED.match(r) else "r" + r] for r in role.split())
    return tuple(out)


class _Texts(dict):
    """What features take from the text of a block alone; short texts are kept, as menus and notices come again and again."""

    def __missing__(self, text: str) -> tuple:
        found = _WORD.findall(text.lower())
        first = found[:2]
        plain = sum(map(len, first)) < 50 and "_" not in text[:60]  # else the words may be cut
        got = (
            [*map(_WORD_BUCKETS.__getitem__, found or ["-"])],
            [_PATH_BUCKETS["i" + w] for w in ((" ".join(first[:1]), " ".join(first)) if plain else _intro(text))],
            min(len(text), 800) / 200,
            text[-1] in ".!?…。”\"",
            "©" in text or "(c)" in text,
            sum([len(w) for w in found if w[0].isdecimal()]) / len(text),
            ":" in text[:14],
        )
        if len(text) <= 200:
            if len(self) > 20_000:
                self.clear()
            self[text] = got
        return got


_TEXTS = _Texts()


class Page(NamedTuple):
    """Features of a page: buckets of words, and of tag path and first words, with offsets per block, and measures."""

    words: np.ndarray
    word_at: np.ndarray
    paths: np.ndarray
    path_at: np.ndarray
    measures: np.ndarray


def features(blocks: list[Block], title: str, hide: bool = False) -> Page:
    """Features of the blocks; with ``hide``, names that tell a role are disguised."""
    top = headline(blocks, title)
    top_nodes = blocks[top].nodes if top >= 0 else ()
    share: dict[int, list[float]] = {}
    for b in blocks:
        s = share.setdefault(b.nodes[-2] if len(b.nodes) > 1 else 0, [0.0, 0.0])
        s[0] += len(b.text) * b.linked
        s[1] += len(b.text)
    words, word_at, paths, path_at, rows = [], [], [], [], []
    n = len(blocks)
    depth = max(1, len(top_nodes))
    for i, b in enumerate(blocks):
        text_words, intro, length, ends, copyright, digits, colon = _TEXTS[b.text]
        word_at.append(len(words))
        words.extend(text_words)
        path_at.append(len(paths))
        paths.extend(_path_buckets(b.names[-4:], b.roles[-4:], hide))
        paths.extend(intro)
        common = 0
        for x, y in zip(b.nodes, top_nodes):
            if x != y:
                break
            common += 1
        s = share[b.nodes[-2] if len(b.nodes) > 1 else 0]
        rows.append(
            (
                length,
                b.linked,
                s[0] / max(1.0, s[1]),
                ends,
                i == top,
                top >= 0 and i > top,
                common / depth,
                (len(top_nodes) - common) / 3,
                _is_byline(b),
                copyright,
                digits,
                colon,
                i / n,
                b.rule,
                not _HEADS.isdisjoint(b.names[-2:]),
                top < 0,
            )
        )
    asint = lambda x: np.asarray(x, np.int64)
    measures = np.array(rows, np.float32).reshape(-1, MEASURES)
    return Page(asint(words), asint(word_at), asint(paths), asint(path_at), measures)


Model = dict[str, np.ndarray]


def fresh_model(rnd: np.random.Generator) -> Model:
    d, h = WORD_SIZE + PATH_SIZE + MEASURES, HIDDEN_SIZE
    scale = lambda *s: (rnd.standard_normal(s) * 0.1).astype(np.float32)
    model = {"words": scale(WORDS, WORD_SIZE), "paths": scale(PATHS, PATH_SIZE), "out": scale(2 * h + d), "bias": np.zeros(1, np.float32)}
    for way in "fb":
        model[f"w{way}"] = (rnd.standard_normal((d + h, 4 * h)) / np.sqrt(d + h)).astype(np.float32)
        bias = np.zeros(4 * h, np.float32)
        bias[h : 2 * h] = 1
        model[f"c{way}"] = bias
    return model


def _inputs(model: Model, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Input vectors of a batch, padded: (time, page, size), and the lengths."""
    sizes = np.array([len(p.measures) for p in pages])
    words = np.concatenate([p.words for p in pages])
    paths = np.concatenate([p.paths for p in pages])
    word_at = np.concatenate([p.word_at + o for p, o in zip(pages, np.cumsum([0] + [len(p.words) for p in pages[:-1]]))])
    path_at = np.concatenate([p.path_at + o for p, o in zip(pages, np.cumsum([0] + [len(p.paths) for p in pages[:-1]]))])
    n_words = np.diff(np.append(word_at, len(words)))
    w = np.add.reduceat(model["words"][words], word_at) / np.sqrt(n_words)[:, None]
    p = np.add.reduceat(model["paths"][paths], path_at)
    rows = np.concatenate([w, p, np.concatenate([q.measures for q in pages])], axis=1)
    x = np.zeros((sizes.max(), len(pages), rows.shape[1]), np.float32)
    who = np.repeat(np.arange(len(pages)), sizes)
    when = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[when, who] = rows
    return x, sizes


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _reverse(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each page's sequence backwards, padding left at the end."""
    steps = np.arange(x.shape[0])[:, None]
    index = np.where(steps < sizes, sizes - 1 - steps, steps)
    return np.take_along_axis(x, index[:, :, None], axis=0)


def _run(x: np.ndarray, w: np.ndarray, c: np.ndarray, keep: bool = False):
    """LSTM over (time, page, size); with ``keep`` also what the way back needs."""
    steps, pages, d = x.shape
    h = c.size // 4
    ahead = (x.reshape(-1, d) @ w[:d]).reshape(steps, pages, 4 * h) + c
    state, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
    out = np.empty((steps, pages, h), np.float32)
    kept = []
    for t in range(steps):
        z = ahead[t] + state @ w[d:]
        gates = _sigmoid(z[:, : 3 * h])
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        g = np.tanh(z[:, 3 * h :])
        before, state_before = cell, state
        cell = f * before + i * g
        th = np.tanh(cell)
        state = o * th
        out[t] = state
        if keep:
            kept.append((i, f, o, g, before, th, state_before))
    return (out, kept) if keep else out


def _back(x: np.ndarray, w: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of inputs, weights and bias from those of the outputs."""
    steps, pages, d = x.shape
    h = dout.shape[2]
    dz_all = np.empty((steps, pages, 4 * h), np.float32)
    dstate, dcell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, th, _ = kept[t]
        ds = dout[t] + dstate
        dcell = dcell + ds * o * (1 - th * th)
        dz = dz_all[t]
        dz[:, :h] = dcell * g * i * (1 - i)
        dz[:, h : 2 * h] = dcell * before * f * (1 - f)
        dz[:, 2 * h : 3 * h] = ds * th * o * (1 - o)
        dz[:, 3 * h :] = dcell * i * (1 - g * g)
        dcell = dcell * f
        dstate = dz @ w[d:].T
    flat = dz_all.reshape(-1, 4 * h)
    states = np.stack([k[6] for k in kept]).reshape(-1, h)
    dw = np.concatenate([x.reshape(-1, d).T @ flat, states.T @ flat])
    return (flat @ w[:d].T).reshape(x.shape), dw, flat.sum(0)


def scores(model: Model, pages: list[Page]) -> list[np.ndarray]:
    """Probability of every block of every page to be main content."""
    x, sizes = _inputs(model, pages)
    forward = _run(x, model["wf"], model["cf"])
    backward = _reverse(_run(_reverse(x, sizes), model["wb"], model["cb"]), sizes)
    p = _sigmoid(np.concatenate([forward, backward, x], axis=2) @ model["out"] + model["bias"])
    return [p[: sizes[k], k] for k in range(len(pages))]


def fit(sample: list[tuple[list[Block], str]], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Train on the pages of ``sample`` that ``teach`` can label."""
    rnd = np.random.default_rng(seed)
    labelled = [(b, t, y) for b, t in sample if (y := teach(b, t)) is not None]
    intros = teaser_intros(labelled)
    for b, _, y in labelled:
        for i, x in enumerate(b):
            if y[i] and not intros.isdisjoint(_intro(x.text)):
                y[i] = 0
    seen = [(features(b, t), features(b, t, True)) for b, t, _ in labelled]
    model = fresh_model(rnd)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step = 0
    h = HIDDEN_SIZE
    for epoch in range(epochs):
        order = rnd.permutation(len(labelled))
        order = sorted(order, key=lambda k: (len(labelled[k][0]) // 8, rnd.random()))
        batches = [order[k : k + 32] for k in range(0, len(order), 32)]
        rnd.shuffle(batches)
        rate = 0.006 * (1 - epoch / (epochs + 1))
        for batch in batches:
            pages = [seen[k][int(rnd.random() < 0.6)] for k in batch]
            x, sizes = _inputs(model, pages)
            xr = _reverse(x, sizes)
            of, kf = _run(x, model["wf"], model["cf"], True)
            ob, kb = _run(xr, model["wb"], model["cb"], True)
            joined = np.concatenate([of, _reverse(ob, sizes), x], axis=2)
            p = _sigmoid(joined @ model["out"] + model["bias"])
            y, mask = np.zeros_like(p), np.zeros_like(p)
            for k, b in enumerate(batch):
                y[: sizes[k], k] = labelled[b][2]
                mask[: sizes[k], k] = 1
            dz = ((p - y) * mask / mask.sum()).astype(np.float32)
            grads = {"out": np.tensordot(joined, dz, ([0, 1], [0, 1])), "bias": dz.sum(keepdims=True).reshape(1)}
            dj = dz[:, :, None] * model["out"]
            dxf, grads["wf"], grads["cf"] = _back(x, model["wf"], kf, dj[:, :, :h])
            dxb, grads["wb"], grads["cb"] = _back(xr, model["wb"], kb, _reverse(dj[:, :, h : 2 * h], sizes))
            dx = dj[:, :, 2 * h :] + dxf + _reverse(dxb, sizes)
            who = np.repeat(np.arange(len(pages)), sizes)
            when = np.concatenate([np.arange(s) for s in sizes])
            rows = dx[when, who]
            for name, lo, hi in (("words", 0, WORD_SIZE), ("paths", WORD_SIZE, WORD_SIZE + PATH_SIZE)):
                g = np.zeros_like(model[name])
                index = np.concatenate([getattr(q, name) for q in pages])
                at = np.concatenate([np.diff(np.append(getattr(q, f"{name[:-1]}_at"), len(getattr(q, name)))) for q in pages])
                part = rows[:, lo:hi] / np.sqrt(at)[:, None] if name == "words" else rows[:, lo:hi]
                order_ = np.argsort(index, kind="stable")
                found, first = np.unique(index[order_], return_index=True)
                g[found] = np.add.reduceat(np.repeat(part, at, axis=0)[order_], first)
                grads[name] = g
            step += 1
            for name, g in grads.items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model


def train(df: DataFrame, body: str, charset: Column, key: str, pages: int = TRAIN_PAGES) -> Model:
    """Train on a bounded sample of ``df``: rows whose hashed key lies in a share of the hash space that holds about ``pages`` rows, bodies up to ``TRAIN_BYTES``."""
    rows = df.count()
    part = df.where(F.length(df[body]).between(1, TRAIN_BYTES))
    if rows > pages:
        part = part.where(F.xxhash64(df[key]) < int(-(2**63) + 2**64 * (pages / rows)))
    picked = part.select(F.xxhash64(df[key]).alias("h"), df[body].alias("b"), charset.alias("c")).limit(2 * pages).collect()
    picked.sort(key=lambda r: (r["h"], len(r["b"])))
    return fit([parse(declared_text(r["b"], r["c"])) for r in picked])


def label_pages(model: Model, pages: list[tuple[list[Block], str]]) -> list[np.ndarray]:
    """Scores of the blocks of each page; pages are run in groups of like length."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k][0]), key=lambda k: len(pages[k][0]))
    at = 0
    while at < len(order):
        group, total = [], 0
        while at < len(order) and len(group) < 256 and total < 20_000:
            group.append(order[at])
            total = len(group) * len(pages[order[at]][0])
            at += 1
        for k, s in zip(group, scores(model, [features(*pages[k]) for k in group])):
            out[k] = s
    return out


def main_blocks(df: DataFrame, key: str, body: str, charset: Column, model: Model | None = None) -> DataFrame:
    """(key, place, block_key, block): the main blocks of every page of ``df``, in order.

    Null and empty bodies have none. Repeated rows give repeated blocks. Other columns are left
    behind. ``model`` is trained on a bounded sample of ``df`` if none is given (one sort of hashes);
    the labelling itself is row-local.
    """
    rows = df.select(df[key].alias("k"), df[body].alias("b"), charset.alias("c")).where(F.length(df[body]) > 0)
    shipped = df.sparkSession.sparkContext.broadcast(model or train(df, body, charset, key))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                pages = [parse(declared_text(b.as_py(), c.as_py())) for b, c in zip(part.column(1), part.column(2))]
                index, place, keys, texts = [], [], [], []
                for i, s in enumerate(label_pages(shipped.value, pages)):
                    for j in np.flatnonzero(s >= 0.5):
                        text = pages[i][0][j].text
                        index.append(i)
                        place.append(int(j))
                        keys.append(block_key(text))
                        texts.append(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(index, pa.int64())), pa.array(place, pa.int32()), pa.array(keys, pa.string()), pa.array(texts, pa.string())],
                    ["k", "place", "block_key", "block"],
                )

    return rows.mapInArrow(run, f"k {kind}, place int, block_key string, block string").withColumnRenamed("k", key)
