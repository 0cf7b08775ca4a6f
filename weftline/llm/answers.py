"""Defective answers to prompts: a multi-label linear classifier over hashed n-grams and pair features.

Nothing is labelled, so the classifier learns from answers that are made defective on purpose: cut at a
random place, replaced by the claim, by a refusal, emptied, or swapped with an answer in another
language; and from good ones, among them answers that say that knowledge is lacking. Each label's
threshold is calibrated on answers held out from training. What the classifier proposes is then checked
exactly where a defect has an exact definition. Features and scores are computed for whole batches.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.cutoff import Ending, _open_json, cut_values, output_ending
from weftline.llm.hashing import mix

#: Defects in the order in which the first that applies is reported.
LABELS = ("empty", "truncated", "refusal", "copy", "language")
#: Hash space, rows of the training sample, epochs (more where the sample is small).
SPACE, TRAIN_ROWS, EPOCHS = 1 << 16, 4000, 6
#: Places of each of the main pair features, and n-grams that weigh in full.
PAIR_PLACES, GRAMS = 4, 24
#: Share of held-out answers without a defect that may pass its threshold: little for refusals, as no exact check follows,
#: much for truncation, as endings tell more than words.
FALSE = (0.02, 0.2, 0.001, 0.02, 0.02)
#: Score of an earlier fit from which an answer of the sample is not taken as free of refusal, and number of fits.
DOUBT, TURNS = 0.01, 3
#: Words that may stand around a repeated claim.
FRAME_WORDS = 5

#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of and in to is was for by with that from at on are not as this be which about it or an has have had could been since one another both",
    "de": "der die das und ist nicht von zu mit den dem ein eine für auf im wurde nach aus auch über sich kein da erst liegt zu es bei",
    "fr": "le la les de des et est une un dans pour par sur pas ne il au aux du en que à été avec ce sont qui plus après cette",
    "es": "el la los las de y en que no se por para con una un del al es como su más fue sobre lo hay pues año después dice",
    "pl": "i w na z się do nie to jest że jak o co za od bo przez roku który dla dopiero",
}
#: Parts of refusals to learn from, by language: openings, cores, verbs, objects; N stands for a name.
REFUSALS = {
    "en": (
        "|I'm sorry, but |Sorry, |I apologize, but |Unfortunately, |As an AI language model, |As an AI assistant, |I appreciate the question, but |Regrettably, ",
        "I can't {v} {o}|I cannot {v} {o}|I can't help with {o}|I cannot assist with {o}|I am unable to {v} {o}|I'm unable to help with {o}|I'm not able to {v} {o}"
        "|I won't {v} {o}|I will not {v} {o}|I won't be able to {v} {o}|I must decline to {v} {o}|I have to decline {o}|I decline to {v} {o}|I refuse to {v} {o}"
        "|I prefer not to {v} {o}|I'd rather not {v} {o}|I am not allowed to {v} {o}|I'm not permitted to {v} {o}|I do not feel comfortable enough to {v} {o}"
        "|it is against my guidelines to {v} {o}|my guidelines do not permit me to {v} {o}|my policy does not allow me to {v} {o}|for safety reasons I do not {v} {o}"
        "|it would be inappropriate to {v} {o}|it would not be right for me to {v} {o}|{o} is outside what I can discuss|{o} is beyond what the assistant may do"
        "|no answer to {o} can be given|I have been asked not to {v} {o}|I must pass on {o}|the assistant does not {v} {o}|please ask a professional about {o}, I cannot {v} it",
        "answer|judge|assess|evaluate|rate|classify|label|process|comment on|discuss|give an opinion on|take a stance on|provide an assessment of|engage with|respond to",
        "this|that|it|this claim|this statement|this request|this question|this topic|this task|claims about N|questions about N|statements on N|N|such content|requests of this kind",
    ),
    "de": (
        "|Es tut mir leid, aber |Leider |Entschuldigung, ",
        "ich kann {o} nicht {v}|ich darf {o} nicht {v}|kann ich {o} nicht {v}|darf ich {o} nicht {v}|ich möchte {o} nicht {v}|ich lehne es ab, {o} zu {v}|es ist mir nicht erlaubt, {o} zu {v}|bei dieser Bitte kann ich nicht helfen",
        "bewerten|beurteilen|beantworten|kommentieren|einstufen|prüfen",
        "diese Aussage|diese Frage|diese Behauptung|das|Aussagen über N|solche Inhalte",
    ),
    "fr": (
        "|Je suis désolé, mais |Désolé, |Malheureusement, ",
        "je ne peux pas {v} {o}|je ne suis pas en mesure d'aider|je ne suis pas autorisé à {v} {o}|je refuse de {v} {o}|je préfère ne pas {v} {o}|je dois refuser de {v} {o}|il m'est impossible de {v} {o}|mes règles ne me permettent pas de {v} {o}",
        "évaluer|juger|répondre à|commenter|classer|traiter",
        "cette affirmation|cette question|cette demande|cela|ce sujet|ce genre de contenu",
    ),
    "es": (
        "|Lo siento, pero |Lamentablemente, |Disculpa, ",
        "no puedo {v} {o}|no puedo ayudar con {o}|no se me permite {v} {o}|prefiero no {v} {o}|debo negarme a {v} {o}|no estoy autorizado a {v} {o}|mis normas no me permiten {v} {o}|me niego a {v} {o}",
        "evaluar|juzgar|responder a|comentar|clasificar|valorar",
        "esta afirmación|esta pregunta|esta solicitud|eso|este tema|este tipo de contenido",
    ),
    "pl": ("|Przepraszam, ale |Niestety ", "nie mogę {v} {o}|nie wolno mi {v} {o}|wolę nie {v} {o}|muszę odmówić|nie mogę w tym pomóc", "ocenić|komentować|sklasyfikować", "tego stwierdzenia|tego pytania|tej prośby"),
    "ru": ("|Извините, но |К сожалению, ", "я не могу {v} {o}|мне нельзя {v} {o}|я отказываюсь {v} {o}|я предпочёл бы не {v} {o}|я не могу помочь с этим", "оценивать|комментировать|обсуждать", "это утверждение|этот вопрос|эту тему"),
}
#: Answers that say that knowledge is lacking, which are no refusals.
LACKING = """
I have no reliable information about N, so this cannot be confirmed.
I do not know of any source that mentions N.
I cannot verify the date because the evidence does not give one.
I am not certain about N, so the label is unknown.
There is not enough evidence to decide whether N is meant.
The evidence items say nothing about N, hence no verdict.
Nothing in my knowledge supports or refutes the statement on N.
It is unclear from the evidence whether N was involved.
I was unable to find evidence for N.
I could not determine whether the claim on N holds.
Knowledge about N is missing; the statement can neither be supported nor refuted.
No dependable account of N exists, which is why the answer is UNKNOWN.
Über N ist mir nichts bekannt, daher bleibt die Aussage offen.
Ich kann nicht sagen, ob N gemeint ist, denn die Belege schweigen.
Je ne sais rien de fiable sur N, donc rien ne peut être confirmé.
Les sources ne permettent pas de vérifier N.
No tengo datos fiables sobre N, así que no se puede confirmar.
Las fuentes no dicen nada sobre N.
Brak wiarygodnych danych o N, więc nie można tego potwierdzić.
О N нет надёжных сведений, поэтому подтвердить нельзя.
""".strip().splitlines()
#: What may follow a refusal.
TAILS = ("", "", "", " Please consult an expert.", " Thank you for understanding.", " Is there something else I can do for you?", " Such topics can cause harm.", " Please rephrase the question.")
#: What stands for nothing, ways to frame a claim.
NOTHING = ("", " ", "-", ".", "...", "…", "none", "None", "null", "N/A", "n/a", "​")
FRAMES = ("{}", "{}", "{}", "The claim states that {}", "Claim: {}", "Statement: {}", "{} (see claim)", "{}, as claimed", "{}, according to the claim.", "“{}”", "- {}", "{} [2]", "The statement is: {}", "The claim says {}")

_NULL = {"none", "null", "na", "nan", "nil"}
_WORD = re.compile(r"[^\W\d_]+|\d+")
_QUOTED = re.compile(r"“[^”]*”?|\"[^\"]*\"|«[^»]*»|„[^“]*“?")
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_QUOTES = frozenset("“\"«„")
_INVISIBLE = " \t\r\n ​‌‍﻿"


class Answer(NamedTuple):
    """An output with the prose of the answer; ``shape`` is json, broken, fence, prose or none."""

    raw: str
    prose: str
    shape: str


def read(output: str | None) -> Answer:
    """The prose of an answer: the rationale of a JSON output, under whatever key, else the text itself."""
    raw = (output or "").strip(_INVISIBLE)
    if not raw:
        return Answer("", "", "none")
    inner = re.sub(r"^```[a-zA-Z]*\s*", "", raw)
    if inner[:1] in ("{", "["):
        if _open_json(inner):
            m = re.search(r"\"(?:rationale|explanation|reason)\"\s*:\s*\"((?:[^\"\\]|\\.)*)", inner, re.S)
            return Answer(raw, m.group(1) if m else "", "broken")
        try:
            value, _ = json.JSONDecoder(strict=False).raw_decode(inner)
        except ValueError:
            m = re.search(r"\"(?:rationale|explanation|reason)\"\s*:\s*\"((?:[^\"\\]|\\.)*)\"", inner, re.S)
            return Answer(raw, m.group(1) if m else "", "json")
        items = list(value.items()) if isinstance(value, dict) else list(enumerate(value))
        for name in ("rationale", "explanation", "reason", "reasoning", "justification"):
            for k, v in items:
                if k == name:
                    return Answer(raw, v if isinstance(v, str) else "", "json")
        texts = [v for k, v in items if isinstance(v, str) and k not in ("prediction", "label", "verdict")]
        longest = max(texts, key=len, default="")
        return Answer(raw, longest if len(longest.split()) > 1 else "", "json")
    if raw.startswith("```"):
        return Answer(raw, inner.removesuffix("```").strip(), "fence")
    return Answer(raw, raw, "prose")


def is_nothing(prose: str) -> bool:
    """Whether a rationale says nothing: no letters or digits, or a word that stands for nothing."""
    words = "".join(c for c in prose.lower() if c.isalnum())
    return not words or words in _NULL


def _script(text: str) -> str:
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in text)
    kana = sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in text)
    letters = sum(c.isalpha() for c in text) or 1
    return "ru" if cyrillic / letters > 0.25 else "ja" if kana / letters > 0.2 else ""


def language(text: str) -> str:
    """Language by script or by most function words; empty if undecided."""
    if (script := _script(text)) != "":
        return script
    words = [w.lower() for w in _WORD.findall(text)]
    hits = sorted(((sum(w in s for w in words), k) for k, s in _SETS.items()), reverse=True)
    if hits[0][0] == 0 or hits[0][0] == hits[1][0]:
        special = {"pl": "ąćęłńśźż", "de": "äöüß", "es": "ñ¿¡", "fr": "èêçœû"}
        found = [k for k, s in special.items() if any(c in s for c in text.lower())]
        if hits[0][0] and len(found) == 1 and any(k == found[0] and n == hits[0][0] for n, k in hits):
            return found[0]
        return ""
    return hits[0][1]


def _own_words(prose: str, claim: str) -> str:
    """The prose without quotations and without names and other words of the claim."""
    taken = set(_WORD.findall(claim))
    return " ".join(w for w in _WORD.findall(_QUOTED.sub(" ", prose)) if w not in taken or not w[0].isupper())


def overlap(prose: str, claim: str) -> tuple[float, int]:
    """Share of the claim's words that the prose repeats, and the words that it adds."""
    want, have = Counter(w.lower() for w in _WORD.findall(claim)), Counter(w.lower() for w in _WORD.findall(prose))
    both = (want & have).total()
    return both / max(1, want.total()), have.total() - both


@lru_cache(maxsize=1 << 16)
def _h(s: str) -> int:
    return zlib.crc32(s.encode()) % SPACE


class _Lexicon:
    """Of each word met so far: number of its lower-case form, languages whose function word it is, hash as n-gram part."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.low = np.zeros(1 << 12, np.int64)
        self.languages = np.zeros(1 << 12, np.uint8)
        self.upper = np.zeros(1 << 12, bool)
        self.gram = np.zeros((2, 1 << 12), np.uint64)  # as the first word, and as any other: names and numbers masked

    def _add(self, word: str) -> int:
        n = self.number[word] = len(self.number)
        if n >= len(self.low):
            more = len(self.low)
            self.low, self.languages, self.upper = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.low, self.languages, self.upper))
            self.gram = np.concatenate([self.gram, np.zeros((2, more), np.uint64)], axis=1)
        low = word.lower()
        self.upper[n] = word[0].isupper()
        self.languages[n] = sum(1 << k for k, words in enumerate(_SETS.values()) if low in words)
        masked = "9" if word[0].isdigit() else low
        self.gram[0, n] = zlib.crc32(masked.encode())
        self.gram[1, n] = zlib.crc32(("N" if word[0].isupper() else masked).encode())
        at = n if low == word else self.number[low] if low in self.number else self._add(low)
        self.low[n] = at
        return n

    def numbers(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, and the row of each."""
        get, add = self.number.get, self._add
        flat = [n if (n := get(w)) is not None else add(w) for ws in words for w in ws]
        return np.array(flat, np.int64), np.repeat(np.arange(len(words)), [len(ws) for ws in words])


_LEXICON = _Lexicon()


class Facts(NamedTuple):
    """What is known of a batch of answers and claims, row by row."""

    answers: list[Answer]
    endings: list[Ending]
    nothing: list[bool]
    share: np.ndarray  # of the claim's words that the prose repeats
    added: np.ndarray  # words of the prose beside them
    claimed: np.ndarray  # words of the claim
    own: np.ndarray  # words of the prose without quotations and names of the claim
    ours: list[str]  # language of the prose
    theirs: list[str]  # language of the claim
    grams: tuple[np.ndarray, np.ndarray]  # row and place of each different n-gram


def _languages(texts: list[str], counts: np.ndarray) -> list[str]:
    """As ``language``, from the counted function words."""
    order = np.argsort(counts, axis=1)
    rows = np.arange(len(texts))
    best, second = counts[rows, order[:, -1]], counts[rows, order[:, -2]]
    plain = (best > second).tolist()
    names, top = list(_SETS), order[:, -1].tolist()
    return [names[top[i]] if plain[i] and (t.isascii() or not _script(t)) else language(t) for i, t in enumerate(texts)]


def facts(outputs: list[str | None], claims: list[str | None]) -> Facts:
    """Facts of a batch; a null claim is an empty one."""
    global _LEXICON
    if len(_LEXICON.number) > 400_000:
        _LEXICON = _Lexicon()
    lexicon = _LEXICON
    answers = [read(o) for o in outputs]
    about = [c or "" for c in claims]
    rows = len(answers)
    full = [_WORD.findall(a.prose) for a in answers]
    bare = [_WORD.findall(_QUOTED.sub(" ", a.prose)) if not _QUOTES.isdisjoint(a.prose) else w for a, w in zip(answers, full)]
    claim_words = [_WORD.findall(c) for c in about]
    (n_full, r_full), (n_bare, r_bare), (n_claim, r_claim) = (lexicon.numbers(w) for w in (full, bare, claim_words))
    size = np.int64(len(lexicon.number))
    have, have_n = np.unique(r_full * size + lexicon.low[n_full], return_counts=True)
    want, want_n = np.unique(r_claim * size + lexicon.low[n_claim], return_counts=True)
    both, i, j = np.intersect1d(have, want, True, True)
    met = np.bincount(both // size, np.minimum(have_n[i], want_n[j]), rows)
    claimed = np.bincount(r_claim, minlength=rows)
    share = met / np.maximum(1, claimed)
    added = np.bincount(r_full, minlength=rows) - met
    named = lexicon.upper[n_bare] & np.isin(r_bare * size + n_bare, r_claim * size + n_claim)
    count = lambda n, r: np.stack([np.bincount(r, (lexicon.languages[n] >> k) & 1, rows) for k in range(len(_SETS))], axis=1)
    own_words = [[w for w in ws if not w[0].isupper() or w not in taken] for ws, taken in zip(bare, map(set, claim_words))]
    ours = _languages([" ".join(w) for w in own_words], count(n_bare[~named], r_bare[~named]))
    theirs = _languages(about, count(n_claim, r_claim))
    first = np.ones(len(r_bare), bool)
    first[1:] = r_bare[1:] != r_bare[:-1]
    gram = np.where(first, lexicon.gram[0, n_bare], lexicon.gram[1, n_bare]) + np.uint64(1)
    places = [(r_bare, mix(gram))]
    for k, step in ((1, 2), (2, 3)):
        if len(gram) > k:
            inside = r_bare[k:] == r_bare[:-k]
            value = gram[:-k] * np.uint64(0x9E3779B97F4A7C15)
            for s in range(1, step):
                value = (value + gram[s : len(gram) - k + s]) * np.uint64(0xBF58476D1CE4E5B9 + 2 * s)
            places.append((r_bare[:-k][inside], mix(value[inside] + np.uint64(step))))
    keys = np.unique(np.concatenate([r * np.int64(SPACE) + (v % np.uint64(SPACE)).astype(np.int64) for r, v in places]))
    return Facts(
        answers, [output_ending(a.raw)[0] for a in answers], [is_nothing(a.prose) for a in answers], share, added, claimed,
        np.bincount(r_bare[~named], minlength=rows), ours, theirs, (keys // SPACE, keys % SPACE),
    )


class Matrix(NamedTuple):
    """Hashed features of a batch and their values; row r has those from start[r] to start[r + 1]."""

    index: np.ndarray
    value: np.ndarray
    start: np.ndarray


@lru_cache(maxsize=1 << 15)
def _dense(shape: str, nothing: bool, state: str, tenths: int, much: bool, added: int, own: int, ours: str, theirs: str, given: str) -> list[int]:
    """Places of the features of form, of prediction and of the pair; few combinations occur."""
    pair = "same" if ours == theirs and ours else "unknown" if not ours or not theirs else "other"
    row = [
        f"shape {shape}", f"nothing {nothing}", f"nothing {nothing} {shape}", f"end {state}", f"end {state} {shape}", f"share {tenths}", f"added {added}",
        f"share {much} added {min(added, 8)}", f"language {pair}", f"language {pair} {own}", f"language {pair} shape {shape}", f"language {pair} added {min(added, 6)}",
        f"languages {ours} {theirs}", f"prediction {given} {shape}",
    ]
    # Pair features stand against dozens of n-grams; each has several places, so that it weighs as much.
    row += [f"{name} {k}" for name in (f"languages are {pair}", f"copied {much and added <= FRAME_WORDS}", f"ends {state}", f"says nothing {nothing}") for k in range(PAIR_PLACES)]
    return [_h(x) for x in row]


def features(f: Facts, predictions: list[str | None]) -> Matrix:
    """Pair features, features of form and prediction, and n-grams; n-grams of a long answer count less each."""
    dense = []
    given = ["none" if p is None else "unknown" if p.upper() == "UNKNOWN" else "given" for p in predictions]
    tenths, much = (f.share * 10).astype(int).tolist(), (f.share > 0.85).tolist()
    added, own = np.minimum(f.added, 12).tolist(), np.minimum(f.own, 4).tolist()
    for i, (a, end) in enumerate(zip(f.answers, f.endings)):
        places = _dense(a.shape, f.nothing[i], end.state, tenths[i], much[i], added[i], own[i], f.ours[i], f.theirs[i], given[i])
        dense.append([*places, _h(f"last2 {end.key}"), _h(f"last {end.last}")])
    rows = len(dense)
    places = np.array(dense, np.int64).reshape(rows, -1 if rows else 0)
    owner, gram = f.grams
    count = np.bincount(owner, minlength=rows)
    row = np.concatenate([np.repeat(np.arange(rows), places.shape[1]), owner])
    value = np.concatenate([np.ones(places.size, np.float32), np.minimum(1, GRAMS / np.maximum(1, count[owner])).astype(np.float32)])
    order = np.argsort(row, kind="stable")
    start = np.concatenate([[0], np.cumsum(count + places.shape[1])])
    return Matrix(np.concatenate([places.ravel(), gram])[order], value[order], start)


class Classifier(NamedTuple):
    """Weights (label, feature), biases and calibrated thresholds."""

    weights: np.ndarray
    bias: np.ndarray
    threshold: np.ndarray


def _refusal(rnd: np.random.Generator, kind: str, name: str) -> str:
    opening, core, verb, thing = (str(rnd.choice(part.split("|"))) for part in REFUSALS[kind])
    text = opening + core.format(v=verb, o=thing)
    return (text[0].upper() + text[1:]).replace("N", name) + ("." if rnd.random() < 0.9 else "")


def spoil(sample: list[tuple[str, str, str | None]], foreign: list[str], seed: int = 5) -> list[tuple[str, str, str | None, tuple[int, ...]]]:
    """(output, claim, prediction, labels): good answers and defective ones made from them; ``foreign`` are outputs to swap in."""
    rnd = np.random.default_rng(seed)
    pick = lambda options: options[int(rnd.integers(len(options)))]
    out: list[tuple[str, str, str | None, tuple[int, ...]]] = []
    by_language: dict[str, list[str]] = {}
    for raw in foreign:
        by_language.setdefault(language(_own_words(read(raw).prose, "")), []).append(raw)
    names = [w for _, c, _ in sample[:500] for w in _WORD.findall(c)[1:] if w[0].isupper()] or ["It"]
    kinds = list(REFUSALS)

    def wrap(raw: str, prose: str) -> str:
        a = read(raw)
        if a.shape != "json" or rnd.random() < 0.4:
            return prose
        quoted = json.dumps(prose, ensure_ascii=False)
        return re.sub(r"(\"(?:rationale|explanation)\"\s*:\s*)\"(?:[^\"\\]|\\.)*\"", lambda m: m.group(1) + quoted, raw, count=1)

    def add(raw: str, claim: str, prediction: str | None, *labels: int) -> None:
        out.append((raw, claim, prediction if read(raw).shape == "json" else None, labels))

    for raw, claim, prediction in sample:
        kind = int(rnd.integers(8))
        out.append((raw, claim, prediction, ()))
        if rnd.random() < 0.15:
            add(wrap(raw, pick(LACKING).replace("N", pick(names))), claim, prediction)
        if kind <= 1:
            if rnd.random() < 0.5:
                cut = raw[: int(rnd.integers(1, max(2, len(raw) - 3)))] + pick(("", "", "", "…", "..."))
            else:
                prose = read(raw).prose
                cut = wrap(raw, prose[: int(rnd.integers(max(1, len(prose) // 4), max(2, len(prose) - 4)))].rstrip(" .,"))
            add(cut, claim, prediction, 1)
        elif kind == 2:
            ours = language(claim) if rnd.random() < 0.4 else "en" if rnd.random() < 0.6 else pick(kinds)
            add(wrap(raw, _refusal(rnd, ours if ours in REFUSALS else "en", pick(names)) + pick(TAILS)), claim, prediction, 2)
        elif kind == 3:
            text = pick(FRAMES).format(claim.strip() if rnd.random() < 0.6 else claim.strip().rstrip("."))
            text = text.lower() if rnd.random() < 0.25 else text.upper() if rnd.random() < 0.05 else text
            add(wrap(raw, text) if rnd.random() < 0.8 else json.dumps({"gold_claim": text}, ensure_ascii=False), claim, prediction, 3)
        elif kind == 4:
            add(pick(("", " \n", "```json\n```", '{"prediction": "UNKNOWN"}')) if rnd.random() < 0.4 else wrap(raw, pick(NOTHING)), claim, prediction, 0)
        theirs = language(claim)
        if kind > 4 or theirs not in ("", "en"):
            others = [k for k in by_language if k and k != theirs and theirs]
            if others:
                add(pick(by_language[pick(sorted(others))]), claim, prediction, 4)
    return out


def _descend(m: Matrix, target: np.ndarray, rows: np.ndarray, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    weights, bias = np.zeros((SPACE, len(LABELS)), np.float32), np.zeros(len(LABELS), np.float32)
    square = np.full((SPACE, len(LABELS)), 1e-2, np.float32)
    for _ in range(max(EPOCHS, 40_000 // max(1, len(rows)))):
        rnd.shuffle(rows)
        for at in range(0, len(rows), 64):
            batch = rows[at : at + 64]
            size = m.start[batch + 1] - m.start[batch]
            start = np.cumsum(size) - size
            entry = np.arange(size.sum()) + np.repeat(m.start[batch] - start, size)
            index, value = m.index[entry], m.value[entry][:, None]
            z = np.add.reduceat(weights[index] * value, start) + bias
            grad = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[batch]) * (1 + 2 * target[batch])
            found, where = np.unique(index, return_inverse=True)
            g = np.zeros((len(found), len(LABELS)), np.float32)
            np.add.at(g, where, np.repeat(grad, size, axis=0) * value)
            square[found] += g * g
            weights[found] -= 0.25 * g / np.sqrt(square[found])
            bias -= 0.02 * grad.sum(0)
    return weights, bias


def scores(weights: np.ndarray, bias: np.ndarray, m: Matrix) -> np.ndarray:
    """Score of each row under each label."""
    if len(m.start) < 2:
        return np.zeros((0, len(LABELS)), np.float32)
    z = np.add.reduceat(weights[m.index] * m.value[:, None], m.start[:-1]) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(score: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Threshold of each label, from held-out answers: what at most the share ``FALSE`` of the answers without the label passes;
    for refusals, a third of the way (in log odds) from there to where almost all with the label pass, if that is higher."""
    out = np.full(len(LABELS), 0.5, np.float32)
    logit = lambda p: float(np.log(p / (1 - p)))
    for k in range(len(LABELS)):
        bad, good = score[target[:, k] == 1, k], score[target[:, k] == 0, k]
        if not len(bad) or not len(good):
            continue
        least = float(np.clip(np.quantile(good, 1 - FALSE[k]), 1e-6, 1 - 1e-6))
        most = float(np.clip(np.quantile(bad, 0.01), 1e-6, 1 - 1e-6))
        out[k] = 1 / (1 + np.exp(-(2 * logit(least) + logit(most)) / 3)) if LABELS[k] == "refusal" and most > least else least
    return out


def fit(sample: list[tuple[str, str, str | None]], seed: int = 5) -> Classifier:
    """Train on (output, claim, prediction) that are good as far as simple tests tell; a fifth is held out for the thresholds.

    The sample holds refusals too. A first fit on answers that give a definite prediction, which a refusal
    hardly does, finds those that may look like the refusals to learn from; they are left out of the next.
    """
    rnd = np.random.default_rng(seed)
    f = facts([o for o, _, _ in sample], [c for _, c, _ in sample])
    plain = [f.share[i] < 0.7 and end.state == "closed" and len(a.prose) >= 12 for i, (a, end) in enumerate(zip(f.answers, f.endings))]
    fine = [
        a.shape == "json" and len(a.prose.split()) >= 4 and f.share[i] < 0.7 and f.endings[i].state != "cut" and (not f.ours[i] or not f.theirs[i] or f.ours[i] == f.theirs[i])
        for i, a in enumerate(f.answers)
    ]
    left = np.array([p is not None and p.upper() != "UNKNOWN" for _, _, p in sample], bool)
    if not left.any():
        left[:] = True
    for turn in range(TURNS):
        good = [s for s, ok, x in zip(sample, fine, left) if ok and x]
        rows = spoil(good, [s[0] for s, ok, x in zip(sample, plain, left) if ok and x], seed)
        if not rows:
            break
        m = features(facts([r[0] for r in rows], [r[1] for r in rows]), [r[2] for r in rows])
        target = np.zeros((len(rows), len(LABELS)), np.float32)
        for i, r in enumerate(rows):
            target[i, list(r[3])] = 1
        held = rnd.random(len(rows)) < 0.2
        weights, bias = _descend(m, target, np.flatnonzero(~held), rnd)
        score = scores(weights, bias, m)
        if turn == TURNS - 1:
            return Classifier(weights, bias, calibrate(score[held], target[held]))
        left = scores(weights, bias, features(f, [p for _, _, p in sample]))[:, LABELS.index("refusal")] < DOUBT
    # Nothing to learn from: all is left to the exact checks, and a refusal has none.
    least = np.array([1.1 if x == "refusal" else 0.0 for x in LABELS], np.float32)
    return Classifier(np.zeros((SPACE, len(LABELS)), np.float32), np.zeros(len(LABELS), np.float32), least)


def train(df: DataFrame, key: str, output: str, claim: str, prediction: str, rows: int = TRAIN_ROWS) -> Classifier:
    """Train on a bounded sample of ``df``: the ``rows`` rows of smallest hash of the key."""
    picked = df.where(F.length(output) > 0).where(F.length(claim) > 0).select(output, claim, prediction, F.xxhash64(key).alias("h"), F.col(key).alias("k"))
    return fit([(r[0], r[1], r[2]) for r in picked.orderBy("h", "k").limit(rows).collect()])


def flags(f: Facts, score: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Labels that the classifier proposes and that stand up to an exact check; truncation is only proposed here."""
    proposed = score >= threshold
    copied = (f.share >= 0.85) & (f.added <= FRAME_WORDS) & (f.claimed >= 3)
    whole = np.array([a.shape != "broken" for a in f.answers], bool)
    other = np.array([a != "" and b != "" and a != b for a, b in zip(f.ours, f.theirs)], bool)
    return proposed & np.stack([np.array(f.nothing, bool) & whole, np.ones(len(whole), bool), ~copied, copied, other], axis=1)


def defects(
    df: DataFrame, key: str, output: str, claim: str, source: str, prediction: str, model: Classifier | None = None
) -> DataFrame:
    """(key, defect): every row whose answer is defective, with the first defect of ``LABELS`` that applies.

    A null output is empty. A null or blank claim has no copy and no language. Repeated rows count
    once. Other columns are left behind. The classifier (fixed size) is broadcast; truncation is
    confirmed by the endings and limits of ``cut_values``, joined by key. Only flagged rows are shuffled.
    """
    model = model or train(df, key, output, claim, prediction)
    shipped = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(df[key].alias("k"), df[output].alias("o"), df[claim].alias("c"), df[prediction].alias("p"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, threshold = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                f = facts(part.column(1).to_pylist(), part.column(2).to_pylist())
                found = flags(f, scores(weights, bias, features(f, part.column(3).to_pylist())), threshold)
                keep = np.flatnonzero(found.any(axis=1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), *(pa.array(x) for x in found[keep].T)], ["k", *LABELS])

    flagged = rows.mapInArrow(run, f"k {kind}, " + ", ".join(f"{x} boolean" for x in LABELS)).dropDuplicates(["k"])
    values = df.select(df[key].alias("id"), df[source].alias("source"), df[claim].alias("about"), F.lit(None).cast("string").alias("rationale"), df[output].alias("raw_model_output"))
    cut = cut_values(values, None).select(F.col("id").alias("k"), F.lit(True).alias("is_cut"))
    both = flagged.join(cut, "k", "left")
    first = (
        F.when(F.col("empty"), "empty")
        .when(F.col("truncated") & F.col("is_cut"), "truncated")
        .when(F.col("refusal"), "refusal")
        .when(F.col("copy"), "copy")
        .when(F.col("language"), "language")
    )
    return both.select(F.col("k").alias(key), first.alias("defect")).where("defect is not null")
