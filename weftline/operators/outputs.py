"""Model outputs of the stages: each shape is declared, one parser checks any of them and names the first rule broken."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.operators.verdicts import strict_json


class Text(NamedTuple):
    """A string of ``least`` to ``most`` characters once white space is collapsed (``lines``: only line ends are)."""

    least: int
    most: int
    lines: bool = False


class Choice(NamedTuple):
    """One of the given names."""

    names: tuple[str, ...]


class Texts(NamedTuple):
    """A list of ``fewest`` to ``most_items`` texts without two that differ in case only."""

    fewest: int
    most_items: int
    item: Text


#: Shapes of the stages' outputs.
QUESTIONS = {"verification_questions": Texts(5, 8, Text(5, 320))}
CLAIMS = {"claims": Texts(0, 64, Text(3, 600))}
ANSWER = {"answer_status": Choice(("ANSWERED", "UNCERTAIN", "INVALID_PREMISE")), "verification_answer": Text(2, 1200)}
EVALUATION = {
    "alignment_validity": Choice(("VALID_DIRECT", "VALID_PARTIAL", "INVALID")),
    "evidence_sufficiency": Choice(("SUFFICIENT", "PARTIAL", "INSUFFICIENT")),
    "answer_correctness": Choice(("CORRECT", "PARTIALLY_CORRECT", "INCORRECT", "INSUFFICIENT", "UNVERIFIABLE")),
    "answer_stance": Choice(("SUPPORTS_CLAIM", "CHALLENGES_CLAIM", "MIXED", "NO_POSITION")),
    "rationale": Text(3, 480),
}
REVISION = {"revised_response": Text(20, 30_000, True)}


class Broken(ValueError):
    """The first rule that an output breaks."""


def _read(name: str, rule, value):
    if isinstance(rule, Choice):
        if value not in rule.names:
            raise Broken(f"{name}:not_a_choice")
        return value
    if isinstance(rule, Texts):
        if not isinstance(value, list):
            raise Broken(f"{name}:not_a_list")
        items = [_read(name, rule.item, v) for v in value]
        if not rule.fewest <= len(items) <= rule.most_items:
            raise Broken(f"{name}:count")
        if len({i.casefold() for i in items}) != len(items):
            raise Broken(f"{name}:duplicate")
        return items
    if not isinstance(value, str):
        raise Broken(f"{name}:not_a_text")
    text = value.replace("\r\n", "\n").replace("\r", "\n").strip() if rule.lines else " ".join(value.split())
    if not rule.least <= len(text) <= rule.most:
        raise Broken(f"{name}:length")
    return text


def parse(raw: str | None, shape: dict) -> dict:
    """The fields of an output of exactly this shape; raises ``Broken`` with the rule otherwise."""
    if raw is None or not raw.strip():
        raise Broken("empty")
    try:
        value = strict_json(raw)
    except (ValueError, RecursionError):
        raise Broken("not_json") from None
    if not isinstance(value, dict) or set(value) != set(shape):
        raise Broken("fields")
    return {name: _read(name, rule, value[name]) for name, rule in shape.items()}


_FENCED = re.compile(r"\A```[A-Za-z]*\s*(.*?)\s*```\Z", re.S)


def recover_text(raw: str | None, shape: dict) -> tuple[dict, str]:
    """The one text of a one-field shape, where only the format is broken; the words are never changed.

    A fence around the output, another key, several texts under keys, or a text alone in braces are
    understood, in this order; anything else raises ``Broken``.
    """
    (name, rule), text = next(iter(shape.items())), (raw or "").strip()
    fenced = _FENCED.match(text)
    if fenced:
        try:
            return parse(fenced[1], shape), "fence"
        except Broken:
            text = fenced[1]
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        value = None
    if isinstance(value, dict) and value and all(isinstance(v, str) for v in value.values()):
        if len(value) == 1:
            return {name: _read(name, rule, next(iter(value.values())))}, "other_key"
        return {name: _read(name, rule, "\n".join(f"{k}: {v}" for k, v in value.items()))}, "flat_object"
    if value is None and text[:1] == "{" and text[-1:] == "}":
        try:
            inner = json.loads(text[1:-1])
        except ValueError:
            inner = None
        if isinstance(inner, str):
            return {name: _read(name, rule, inner)}, "text_in_braces"
    raise Broken("not_recoverable")


def without_duplicates(raw: str | None, shape: dict) -> dict:
    """As ``parse`` for a list of texts, with later duplicates left out instead of refused."""
    try:
        value = json.loads(raw or "")
        (name, rule), items = next(iter(shape.items())), value[next(iter(shape))]
        kept = {_read(name, rule.item, i).casefold(): i for i in reversed(items)}
        unique = [i for i in items if kept.get(_read(name, rule.item, i).casefold()) is i]
    except (ValueError, TypeError, KeyError, RecursionError):
        return parse(raw, shape)
    return parse(json.dumps({name: unique}), shape) if set(value) == {name} else parse(raw, shape)


def parse_outputs(df: DataFrame, key: str, raw: str, shape: dict, recover: bool = False) -> DataFrame:
    """(key, outcome, rule, method, fields): outcome ok, recovered or parse_error; ``fields`` is JSON with sorted keys.

    Null and blank outputs are parse errors. ``recover`` forgives the format of a one-text shape and
    duplicates of a list shape. Row-local; other columns are left behind.
    """
    rows = df.select(df[key].alias("k"), df[raw].alias("r"))
    kind = rows.schema["k"].dataType.simpleString()

    def one(text: str | None) -> tuple:
        method = "strict"
        try:
            fields, rule = parse(text, shape), None
        except Broken as e:
            fields, rule = None, str(e)
        if fields is None and recover:
            try:
                if isinstance(next(iter(shape.values())), Texts):
                    fields, method = without_duplicates(text, shape), "deduplicated"
                else:
                    fields, method = recover_text(text, shape)
            except Broken:
                pass
        if fields is None:
            return "parse_error", rule, None, None
        return "ok" if rule is None else "recovered", rule, method, json.dumps(fields, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(one, batch.column(1).to_pylist()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], ["k", "outcome", "rule", "method", "fields"])

    return rows.mapInArrow(run, f"k {kind}, outcome string, rule string, method string, fields string").withColumnRenamed("k", key)
