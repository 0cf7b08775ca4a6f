"""Verdicts in raw model output: a strict parse, and recovery of what breaks the format harmlessly."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LABELS = ("FACTUAL", "NON_FACTUAL", "UNKNOWN")
#: Limits of a rationale, and other names of the three fields.
MOST_WORDS, MOST_CHARS = 35, 240
ALIASES = {"label": "prediction", "verdict": "prediction", "score": "confidence", "explanation": "rationale", "reason": "rationale"}
_FENCE = re.compile(r"^```[a-zA-Z]*\s*|\s*```$")


def _strict_pairs(pairs):
    seen = dict(pairs)
    if len(seen) != len(pairs):
        raise ValueError("duplicate_key")
    return seen


def _no_constant(name):
    raise ValueError("not_finite")


def strict_json(text: str):
    """JSON without repeated keys, NaN or infinities, and with nothing behind it."""
    return json.loads(text, object_pairs_hook=_strict_pairs, parse_constant=_no_constant)


def check_verdict(value) -> str | None:
    """Why a parsed value is no verdict; None if it is one."""
    if not isinstance(value, dict):
        return "not_an_object"
    if set(value) != {"prediction", "confidence", "rationale"}:
        return "wrong_keys"
    if value["prediction"] not in LABELS:
        return "wrong_label"
    c = value["confidence"]
    if isinstance(c, bool) or not isinstance(c, (int, float)) or not 0 <= c <= 1:
        return "wrong_confidence"
    r = value["rationale"]
    if not isinstance(r, str) or not r.strip():
        return "wrong_rationale"
    return "rationale_too_long" if len(r.split()) > MOST_WORDS or len(r) > MOST_CHARS else None


def parse_verdict(raw: str | None, recover: bool = False) -> tuple[str, str | None, str | None, float | None, str | None]:
    """(outcome, reason, prediction, confidence, method) of one output.

    Without ``recover`` only the exact format is ok. With it fences, text behind the object, other
    key names, extra keys, labels in lower case and long rationales are forgiven, never a missing label.
    """
    if raw is None or not raw.strip():
        return "empty", "empty", None, None, None
    try:
        value, reason = strict_json(raw), None
        reason = check_verdict(value)
    except ValueError as e:
        value, reason = None, str(e) if str(e) in ("duplicate_key", "not_finite") else "not_json"
    if reason is None:
        return "ok", None, value["prediction"], float(value["confidence"]), "strict"
    if not recover:
        return "parse_error", reason, None, None, None
    text = _FENCE.sub("", raw.strip())
    try:
        value, _ = json.JSONDecoder().raw_decode(text)
    except ValueError:
        return "parse_error", reason, None, None, None
    if not isinstance(value, dict):
        return "parse_error", reason, None, None, None
    named = {ALIASES.get(str(k).lower(), str(k).lower()): v for k, v in value.items()}
    label = str(named.get("prediction", "")).strip().upper().replace("-", "_").replace(" ", "_")
    c = named.get("confidence")
    good = isinstance(c, (int, float)) and not isinstance(c, bool) and 0 <= c <= 1
    if label not in LABELS:
        return "parse_error", reason, None, None, None
    return "recovered", reason, label, float(c) if good else None, "format"


def parse_verdicts(df: DataFrame, key: str, raw: str, recover: bool = False) -> DataFrame:
    """(key, outcome, reason, prediction, confidence, method) of every row; row-local."""
    rows = df.select(df[key].alias("k"), df[raw].alias("r"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(parse_verdict(r, recover) for r in batch.column(1).to_pylist()))) or [()] * 5
            types = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["k", "outcome", "reason", "prediction", "confidence", "method"])

    out = rows.mapInArrow(run, f"k {kind}, outcome string, reason string, prediction string, confidence double, method string")
    return out.withColumnRenamed("k", key)
