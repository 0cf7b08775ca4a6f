"""Which URLs may be fetched, when to try again, how bytes become text, and stable hashes of JSON."""

from __future__ import annotations

import hashlib
import html
import ipaddress
import json
import re
from collections.abc import Callable
from datetime import UTC, datetime
from difflib import SequenceMatcher
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

import pandas as pd
import unicodedata
from collections import Counter
from pyspark.sql import functions as F

from weftline.functions.http import codec_of

_BLANKS = re.compile(r"[^\S\n]+")
_WORDS = re.compile(r"[^\w]+")


def safe_url(url: str | None) -> tuple[str | None, str | None]:
    """(URL to fetch, None) or (None, why it must not be fetched). Nothing but syntax is changed: the query stays."""
    text = (url or "").strip()
    if not text:
        return None, "missing"
    if any(c < " " or c == "\x7f" for c in text):
        return None, "control_characters"
    try:
        parts = urlsplit(text)
        port = parts.port
    except ValueError:
        return None, "malformed"
    scheme = parts.scheme.lower()
    if scheme not in ("http", "https"):
        return None, "scheme"
    if parts.username is not None or parts.password is not None:
        return None, "userinfo"
    try:
        host = (parts.hostname or "").rstrip(".").encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None, "host"
    if not host or "%" in host or host == "localhost" or host.endswith(".localhost"):
        return None, "host"
    try:
        if not public_address(host) and ipaddress.ip_address(host):
            return None, "address"
    except ValueError:
        pass
    usual = 443 if scheme == "https" else 80
    shown = f"[{host}]" if ":" in host else host
    where = shown if port in (None, usual) else f"{shown}:{port}"
    return f"{scheme}://{where}{parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""), None


def public_address(address: str) -> bool:
    """Whether an IP address is one of the public network."""
    try:
        a = ipaddress.ip_address(address)
    except ValueError:
        return False
    mapped = getattr(a, "ipv4_mapped", None)
    if mapped is not None:
        return public_address(str(mapped))
    return a.is_global and not (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified)


def retry_delay(retry_after: str | None, retry: int, backoff: float = 1.0, most: float = 60.0, now: datetime | None = None) -> float | None:
    """Seconds to wait before the next try: what the server asks for (seconds or a date), else doubling; None: do not try."""
    wait = -1.0
    if retry_after:
        try:
            wait = float(retry_after)
        except ValueError:
            try:
                when = parsedate_to_datetime(retry_after)
                wait = max(0.0, ((when if when.tzinfo else when.replace(tzinfo=UTC)) - (now or datetime.now(UTC))).total_seconds())
            except (TypeError, ValueError, OverflowError):
                wait = -1.0
    if not wait >= 0:
        wait = backoff * 2**retry
    return wait if wait <= most else None


def decode_cascade(body: bytes, declared: str | None) -> tuple[str, str]:
    """Text of a body and how it was read: the declared charset, UTF-8, Windows-1252 and Latin-1 are tried in turn."""
    names = [codec_of(declared)] if declared and codec_of(declared) != "utf-8" else []
    for name in [*names, "utf-8-sig" if body[:3] == b"\xef\xbb\xbf" else "utf-8", "cp1252", "latin-1"]:
        try:
            return body.decode(name), name
        except UnicodeDecodeError:
            continue
    return body.decode("utf-8", "replace"), "utf-8-replacement"


def document_space(text: str) -> str:
    """Text with references resolved, blanks collapsed in each line, and never more than one empty line."""
    out: list[str] = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = " ".join(html.unescape(line).split())
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


def canonical_hash(value) -> str:
    """SHA-256 of a JSON value with sorted keys and no blanks; the order of keys does not matter."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def aligned_form(text: str) -> str:
    """Text for alignment: references resolved, compatibility forms unified, without case, words only."""
    return _WORDS.sub(" ", unicodedata.normalize("NFKC", html.unescape(text)).casefold()).strip()


def lexical_score(evidence: str | None, passage: str | None) -> float:
    """How well a passage matches evidence: 0.8 x recall + 0.2 x F1 of the words, or the ratio of common runs if that is higher."""
    a, b = aligned_form(evidence or ""), aligned_form(passage or "")
    left, right = Counter(a.split()), Counter(b.split())
    if not left or not right:
        return 0.0
    both = (left & right).total()
    recall, precision = both / left.total(), both / right.total()
    f1 = 2 * precision * recall / (precision + recall) if both else 0.0
    words = 0.8 * recall + 0.2 * f1
    matcher = SequenceMatcher(None, a, b, autojunk=False)
    # The ratio is dear; two upper bounds tell most pairs apart.
    if matcher.real_quick_ratio() <= words or matcher.quick_ratio() <= words:
        return words
    return max(words, matcher.ratio())


def batch_udf(f: Callable, returns: str):
    """``f`` over Arrow batches of one or two string columns."""

    def one(a: pd.Series) -> pd.Series:
        return a.map(f, na_action="ignore")

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)])

    return {1: F.pandas_udf(one, returns), 2: F.pandas_udf(two, returns)}
