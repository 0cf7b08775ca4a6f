"""Claims in a canonical form: the same statement in nearly the same words gives nearly the same tokens."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

#: Month names of the languages of the claims, by their number.
MONTHS = {
    m: k
    for names in (
        "january february march april may june july august september october november december",
        "jan feb mar apr may jun jul aug sep oct nov dec",
        "januar februar märz april mai juni juli august september oktober november dezember",
        "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    )
    for k, m in enumerate(names.split(), 1)
} | {"sept": 9}
#: Words that make a statement the opposite.
NEGATIONS = frozenset(
    "not no never none neither nor without cannot hardly nicht kein keine keinen keiner keinem nie niemals ohne pas jamais aucun aucune sans nunca jamás ningún ninguna sin ni nie bez не нет никогда без".split()
)
#: Articles, which do not matter.
ARTICLES = frozenset("a an the der die das den dem des ein eine einen einem einer eines le la les l un une el los las una unos unas".split())
#: Unit signs and other spellings, and number words, in one spelling.
SAME = {
    "km": "kilometres", "kms": "kilometres", "kilometer": "kilometres", "kilometers": "kilometres", "kilometre": "kilometres",
    "m": "metres", "meter": "metres", "meters": "metres", "metre": "metres",
    "cm": "centimetres", "centimeters": "centimetres", "mm": "millimetres", "millimeters": "millimetres",
    "kg": "kilograms", "kilogrammes": "kilograms", "g": "grams", "t": "tonnes", "tons": "tonnes", "tonne": "tonnes",
    "l": "litres", "liters": "litres", "liter": "litres", "litre": "litres", "ha": "hectares", "hectare": "hectares",
    "%": "percent", "pct": "percent", "°": "degrees", "°c": "degrees", "degree": "degrees", "deg": "degrees",
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12",
}
_SCALE = {"thousand": 10**3, "million": 10**6, "billion": 10**9}
_ORDINAL = re.compile(r"^(\d+)(?:st|nd|rd|th|er|re|e|º|ª)$")

_REFERENCES = re.compile(r"\[\s*(?:\d+|[a-z]|note \d+|citation needed)\s*(?:[,;–-]\s*\d+\s*)*\]|[¹²³⁴⁵⁶⁷⁸⁹⁰†‡]|(?<=[.\w])\(\d{1,2}\)$", re.I)
_BULLET = re.compile(r"^\s*(?:[-*•–—>#]+\s+|\(?\d{1,2}[.)]\s+(?=\D))")
_GROUPED = re.compile(r"(?<![\d.,])\d{1,3}(?:([,.'’   ])\d{3})(?:\1\d{3})*(?!\d)")
_DATES = (
    re.compile(r"\b(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})\b"),
    re.compile(r"\b(?P<d>\d{1,2})(?:st|nd|rd|th|\.)?\s+(?:of\s+|de\s+)?(?P<n>[^\W\d_]{3,12})\.?,?\s+(?:de\s+)?(?P<y>\d{4})\b"),
    re.compile(r"\b(?P<n>[^\W\d_]{3,12})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})\b"),
    re.compile(r"\b(?P<d>\d{1,2})[./](?P<m>\d{1,2})[./](?P<y>\d{4})\b"),
)
_TOKEN = re.compile(r"°c|[%°]|\d+(?:\.\d+)?[^\W\d_]*|[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A time phrase: preposition and date or year, at the beginning or end of a clause.
_TIME = re.compile(r"\b(?:in the year|im jahr|en el año|en l’an|in|on|en|im|am)\s+(?P<t>date\d{8}|\d{4})\b", re.I)


@lru_cache(maxsize=4096)
def _month(name: str) -> int:
    if name in MONTHS:
        return MONTHS[name]
    return next((k for full, k in MONTHS.items() if len(full) > 4 and is_slip(name, full)), 0) if len(name) > 4 else 0


def _date(m: re.Match) -> str:
    part = m.groupdict()
    month = int(part["m"]) if part.get("m") else _month(part["n"].lower())
    if not 1 <= month <= 12:
        return m.group()
    return f"date{int(part['y']):04d}{month:02d}{int(part['d']):02d}"


def canonical(claim: str | None) -> list[str]:
    """Tokens of a claim; empty for null and blank claims.

    Case, layout, punctuation, bullets, reference marks and articles are dropped; numbers, dates
    and units get one notation; a time phrase ("in 1946", "on 4 May 1900") is put last.
    """
    text = unicodedata.normalize("NFKC", _REFERENCES.sub(" ", claim or "")).replace("­", "").replace("​", "")
    text = " ".join(text.split())
    text = _BULLET.sub("", text).casefold()
    text = _GROUPED.sub(lambda m: re.sub(r"\D", "", m.group()), text)
    for pattern in _DATES:
        text = pattern.sub(_date, text)
    text = re.sub(r"(\d)[\s-]+(thousand|million|billion)\b", lambda m: m.group(1) + "0" * len(str(_SCALE[m.group(2)])[1:]), text)
    times: list[str] = []

    def take(m: re.Match) -> str:
        times.append(m.group("t"))
        return " "

    text = _TIME.sub(take, text)
    out: list[str] = []
    for token in _TOKEN.findall(text):
        token = token.replace("’", "'")
        if token.endswith("n't"):
            out += [token[:-3], "not"] if token not in ("can't", "won't") else [{"can't": "can", "won't": "will"}[token], "not"]
            continue
        token = token.removesuffix("'s")
        if (m := _ORDINAL.match(token)) is not None:
            token = m.group(1)
        elif token[:1].isdigit() and (m := re.match(r"^(\d+(?:\.\d+)?)([^\W\d_]+)$", token)) is not None:
            out += [m.group(1), SAME.get(m.group(2), m.group(2))]
            continue
        token = SAME.get(token, token)
        if token == "cannot":
            out += ["can", "not"]
        elif token not in ARTICLES:
            out.append(token)
    return out + sorted(times)


def is_number(token: str) -> bool:
    """Whether a token stands for a number or a date; these must agree exactly."""
    return token[:1].isdigit() or (token.startswith("date") and token[4:].isdigit())


def slips(a: str, b: str, most: int = 2) -> int:
    """Slips (insertion, loss, change, swap of neighbours) between two words, ``most`` + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def is_slip(x: str, y: str) -> bool:
    """Whether one word is the other with a spelling slip: one in words of up to four letters, two in longer ones.

    Another letter in place of one makes another word where words are short, as do two such changes anywhere.
    """
    shorter = min(len(x), len(y))
    if shorter < 3:
        return False
    allowed = 1 if shorter <= 4 else 2
    if slips(x, y, allowed) > allowed:
        return False
    left, right = Counter(x), Counter(y)
    changed = min((left - right).total(), (right - left).total())
    return changed == 0 or (changed == 1 and shorter >= 6)


def must_agree(token: str) -> bool:
    """Whether a token must be the same in both claims: numbers, dates and negations."""
    return is_number(token) or token in NEGATIONS


def same_statement(a: list[str], b: list[str], most_words: int) -> bool:
    """Whether two canonical claims say the same in nearly the same words.

    Numbers, dates and negations must agree; at most ``most_words`` other words may differ, each by
    a spelling slip. Words keep their order.
    """
    if len(a) != len(b):
        return False
    differ = 0
    for x, y in zip(a, b):
        if x == y:
            continue
        if must_agree(x) or must_agree(y):
            return False
        differ += 1
        if differ > most_words or not is_slip(x, y):
            return False
    return True
