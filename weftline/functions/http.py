"""What the headers of a fetch say about its body, and the body's declared text."""

from __future__ import annotations

import codecs
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def header(headers: Column, name: str) -> Column:
    """Value of header ``name``, in any case; NULL without headers or without that header."""
    named = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(F.transform(named, lambda e: e["value"]), F.lit(0))


def media_type(headers: Column, default: str = "text/html") -> Column:
    """The content-type before ``;`` in lower case; ``default`` where no content-type is given."""
    before = F.lower(F.trim(F.split_part(header(headers, "content-type"), F.lit(";"), F.lit(1))))
    return F.when(before.isNull() | (before == ""), F.lit(default)).otherwise(before)


def charset(headers: Column) -> Column:
    """The charset parameter of the content-type as written, or NULL."""
    found = F.regexp_extract(header(headers, "content-type"), r"(?i)charset\s*=\s*[\"']?([^\s\"';]+)", 1)
    return F.when(found != "", found)


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and path; NULL where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


@lru_cache(maxsize=256)
def codec_of(name: str | None) -> str:
    """Python codec of a declared charset; UTF-8 if none is named or the name is unknown."""
    try:
        info = codecs.lookup(name or "utf-8")
    except (LookupError, ValueError):
        return "utf-8"
    return info.name if info._is_text_encoding else "utf-8"


def declared_text(body: bytes | None, declared: str | None) -> str | None:
    """Body decoded by its declared charset, invalid bytes replaced; None for a null body."""
    if body is None:
        return None
    return bytes(body).decode(codec_of(declared), "replace")
