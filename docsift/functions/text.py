"""Analysers, titles, snippets and content hashes, as Spark columns."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift.functions.stem import stem

SIMPLE, UNICODE, PORTER = "simple", "unicode61", "porter_unicode61"


def content_hash(col) -> Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)


def docid(hash_col) -> Column:
    return F.substring(hash_col, 1, 6)


def display_path(collection="collection", path="path") -> Column:
    return F.concat_ws("/", collection, path)


def title(body, path) -> Column:
    """The first heading of level 1 or 2 with text, else the file name without its last extension."""
    heading = F.trim(F.regexp_extract(body, r"(?m)^[\s&&[^\n]]*##? [\s&&[^\n]]*(\S[^\n]*?)\s*$", 1))
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(heading != "", heading).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


# --- analysers


@lru_cache(maxsize=1 << 16)
def _folded(c: str) -> str:
    """One character in lower case, without a single diacritic; a combining mark alone is nothing."""
    if unicodedata.category(c) == "Mn":
        return ""
    low = "s" if c == "ſ" else c.lower()
    parts = unicodedata.normalize("NFD", low)
    return parts[0] if len(parts) == 2 and unicodedata.category(parts[1]) == "Mn" and parts[0].isascii() else low


@lru_cache(maxsize=1 << 16)
def _is_token(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co"


#: A combining mark continues a token that has begun.
_MARK = re.compile("[̀-ͯ]")
_ASCII_TOKEN = re.compile("[0-9a-z]+")


def tokens(text: str) -> list[str]:
    """Unicode tokens, folded."""
    if text.isascii():
        return _ASCII_TOKEN.findall(text.lower())
    out, now = [], []
    for c in text:
        if _is_token(c) or now and _MARK.match(c):
            now.append(_folded(c))
        elif now:
            out.append("".join(now))
            now = []
    return [t for t in [*out, "".join(now)] if t]


_stem = lru_cache(maxsize=1 << 18)(stem)


def analyze(text: str | None, analyzer: str = PORTER) -> list[str]:
    """The tokens of one text, on the driver or inside a worker."""
    if not text:
        return []
    if analyzer == SIMPLE:
        import regex

        return regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return [_stem(t) for t in tokens(text)] if analyzer == PORTER else tokens(text)


def token_column(col, analyzer: str = SIMPLE) -> Column:
    """The tokens of a column. The simple analyser stays in the JVM, the others are an Arrow UDF."""
    text = F.coalesce(col if isinstance(col, Column) else F.col(col), F.lit(""))
    if analyzer == SIMPLE:
        return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: analyze(t, analyzer))

    return split(text)


def term_places(words: Column) -> Column:
    """Distinct terms of an array of tokens, each with its places: sorted inside the row, then cut into runs."""

    def bound(value: Column, use) -> Column:
        """``use`` of a value that is worked out once, however often it is named."""
        return F.get(F.transform(F.array(value), use), 0)

    def runs(pairs: Column) -> Column:
        term = lambda k: F.get(pairs, k)["term"]
        starts = F.filter(F.transform(pairs, lambda _, k: k), lambda k: (k == 0) | (term(k - 1) != term(k)))

        def cut(at: Column) -> Column:
            end = lambda j: F.coalesce(F.get(at, j + 1), F.size(pairs))
            return F.transform(at, lambda a, j: F.struct(term(a).alias("term"), F.transform(F.slice(pairs, a + 1, end(j) - a), lambda x: x["at"]).alias("positions")))

        return bound(starts, cut)

    return bound(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at")))), runs)


# --- snippets

#: Bytes kept before the first hit.
LEAD = 50


def snippet(body: str, query: str, size: int) -> str:
    """Whole lines around the first query word of three bytes or more that the body holds; sizes are bytes."""
    raw = body.encode()
    if len(raw) <= size:
        return body
    low = body.lower().encode()
    hits = (low.find(w.lower().encode()) for w in query.split() if len(w.encode()) >= 3)
    start = _boundary(raw, max(0, next((h for h in hits if h >= 0), 0) - LEAD))
    line = raw.rfind(b"\n", 0, start) + 1
    end = raw.find(b"\n", _boundary(raw, min(line + size, len(raw))))
    return raw[line : len(raw) if end < 0 else end].decode()


def _boundary(raw: bytes, at: int) -> int:
    """The last place up to ``at`` where a character begins."""
    at = min(at, len(raw))
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def snippet_column(body, query: str, size: int) -> Column:
    @F.pandas_udf("string")
    def cut(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else snippet(b, query, size))

    return cut(body)
