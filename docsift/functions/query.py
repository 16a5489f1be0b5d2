"""The search syntax, and typed queries with their expansion."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import StrEnum

from docsift.functions.text import PORTER, analyze


@dataclass(frozen=True)
class Clause:
    """Words that stand one after another in one column; ``prefix``: the last one may go on."""

    words: tuple[str, ...]
    prefix: bool = False
    negated: bool = False

    def fts5(self) -> str:
        return f'"{" ".join(self.words)}"' + "*" * self.prefix

    def analyzed(self, analyzer: str) -> Clause:
        return Clause(tuple(t for w in self.words for t in analyze(w, analyzer)), self.prefix, self.negated)


# An item: maybe a minus, then a quoted phrase (the closing sign may be missing) or a run up to white space or a quote.
_ITEM = re.compile(r'[\t\n\x0c\r ]*(?P<minus>-)?(?:"(?P<phrase>[^"]*)"?|(?P<bare>[^\t\n\x0c\r "]*))')


def _words(part: str) -> list[str]:
    out, now = [], ""
    for c in part:
        if c.isalnum() or c == "'":
            now += c
        else:
            out.append(now)
            now = ""
    return [w.lower() for w in [*out, now] if w]


def parse(query: str) -> list[Clause]:
    """Clauses in order; empty if none is positive. A bare word is a prefix, a punctuated one a phrase."""
    clauses, text, at = [], query.strip(), 0
    while at < len(text):
        m = _ITEM.match(text, at)
        if m.end() == at:
            break
        at = m.end()
        quoted = m["phrase"] is not None
        words = _words(m["phrase"] if quoted else m["bare"])
        if words:
            clauses.append(Clause(tuple(words), not quoted and len(words) == 1, m["minus"] is not None))
    return clauses if any(not c.negated for c in clauses) else []


def to_fts5(query: str) -> str | None:
    """The clauses in SQLite's full-text syntax, for comparison."""
    clauses = parse(query)
    kept = " ".join(c.fts5() for c in clauses if not c.negated)
    return kept + "".join(f" NOT {c.fts5()}" for c in clauses if c.negated) if clauses else None


def clauses_for(query: str, analyzer: str = PORTER) -> list[Clause]:
    """Parsed and analysed; clauses without a token are dropped, and with them everything if none positive is left."""
    out = [c for c in (c.analyzed(analyzer) for c in parse(query)) if c.words]
    return out if any(not c.negated for c in out) else []


class QueryType(StrEnum):
    LEX = "lex"
    VEC = "vec"
    HYDE = "hyde"


@dataclass(frozen=True)
class Query:
    kind: QueryType
    text: str


def expand_simple(query: str) -> list[Query]:
    return [Query(QueryType.LEX, query), Query(QueryType.VEC, query), Query(QueryType.HYDE, f"Information about {query}")]


_LINE = re.compile(r"(lex|vec|hyde):\s*(.+)")


def from_model_output(output: str, original: str) -> list[Query]:
    """Lines ``kind: text`` that share a word with the original; the simple expansion if there are none."""
    asked = original.lower()
    words = [w for w in asked.split() if len(w.encode()) >= 3]
    found = []
    for line in output.splitlines():
        if (m := _LINE.fullmatch(line.strip())) and (len(asked.encode()) < 3 or any(w in m[2].lower() for w in words)):
            found.append(Query(QueryType(m[1]), m[2].strip()))
    return found or expand_simple(original)
