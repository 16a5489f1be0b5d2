"""Overlapping chunks that end at structural breaks and keep fenced code whole. All offsets and sizes are bytes."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES, OVERLAP_BYTES = 3200, 480

# What a chunk may end at, and how good an end it is; earlier entries win a place.
BREAKS = (("\n# ", 100), ("\n## ", 90), ("\n### ", 85), ("\n#### ", 80), ("\n```", 75), ("\n---", 70), ("\n\n", 60), ("\n- ", 45), ("\n* ", 45), ("\n1. ", 45), (". ", 30), (".\n", 30), ("\n", 10))
_LINE = re.compile(rb"[^\n]*")


@dataclass(frozen=True)
class Chunk:
    text: str
    pos: int


def break_points(raw: bytes) -> tuple[list[int], list[int]]:
    """Places and scores, in order of place."""
    best: dict[int, int] = {}
    for mark, score in BREAKS:
        after = 1 if mark[0] == "\n" else len(mark)
        for m in re.finditer(re.escape(mark.encode()), raw):
            if 0 < m.start() + after < len(raw):
                best.setdefault(m.start() + after, score)
    places = sorted(best)
    return places, [best[p] for p in places]


def fences(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of fenced blocks; one left open protects nothing."""
    lines = [m.span() for m in _LINE.finditer(raw) if m[0].decode(errors="replace").strip()[:3] in ("```", "~~~")]
    return [(a, d) for (a, _), (_, d) in zip(lines[::2], lines[1::2], strict=False)]


class Chunker:
    def __init__(self, max_bytes: int = MAX_BYTES, overlap_bytes: int = OVERLAP_BYTES):
        self.max_bytes, self.overlap_bytes = max_bytes, overlap_bytes

    def _best(self, places: list[int], scores: list[int], blocks: list[tuple[int, int]], target: int) -> int | None:
        """The place near the target of the highest score after decay; the last of equals."""
        reach = self.max_bytes // 4
        found: tuple[float, int] | None = None
        for k in range(bisect_left(places, max(0, target - reach)), bisect_right(places, target + reach // 4)):
            p = places[k]
            if any(a < p < b for a, b in blocks):
                continue
            far = abs(p - target) / reach if reach else math.nan
            near = math.fma(-far, far, 1.0) if reach else 0.0
            worth = (scores[k] * max(near, 0.0), p)
            if found is None or worth >= found:
                found = worth
        return found and found[1]

    def split(self, text: str) -> list[Chunk]:
        raw = text.encode()
        size = len(raw)
        if size <= self.max_bytes:
            return [Chunk(text, 0)]
        begins = lambda i: i >= size or raw[i] & 0xC0 != 0x80
        (places, scores), blocks = break_points(raw), fences(raw)
        out, pos = [], 0
        while True:
            target = end = min(pos + self.max_bytes, size)
            if end < size:
                cut = self._best(places, scores, blocks, target)
                if cut is not None and pos < cut <= target:  # a better place beyond the target isn't replaced by the next best
                    end = cut
            while not begins(end):
                end -= 1
            if end <= pos:
                end = pos + 1
                while not begins(end):
                    end += 1
            out.append(Chunk(raw[pos:end].decode(), pos))
            if end >= size:
                return out
            back = max(0, end - self.overlap_bytes)
            while not begins(back):
                back -= 1
            pos = back if back > pos else end


def chunk_column(body, chunker: Chunker | None = None) -> Column:
    """``array<struct<seq, pos, text>>``, to be exploded."""
    chunker = chunker or Chunker()

    @F.pandas_udf("array<struct<seq:int,pos:int,text:string>>")
    def cut(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [] if b is None else [{"seq": i, "pos": c.pos, "text": c.text} for i, c in enumerate(chunker.split(b))])

    return cut(body)
