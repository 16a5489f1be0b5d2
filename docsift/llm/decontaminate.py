"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The benchmark's windows are cut into blocks of a bounded number of words; one block is broadcast at a time, so no table has
to be small. A benchmark of one block, the usual case, is a single pass over the documents without a shuffle. For each
document the scan turns words into numbers of the block's vocabulary, hashes every window of the needed lengths with array
arithmetic, looks the hashes up, and verifies every hit word by word. Hits become spans, and spans or documents go.

Words are runs of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII.

Defined results: null text has no words and no hits; items without words, or without an id, have no windows; items with one
id count once; repeated documents each get a row; an empty benchmark hits nothing; columns other than those named are not read
(report) or are passed through (clean).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.llm.shared import discard, free_name, save, slices, table

WINDOW = 8
#: Items found in so many make a document contaminated.
MIN_ITEMS = 2
#: Words of benchmark items in one broadcast block: about 100 MB as Python objects at most.
BLOCK_WORDS = 400_000
_ASCII = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else (c + 32 if 0x41 <= c <= 0x5A else 0x20) for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_ASCII).split()


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """A polynomial hash of each row of numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = h * _BASE + c
    return h ^ h >> np.uint64(29)


class Grams:
    """Windows of a block of items: vocabulary, sorted hashes by window length, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        owners: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for name, text in items:
            w = words_of(text)
            ids = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in w]
            n = min(window, len(w))
            for i in range(len(w) - n + 1) if n else ():
                owners[n][tuple(ids[i : i + n])].add(name)
        self.by_len = {}
        for n, grams in owners.items():
            keys = np.array(list(grams), np.uint64)
            h = _hash(list(keys.T))
            order = np.argsort(h, kind="stable")
            names = list(grams.values())
            self.by_len[n] = (h[order], keys[order], [sorted(names[i]) for i in order.tolist()])

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Hit words as a mask, and the items found."""
        hit, items = np.zeros(len(words) + 1, np.int64), set()
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        for n, (hashes, keys, owners) in self.by_len.items():
            if len(ids) < n:
                continue
            known = ids > 0
            c = np.concatenate([[0], np.cumsum(known)])
            at = np.flatnonzero(c[n:] - c[:-n] == n)
            if not len(at):
                continue
            h = _hash([ids[at + k] for k in range(n)])
            lo = np.searchsorted(hashes, h)
            found = hashes[np.minimum(lo, len(hashes) - 1)] == h
            for i, j, x in zip(at[found].tolist(), lo[found].tolist(), h[found], strict=True):
                while j < len(hashes) and hashes[j] == x:
                    if (keys[j] == ids[i : i + n]).all():
                        hit[i] += 1
                        hit[i + n] -= 1
                        items.update(owners[j])
                        break
                    j += 1
        return np.cumsum(hit[:-1]) > 0, items


def _runs(mask: np.ndarray) -> list[list[int]]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Iterator[Grams]:
    """The benchmark as hash sets of at most BLOCK_WORDS words (or one item), one held by the driver at a time."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    part: list[tuple[str, bytes]] = []
    size = 0
    for r in rows.toLocalIterator():
        part.append((r.i, bytes(r.t)))
        size += len(r.t) // 5 + 1
        if size >= BLOCK_WORDS:
            yield Grams(part, window)
            part, size = [], 0
    yield Grams(part, window)


FOUND = ("_n_words", "_spans", "_items")


def _joined(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping and touching runs made one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _pass(rows: DataFrame, text_col: str, grams: Grams, below: int | None) -> DataFrame:
    """Adds a block's hits to the columns FOUND, the last three of ``rows``.

    With ``below`` this is the last block and the documents are cleaned at once: those with so many items go, the spans of
    the others are cut out, and FOUND goes.
    """
    sent, at = rows.sparkSession.sparkContext.broadcast(grams), rows.columns.index(text_col)
    names = rows.columns if below is None else rows.columns[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for b in slices(batches):
            spans, items, n = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), []
            for i, t in enumerate(b.column(at).cast(pa.binary())):
                w = words_of(t.as_py() or b"")
                mask, found = g.scan(w)
                n.append(len(w))
                if found:
                    spans[i], items[i] = _joined([*spans[i], *_runs(mask)]), sorted({*items[i], *found})
            if below is None:
                new = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], *new], names=names)
                continue
            cols = list(b.columns[:-3])
            if any(spans):
                cols[at] = pa.array([cut(t.as_py(), s) if s else t.as_py() for t, s in zip(cols[at], spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array([len(x) < below for x in items], pa.bool_()))

    return rows.mapInArrow(run, rows.schema if below is None else T.StructType(rows.schema.fields[:-3]))


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, below: int | None = None) -> DataFrame:
    """The documents with every column and FOUND: words, runs of hit words (end exclusive), and the items that occur.

    Where the documents have columns of those names, the new ones have a number after theirs.

    One block is one pass in the scan's own stage. With more, each pass is written to the shared folder before the next, so
    that one block is in an executor's memory at a time. ``below``: see _pass.
    """
    names = [free_name(docs, n) for n in FOUND]
    out = docs.select("*", F.lit(0).cast("long").alias(names[0]), F.expr("cast(array() as array<array<int>>)").alias(names[1]), F.expr("cast(array() as array<string>)").alias(names[2]))
    parts = blocks(benchmark, item_col, item_text, window)
    grams, following, k = next(parts), next(parts, None), 0
    while following is not None:
        before, out = out, save(_pass(out, text_col, grams, None), "marked")
        if k:
            discard(docs.sparkSession, before)
        grams, following, k = following, next(parts, None), k + 1
    return _pass(out, text_col, grams, below)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """A row for each document: ``doc_id, n_words, spans, items, contaminated``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = mark(rows, benchmark, "text", item_col, item_text, window)
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"), (F.size("_items") >= min_items).alias("contaminated"))


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the characters from each span's first word to its last."""
    import regex

    at = [m.span() for m in regex.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return "".join([*out, text[end:]])


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """The documents with every column: contaminated ones go, the others lose their hit spans."""
    return mark(docs, benchmark, text_col, item_col, item_text, window, min_items)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH low AS (SELECT doc_id, k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT *, row_number() OVER () AS k FROM documents)),
item AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT id, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT id, w, least(8, len(w)) AS n FROM item WHERE len(w) > 0))),
one AS (SELECT DISTINCT n, g FROM win),
pos AS (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM one) WHERE len(w) >= n),
hit AS (SELECT k, i, p.n, one.g FROM (SELECT k, n, i, list_slice(w, i, i + n - 1) AS g FROM pos) p JOIN one ON p.n = one.n AND p.g = one.g),
cover AS (SELECT k, count(DISTINCT i + d) AS n_hit FROM (SELECT k, i, unnest(range(0, n)) AS d FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY encode(id)) AS ids FROM (SELECT DISTINCT k, id FROM hit JOIN win ON hit.n = win.n AND hit.g = win.g) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM low LEFT JOIN cover USING (k) LEFT JOIN items USING (k)
"""
