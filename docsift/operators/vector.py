"""Exact nearest neighbours by Euclidean distance, and pluggable embedders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are compared at once in a batch search, so what is broadcast stays small.
QUERY_BLOCK = 4096
#: Distances of a batch that a task holds at once.
CELLS = 1 << 20


class Embedder(Protocol):
    """Turns texts into vectors; must be picklable, and is loaded once a worker."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A deterministic stand-in for a model: signed hashed word counts, of length 1."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dims] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).astype(np.float32).tolist()


def embed_column(text, embedder: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedder.embed(texts.tolist()), index=texts.index)

    return run(text)


def distance(vector, query: Sequence[float]) -> Column:
    """Euclidean distance in double, inside the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def knn(vectors: DataFrame, query: Sequence[float], k: int, ties: Sequence[str], vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows with ``distance``; every task keeps its own k, so k rows a task are moved."""
    fits = vectors.where(F.size(vector_col) == len(query))
    return fits.withColumn("distance", distance(vector_col, query)).orderBy("distance", *ties).limit(k)


def knn_join(hits: DataFrame, documents: DataFrame, where: Column | None = None) -> DataFrame:
    """Chunk hits to documents that share the content hash: one row a hit and active document, with ``score``.

    Filters act after the k nearest are chosen, so fewer rows than k may be left.
    """
    found = documents.where("active").join(F.broadcast(hits.select("hash", "seq", "distance")), "hash")  # hits are k rows
    found = found if where is None else found.where(where)
    return found.withColumn("score", 1 - F.col("distance"))


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, id, distance, rank``: the k nearest of each query among all vectors.

    Queries go round in blocks of a bounded size; each task keeps k candidates a query and block, and a window picks the k
    best of those. Candidates of a batch are all rows that rounding can't tell from the k-th nearest, however many tie; their
    distances are recomputed from differences and cut to k by distance and id, so ranks don't depend on rounding or partitions.
    """
    out = None
    asked = queries.select(F.col(id_col).alias("q"), F.col(vector_col).alias("v")).where("v is not null")
    part: list = []

    def compared(rows: list) -> DataFrame:
        ids = np.array([r.q for r in rows], np.int64)
        q = np.array([r.v for r in rows], np.float64)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q, (q**2).sum(axis=1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, qq = sent.value
            best: list[np.ndarray] = []
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.array([v for v in b.column(1).to_pylist() if v is not None and len(v) == q.shape[1]], np.float64).reshape(-1, q.shape[1])
                names = np.array([n for n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if v is not None and len(v) == q.shape[1]], np.int64)
                if not len(names):
                    continue
                best += _candidates(ids, q, qq, names, x, k)
                if sum(p.shape[1] for p in best) > 64 * k * len(ids):
                    best = [_kept(np.concatenate(best, axis=1), k)]
            if best:
                a = _kept(np.concatenate(best, axis=1), k)
                yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1]), pa.array(a[2].view(np.float64))], names=["query_id", "id", "distance"])

        return vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "query_id bigint, id bigint, distance double")

    for r in asked.toLocalIterator():
        part.append(r)
        if len(part) == block:
            out, part = compared(part) if out is None else out.unionAll(compared(part)), []
    if part or out is None:
        out = compared(part or [type("Row", (), {"q": -1, "v": [0.0]})()]) if out is None else out.unionAll(compared(part))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def _candidates(ids: np.ndarray, q: np.ndarray, qq: np.ndarray, names: np.ndarray, x: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """``query, id, distance`` of the k nearest rows of a batch, ties by id, for some queries at a time."""
    xx, dims = (x**2).sum(axis=1), max(1, x.shape[1])
    wide = 8 * (dims + 4) * np.finfo(float).eps
    step, pairs = max(1, CELLS // len(names)), max(1, CELLS // dims)
    for at in range(0, len(ids), step):
        some, norm = q[at : at + step], qq[at : at + step, None]
        near = norm + xx[None] - 2 * some @ x.T
        last = np.partition(near, k - 1, axis=1)[:, k - 1 : k] if len(names) > k else np.full((len(some), 1), np.inf)
        # Both the k-th value and the one beside it may be off by the rounding of sums of this size.
        row, col = np.nonzero(~(near - wide * (norm + xx[None]) > last + wide * (norm + np.max(xx))))
        kept: list[np.ndarray] = []
        for p in range(0, len(row), pairs):
            r, c = row[p : p + pairs], col[p : p + pairs]
            d = np.sqrt(((x[c] - some[r]) ** 2).sum(axis=1))
            kept = [_kept(np.concatenate([*kept, np.stack([ids[at + r], names[c], d.view(np.int64)])], axis=1), k)]
        yield from kept


def _kept(rows: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each query."""
    order = np.lexsort((rows[1], rows[2].view(np.float64), rows[0]))
    rows = rows[:, order]
    first = np.searchsorted(rows[0], rows[0], "left")
    return rows[:, np.arange(rows.shape[1]) - first < k]
