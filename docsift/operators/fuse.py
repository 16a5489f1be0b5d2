"""Reciprocal rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The constant of the fusion, and the weights of the lists of a hybrid search.
RRF_K = 60
ORIGINAL, EXPANDED, VECTOR = 1.0, 0.8, 1.0


def rank_list(rows: DataFrame, list_id: int, weight: float, order: Sequence[Column | str], key: Column) -> DataFrame:
    """Adds ``key, list_id, weight, rank`` (from 0) to one result list. Lists are limits, so they are small."""
    return rows.select("*", key.alias("key"), F.lit(list_id).alias("list_id"), F.lit(float(weight)).alias("weight")).withColumn("rank", F.row_number().over(Window.partitionBy("list_id").orderBy(*order)) - 1)


def rrf(lists: DataFrame, k: int = RRF_K, keep: Sequence[str] = ()) -> DataFrame:
    """``key, score`` and, of the first list and place that has the key, the columns ``keep``.

    A key that stands twice in a list adds twice. Parts are summed in the order of lists and ranks, so the sum is the same
    in every run.
    """
    part = F.struct("list_id", "rank", (F.col("weight") / (F.lit(k) + F.col("rank") + 1)).alias("part"))
    total = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(0.0), lambda s, x: s + x["part"])
    first = [F.min_by(F.struct(*keep), F.struct("list_id", "rank")).alias("_first")] if keep else []
    fused = lists.groupBy("key").agg(total.alias("score"), *first)
    return fused.select("key", "score", *(["_first.*"] if keep else []))


class Reranker(Protocol):
    """Scores passages for a query; must be picklable."""

    def score(self, query: str, passages: list[str]) -> list[float]: ...


class OverlapReranker:
    """A deterministic stand-in for a cross-encoder: the share of query words that the passage holds."""

    def score(self, query: str, passages: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(p.lower().split())) / max(1, len(words)) for p in passages]


def rerank_scores(passage, query: str, reranker: Reranker) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in batches:
            yield pd.Series(reranker.score(query, p.fillna("").tolist()), index=p.index, dtype="float64")

    return run(passage)
