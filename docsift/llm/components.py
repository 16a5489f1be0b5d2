"""Connected components of a distributed edge list, by alternating large and small stars.

Nothing is gathered on the driver but two numbers a round. Each round's edges are written to the shared folder, so lineage
stays short and lost executors cost one stage. Rounds grow with the logarithm of the longest path.

A hub's edges never meet in one task: keys of many rows get what is known of them by broadcast (see ``by_key``), the others by
shuffle, and least neighbours are aggregated before they are shuffled.

Defined results: edges with a null end and loops are left out; repeated edges count once; no edges give no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.shared import discard, save

#: Keys that may be broadcast, 24 bytes each, and the rows of a key up to which a shuffle is as good.
BROADCAST_KEYS, FEW = 200_000, 1024


def by_key(rows: DataFrame, known: DataFrame, key: str, n_rows: int, scratch: list, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Inner join of rows with one known row a key; ``known`` says in ``n`` how many rows have the key, or more.

    Of ``n_rows`` rows at most ``n_rows / least`` keys can have over ``least`` each, so those keys are within the bound of a
    broadcast whatever the data; their rows stay where they are. Rows of all other keys are shuffled, in groups of ``least`` at
    most. ``known`` is written first, and goes into ``scratch``; most often it has no such key.
    """
    least = max(FEW, -(-n_rows // broadcast_keys))
    known = save(known, "known")
    scratch.append(known)
    if known.where(F.col("n") > least).isEmpty():
        return rows.join(known.drop("n"), key)
    hot = F.broadcast(known.where(F.col("n") > least).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(known.where(F.col("n") <= least).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def _large_star(edges: DataFrame, n: int, scratch: list) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
    return by_key(both.where("v > u"), least, "u", 2 * n, scratch).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int, scratch: list) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hung = by_key(down, least, "u", n, scratch).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(scratch[-1].select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame, name: str = "stars") -> DataFrame:
    """Edges ``u, v`` (bigint, any direction, repeats allowed) to rows ``u, v``: v is the least node that u reaches, u <> v."""
    spark = edges.sparkSession
    now = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = _mark(now)
    while seen[0]:
        scratch: list[DataFrame] = []
        large = save(_large_star(now, seen[0], scratch), name)
        after = save(_small_star(large, seen[0], scratch), name)
        mark = _mark(after)
        for t in (now, large, *scratch):
            discard(spark, t)
        now = after
        if mark == seen:
            break
        seen = mark
    return now


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest, to see whether a round changed anything."""
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("long"))).first())
