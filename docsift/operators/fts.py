"""Full-text search: occurrences of clauses, boolean match, BM25.

Two ways to the same occurrences. ``scan`` counts clauses inside each row of a corpus, without an index: one pass, and nothing
is shuffled but matching documents. ``lookup`` reads a postings table, whose term filter reaches the files. Both give a row per
document with the weighted count of each clause; the rest is shared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.query import Clause
from docsift.functions.text import term_places, token_column

# BM25's parameters, the least idf, and the weights of path, title and body.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WEIGHTS = (10.0, 1.0, 1.0)


def normalize_bm25(raw: Column) -> Column:
    return F.abs(raw) / (1 + F.abs(raw))


def _count(words: Column, clause: Clause) -> Column:
    """Places in an array of tokens where a clause stands; overlapping ones count."""
    last = len(clause.words) - 1
    fits = lambda t, k: t.startswith(clause.words[k]) if clause.prefix and k == last else t == clause.words[k]
    if last == 0:
        return F.size(F.filter(words, lambda t: fits(t, 0)))

    def here(all_: Column, i: Column) -> Column:
        out = F.lit(True)
        for k in range(last + 1):
            out = out & fits(F.get(all_, i + k), k)
        return F.coalesce(out, F.lit(False))

    # The tokens are bound to a name first: a filter on the count may be moved below the projection that makes them.
    return F.get(F.transform(F.array(words), lambda all_: F.size(F.filter(all_, lambda t, i: here(all_, i)))), 0)


def scan(corpus: DataFrame, clauses: Sequence[Clause], fields: Sequence[str], analyzer: str, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Adds ``dl`` (tokens of all fields) and ``tf0, tf1, …`` (weighted count of each clause)."""
    tokens = [f"_t{i}" for i in range(len(fields))]
    rows = corpus.select("*", *[token_column(f, analyzer).alias(t) for f, t in zip(fields, tokens, strict=True)])
    counted = [sum((F.lit(w) * _count(F.col(t), c) for t, w in zip(tokens, weights, strict=True)), F.lit(0.0)).alias(f"tf{i}") for i, c in enumerate(clauses)]
    return rows.select("*", sum((F.size(t) for t in tokens), F.lit(0)).alias("dl"), *counted).drop(*tokens)


def postings(corpus: DataFrame, fields: Sequence[str], keys: Sequence[str], analyzer: str) -> DataFrame:
    """``term, *keys, field, positions`` of each distinct term of a field, made inside the row."""
    each = F.array(*[F.struct(F.lit(i).alias("field"), token_column(f, analyzer).alias("words")) for i, f in enumerate(fields)])
    rows = corpus.select(*keys, F.explode(each).alias("f")).select(*keys, F.col("f.field").alias("field"), F.explode(term_places(F.col("f.words"))).alias("t"))
    return rows.select(F.col("t.term").alias("term"), *keys, "field", F.col("t.positions").alias("positions"))


def vocabulary(corpus: DataFrame, field: str, analyzer: str) -> DataFrame:
    """``term, df, n``: rows that hold a term, and its places in all of them.

    A row gives each token with n 1 and each distinct one with df 1; both are summed before anything is shuffled.
    """
    entry = lambda df, n: lambda t: F.struct(t.alias("term"), F.lit(df).alias("df"), F.lit(n).alias("n"))
    rows = corpus.select(token_column(field, analyzer).alias("words"))
    each = rows.select(F.explode(F.concat(F.transform("words", entry(0, 1)), F.transform(F.array_distinct("words"), entry(1, 0)))).alias("t"))
    return each.groupBy(F.col("t.term").alias("term")).agg(F.sum("t.df").alias("df"), F.sum("t.n").alias("n"))


def _wanted(clauses: Sequence[Clause]) -> Column:
    """Terms that some clause needs, as a filter that parquet readers understand."""
    exact = {w for c in clauses for w in (c.words[:-1] if c.prefix else c.words)}
    out = F.col("term").isin(sorted(exact)) if exact else F.lit(False)
    for p in sorted({c.words[-1] for c in clauses if c.prefix}):
        out = out | F.col("term").startswith(p)
    return out


def lookup(index: DataFrame, clauses: Sequence[Clause], keys: Sequence[str], weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """``*keys, tf0, tf1, …`` of documents that hold a term of some clause."""
    index = index.where(_wanted(clauses))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("field") + 1)
    shifted = lambda k: F.transform("positions", lambda p: p - F.lit(k))
    word = lambda c, k: F.col("term").startswith(c.words[k]) if c.prefix and k == len(c.words) - 1 else F.col("term") == c.words[k]
    # Places of each needed word within a field; then a clause is the places that all its words share after shifting.
    slots = [(i, k) for i, c in enumerate(clauses) for k in range(len(c.words))]
    gathered = index.groupBy(*keys, "field").agg(*[F.flatten(F.collect_list(F.when(word(clauses[i], k), shifted(k)))).alias(f"_{i}_{k}") for i, k in slots])

    def places(i: int) -> Column:
        out = F.col(f"_{i}_0")
        for k in range(1, len(clauses[i].words)):
            out = F.array_intersect(out, F.col(f"_{i}_{k}"))
        return F.size(out)

    by_field = gathered.select(*keys, *[(weight * places(i)).alias(f"tf{i}") for i in range(len(clauses))])
    return by_field.groupBy(*keys).agg(*[F.sum(f"tf{i}").alias(f"tf{i}") for i in range(len(clauses))])


def matches(clauses: Sequence[Clause], at: Sequence[int] | None = None) -> Column:
    """All positive clauses and no negated one."""
    out = F.lit(True)
    for i, c in zip(range(len(clauses)) if at is None else at, clauses, strict=True):
        out = out & ((F.col(f"tf{i}") == 0) if c.negated else (F.col(f"tf{i}") > 0))
    return out


def statistics(counted: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """One row ``n_docs, total, df0, df1, …`` over all documents; filters don't change it."""
    return counted.agg(F.count("*").alias("n_docs"), F.sum(F.col("dl").cast("long")).alias("total"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(clauses))])


def bm25(clauses: Sequence[Clause], at: Sequence[int] | None = None) -> Column:
    """The score, larger is better, over columns ``tfI, dl, n_docs, total, dfI``; a repeated clause adds again.

    ``at`` holds the column number of each clause, if that isn't its place. An empty corpus has no mean length, and no scores.
    """
    score = F.lit(0.0)
    mean = F.col("total") / F.greatest(F.col("n_docs"), F.lit(1))
    for i, c in zip(range(len(clauses)) if at is None else at, clauses, strict=True):
        if not c.negated:
            idf = F.log((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
            tf = F.col(f"tf{i}")
            score = score + F.when(idf > 0, idf).otherwise(LEAST_IDF) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / mean))
    return score


def ranked(counted: DataFrame, stats: DataFrame, clauses: Sequence[Clause], limit: int | None, ties: Sequence[str]) -> DataFrame:
    """Matching rows with ``score`` in [0, 1), best first, at most ``limit``; equal scores in the order of ``ties``."""
    numbers = stats.first().asDict()  # one row, which becomes constants of the plan
    if not numbers["n_docs"]:
        counted = counted.where("false")
    hits = counted.where(matches(clauses)).withColumns({k: F.lit(v or 0) for k, v in numbers.items()})
    scored = hits.withColumn("score", normalize_bm25(bm25(clauses))).drop(*numbers)
    ordered = scored.orderBy(F.desc("score"), *ties)
    return ordered if limit is None else ordered.limit(limit)


def search(corpus: DataFrame, clauses: Sequence[Clause], fields: Sequence[str], analyzer: str, limit: int | None, ties: Sequence[str], where: Column | None = None, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Search without an index. ``where`` filters results before the limit and leaves the statistics alone."""
    counted = scan(corpus, clauses, fields, analyzer, weights)
    shown = counted if where is None else counted.where(where)
    return ranked(shown, statistics(counted, clauses), clauses, limit, ties)


def search_lists(corpus: DataFrame, lists: Sequence[Sequence[Clause]], fields: Sequence[str], analyzer: str, limit: int, ties: Sequence[str], weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Several searches in the two passes of one: every clause is counted once, and a row scored for all lists.

    The best ``limit`` rows of each list, with ``list_id`` (its place), ``score`` and ``rank`` (from 0); each task keeps ``limit``
    rows a list before any row is moved.
    """
    distinct = list(dict.fromkeys(c for clauses in lists for c in clauses))
    counted = scan(corpus, distinct, fields, analyzer, weights)
    numbers = statistics(counted, distinct).first().asDict()
    rows = counted.withColumns({k: F.lit(v or 0) for k, v in numbers.items()})
    scores = []
    for i, clauses in enumerate(lists):
        at = [distinct.index(c) for c in clauses]
        scores.append(F.when(matches(clauses, at), F.struct(F.lit(i).alias("list_id"), normalize_bm25(bm25(clauses, at)).alias("score"))))
    found = rows.select(*corpus.columns, F.explode(F.filter(F.array(*scores), lambda x: x.isNotNull())).alias("_l")).select(*corpus.columns, "_l.*")
    order = Window.partitionBy("list_id").orderBy(F.desc("score"), *ties)
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < limit)
