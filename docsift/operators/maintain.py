"""Set operations behind incremental indexing: classification, upsert, orphans, status, contexts. Plain DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDEXED, UPDATED, UNCHANGED, REMOVED, KEPT = "indexed", "updated", "unchanged", "removed", "kept"
KEY = ("collection", "path")
#: What names a stored row.
ROW = ("revision", "number")


def classify(scan: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One full outer join on (collection, path): each path of either side with ``status``.

    scan: ``collection, path, hash, …``, hash null for files without usable text; snapshot: ``collection, path, hash, active, …``.
    An unusable file counts as present, so its old document stays as it is.
    """
    new = scan.select(*KEY, F.col("hash").alias("new_hash"), F.lit(True).alias("present"))
    old = snapshot.select(*KEY, F.col("hash").alias("old_hash"), F.coalesce("active", F.lit(False)).alias("was_active"))
    active = F.coalesce("was_active", F.lit(False))
    status = (
        F.when(F.col("present").isNull(), F.when(active, REMOVED).otherwise(KEPT))
        .when(F.col("new_hash").isNull(), KEPT)
        .when(active & (F.col("new_hash") == F.col("old_hash")), UNCHANGED)
        .when(active, UPDATED)
        .otherwise(INDEXED)
    )
    return new.join(old, list(KEY), "full_outer").select(*KEY, "new_hash", "old_hash", status.alias("status"))


def counts(classified: DataFrame) -> dict[str, int]:
    got = {r.status: r.n for r in classified.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return {s: got.get(s, 0) for s in (INDEXED, UPDATED, UNCHANGED, REMOVED)}


def new_content(bodies: DataFrame, content: DataFrame) -> DataFrame:
    """Bodies whose hash isn't stored yet, one row a hash; only hashes of the store are read."""
    return bodies.dropDuplicates(["hash"]).join(content.select("hash"), "hash", "left_anti")


def marks(rows: DataFrame) -> DataFrame:
    """A set of rows as bits: ``revision, word, bits`` for 64 numbers each, so about a byte a row."""
    word, bit = F.shiftright("number", 6).alias("word"), F.expr("shiftleft(1L, CAST(number & 63 AS INT))")
    return rows.groupBy("revision", word).agg(F.bit_or(bit).alias("bits"))


def flagged(rows: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """Adds whether ``chosen`` names a row by revision and number; only the bits are moved, never a row."""
    bits = F.broadcast(marks(chosen.select(*ROW)).withColumnRenamed("revision", "_revision"))
    on = (F.col("revision") == F.col("_revision")) & (F.shiftright("number", 6) == F.col("word"))
    hit = F.expr("coalesce(getbit(bits, CAST(number & 63 AS INT)), 0) = 1")
    return rows.join(bits, on, "left").withColumn(name, hit).drop("_revision", "word", "bits")


def marked(rows: DataFrame, chosen: DataFrame, there: bool = True) -> DataFrame:
    """Rows that ``chosen`` names by revision and number, or the others."""
    return flagged(rows, chosen, "_there").where("_there" if there else "not _there").drop("_there")


def unembedded(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active documents without a first chunk vector: distinct ``hash, path``."""
    return documents.where("active").join(vectors.where("seq = 0").select("hash"), "hash", "left_anti").select("hash", "path").distinct()


def needs_embedding(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    return unembedded(documents, vectors).agg(F.count_distinct("hash").alias("needs_embedding"))


def live(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of a table keyed by hash that an active document uses."""
    return rows.join(documents.where("active").select("hash").distinct(), "hash", "left_semi")


def orphans(rows: DataFrame, documents: DataFrame) -> DataFrame:
    return rows.join(documents.where("active").select("hash").distinct(), "hash", "left_anti")


def collection_status(names: DataFrame, documents: DataFrame) -> DataFrame:
    """``collection, doc_count, last_modified`` for every name, 0 and null for an empty one."""
    per = documents.where("active").groupBy("collection").agg(F.count("*").alias("doc_count"), F.max("modified_at").alias("last_modified"))
    return names.join(per, "collection", "left").select("collection", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), "last_modified")


def context_for_path(context: Column, path: Column, overall: Column) -> Column:
    """The overall context, then those of all prefixes of the path, shortest first, with blank lines between; else null.

    Prefixes are plain strings, so ``/api`` fits ``/apiary.md`` too.
    """
    slashed = lambda c: F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c))
    entries = F.filter(F.map_entries(context), lambda e: slashed(path).startswith(slashed(e["key"])))
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(F.octet_length(e["key"]).alias("size"), e["key"].alias("prefix"), e["value"].alias("text"))))
    parts = F.concat(F.filter(F.array(overall), lambda x: x.isNotNull()), F.coalesce(F.transform(ordered, lambda e: e["text"]), F.expr("cast(array() as array<string>)")))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n"))


def by_docid(documents: DataFrame, docid: str) -> DataFrame:
    """The first active document, by collection and path, whose hash begins with a docid; ``#`` and case don't matter."""
    return documents.where(F.col("active") & F.col("hash").startswith(docid.lstrip("#").lower())).orderBy(*KEY).limit(1)
