"""The facade: collections, incremental indexing, embedding, full-text, vector and hybrid search, maintenance."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.errors import CollectionExistsError, ConfigError, EmbeddingError, NotFoundError
from docsift.functions.chunk import Chunker, chunk_column
from docsift.functions.query import Query, QueryType, clauses_for, expand_simple
from docsift.functions.text import PORTER, analyze, snippet_column, token_column
from docsift.operators import fts, fuse, maintain, vector
from docsift.plans.store import Store
from docsift.schema import RESULT, Collection, CollectionInfo, Document, EmbedResult, IndexStatus, UpdateResult
from docsift.sources import files

FIELDS = ("filepath", "title", "body")
#: A hybrid search takes so many times its limit from each list, and reranks so many times it.
FETCH, RERANK, PASSAGE = 3, 2, 4000
MODEL = "default"
#: The order of postings within a file.
SORT = ("term", "revision", "number")


class Engine:
    """``root`` is a directory that Spark can write; only a local master may go without, with a temporary folder.

    Results are DataFrames of schema.RESULT unless said otherwise.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, analyzer: str = PORTER, embedder: vector.Embedder | None = None, reranker: fuse.Reranker | None = None, chunker: Chunker | None = None):
        self.spark, self.analyzer = spark, analyzer
        if root is None and not spark.sparkContext.master.startswith("local"):
            raise ConfigError("name a folder that the driver and all executors share")
        self.store = Store(spark, root or tempfile.mkdtemp(prefix="docsift-"))
        self.embedder, self.reranker, self.chunker = embedder or vector.HashingEmbedder(), reranker, chunker or Chunker()

    def set_chunker(self, chunker: Chunker) -> None:
        self.chunker = chunker

    # --- collections and contexts

    def register_collection(self, c: Collection) -> None:
        if not files.SCHEMES.match(c.path) and not os.path.isdir(c.path):
            raise ConfigError(f"not a directory: {c.path}")
        self.store.put_collection(c)
        self.store.commit()

    def get_collection(self, name: str) -> Collection | None:
        return next((c for c in self.store.collections if c.name == name), None)

    def list_collections(self) -> list[CollectionInfo]:
        return self.status().collections

    def remove_collection(self, name: str) -> int:
        """Drops a collection with its documents, then cleans the whole store; returns its documents, inactive ones too."""
        docs = self.store.table("documents")
        n = docs.where(F.col("collection") == name).count()
        self.store.replace("documents", docs.where(F.col("collection") != name))
        self.store.drop_collection(name)
        self.cleanup()
        return n

    def rename_collection(self, old: str, new: str) -> None:
        """An unknown old name changes nothing. Paths are searchable under the new name at once."""
        if self.get_collection(new):
            raise CollectionExistsError(new)
        c = self.get_collection(old)
        if c is None:
            return
        self.store.drop_collection(old)
        c.name = new
        self.store.put_collection(c)
        docs, postings = self.store.table("documents"), self.store.table("postings")
        size = lambda: F.size(token_column(F.concat_ws("/", "collection", "path"), self.analyzer))
        moved = docs.where(F.col("collection") == old)
        named = moved.withColumn("doc_tokens", F.col("doc_tokens") - size()).withColumn("collection", F.lit(new)).withColumn("doc_tokens", F.col("doc_tokens") + size())
        # Only terms of paths change: no body is read.
        kept = maintain.marked(postings.where("field = 0"), moved, there=False).unionByName(postings.where("field <> 0"))
        self.store.replace("postings", kept, sort=SORT)
        self._index(named.withColumn("filepath", F.concat_ws("/", "collection", "path")), FIELDS[:1])
        self.store.replace("documents", docs.where(F.col("collection") != old).unionByName(named))
        self.store.commit()

    def set_context(self, collection: str, prefix: str, text: str) -> bool:
        if (c := self.get_collection(collection)) is None:
            return False
        c.context[prefix] = text
        self.store.put_collection(c)
        self.store.commit()
        return True

    def remove_context(self, collection: str, prefix: str) -> bool:
        c = self.get_collection(collection)
        if c is None or c.context.pop(prefix, None) is None:
            return False
        self.store.put_collection(c)
        self.store.commit()
        return True

    def set_global_context(self, text: str | None) -> None:
        self.store.state["config"].pop("global_context", None)
        if text is not None:
            self.store.state["config"]["global_context"] = text
        self.store.commit()

    def global_context(self) -> str | None:
        return self.store.state["config"].get("global_context")

    def context_for_path(self, collection: str, path: str) -> str | None:
        c = self.get_collection(collection)
        pairs = sorted((c.context if c else {}).items())
        context = F.create_map(*[F.lit(x) for p in pairs for x in p]) if pairs else F.expr("cast(map() as map<string,string>)")
        return self.spark.range(1).select(maintain.context_for_path(context, F.lit(path), F.lit(self.global_context()).cast("string")).alias("c")).first().c

    # --- indexing

    def _index(self, docs: DataFrame, fields: Sequence[str]) -> DataFrame:
        """Writes postings of documents (``revision, number`` and the fields); gives ``number, doc_tokens`` of those that have tokens."""
        self.store.append("postings", fts.postings(docs, fields, maintain.ROW, self.analyzer), sort=SORT)
        made = self.store.segment("postings", self.store.state["tables"]["postings"][-1])
        return made.groupBy("number").agg(F.sum(F.size("positions")).cast("int").alias("doc_tokens"))

    def update(self, names: Sequence[str] | None = None) -> UpdateResult:
        """Scan registered collections, or those named, and take in what changed; unknown names are ignored."""
        chosen = [c for c in self.store.collections if names is None or c.name in set(names)]
        if not chosen:
            return UpdateResult()
        scans = [files.scan(self.spark, c) for c in chosen]
        return self.ingest(reduce(DataFrame.unionByName, scans), [c.name for c in chosen])

    def ingest(self, scanned: DataFrame, collections: Sequence[str]) -> UpdateResult:
        """Take in a complete scan ``collection, path, body`` of some collections; a file without usable text has a null body.

        The scan is written once, with numbers. What is to be done is worked out on hashes, and bodies are then picked by number.
        """
        scratch, version = f"{self.store.root}/scan-{uuid.uuid4().hex}", self.store.state["version"]
        try:
            numbered = files.with_identity(scanned).withColumn("body_len", F.char_length("body")).withColumn("number", F.monotonically_increasing_id())
            self.store.put(numbered, f"{scratch}/files", small=True)
            scan = self.spark.read.parquet(f"{scratch}/files").withColumn("revision", F.lit(version).cast("long"))
            docs = self.store.table("documents")
            mine = docs.where(F.col("collection").isin(list(collections)))
            maintain.classify(scan, mine).select(*maintain.KEY, "status").write.parquet(f"{scratch}/status")
            status = self.spark.read.parquet(f"{scratch}/status")
            n = maintain.counts(status)
            if n["indexed"] or n["updated"] or n["removed"]:
                self._take(scan, docs, mine, status)
        finally:
            self.store.delete(scratch)
        return UpdateResult(len(collections), n["indexed"], n["updated"], n["unchanged"], n["removed"])

    def _take(self, scan: DataFrame, docs: DataFrame, mine: DataFrame, status: DataFrame) -> None:
        keys, now = list(maintain.KEY), F.date_trunc("second", F.current_timestamp())
        fresh = scan.drop("body").join(status.where(F.col("status").isin(maintain.INDEXED, maintain.UPDATED)), keys, "left_semi")
        first = fresh.groupBy("hash").agg(F.min(F.struct(*maintain.ROW)).alias("row")).select("hash", "row.*")
        first = first.join(self.store.table("content").select("hash"), "hash", "left_anti")
        self.store.append("content", maintain.marked(scan, first).withColumnRenamed("body", "doc").withColumn("created_at", now))
        sizes = self._index(maintain.marked(scan, fresh).withColumn("filepath", F.concat_ws("/", *keys)), FIELDS)
        # A path may stand on several rows, which stay as they are and don't multiply. A clock that was set back doesn't put a change
        # before its document.
        born = mine.groupBy(*keys).agg(F.min("created_at").alias("born"))
        changed = fresh.join(born, keys, "left").join(sizes, "number", "left").withColumns({"created_at": F.coalesce("born", now), "modified_at": F.greatest("born", now), "active": F.lit(True), "doc_tokens": F.coalesce("doc_tokens", F.lit(0))}).select(*docs.columns)
        gone = status.where(F.col("status") == maintain.REMOVED).select(*keys, F.lit(True).alias("gone")).distinct()
        rest = docs.join(fresh.select(*keys), keys, "left_anti").join(gone, keys, "left").withColumn("active", F.col("active") & F.col("gone").isNull()).drop("gone")
        self.store.replace("documents", rest.unionByName(changed))
        self.store.commit()

    def embed(self, force: bool = False) -> EmbedResult:
        """Chunk and embed documents without vectors; equal bodies are embedded once and counted by path."""
        if force:
            self.clear_embeddings()
        waiting = maintain.unembedded(self.store.table("documents"), self.store.table("vectors"))
        n = waiting.count()
        if not n:
            return EmbedResult()
        content = self.store.table("content")
        bodies = maintain.marked(content, content.select("hash", *maintain.ROW).join(waiting.select("hash").distinct(), "hash", "left_semi"))
        chunks = bodies.select("hash", F.explode(chunk_column("doc", self.chunker)).alias("c")).select("hash", "c.seq", "c.pos", "c.text")
        rows = chunks.select("hash", "seq", "pos", F.lit(MODEL).alias("model"), vector.embed_column("text", self.embedder).alias("embedding"), F.date_trunc("second", F.current_timestamp()).alias("embedded_at"))
        try:
            segment = self.store.write("vectors", rows)
        except Exception as e:
            raise EmbeddingError(str(e)) from e
        self.store.state["tables"]["vectors"].append(segment)
        self.store.commit()
        made = self.spark.read.parquet(f"{self.store.root}/{segment}").groupBy("hash").agg(F.count("*").alias("k"))
        return EmbedResult(n, waiting.join(made, "hash").agg(F.sum("k")).first()[0])

    # --- search

    def search_fts(self, query: str, limit: int = 10, collection: str | None = None) -> DataFrame:
        clauses = clauses_for(query, self.analyzer)
        if not clauses:
            return self.spark.createDataFrame([], RESULT)
        docs = self.store.table("documents").where("active")
        keys = list(maintain.ROW)
        counted = fts.lookup(self.store.table("postings"), clauses, keys).join(docs.select(*keys, *maintain.KEY, F.col("doc_tokens").alias("dl")), keys)
        tf = [f"tf{i}" for i in range(len(clauses))]
        df = counted.agg(*[F.sum((F.col(t) > 0).cast("long")).alias(f"df{i}") for i, t in enumerate(tf)])
        stats = docs.agg(F.count("*").alias("n_docs"), F.sum(F.col("doc_tokens").cast("long")).alias("total")).crossJoin(df)
        shown = counted if collection is None else counted.where(F.col("collection") == collection)
        top = fts.ranked(shown, stats, clauses, limit, maintain.KEY).select(*keys, "score")
        return docs.join(F.broadcast(top), keys).select(*self._columns(F.col("score"), "Fts")).orderBy(F.desc("score"), "collection", "path")  # top is limit rows

    @staticmethod
    def _columns(score, source: str) -> list:
        return ["collection", "path", "title", "hash", "modified_at", "body_len", score.alias("score"), F.lit(source).alias("source")]

    def search_vec(self, query: str | Sequence[float], limit: int = 10, collection: str | None = None) -> DataFrame:
        """Nearest chunks, then their documents: one with several near chunks comes several times."""
        emb = self.embedder.embed([query])[0] if isinstance(query, str) else query
        hits = vector.knn(self.store.table("vectors"), emb, limit, ("hash", "seq"))
        where = None if collection is None else F.col("collection") == collection
        found = vector.knn_join(hits, self.store.table("documents"), where)
        return found.select(*self._columns(F.col("score"), "Vec"), "seq").orderBy(F.desc("score"), "collection", "path", "seq").drop("seq")

    def search(self, query: str, limit: int = 10) -> DataFrame:
        return self.search_with_queries(query, expand_simple(query), limit)

    def search_with_queries(self, query: str, queries: Sequence[Query], limit: int = 10) -> DataFrame:
        """Lists of all queries, fused by reciprocal rank, and reranked if there is a reranker."""
        fetch, lists = limit * FETCH, []
        asked = [(Query(QueryType.LEX, query), fuse.ORIGINAL), *((q, fuse.EXPANDED if q.kind == QueryType.LEX else fuse.VECTOR) for q in queries)]
        for q, weight in asked:
            rows = self.search_fts(q.text, fetch) if q.kind == QueryType.LEX else self.search_vec(q.text, fetch)
            lists.append(fuse.rank_list(rows, len(lists), weight, (F.desc("score"), "collection", "path"), F.concat_ws("/", "collection", "path")))
        fields = [n for n in RESULT.names if n != "score"]
        fused = fuse.rrf(reduce(DataFrame.unionByName, lists), keep=fields).select(*RESULT.names, "key")
        if self.reranker is not None:
            fused = self._reranked(query, fused, limit)
            return fused.orderBy(F.desc("_scored"), F.desc("score"), "key").limit(limit).select(*RESULT.names)
        return fused.orderBy(F.desc("score"), "key").limit(limit).select(*RESULT.names)

    def _reranked(self, query: str, fused: DataFrame, limit: int) -> DataFrame:
        """Scores of the reranker for the first results that have a body; the others follow in their order.

        A single result isn't reranked. A failing reranker leaves the order as it is.
        """
        marked = fused.withColumn("_scored", F.lit(False))
        top = fused.orderBy(F.desc("score"), "key").limit(limit * RERANK).cache()
        try:
            if top.count() < 2:
                return marked
            bodies = self.store.table("content").join(F.broadcast(top.select("hash").distinct()), "hash").select("hash", snippet_column("doc", query, PASSAGE).alias("passage"))
            passages = top.select("key", "hash").join(bodies, "hash").coalesce(1)
            scores = passages.select("key", fuse.rerank_scores("passage", query, self.reranker).alias("new")).toPandas()
        except PythonException:  # the model's own failure; errors of the engine are not hidden
            return marked
        finally:
            top.unpersist()
        new = self.spark.createDataFrame(scores, "key string, new double")
        joined = fused.join(F.broadcast(new), "key", "left")
        return joined.withColumn("_scored", F.col("new").isNotNull()).withColumn("score", F.coalesce("new", "score")).drop("new")

    def explain(self, query: str) -> list[list[str]]:
        """The analysed clauses of a query."""
        return [list(c.words) for c in clauses_for(query, self.analyzer)] if analyze(query, self.analyzer) else []

    # --- documents

    def get_document(self, collection: str, path: str) -> Document | None:
        return self._document(self.store.table("documents").where(F.col("active") & (F.col("collection") == collection) & (F.col("path") == path)))

    def _document(self, rows: DataFrame) -> Document | None:
        body = self.store.table("content").select("hash", "doc")
        r = F.broadcast(rows.limit(1)).join(body, "hash").first()
        return r and Document(r.collection, r.path, r.title, r.hash, _stamp(r.modified_at), r.body_len, r.doc)

    def find_by_docid(self, docid: str) -> tuple[str, str] | None:
        r = maintain.by_docid(self.store.table("documents"), docid).first()
        return r and (r.collection, r.path)

    def get_body(self, hash_: str) -> str | None:
        r = self.store.table("content").where(F.col("hash") == hash_).select("doc").first()
        return r and r.doc

    def active_paths(self, collection: str) -> DataFrame:
        return self.store.table("documents").where(F.col("active") & (F.col("collection") == collection)).select("path")

    def get(self, name: str) -> Document:
        """A document by ``#docid``, docid or ``collection/path``; six hex digits are always a docid."""
        clean = name.lstrip("#")
        if re.fullmatch(r"[0-9a-fA-F]{6}", clean):
            found = self._document(maintain.by_docid(self.store.table("documents"), clean))
        else:
            collection, slash, path = name.partition("/")
            found = self.get_document(collection, path) if slash else None
        if found is None:
            raise NotFoundError(name)
        return found

    # --- health and maintenance

    def doc_count(self) -> int:
        return self.store.table("documents").where("active").count()

    def needs_embedding(self) -> int:
        return maintain.needs_embedding(self.store.table("documents"), self.store.table("vectors")).first()[0]

    def status(self) -> IndexStatus:
        docs, known = self.store.table("documents"), {c.name: c for c in self.store.collections}
        names = self.spark.createDataFrame([(n,) for n in known], "collection string")
        per = maintain.collection_status(names, docs).orderBy("collection").collect()
        infos = [CollectionInfo(known[r.collection], r.doc_count, _stamp(r.last_modified)) for r in per]
        return IndexStatus(self.doc_count(), self.needs_embedding(), bool(self.store.state["tables"]["vectors"]), infos)

    def cleanup(self) -> int:
        """Delete inactive documents, and content, vectors and postings that none uses; returns documents, bodies and vectors gone."""
        docs, content, vectors = (self.store.table(t) for t in ("documents", "content", "vectors"))
        n = [docs.where("not active").count(), maintain.orphans(content.select("hash"), docs).count(), maintain.orphans(vectors.select("hash"), docs).count()]
        self._settle("documents", docs.where("active"))
        docs = self.store.table("documents")
        if n[1]:
            self._settle("content", maintain.marked(content, maintain.live(content.select("hash", *maintain.ROW), docs)))
        if n[2]:
            self._settle("vectors", maintain.live(vectors, docs))
        self._compact_postings()
        return sum(n)

    def _settle(self, table: str, rows: DataFrame, sort: tuple[str, ...] = ()) -> None:
        """Replace one table for good, so that no more than one is there twice; each step leaves a store that is right."""
        self.store.replace(table, rows, sort)
        self.store.commit()
        self.store.drop_unnamed()

    def _compact_postings(self) -> None:
        self._settle("postings", maintain.marked(self.store.table("postings"), self.store.table("documents").where("active")), SORT)

    def clear_embeddings(self) -> int:
        n = self.store.table("vectors").count()
        self.store.state["tables"]["vectors"] = []
        self.store.commit()
        self.store.drop_unnamed()
        return n

    def vacuum(self) -> None:
        """Compact small segments and delete old ones, one table after the other."""
        self._settle("documents", self.store.table("documents"))
        for t in ("content", "vectors"):
            if len(self.store.state["tables"][t]) > 1:
                self._settle(t, self.store.table(t))
        self._compact_postings()


def _stamp(at) -> str | None:
    """RFC 3339 in UTC with seconds; the session's time zone is taken to be UTC."""
    return at and at.strftime("%Y-%m-%dT%H:%M:%SZ")
