"""Schemas of the stored tables and of results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "floats": T.ArrayType(T.FloatType()), "ints": T.ArrayType(T.IntegerType())}


def _schema(text: str) -> T.StructType:
    """``name type, …`` without a session, which parsing DDL would need."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(","))])


#: ``revision`` is the version of the store that a row was taken in at, ``number`` its place in that scan; together they are unique.
CONTENT = _schema("hash string, doc string, created_at timestamp, revision long, number long")
#: Postings name a document by revision and number; ``doc_tokens`` counts its tokens over all columns.
DOCUMENTS = _schema("collection string, path string, title string, hash string, body_len int, created_at timestamp, modified_at timestamp, active boolean, revision long, number long, doc_tokens int")
VECTORS = _schema("hash string, seq int, pos int, model string, embedding floats, embedded_at timestamp")
#: ``field``: 0 path with collection, 1 title, 2 body.
POSTINGS = _schema("term string, revision long, number long, field int, positions ints")
TABLES = {"content": CONTENT, "documents": DOCUMENTS, "vectors": VECTORS, "postings": POSTINGS}
RESULT = _schema("collection string, path string, title string, hash string, modified_at timestamp, body_len int, score double, source string")


@dataclass
class Collection:
    """A directory that is indexed under a name."""

    name: str
    path: str
    pattern: str = "**/*.md"
    ignore: list[str] = field(default_factory=list)
    context: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class CollectionInfo:
    collection: Collection
    doc_count: int
    last_modified: str | None


@dataclass(frozen=True)
class IndexStatus:
    total_documents: int
    needs_embedding: int
    has_vector_index: bool
    collections: list[CollectionInfo]


@dataclass(frozen=True)
class Document:
    collection: str
    path: str
    title: str
    hash: str
    modified_at: str | None
    body_len: int
    body: str | None = None

    @property
    def docid(self) -> str:
        return self.hash[:6]

    @property
    def display_path(self) -> str:
        return f"{self.collection}/{self.path}"


@dataclass(frozen=True)
class UpdateResult:
    collections: int = 0
    indexed: int = 0
    updated: int = 0
    unchanged: int = 0
    removed: int = 0


@dataclass(frozen=True)
class EmbedResult:
    embedded: int = 0
    chunks: int = 0
