import json
import os

import pytest

from docsift import cli
from docsift.errors import CollectionExistsError, ConfigError, NotFoundError, StorageError
from docsift.functions.chunk import Chunker
from docsift.operators.fuse import OverlapReranker
from docsift.plans.engine import Engine
from docsift.schema import Collection, UpdateResult
from docsift.sources.files import scan, walk
from docsift.streaming.ingest import watch


def put(base, files):
    for name, text in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def place(tmp_path):
    base = tmp_path / "docs"
    put(base, {"rust.md": "# Rust Ownership\nRust has a unique ownership model running runner", "b.md": "# Café élan\nthe café runs; should_notify don't worry", "sub/c.md": "apple banana apple", "same.md": "apple banana apple", "blank.md": "  \n", "bad.md": b"\xff\xfe", "skip.md": "x", ".gitignore": "skip.md\n", "node_modules/n.md": "x", ".hidden/h.md": "x", "t.txt": "x", "drafts/d.md": "x"})
    return base


@pytest.fixture
def engine(spark, tmp_path, place):
    e = Engine(spark, str(tmp_path / "store"))
    e.register_collection(Collection("docs", str(place), ignore=["drafts/"]))
    return e


def paths(rows):
    return [r.path for r in rows.collect()]


def test_walk(place):
    assert list(walk(str(place), ignore=["drafts/"])) == ["b.md", "bad.md", "blank.md", "rust.md", "same.md", "sub/c.md"]
    assert list(walk(str(place), "*.{md,txt}", ["**/d.md", "b*.md"])) == ["rust.md", "same.md", "sub/c.md", "t.txt"]
    assert list(walk(str(place), "sub/*.md")) == ["sub/c.md"]
    with pytest.raises(ConfigError):
        list(walk(str(place / "none")))


def test_update_search_and_get(engine, place):
    assert engine.update() == UpdateResult(1, 4, 0, 0, 0)
    assert engine.update(["docs", "unknown"]) == UpdateResult(1, 0, 0, 4, 0)
    assert engine.update(["unknown"]) == UpdateResult()
    assert paths(engine.search_fts("running")) == ["rust.md", "b.md"]
    assert paths(engine.search_fts('"should notify"')) == ["b.md"] and paths(engine.search_fts("don't")) == ["b.md"]
    assert paths(engine.search_fts("apple -sub")) == ["same.md"] and paths(engine.search_fts("apple", collection="other")) == []
    assert paths(engine.search_fts("---")) == []
    doc = engine.get("docs/rust.md")
    assert (doc.title, doc.body_len) == ("Rust Ownership", len(doc.body)) and engine.get("#" + doc.docid.upper()).path == "rust.md"
    for name in ("docs/none.md", "ffffff", "nothing"):
        with pytest.raises(NotFoundError):
            engine.get(name)
    born = engine.store.table("documents").where("path = 'rust.md'").first().created_at

    put(place, {"rust.md": "# New Title\nferris", "new.md": "ferris", "b.md": "\n"})
    os.remove(place / "same.md")
    assert engine.update() == UpdateResult(1, 1, 1, 1, 1)  # b.md turned blank: it stays as it was
    assert paths(engine.search_fts("unique")) == [] and sorted(paths(engine.search_fts("ferris"))) == ["new.md", "rust.md"]
    assert paths(engine.search_fts("café")) == ["b.md"] and engine.get("docs/rust.md").title == "New Title"
    assert engine.store.table("documents").where("path = 'rust.md'").first().created_at == born
    put(place, {"same.md": "apple banana apple"})
    assert engine.update().indexed == 1  # back again counts as new
    assert engine.doc_count() == 5


def test_vectors_hybrid_and_rerank(engine, spark):
    engine.update()
    assert engine.needs_embedding() == 3  # two paths share a body
    made = engine.embed()
    assert made.embedded == 4 and made.chunks == 4 and engine.embed().embedded == 0 and engine.needs_embedding() == 0
    again = Engine(spark, engine.store.root)  # a new handle sees the vectors
    assert {"sub/c.md", "same.md"} <= set(paths(again.search_vec("apple banana apple", 3)))
    found = again.search("apple banana", 3).collect()
    assert {found[0].path, found[1].path} == {"sub/c.md", "same.md"} and found[0].source == "Fts"
    ranked = Engine(spark, engine.store.root, reranker=OverlapReranker()).search("rust ownership", 3).collect()
    assert ranked[0].path == "rust.md" and ranked[0].score == 1.0

    class Broken:
        def score(self, query, passages):
            raise ValueError

    assert [r.path for r in Engine(spark, engine.store.root, reranker=Broken()).search("apple banana", 3).collect()] == [r.path for r in found]
    assert engine.clear_embeddings() == 3 and engine.needs_embedding() == 3
    engine.set_chunker(Chunker(20, 5))
    assert engine.embed().chunks > 4


def test_collections_contexts_and_cleanup(engine, place, tmp_path):
    with pytest.raises(ConfigError):
        engine.register_collection(Collection("x", str(tmp_path / "none")))
    engine.update()
    engine.register_collection(Collection("empty", str(tmp_path)))
    assert [(i.collection.name, i.doc_count) for i in engine.list_collections()] == [("docs", 4), ("empty", 0)]
    with pytest.raises(CollectionExistsError):
        engine.rename_collection("docs", "empty")
    engine.rename_collection("nobody", "fresh")
    engine.rename_collection("docs", "papers")
    assert len(paths(engine.search_fts("papers"))) == 4 and paths(engine.search_fts("docs")) == []
    assert engine.set_context("papers", "/", "Root") and engine.set_context("papers", "/sub", "Sub") and not engine.set_context("nobody", "/", "x")
    assert engine.context_for_path("papers", "subway.md") == "Root\n\nSub" and engine.context_for_path("empty", "x") is None
    engine.set_global_context("All")
    assert engine.context_for_path("papers", "x.md") == "All\n\nRoot" and engine.global_context() == "All"
    assert engine.remove_context("papers", "/sub") and not engine.remove_context("papers", "/sub")
    os.remove(place / "rust.md")
    assert engine.update(["papers"]).removed == 1 and sorted(paths(engine.active_paths("papers"))) == ["b.md", "same.md", "sub/c.md"]
    assert engine.cleanup() == 2 and engine.cleanup() == 0  # the row and its body
    engine.vacuum()
    assert paths(engine.search_fts("café")) == ["b.md"]
    assert engine.remove_collection("papers") == 3 and engine.doc_count() == 0 and engine.status().total_documents == 0


def test_listed_by_spark(spark, place):
    """The way for stores that aren't local, tried on a local one under another scheme."""
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.store.link./{place.name}", f"file://{place}")
    rows = scan(spark, Collection("docs", f"viewfs://store/{place.name}", ignore=["drafts/"]))
    assert sorted(r.path for r in rows.collect()) == ["b.md", "bad.md", "blank.md", "rust.md", "same.md", "skip.md", "sub/c.md"]


def test_command_line(engine, place, capsys):
    run = lambda *a: cli.run(engine, cli.parser().parse_args(list(a)))
    assert run("update") == "1 collections: 4 indexed, 0 updated, 0 unchanged, 0 removed"
    assert run("fts", "café").endswith("docs/b.md — Café élan") and run("fts", "nothing") == "no results"
    assert json.loads(run("fts", "café", "--json"))[0]["path"] == "b.md" and json.loads(run("get", "docs/b.md", "--json"))["title"] == "Café élan"
    assert run("get", "docs/b.md").startswith("# Café élan\n\n") and "documents:        4" in run("status")
    assert run("context", "add", "docs", "/", "Root") == "context set for docs:/" and json.loads(run("context", "list", "--json"))[0]["context"] == "Root"
    assert run("context", "rm", "docs", "/x") == "" and "context not found" in capsys.readouterr().err
    assert run("collection", "rename", "docs", "d") == "renamed 'docs' → 'd'" and run("collection", "remove", "d") == "removed 'd' (4 documents)"


def test_stream(spark, tmp_path, place):
    e = Engine(spark, str(tmp_path / "live"))
    e.register_collection(Collection("docs", str(place)))
    for text in ("first", "second"):
        put(place, {f"{text}.md": text})
        q = watch(e, "docs", str(place), str(tmp_path / "mark"), once=True)
        q.awaitTermination()
        assert paths(e.search_fts(text)) == [f"{text}.md"]


def test_empty_store(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "empty"))
    for query in ("apple", '"a phrase" -word', "---"):
        assert engine.search_fts(query).count() == 0 and engine.search(query).count() == 0
    assert engine.search_vec("apple").count() == 0 and engine.doc_count() == 0 and engine.cleanup() == 0


def test_two_writers(engine, spark, tmp_path):
    """Of two that began from one version the second is refused, and nothing of the first is lost."""
    other = Engine(spark, str(tmp_path / "store"))
    engine.set_global_context("first")
    with pytest.raises(StorageError):
        other.set_global_context("second")
    assert Engine(spark, str(tmp_path / "store")).global_context() == "first"
    engine.set_global_context("again")


class Broken:
    def score(self, query, passages):
        raise ValueError("no model")


def test_failing_reranker_keeps_the_order(engine):
    engine.update()
    plain = paths(engine.search("running"))
    engine.reranker = Broken()
    assert paths(engine.search("running")) == plain and len(plain) > 1
