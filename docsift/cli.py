"""Command line: ``python -m docsift.cli --index DIR COMMAND …``."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import asdict

from docsift.errors import ConfigError, DocsiftError
from docsift.operators.models import OnnxEmbedder, OnnxReranker
from docsift.plans.engine import Engine
from docsift.schema import Collection
from docsift.sources.files import result_line, to_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docsift")
    p.add_argument("--index", default="index.docsift")
    p.add_argument("--embedder", metavar="DIR", help="folder with model.onnx and tokenizer.json")
    p.add_argument("--reranker", metavar="DIR", help="the same for a cross-encoder")
    top = p.add_subparsers(dest="command", required=True)

    def command(group, name: str, *flags, json: bool = False):
        c = group.add_parser(name)
        for names, options in flags:
            c.add_argument(*names, **options)
        if json:
            c.add_argument("--json", action="store_true")
        return c

    col = top.add_parser("collection").add_subparsers(dest="action", required=True)
    command(col, "add", (["path"], {}), (["--name"], {"required": True}), (["--pattern"], {"default": "**/*.md"}), (["--ignore"], {"action": "append", "default": []}))
    command(col, "list", json=True)
    command(col, "remove", (["name"], {}))
    command(col, "rename", (["old"], {}), (["new"], {}))
    command(top, "update", (["-c", "--collection"], {"action": "append", "default": []}))
    command(top, "embed", (["--force"], {"action": "store_true"}))
    for name in ("search", "fts"):
        command(top, name, (["query"], {}), (["-n", "--limit"], {"type": int, "default": 10}), json=True)
    command(top, "get", (["path"], {}), json=True)
    command(top, "status", json=True)
    ctx = top.add_parser("context").add_subparsers(dest="action", required=True)
    command(ctx, "add", (["collection"], {}), (["path"], {}), (["text"], {}))
    command(ctx, "list", json=True)
    command(ctx, "rm", (["collection"], {}), (["path"], {}))
    command(ctx, "global", (["text"], {"nargs": "?"}))
    command(top, "cleanup")
    command(top, "vacuum")
    return p


def _contexts(engine: Engine) -> list[dict]:
    overall = engine.global_context()
    out = [{"collection": "*", "path": "/", "context": overall}] if overall is not None else []
    return out + [{"collection": c.name, "path": p, "context": t} for c in engine.store.collections for p, t in c.context.items()]


def _collection(engine: Engine, a: argparse.Namespace) -> str:
    if a.action == "add":
        if not os.path.exists(a.path):
            raise ConfigError(f"{a.path}: no such directory")
        path = os.path.realpath(a.path)
        engine.register_collection(Collection(a.name, path, a.pattern, a.ignore))
        return f"registered collection '{a.name}' at {path}"
    if a.action == "list":
        infos = engine.list_collections()
        if a.json:
            return to_json([{**asdict(i.collection), "doc_count": i.doc_count, "last_modified": i.last_modified} for i in infos])
        return "\n".join(f"{i.collection.name:<16} {i.collection.path:<40} {i.doc_count} docs" for i in infos) or "no collections registered"
    if a.action == "remove":
        return f"removed '{a.name}' ({engine.remove_collection(a.name)} documents)"
    engine.rename_collection(a.old, a.new)
    return f"renamed '{a.old}' → '{a.new}'"


def _context(engine: Engine, a: argparse.Namespace) -> str:
    if a.action == "list":
        rows = _contexts(engine)
        return to_json(rows) if a.json else "\n".join(f"{r['collection']}  {r['path']}  {r['context']}" for r in rows)
    if a.action == "global":
        engine.set_global_context(a.text)
        return "global context cleared" if a.text is None else "global context set"
    done = engine.set_context(a.collection, a.path, a.text) if a.action == "add" else engine.remove_context(a.collection, a.path)
    if not done:  # told, but no failure
        print(f"collection '{a.collection}' not found" if a.action == "add" else "context not found", file=sys.stderr)
        return ""
    return f"context set for {a.collection}:{a.path}" if a.action == "add" else f"context removed for {a.collection}:{a.path}"


def run(engine: Engine, a: argparse.Namespace) -> str:
    """What a command prints."""
    if a.command in ("collection", "context"):
        return (_collection if a.command == "collection" else _context)(engine, a)
    if a.command == "update":
        r = engine.update(a.collection or None)
        return f"{r.collections} collections: {r.indexed} indexed, {r.updated} updated, {r.unchanged} unchanged, {r.removed} removed"
    if a.command == "embed":
        r = engine.embed(a.force)
        return "cleared all embeddings\n" * a.force + f"{r.embedded} documents embedded, {r.chunks} chunks"
    if a.command in ("search", "fts"):
        found = (engine.search if a.command == "search" else engine.search_fts)(a.query, a.limit)
        if a.json:
            return to_json(found.collect())
        return "\n".join(r.line for r in found.select(result_line().alias("line")).collect()) or "no results"
    if a.command == "get":
        d = engine.get(a.path)
        return to_json([d])[2:-2] if a.json else f"# {d.title}\n\n{d.body}"
    if a.command == "status":
        s = engine.status()
        if a.json:
            return to_json([s])
        head = f"documents:        {s.total_documents}\nneeds embedding:  {s.needs_embedding}\nvector index:     {'yes' if s.has_vector_index else 'no'}"
        return head + "".join(["\n\ncollections:"] * bool(s.collections) + [f"\n  {i.collection.name:<16} {i.doc_count} docs  {i.collection.path}" for i in s.collections])
    if a.command == "cleanup":
        return f"{engine.cleanup()} items cleaned up"
    engine.vacuum()
    return "store vacuumed"


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("docsift").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        root = os.path.abspath(a.index) if "://" not in a.index else a.index
        engine = Engine(spark, root, embedder=a.embedder and OnnxEmbedder(a.embedder), reranker=a.reranker and OnnxReranker(a.reranker))
        if out := run(engine, a):
            print(out)
        return 0
    except DocsiftError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
