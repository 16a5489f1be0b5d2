"""Directories of text files as a source, and results as JSON or text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import asdict, is_dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.errors import ConfigError
from docsift.functions.text import content_hash, title
from docsift.schema import Collection

# Directories that are never walked.
EXCLUDED = ("node_modules", ".git", ".cache", "vendor", "dist", "build", "target")
SCHEMES = re.compile(r"[a-z][a-z0-9+.-]*://")


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: ``**/`` any folders, ``*`` and ``?`` within a name, ``[…]``, ``{a,b}``.

    A pattern without a slash fits a name in any folder.
    """
    if "/" not in pattern.strip("/"):
        pattern = "**/" + pattern.lstrip("/")
    out, i, depth = "", 0, 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif (c := pattern[i]) == "[" and (m := re.match(r"\[(!|\^)?([^\]]+)\]", pattern[i:])):
            out, i = out + f"[{'^' * bool(m[1])}{m[2]}]", i + m.end()
        else:
            if c in "{}":
                depth += 1 if c == "{" else -1
            out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if depth else ","}.get(c, re.escape(c))
            i += 1
    if depth:
        raise ConfigError(f"unbalanced braces in {pattern!r}")
    return out.removeprefix("/")


class _GitIgnore:
    """The rules of ``.gitignore`` files on the way down to a path; the last that fits decides."""

    def __init__(self, rules: list[tuple[re.Pattern, bool, bool]]):
        self.rules = rules

    def below(self, base: str, rel: str) -> _GitIgnore:
        try:
            lines = open(os.path.join(base, rel, ".gitignore"), encoding="utf-8", errors="replace").read().splitlines()
        except OSError:
            return self
        rules = list(self.rules)
        for line in lines:
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            back, only_dir = line.startswith("!"), line.endswith("/")
            body = line.lstrip("!").rstrip("/")
            anchored = "/" in body
            inner = glob_regex(body.lstrip("/") if anchored else body)
            if anchored and "/" not in body.lstrip("/"):
                inner = inner.removeprefix("(?:[^/]+/)*")
            rules.append((re.compile((re.escape(rel) + "/" if rel else "") + inner + r"\Z"), back, only_dir))
        return _GitIgnore(rules)

    def hides(self, rel: str, is_dir: bool) -> bool:
        hidden = False
        for pattern, back, only_dir in self.rules:
            if (is_dir or not only_dir) and pattern.match(rel):
                hidden = not back
        return hidden


def walk(base: str, pattern: str = "**/*.md", ignore: list[str] | tuple[str, ...] = ()) -> Iterator[str]:
    """Paths below a local directory, relative and with ``/``: regular files that fit, without hidden, excluded and ignored ones."""
    if not os.path.isdir(base):
        raise ConfigError(f"not a directory: {base}")
    wanted = re.compile(glob_regex(pattern) + r"\Z")
    refused = [(re.compile(glob_regex(p.rstrip("/")) + r"\Z"), p.endswith("/")) for p in ignore]

    def inside(rel: str, git: _GitIgnore) -> Iterator[str]:
        git = git.below(base, rel)
        try:
            entries = sorted(os.scandir(os.path.join(base, rel)), key=lambda e: e.name)
        except OSError as e:
            raise ConfigError(str(e)) from e
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") or any(p.match(path) for p, only in refused if is_dir or not only):
                continue
            if is_dir:
                if e.name not in EXCLUDED and not git.hides(path, True):
                    yield from inside(path, git)
            elif e.is_file(follow_symlinks=False) and wanted.match(path) and not git.hides(path, False):
                yield path

    yield from inside("", _GitIgnore([]))


def _fits(path: Column, c: Collection) -> Column:
    """The walk's name rules as a predicate over relative paths, for stores that Spark lists itself."""
    java = lambda p: "^" + glob_regex(p) + "$"
    ok = path.rlike(java(c.pattern)) & ~path.rlike(r"(^|/)(\.[^/]*|" + "|".join(map(re.escape, EXCLUDED)) + r")(/|$)")
    for p in c.ignore:
        ok = ok & ~path.rlike("^" + glob_regex(p.rstrip("/")) + ("/.*$" if p.endswith("/") else "(/.*)?$"))
    return ok


def below(spark: SparkSession, base: str) -> Column:
    """The part of a listed file's ``path`` below a directory, which Spark writes with scheme and host."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    return F.when(F.col("path").startswith(full), F.substr("path", F.lit(len(full) + 1)))


def usable(content: str) -> Column:
    """The text of a file, null where it is blank or isn't UTF-8."""
    text = F.col(content).cast("string")
    return F.when(F.is_valid_utf8(text) & text.rlike(r"\S"), text)


def scan(spark: SparkSession, c: Collection) -> DataFrame:
    """``collection, path, body``: every file that the walk finds; body is null where the file is blank or isn't UTF-8 text.

    Local directories are walked on the driver with .gitignore rules, and files are read on the executors, which must see the
    same directory; other stores are listed by Spark, where .gitignore files are not looked at.
    """
    base = c.path.rstrip("/") or "/"
    if SCHEMES.match(base) and not base.startswith("file:"):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        rows = raw.select(below(spark, base).alias("path"), "content")
        rows = rows.where(_fits(F.col("path"), c))
    else:
        base = base.removeprefix("file://")
        paths = list(walk(base, c.pattern, c.ignore))
        names = spark.createDataFrame(pd.DataFrame({"path": pd.Series(paths, dtype=object)}), "path string")

        @F.pandas_udf("binary")
        def read(rel: pd.Series) -> pd.Series:
            def one(p: str) -> bytes | None:
                try:
                    return open(os.path.join(base, p), "rb").read()
                except OSError:
                    return None

            return rel.map(one)

        rows = names.repartition(max(1, min(len(paths) // 64 + 1, 4096))).withColumn("content", read("path"))
    return rows.select(F.lit(c.name).alias("collection"), F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), usable("content").alias("body"))


def with_identity(files: DataFrame) -> DataFrame:
    """Adds ``hash`` and ``title``; both are null where the body is null. A body that is empty or blank has both."""
    return files.select("collection", "path", "body", content_hash("body").alias("hash"), F.when(F.col("body").isNotNull(), title(F.col("body"), F.col("path"))).alias("title"))


def to_json(results: list) -> str:
    """Rows, dataclasses or mappings as pretty JSON."""
    plain = [asdict(r) if is_dataclass(r) else r.asDict(recursive=True) if hasattr(r, "asDict") else r for r in results]
    return json.dumps(plain, indent=2, ensure_ascii=False, default=str)


def json_column(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def result_line(score="score", hash_col="hash", collection="collection", path="path", title_col="title") -> Column:
    """``0.123  #docid collection/path — title``."""
    return F.concat(F.format_string("%.3f", F.col(score)), F.lit("  #"), F.substring(hash_col, 1, 6), F.lit(" "), F.concat_ws("/", collection, path), F.lit(" — "), F.col(title_col))


