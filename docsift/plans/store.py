"""The store: tables in Parquet segments, and one small state file that names the current ones.

Content, vectors and postings only grow by segments; the narrow documents table is rewritten. A change is visible when the state
file is replaced, in one rename; until then a failed or repeated job leaves only files that nothing names. Cleaning and vacuuming write
compact segments and delete those no longer named, one table after the other. Of two writers that began from one version, one is refused.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from docsift.errors import StorageError
from docsift.schema import TABLES, Collection


#: Age from which a claim is taken for that of a dead writer.
CLAIM_MS = 600_000
#: Of the tables' layout.
FORMAT = 2
#: Bytes of files that a task sorts, whatever the session's splits are, so that it needs no room on disk for it. A row group can't be
#: split, so those of files that are sorted later are no larger.
SORT_BYTES = 8 << 20
SPLIT = "spark.sql.files.maxPartitionBytes"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self.state = self._read_state()

    # --- state

    def _read_state(self) -> dict:
        at = self._path(f"{self.root}/STATE.json")
        if not self._fs.exists(at):
            return {"format": FORMAT, "version": 0, "tables": {t: [] for t in TABLES}, "collections": [], "config": {}}
        try:
            stream = self._fs.open(at)
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            state = json.loads(text)
        except Exception as e:
            raise StorageError(f"{self.root}: {e}") from e
        if state.get("format") != FORMAT:
            raise StorageError(f"{self.root}: written in another format; index it again")
        return state

    def commit(self) -> None:
        """Replace the state file in one step.

        A version is written by the one writer that creates its claim; another that began from the same state is refused, and
        has to read the store again. A claim that was left by a writer that died counts for CLAIM_MS.
        """
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        version = self.state["version"]
        claim = self._path(f"{self.root}/.claim-{version + 1}")
        if self._fs.exists(claim) and time.time() * 1000 - self._fs.getFileStatus(claim).getModificationTime() > CLAIM_MS:
            self._fs.delete(claim, False)
        if not self._fs.createNewFile(claim):
            raise StorageError(f"{self.root}: another writer is at version {version + 1}")
        try:
            if self._read_state()["version"] != version:
                raise StorageError(f"{self.root}: version {version} is no longer the latest")
            self._replace_state(jvm, sc)
        finally:
            self._fs.delete(claim, False)

    def _replace_state(self, jvm, sc) -> None:
        self.state["version"] += 1
        draft, final = (self._path(f"{self.root}/{n}") for n in (f".state-{uuid.uuid4().hex}", "STATE.json"))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        over = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, final, over)

    # --- tables

    def table(self, name: str) -> DataFrame:
        segments = [f"{self.root}/{s}" for s in self.state["tables"][name]]
        reader = self.spark.read.schema(TABLES[name])
        return reader.parquet(*segments) if segments else self.spark.createDataFrame([], TABLES[name])

    def segment(self, name: str, segment: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{segment}")

    def write(self, name: str, rows: DataFrame, sort: tuple[str, ...] = ()) -> str:
        """A new segment, not yet named by the state. ``sort`` orders the rows of each file; nothing is moved for it."""
        segment = f"{name}/{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
        rows = rows.select(*TABLES[name].names)
        if sort:
            rows = rows.sortWithinPartitions(*sort)
        with self._splits(SORT_BYTES if sort else None):
            self.put(rows, f"{self.root}/{segment}", small=bool(sort))
        return segment

    @staticmethod
    def put(rows: DataFrame, folder: str, small: bool = False) -> None:
        """Files of rows; ``small`` bounds their row groups."""
        writer = rows.write.option("compression", "zstd")
        (writer.option("parquet.block.size", SORT_BYTES) if small else writer).parquet(folder)

    @contextmanager
    def _splits(self, most: int | None) -> Iterator[None]:
        """Tasks read at most so many bytes of files meanwhile."""
        conf = self.spark.conf
        was, size = conf.get(SPLIT), self.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        if most is None or size <= most:
            yield
            return
        conf.set(SPLIT, str(most))
        try:
            yield
        finally:
            conf.set(SPLIT, was)

    def append(self, name: str, rows: DataFrame, sort: tuple[str, ...] = ()) -> None:
        self.state["tables"][name].append(self.write(name, rows, sort))

    def replace(self, name: str, rows: DataFrame, sort: tuple[str, ...] = ()) -> None:
        self.state["tables"][name] = [self.write(name, rows, sort)]

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def drop_unnamed(self) -> None:
        """Delete segments that the state no longer names."""
        for name, kept in self.state["tables"].items():
            at = self._path(f"{self.root}/{name}")
            if self._fs.exists(at):
                for entry in self._fs.listStatus(at):
                    if f"{name}/{entry.getPath().getName()}" not in kept:
                        self._fs.delete(entry.getPath(), True)

    # --- collections and settings, which are few

    @property
    def collections(self) -> list[Collection]:
        return [Collection(**c) for c in self.state["collections"]]

    def put_collection(self, c: Collection) -> None:
        others = [x for x in self.state["collections"] if x["name"] != c.name]
        self.state["collections"] = sorted([*others, dict(vars(c))], key=lambda x: x["name"])

    def drop_collection(self, name: str) -> None:
        self.state["collections"] = [x for x in self.state["collections"] if x["name"] != name]
