"""The store that is written by queries: room on disk, and rows as their SQL has them."""

import os

import pytest
from conftest import DATA

from docsift import queries
from docsift.plans.store import Store


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


@pytest.mark.parametrize("name", ["store_cleanup", "store_remove", "store_vacuum"])
def test_room(spark, monkeypatch, name):
    """At no time does a store take four times the room of its input."""
    write, seen = Store.write, []

    def watched(self, *a, **b):
        out = write(self, *a, **b)
        seen.append(size(self.root.removeprefix("file://")))
        return out

    monkeypatch.setattr(Store, "write", watched)
    queries.QUERIES[name](spark, DATA)
    assert 0 < max(seen) < 4 * os.path.getsize(f"{DATA}/documents.parquet")


def test_marked(spark):
    from docsift.operators.maintain import marked

    rows = spark.range(300).selectExpr("id % 2 AS revision", "id * 8589934592 DIV 7 AS number", "id")
    some = rows.where("id % 5 = 0 OR id = 63")
    assert {r.id for r in marked(rows, some).collect()} == {i for i in range(300) if i % 5 == 0 or i == 63}
    assert {r.id for r in marked(rows, some, there=False).collect()} == {i for i in range(300) if i % 5 and i != 63}
    assert marked(rows, rows.where("false")).count() == 0 and marked(rows, rows.where("false"), there=False).count() == 300


def test_sorted_tasks_are_bounded(spark, monkeypatch):
    """A sort of postings has its own splits, so what it spills doesn't grow with those of the session."""
    from docsift.plans import store

    monkeypatch.setattr(store, "SORT_BYTES", 1 << 16, raising=False)
    was, written, write = spark.conf.get("spark.sql.files.maxPartitionBytes"), [], Store.write

    def watched(self, name, *a, **b):
        out = write(self, name, *a, **b)
        if name == "postings":
            written.append([os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{self.root}/{out}".removeprefix("file://")) for f in names if f.endswith(".parquet")])
        return out

    monkeypatch.setattr(Store, "write", watched)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        queries.QUERIES["store_remove"](spark, DATA.replace("sf0.001", "sf0.01"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == was
    assert len(written[0]) > 4 and len(written[-1]) > 4  # more than there are cores


def test_bodies_stay_where_they_are(spark, monkeypatch):
    """Labels that are too many for a broadcast don't move the texts."""
    from docsift.plans.engine import Engine

    plans, ingest = [], Engine.ingest
    monkeypatch.setattr(Engine, "ingest", lambda self, rows, names: plans.append(rows._jdf.queryExecution().toString()) or ingest(self, rows, names))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries.QUERIES["store_update"](spark, DATA)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 2 and not any("SortMergeJoin" in p for p in plans)
