"""Rows with nulls are stored as their SQL has them, and a clock that is set back leaves times in order."""

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from docsift import queries
from docsift.plans.engine import Engine


@pytest.fixture(scope="module")
def nulls(tmp_path_factory):
    """The smallest documents, some without a text, lang, source or id, some of them twice, and all labels."""
    at, c = tmp_path_factory.mktemp("nulls"), duckdb.connect()
    some = lambda k, column: f"CASE WHEN {k} THEN NULL ELSE {column} END AS {column}"
    c.execute(f"CREATE TABLE d AS SELECT doc_id AS n, * REPLACE ({some('doc_id % 3 = 0', 'text')}, {some('doc_id % 5 = 1', 'lang')}, {some('doc_id % 7 = 2', 'source')}) FROM '{DATA}/documents.parquet' WHERE length(text) < 2000")
    c.execute(f"COPY (SELECT * EXCLUDE (n) REPLACE ({some('n % 11 = 3', 'doc_id')}) FROM (FROM d UNION ALL FROM d WHERE n % 4 = 1 UNION ALL SELECT * REPLACE (NULL AS text) FROM d WHERE n % 4 = 2)) TO '{at}/documents.parquet'")
    c.execute(f"COPY (FROM '{DATA}/labels.parquet') TO '{at}/labels.parquet'")
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    kinds = c.execute(f"WITH {queries._FILES} SELECT count(DISTINCT (collection IS NULL, path IS NULL, hash IS NULL, coalesce(toxic, 0), coalesce(left(path, 3), ''))) FROM files LEFT JOIN labels USING (doc_id)").fetchone()[0]
    assert kinds > 20
    return str(at), c


def _same(spark, nulls, name):
    at, c = nulls
    got = queries.QUERIES[name](spark, at)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["store_update", "store_content", "store_vacuum", "store_rename", "store_remove", "store_embed"])
def test_nulls(spark, nulls, name):
    _same(spark, nulls, name)


def test_clock(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    scan = lambda body: spark.createDataFrame([("c", "a.md", body), ("c", "b.md", "same")], "collection string, path string, body string")
    engine.ingest(scan("one"), ["c"])
    engine.store.replace("documents", engine.store.table("documents").withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY")))
    engine.store.commit()
    assert engine.ingest(scan("two"), ["c"]).updated == 1
    assert engine.store.table("documents").where("path = 'a.md' AND created_at <= modified_at").count() == 1
