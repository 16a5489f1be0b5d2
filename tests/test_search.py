import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.functions.query import clauses_for, to_fts5
from docsift.functions.text import PORTER
from docsift.operators import fts, fuse, vector

FIELDS = ("filepath", "title", "body")
WORDS = "apple banana cherry running runner should notify phi don worry unique café md docs the".split()
QUERIES = ["apple", "run", "app ban", '"phi phi"', "apple -banana", 'cherry -"should notify" -docs', "apple apple", "md", "should_notify", "don't", "relational", '"the apple']


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    return [(i, f"docs/{rng.choice(WORDS)}-{i}.md", say(3), say(rng.randint(1, 40)) + (" phi phi phi" if i % 7 == 0 else "")) for i in range(60)]


@pytest.mark.parametrize("query", QUERIES)
def test_scan_and_index_score_like_fts5(query, corpus, spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(filepath, title, body, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f(rowid, filepath, title, body) VALUES (?, ?, ?, ?)", corpus)
    raw = dict(db.execute("SELECT rowid, bm25(f, 10.0, 1.0, 1.0) FROM f WHERE f MATCH ?", (to_fts5(query),)).fetchall())
    want = {k: -v / (1 - v) for k, v in raw.items()}
    rows = spark.createDataFrame(corpus, "id long, filepath string, title string, body string")
    clauses = clauses_for(query, PORTER)
    got = {r.id: r.score for r in fts.search(rows, clauses, FIELDS, PORTER, None, ("id",)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    counted = {tuple(r) for r in fts.lookup(fts.postings(rows, FIELDS, ("id",), PORTER), clauses, ("id",)).where(" OR ".join(f"tf{i} > 0" for i in range(len(clauses)))).collect()}
    scanned = {tuple(r) for r in fts.scan(rows, clauses, FIELDS, PORTER).select("id", *[f"tf{i}" for i in range(len(clauses))]).where(" OR ".join(f"tf{i} > 0" for i in range(len(clauses)))).collect()}
    assert counted == scanned


def test_normalised_scores(spark):
    r = spark.range(1).select(*[fts.normalize_bm25(F.lit(x)).alias(n) for x, n in ((-3.0, "a"), (3.0, "b"), (0.0, "c"))]).first()
    assert (r.a, r.b, r.c) == (0.75, 0.75, 0.0)


def test_knn_and_batch(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None), (998, [1.0])], "vec_id long, embedding array<float>").repartition(5)
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2))
    want = {(i, j) for i in range(0, 300, 10) for j in np.lexsort((np.arange(300), d[i]))[:4].tolist()}
    got = vector.knn_batch(rows, rows.where("vec_id % 10 = 0 AND vec_id < 300"), 4, block=7)
    assert {(r.query_id, r.id) for r in got.collect()} == want
    assert [r.vec_id for r in vector.knn(rows, x[0].tolist(), 5, ("vec_id",)).collect()] == np.lexsort((np.arange(300), d[0]))[:5].tolist()


def test_batch_of_equal_vectors(spark):
    """Of thousands of equal vectors in a batch the least ids count, at the cut too, however rows are dealt."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 8)).astype(np.float32)
    x[rng.permutation(6000)[:4000]] = x[17]
    x[:3] = x[17] + np.float32([[1e-3], [2e-3], [3e-3]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = [0, 17, 40, 5999]
    for n in (1, 3):
        got = vector.knn_batch(rows.repartition(n), rows.where(F.col("vec_id").isin(asked)), 6).collect()
        for i in asked:
            d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
            assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == np.lexsort((np.arange(6000), d))[:6].tolist()


def test_fusion(spark):
    def lists(*keys_and_weights):
        rows = [(k, i, w, r) for i, (keys, w) in enumerate(keys_and_weights) for r, k in enumerate(keys)]
        return {r.key: r.score for r in fuse.rrf(spark.createDataFrame(rows, "key string, list_id int, weight double, rank int")).collect()}

    got = lists(("ab", 1.0), ("bc", 0.8))
    assert got == pytest.approx({"b": 1 / 62 + 0.8 / 61, "a": 1 / 61, "c": 0.8 / 62})
    assert lists(("aab", 1.0)) == pytest.approx({"a": 1 / 61 + 1 / 62, "b": 1 / 63})
