import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from docsift.functions import text as X

ENDINGS = ["", "s", "ed", "ing", "ly", "ness", "ation", "e", "ies", "al", "ion", "ive", "ll", "y", "ement", "eed", "sses"]


def fts5_tokens(texts, tokenizer):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE f USING fts5(b, tokenize='{tokenizer}')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    db.executemany("INSERT INTO f(rowid, b) VALUES (?, ?)", list(enumerate(texts)))
    out = {i: {} for i in range(len(texts))}
    for term, doc, at in db.execute("SELECT term, doc, offset FROM v"):
        out[doc][at] = term
    return [[t[k] for k in sorted(t)] for t in out.values()]


@pytest.mark.parametrize(("tokenizer", "analyzer"), [("porter unicode61", X.PORTER), ("unicode61", X.UNICODE)])
def test_analyzers_are_those_of_fts5(tokenizer, analyzer, duck):
    rng = random.Random(5)
    texts = [r[0] for r in duck.execute("SELECT text FROM documents").fetchall()]
    texts.append(" ".join("".join(rng.choice("aeioubcdlstyzngr") for _ in range(rng.randint(1, 9))) + rng.choice(ENDINGS) for _ in range(20000)))
    texts.append("é à ü ñ ệ ß ² ½ ⅷ ٣ İ ı Å ñ̃ café naïve Ω Жук Й ё か 日本語 한국 x_y-z'q Ｆ ﬁ ſ K should_notify don't")
    assert [X.analyze(t, analyzer) for t in texts] == fts5_tokens(texts, tokenizer)


def test_titles(spark):
    cases = [("# My Title\nBody", "a.md", "My Title"), ("## Sub Title\nBody", "a.md", "Sub Title"), ("No headings here", "notes.md", "notes"), ("### Three", "a/b.tar.gz", "b.tar"), ("x\n  # Deep  \n", "a.md", "Deep"), ("# \n## Two", "a.md", "Two"), ("", ".hidden", ""), ("```\n# in code\n```", "a.md", "in code"), ("#x", "d/plain", "plain"), ("# \n", "w\\v.txt", "v")]
    rows = spark.createDataFrame([(b, p, w) for b, p, w in cases], "b string, p string, w string").select(X.title(F.col("b"), F.col("p")).alias("t"), "w").collect()
    assert [r.t for r in rows] == [r.w for r in rows]


def test_snippets():
    assert X.snippet("tiny — body", "body", 4096) == "tiny — body"
    assert X.snippet("a" * 3998 + "→" + "b" * 1000, "search", 4000) == "a" * 3998 + "→" + "b" * 1000
    assert "needle" in X.snippet("x" * 60 + "→needle and the rest", "needle", 50)
    assert X.snippet("l1\nl2\nword here\nl4\n" + "z" * 100, "word", 10).startswith("l1")


def test_identity(spark):
    r = spark.createDataFrame([("é→x",)], "t string").select(X.content_hash("t").alias("h"), F.char_length("t").alias("n"), X.docid(X.content_hash("t")).alias("d")).first()
    assert len(r.h) == 64 and r.n == 3 and r.d == r.h[:6]
