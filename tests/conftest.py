import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query against its SQL, as bags of rows with columns in order of name."""

    def check(run, sql):
        got = run(spark, DATA).toPandas()
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(got.columns)

        def rows(d):
            plain = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
            return sorted((tuple(plain(v) for v in r) for r in d[cols].astype(object).values.tolist()), key=str)

        assert rows(got) == rows(want)

    return check
