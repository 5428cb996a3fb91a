import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.local.dir", str(base / "local"))
        .config("spark.checkpoint.dir", str(base / "shared"))
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def plain(v):
    """A value that compares across engines."""
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf_dir):
    def check(query, sql):
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        found = duck.execute(sql)
        there = [c[0] for c in found.description]
        assert sorted(there) == names
        a = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        b = sorted((tuple(plain(r[there.index(c)]) for c in names) for r in found.fetchall()), key=repr)
        assert a == b

    return check
