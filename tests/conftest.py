import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("seqframe-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def same_rows(spark, sf_dir, query, sql):
    """Compare a query with DuckDB SQL on the same tables, order aside; columns by name."""
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = query(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names), (got.columns, names)
    order = sorted(names)

    def norm(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if type(v).__name__ == "Decimal":
            return float(v)
        if isinstance(v, bool):
            return v
        return v

    want = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(norm(r[c]) for c in order) for r in got.collect()), key=repr)
    assert len(have) == len(want), (len(have), len(want))
    for a, b in zip(have, want):
        assert a == b, (order, a, b)
