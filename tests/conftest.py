import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def canonical(v):
    import datetime
    import decimal
    import math

    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def check(query, sql):
        df = query(spark, SMALL)
        cols = sorted(df.columns)
        got = sorted(tuple(map(canonical, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
        rel = duck.execute(sql)
        names = [c[0] for c in rel.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted(tuple(canonical(r[i]) for i in at) for r in rel.fetchall())
        assert got == want
        return len(got)

    return check
