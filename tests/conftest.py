import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def same_rows(got, expected, places=6):
    """Whether two lists of rows are equal as multisets, numbers rounded."""
    import decimal
    import math
    from collections import Counter

    def norm(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, decimal.Decimal):
            v = float(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, places) + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(map(norm, v))
        return v

    return Counter(tuple(map(norm, r)) for r in got) == Counter(tuple(map(norm, r)) for r in expected)


@pytest.fixture(scope="session")
def against_sql(spark):
    """Runs a query and its SQL twin over sf0.001 and compares columns and rows."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS FROM '{folder}/{t}'")

    def check(query, sql):
        df = query(spark, folder)
        columns = sorted(df.columns)
        got = [tuple(r[c] for c in columns) for r in df.collect()]
        ran = con.execute(sql)
        names = [x[0] for x in ran.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        expected = [tuple(r[i] for i in at) for r in ran.fetchall()]
        assert same_rows(got, expected)

    return check
