import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compares a query with its SQL, columns by name and rows in any order."""

    def rows(columns, values):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(repr([v[i] for i in order]) for v in values)

    def check(query, sql):
        df = query(spark, SF)
        cur = duck.execute(sql)
        names, want = [c[0] for c in cur.description], cur.fetchall()
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, df.collect()) == rows(names, want)

    return check
