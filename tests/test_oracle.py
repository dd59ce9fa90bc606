"""Every query of the library that has SQL, against DuckDB over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from refminer.plans import queries

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = FOLDER / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value.replace(tzinfo=None)) if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, str(FOLDER))
    result = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(row[columns.index(c)]) for c in df.columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(map(plain, row)) for row in df.collect()), key=repr) == want


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "dataset_identifier", "data_repository", "dataset_webpage"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
