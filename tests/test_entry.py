import os

import pytest

import __spark_entry__ as entry

WHERE = "/root/testdata/sf0.001"
#: Delimiters are inferred from the rows; in two hundred of them some marks come once or twice, which decides nothing.
FULLER = "/root/testdata/sf0.01"


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p2_found", "p3_found", "p4_found", "p5_found"} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(WHERE), reason="no test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["tbl", "row_id", "ref", "loaded_month", "fate"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(WHERE), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db, where = duckdb.connect(), FULLER if name.startswith("p3_") else WHERE
    for file in os.listdir(where):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{where}/{file}')")
    got, want = entry.queries()[name](spark, where).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        return sorted(tuple("null" if x is None or x != x else f"{x:.5g}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(got) == rows(want)
