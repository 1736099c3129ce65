import duckdb
import pandas as pd
import pytest

from nightloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = duck.sql(queries.oracle_sql()[name])
    expected = pd.DataFrame(result.fetchall(), columns=[c[0] for c in result.description])
    found = queries.queries()[name](spark, SF).toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    columns = sorted(found.columns)
    own = [x[columns].astype(object) for x in (found, expected)]
    rows = [sorted(map(tuple, x.where(x.notna(), None).values.tolist()), key=str) for x in own]
    assert rows[0] == rows[1]
