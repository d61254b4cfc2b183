import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entrypoint
from tidegrid.llm import queries

TABLES = "documents embeddings pages labels conversations".split()


def test_one_query_for_each_operator():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(names) <= set(entrypoint.queries()) and set(queries.ORACLE_SQL) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    def cells(pdf):
        whole = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) else v
        return sorted(str([whole(v) for v in r]) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))
    assert cells(got) == cells(want)
