"""The queries that SQL can express, against DuckDB, and the pipeline, on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

from platter.llm.queries import QUERIES
from platter.llm.sqls import ORACLE_SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple("NULL" if x is None or x != x else str(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(c.execute(ORACLE_SQL[name]).df())


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(docs.columns) | {"shard", "slot"} == set(out.columns)
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    assert set(out.doc_id) < {r.doc_id for r in docs.select("doc_id").collect()}
