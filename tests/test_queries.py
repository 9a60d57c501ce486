"""Every registered query of the reference's operators against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from platter.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows_of(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple("NULL" if x is None or x != x else str(x) for x in r) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows_of(got) == rows_of(duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert name == "store_or_pack"  # see test_formats


EDGES = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", ["lzh_roundtrip", "lzw_roundtrip", "mfm_roundtrip", "pll_decode", "store_or_pack", "packed_cells", "rename_collisions", "delete_subtrees", "volume_rollup", "name_checks", "ascii_names", "crc16_text", "block_allocation"])
def test_null_empty_and_repeated_rows(spark, tmp_path, name):
    rows = [(1, None, "en", "src3"), (2, "", "de", "src1"), (3, "Ünïcode text", "de", "src2"), (3, "Ünïcode text", "de", "src2"), (4, "x" * 6000, "fr", "src2")]
    spark.createDataFrame(rows, EDGES).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    if name in catalog.ORACLE_SQL and name not in ("crc16_text", "volume_rollup", "block_allocation", "delete_subtrees"):
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert rows_of(got) == rows_of(c.execute(catalog.ORACLE_SQL[name]).df())
    spark.createDataFrame([], EDGES).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(f"{tmp_path}/none/events.parquet")
    assert not len(catalog.QUERIES[name](spark, f"{tmp_path}/none").toPandas())
