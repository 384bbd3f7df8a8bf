"""Registered queries over archives, images and trees against their SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bytegrove import binary_queries as binary

TABLES = "/root/testdata/sf0.001"


def _rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(binary.queries()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{TABLES}/{table}.parquet'")
    want = con.execute(binary.oracle_sql()[name]).df()
    got = binary.queries()[name](spark, TABLES).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and _rows(got) == _rows(want)


def test_documents_without_text(spark, tmp_path):
    spark.createDataFrame([(0, None), (1, ""), (2, None), (3, None), (4, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["doc_id"], r["object_id"]): (r["path"], r["size"], r["type"]) for r in binary.zip_members(spark, str(tmp_path)).collect()}
    assert found[0, 1] == ("text/0.txt", 0, None) and found[1, 5] == ("deep.txt", 6, None)
    assert found[2, 0] == ("2.zip", 4, None) and found[3, 0] == ("3.zip", 0, None) and found[4, 4] == ("inner.zip", None, "Zip")


def test_texts_that_stay_as_they_are_make_no_archive(spark):
    made = spark.range(1).select(binary._archive(F.lit("0"), F.lit(None).cast("binary"), F.lit(b"i")).alias("none"), binary._archive(F.lit("0"), F.lit(b""), F.lit(b"i")).alias("empty")).first()
    assert made["none"] is None and made["empty"].startswith(b"PK\x03\x04")
