"""Queries over documents without text and vectors without length, held against their SQL."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

SRC = "/root/testdata/sf0.001"
TEXTS = (None, "", " ", "\n\t \r\f", "\x0b", " 　", "x", "ask a@b.co")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Fifty documents and vectors of sf0.001, and odd ones; of one vector the cosine to the first is -0.0000003."""
    out = str(tmp_path_factory.mktemp("odd"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SRC}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    docs = spark.read.parquet(f"{SRC}/documents.parquet").where("doc_id < 50").select("doc_id", "text", "n_chars")
    odd = spark.createDataFrame([(100 + k, x, None if x is None else len(x)) for k, x in enumerate(TEXTS)], docs.schema)
    docs.unionByName(odd).withColumn("source", F.lit("s")).coalesce(1).write.parquet(f"{out}/documents.parquet")
    turned = [0.0, 1.0] + [0.0] * 62
    near = [-3e-7, 0.0, 1.0] + [0.0] * 61
    rows = [(0, [1.0] + [0.0] * 63), (1, turned), (100, None), (101, [0.0] * 64), (106, near), (107, [float("nan")] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.mark.parametrize("name", ["csv_export", "gdpr_checks", "audit_overview", "experience_correlation", "semantic_score"])
def test_documents_without_text_count_as_in_sql(spark, folder, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    for table in ("benchmark", "labels", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    entry.queries()[name](spark, folder).coalesce(1).write.parquet(str(tmp_path / "got"))
    rows = lambda body: sorted(con.execute(f"SELECT COLUMNS(*)::VARCHAR FROM ({body})").fetchall(), key=str)
    got, want = rows(f"SELECT * FROM read_parquet('{tmp_path}/got/*.parquet')"), rows(entry.oracle_sql()[name])
    assert len(want) > 0 and got == want
