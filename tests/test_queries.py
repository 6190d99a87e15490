"""Every query with SQL against that SQL; the others run and have a stable schema."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwright import phase_queries, queries
from tests.conftest import assert_same


QUERIES = queries.queries() | phase_queries.queries()
SQL = queries.oracle_sql() | phase_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df())


def test_sql_of_greedy_along_a_chain(spark, tmp_path):
    words = F.expr("array_join(transform(sequence(6 * id, 6 * id + 99), x -> concat('w', x)), ' ')")
    docs = spark.range(8).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("s").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries.near_dedup_kept(spark, str(tmp_path)).toPandas()
    assert sorted(got["row_idx"]) == [0, 2, 4, 6]
    assert_same(got, con.execute(SQL["near_dedup_kept"]).df())
    for name in ("processed_rows", "package_rows", "reproducibility_file"):
        assert_same(QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(SQL[name]).df())


def test_files_of_phases_after_a_chain(spark, tmp_path):
    words = F.expr("array_join(transform(sequence(6 * id, 6 * id + 99), x -> concat('w', x)), ' ')")
    docs = spark.range(18).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("s").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("ambiguity_file", "run_log", "severity_file", "balanced_file"):
        assert_same(QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(SQL[name]).df())


def test_reports_of_phases_after_a_chain(spark, tmp_path):
    words = F.expr("array_join(transform(sequence(6 * id, 6 * id + 99), x -> concat('w', x)), ' ')")
    docs = spark.range(18).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("s").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("distribution_file", "phase1_report", "dataset_version"):
        assert_same(QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(SQL[name]).df())


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
