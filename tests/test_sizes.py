"""Registered queries on tables laid out or sized as larger ones are."""

import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import ROOT

sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_sql import rows_of  # noqa: E402


def agree(spark, folder, name, **views):
    con = duckdb.connect()
    for table, path in views.items():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    names, got = rows_of(contract.queries()[name](spark, str(folder)).toArrow())
    want_names, want = rows_of(con.sql(contract.oracle_sql()[name]).to_arrow_table())
    assert names == want_names
    assert got == want
    return got


def test_query_audit_has_no_limit(spark, data, tmp_path):
    """A day with more audit rows than a page of them holds."""
    events = spark.read.parquet(f"{data}/events.parquet")
    busy = events.where("event_type NOT IN ('view', 'click')").withColumn("ts", F.lit("2024-01-05 10:00:00").cast(events.schema["ts"].dataType))
    copies = busy.crossJoin(spark.range(8)).withColumn("event_id", F.col("event_id") + F.col("id") * 10_000_000).drop("id")
    copies.write.parquet(str(tmp_path / "events.parquet"))
    assert len(agree(spark, tmp_path, "p20_query_audit", events=f"{tmp_path}/events.parquet/*.parquet")) > 1000


@pytest.mark.parametrize("name", ["x11_work_stream", "x12_first_shown_stream"])
def test_streams_read_folders_of_files(spark, data, tmp_path, name):
    """A table of several files is a folder, which a stream must read as it reads one file."""
    views = {}
    for table in ("documents", "labels", "events"):
        spark.read.parquet(f"{data}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
        views[table] = f"{tmp_path}/{table}.parquet/*.parquet"
    assert agree(spark, tmp_path, name, **views)
