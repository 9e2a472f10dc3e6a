"""Tables on storage: typed reads, append-only logs and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.schemas import AUDIT, DOCUMENTS, ENTRIES, REPORTS, conform

_STRINGS = "array<string>"


def _string_array(df: DataFrame, name: str) -> DataFrame:
    """JSON text to an array; NULL, '' and absent become an empty array."""
    empty = F.array().cast(_STRINGS)
    if name not in df.columns:
        return df.withColumn(name, empty)
    if isinstance(df.schema[name].dataType, T.StringType):
        return df.withColumn(name, F.coalesce(F.from_json(name, _STRINGS), empty))
    return df.withColumn(name, F.coalesce(name, empty))


def as_documents(df: DataFrame) -> DataFrame:
    return conform(_string_array(df, "key_topics"), DOCUMENTS)


def as_entries(df: DataFrame) -> DataFrame:
    df = _string_array(df, "sources")
    if "retrieval_score" not in df.columns and "retrieval_count" in df.columns:
        df = df.withColumnRenamed("retrieval_count", "retrieval_score")
    df = conform(df, ENTRIES)
    return df.withColumns(
        {
            "reasoning": F.coalesce("reasoning", F.lit("")),
            "trust_score": F.coalesce("trust_score", F.lit(0.5)),
            "retrieval_score": F.coalesce("retrieval_score", F.lit(0.0)),
        }
    )


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document catalog; columns an older table lacks are NULL."""
    return as_documents(spark.read.parquet(path))


def load_entries(spark: SparkSession, path: str) -> DataFrame:
    return as_entries(spark.read.parquet(path))


def check_audit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split audit rows; one without correlation id is refused."""
    known = F.coalesce(F.col("correlation_id"), F.lit("")) != ""
    return df.filter(known), df.filter(~known).withColumn("reason", F.lit("missing correlation id"))


def append_audit(df: DataFrame, path: str) -> DataFrame:
    """Append sound rows by day and return the refused ones. There is no update or delete."""
    good, rejects = check_audit(df)
    rows = conform(good, AUDIT).withColumn("dt", F.to_date("timestamp"))
    rows.write.mode("append").partitionBy("dt").parquet(path)
    return rejects


def append_report(df: DataFrame, path: str) -> None:
    conform(df, REPORTS).write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """Write one state of a table. A version is never overwritten, so readers of the
    previous one are undisturbed and a lost executor replays from it."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Highest complete version; one without a success marker is still being written."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    versions = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            versions.append(int(name.split("=", 1)[1]))
    return max(versions, default=None)
