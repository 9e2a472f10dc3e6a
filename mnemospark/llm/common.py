"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import cut_lineage, ensure_checkpoint_dir, scratch_folder

__all__ = ["WORD_GAPS", "blocks", "counted", "cut_lineage", "documents", "ensure_checkpoint_dir", "give_back", "let", "partitions", "scratch_folder", "segments", "stored", "tune", "words", "worker_cache"]

#: What separates words: the ASCII white space.
WORD_GAPS = r"[\x20\x09-\x0D]+"
#: Bytes of text that numpy code works on at a time.
BLOCK = 4 << 20
#: Slim rows that a partition holds at least where ``counted`` reads them back.
FULL = 20_000


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by bytes, since texts differ in length by four powers of ten."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16777216")
    return spark


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for slim tables with several readers."""
    return cut_lineage(df)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` stored, and its number of rows; a slim table is read back in as many partitions as it fills."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return out.coalesce(max(1, -(-n // FULL))), n


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The words of a text, an empty array for a null or blank one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAPS), lambda w: w != "")


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one longer row."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.append(0, lengths.astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths laid end to end: the run of each element and its place in it."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - starts[run]


def give_back() -> None:
    """Return freed memory to the system: workers wait for later stages, and what they hold is missing there."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def worker_cache(name: str) -> dict:
    """A dict that lives in the Python worker until another name is asked for: one stage's cache does not outlive it."""
    holder = sys.modules.setdefault("_mnemospark_worker_cache", types.ModuleType("_mnemospark_worker_cache"))
    if getattr(holder, "name", None) != name:
        holder.name, holder.held = name, {}
    return holder.held
