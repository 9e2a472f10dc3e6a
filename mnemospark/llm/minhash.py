"""Near-duplicates by min-max hashing: both ends of every permutation go into the signature.

A permutation of the shingle hashes of a text gives two values, its smallest and its
largest, each equal in two texts with the chance of their Jaccard similarity s. So a
band of six values costs three permutations. Texts that share a band are candidates, which
a pair at s becomes with a chance of 1 - (1 - s^6)^bands: with 40 bands all but 5 in a
million at 0.8. Every link is then confirmed on the whole sets (``verify``). The
signature also estimates the similarity: the two ends of one permutation are slightly
negatively correlated, so their mean varies less than that of independent minima.

Texts with equal sets are one node, so that exact copies cost nothing more.

Defined cases: a null or blank text has no shingles, n_shingles 0, and is linked with nothing,
equal ones neither; a text with fewer words than a shingle has its whole word sequence as
its one shingle; repeated rows have equal sets and so one component; a row with a null id
counts for links, but a component takes its name from the ids that are not null (null if it
has none, and then all its rows are kept); rows that share the smallest id are all kept;
very long texts are hashed whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import blocks, stored, tune
from mnemospark.llm.simhash import _shingles
from mnemospark.llm.verify import true_components

BANDS = 40
#: Permutations in a band; each gives two values.
ROWS = 3


def multipliers(n: int, seed: int = 42) -> np.ndarray:
    """Odd numbers: multiplying by one permutes the 32-bit integers."""
    return (np.random.default_rng(seed).integers(0, 1 << 31, n, np.uint32) << np.uint32(1)) | np.uint32(1)


def signatures(hashes: np.ndarray, counts: np.ndarray, permutations: int, seed: int = 42) -> np.ndarray:
    """For each set (no empty ones) a row of ``2 * permutations`` values: minimum and maximum under each.

    ``hashes`` has the 64-bit shingle hashes of all sets end to end; their upper halves are permuted.
    """
    starts = np.cumsum(counts) - counts
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(counts), 2 * permutations), np.uint32)
    for i, factor in enumerate(multipliers(permutations, seed)):
        moved = upper * factor
        out[:, 2 * i] = np.minimum.reduceat(moved, starts)
        out[:, 2 * i + 1] = np.maximum.reduceat(moved, starts)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each set and band; the band's number is part of it."""
    parts = signature.reshape(len(signature), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        keys = (keys ^ parts[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated Jaccard similarity of two sets: the share of equal values of their signatures."""
    return float((a == b).mean())


def profiles(rows: DataFrame, words: int, bands: int, permutations: int) -> DataFrame:
    """``doc_id, body, node, n, bands``: the set's 128-bit hash (null for the empty set), its size and its keys."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = [_shingles(x, words) for x in block.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
            counts = np.fromiter(map(len, sets), np.int64, len(sets))
            full = counts[counts > 0]
            keys = band_keys(signatures(np.concatenate(sets), full, bands * permutations), bands) if len(full) else np.empty((0, bands), np.uint64)
            ends = np.cumsum(np.append(0, np.where(counts > 0, bands, 0)))
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("body"), pa.array(nodes, pa.binary()), pa.array(counts), lists], ["doc_id", "body", "node", "n", "bands"])

    return rows.select("doc_id", "text", "body").mapInArrow(make, f"doc_id {kind}, body long, node binary, n long, bands array<long>")


def distinct_sets(found: DataFrame) -> DataFrame:
    """``node, id, doc_id, body, lowest, n, bands``: one row for each distinct set, with a number and a document that has it."""
    sets = found.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "body")).alias("first"), F.min("doc_id").alias("lowest"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    return stored(sets.select("node", F.monotonically_increasing_id().alias("id"), "first.doc_id", "first.body", "lowest", "n", "bands"))


def named_components(found: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc_id, n, component_id``: the smallest id that can be reached, for each row of ``found``; empty sets are by themselves."""
    rooted = sets.select("node", "id", "lowest").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    classes = rooted.join(names, "root").select("node", "component_id")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "node", "n").join(classes, "node", "left").select("doc_id", "n", own.alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, bands: int = BANDS, permutations: int = ROWS, text: str = "text", doc_id: str = "doc_id", chunk: int = 512) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, linked by at least ``percent`` per cent of the union of two sets."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("body"))
    found = stored(profiles(rows, words, bands, permutations))
    sets = distinct_sets(found)
    entries = sets.select(F.explode("bands").alias("key"), "id")
    roots = true_components(sets, entries, rows, words, percent, chunk)
    return named_components(found, sets, roots).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))
