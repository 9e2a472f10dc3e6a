"""Near-duplicate documents at a true similarity: SimHash blocks first, min-max bands for the rest.

Candidates come from two kinds of tables over the distinct sets of shingles. The pigeonhole blocks
of 64-bit SimHash fingerprints find every pair that differs in at most ``distance`` bits, and
the Hamming check joins them. A pair at a similarity of 0.8 differs in about ten bits, which
blocks of a useful width cannot find, so bands of min-max hashes are added. All
links are then checked on the shingles (``verify``), those of the blocks too.

Defined cases: texts without words, null ones included, are one group; fewer words than a shingle are
one shingle; repeated rows, and rows that share an id but not their text, are told apart by
their hash; ties for the first row of a group go to the smaller hash; very long texts are
compared whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import blocks, give_back, stored, tune
from mnemospark.llm.components import connected
from mnemospark.llm.minhash import BANDS, ROWS, band_keys, signatures
from mnemospark.llm.simhash import _majority, _shingles, links, pigeonhole_masks
from mnemospark.llm.verify import true_components


def _profiles(rows: DataFrame, words: int, bands: int, permutations: int) -> DataFrame:
    """``doc_id, body, node, n, fingerprint, bands`` of every row; an empty set has no bands and fingerprint zero."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 20):
            sets = [_shingles(x, words) for x in block.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
            counts = np.fromiter(map(len, sets), np.int64, len(sets))
            hashes = np.concatenate([np.zeros(0, np.uint64), *sets])
            full = counts[counts > 0]
            keys = band_keys(signatures(hashes, full, bands * permutations), bands) if len(full) else np.empty((0, bands), np.uint64)
            ends = np.cumsum(np.append(0, np.where(counts > 0, bands, 0)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            nodes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            prints = pa.array([f"{x:016x}" for x in _majority(hashes, counts).tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("body"), nodes, pa.array(counts), prints, lists], ["doc_id", "body", "node", "n", "fingerprint", "bands"])
        give_back()

    return rows.select("doc_id", "text", "body").mapInArrow(make, f"doc_id {kind}, body long, node binary, n long, fingerprint string, bands array<long>")


def similar_documents(rows: DataFrame, words: int = 5, percent: int = 80, distance: int = 3, bands: int = BANDS, permutations: int = ROWS) -> DataFrame:
    """``doc_id, body, first_id, first_body`` of every row: the least (id, hash) among the rows that can be reached.

    ``rows``: ``doc_id, text, body``, where ``body`` is a hash of what tells rows of one id apart.
    A link joins sets of shingles that share at least ``percent`` per cent of their union.
    """
    tune(rows.sparkSession)
    found = stored(_profiles(rows, words, bands, permutations))
    sets = found.groupBy("node").agg(
        F.min(F.struct("doc_id", "body")).alias("first"), F.first("n").alias("n"), F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands")
    )
    sets = stored(sets.select("node", F.monotonically_increasing_id().alias("id"), "first.doc_id", "first.body", "n", "fingerprint", "bands"))
    prints = sets.select("fingerprint").where("n > 0").distinct()
    close = connected(links(prints, pigeonhole_masks(64, distance), distance), "fingerprint")
    blocked = sets.where("n > 0").join(close, "fingerprint", "left").select(F.xxhash64(F.lit("block"), F.coalesce("root", "fingerprint")).alias("key"), "id")
    entries = blocked.union(sets.select(F.explode("bands").alias("key"), "id"))
    roots = true_components(sets, entries, rows, words, percent)
    rooted = sets.select("node", "id", "doc_id", "body").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "body")).alias("name"))
    classes = rooted.select("node", "root").join(names, "root").select("node", F.col("name.doc_id").alias("first_id"), F.col("name.body").alias("first_body"))
    return found.select("doc_id", "body", "node").join(classes, "node").drop("node")
