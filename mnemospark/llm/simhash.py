"""SimHash near-duplicates: fingerprints that share a block are compared bit by bit.

A fingerprint bit is the majority of that bit over the hashes of the text's word shingles.
Equal fingerprints are one row from then on, so that exact copies cost nothing more. The
bits are dealt into blocks, and a table is made for each choice of ``choose`` blocks: when
``parts`` blocks are cut and at most ``distance`` bits differ, some choice of ``parts -
distance`` blocks has none of the differing bits (pigeonhole), and the pair meets in that
table. Wider fingerprints use ``sampled`` tables instead: each takes a fixed pseudo-random
set of bits, which close pairs share with a known probability.

Fingerprints of one table entry are compared in tasks of at most about two ``chunk``s:
larger entries are split into chunks, and every two chunks meet in one task. A task gives
the links of a spanning forest of what it compared (each node to the smallest node of its
part), which has the same components as all pairs, and no more rows than fingerprints.

Defined cases: a text without words, null ones included, has the fingerprint zero; a text
with fewer words than a shingle has its whole word sequence as its one shingle; a bit set in
exactly half of the hashes is not set; repeated rows have equal fingerprints and so one
component; a null id is a document like others; very long texts are hashed whole; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import blocks, partitions, stored, tune
from mnemospark.llm.components import connected

#: Odd multipliers that derive further 64-bit words of a wide fingerprint from one hash.
_FURTHER = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: For each byte a 64-bit word with one 8-bit counter for each of its bits.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _hashes(text: bytes, words: int) -> list[int]:
    own = text.lower().split()
    if not own:
        return []
    if len(own) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(own), 42)]
    line = b" ".join(own)
    first, last, at = [], [], 0
    for w in own:
        first.append(at)
        at += len(w)
        last.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(first, last[words - 1 :])]


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit word for each text: the bits set in over half of its hashes. ``hashes`` of all texts end to end."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # runs of at most 255 hashes, so that the 8-bit counters cannot overflow
    sizes = counts[full]
    runs = -(-sizes // 255)
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(full)), runs)
    cut = np.repeat(starts, runs) + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs))
    head = np.cumsum(runs) - runs
    data = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        packed = np.add.reduceat(_SPREAD[data[:, byte]], cut)
        ones = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), head, axis=0)
        bits = 2 * ones > sizes[:, None]
        out[full] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out


def _prints(hashes: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """The ``width`` words of the fingerprints; ``hashes`` of all texts end to end."""
    out = []
    for k in range(width):
        own = hashes
        if k:
            own = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_FURTHER[k])
            own = (own ^ (own >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            own ^= own >> np.uint64(32)
        out.append(_majority(own, counts))
    return out


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint``: the SimHash of every text as ``16 * width`` hex digits, ``width`` words of 64 bits.

    Shingles are XXH64 hashed with the seed 42; only A-Z are lower-cased.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found = [_hashes(x, words) for x in block.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            hashes = np.fromiter(itertools.chain.from_iterable(found), np.uint64, int(counts.sum()))
            texts = ["".join(f"{x:016x}" for x in row) for row in zip(*(x.tolist() for x in _prints(hashes, counts, width)))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(make, f"doc_id {kind}, fingerprint string")


def pigeonhole_masks(bits: int, distance: int, choose: int = 2) -> list[np.ndarray]:
    """Masks (arrays of bit numbers) of which any two fingerprints with at most ``distance`` differing bits share one."""
    parts = np.array_split(np.arange(bits), distance + choose)
    return [np.concatenate(x) for x in itertools.combinations(parts, choose)]


def sampled_masks(bits: int, size: int, tables: int, seed: int = 42) -> list[np.ndarray]:
    """``tables`` masks of ``size`` bits drawn evenly: every bit is used about equally often."""
    rng = np.random.default_rng(seed)
    dealt = np.concatenate([rng.permutation(bits) for _ in range(-(-size * tables // bits))])
    return [np.sort(dealt[i * size : (i + 1) * size]) for i in range(tables)]


def _forest(prints: list[bytes], distance: int) -> list[tuple[int, int]]:
    """Links (i, root) joining the fingerprints that are connected by at most ``distance`` differing bits."""
    n = len(prints)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if n <= 8:
        own = [int.from_bytes(x) for x in prints]
        for i in range(n):
            for j in range(i):
                if (own[i] ^ own[j]).bit_count() <= distance:
                    a, b = find(i), find(j)
                    if a != b:
                        root[max(a, b)] = min(a, b)
    else:
        words = np.frombuffer(b"".join(prints), np.uint64).reshape(n, -1)
        for i in range(1, n):
            apart = np.bitwise_count(words[:i] ^ words[i]).sum(1, dtype=np.int64)
            near = np.flatnonzero(apart <= distance)
            for r in {find(j) for j in near.tolist()}:
                a = find(i)
                root[max(a, r)] = min(a, r)
    return [(i, find(i)) for i in range(n) if find(i) != i]


def links(distinct: DataFrame, masks: list[np.ndarray], distance: int, width: int = 1, chunk: int = 1024) -> DataFrame:
    """``a, b``: links between fingerprints (column ``fingerprint``, distinct) that join all pairs found.

    The tables' keys are counted first, and only fingerprints that share one travel on.
    """
    tune(distinct.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed_prints = batch.column("raw").to_pylist()
            raw = np.frombuffer(b"".join(packed_prints), ">u8").astype("<u8").reshape(-1, width)
            bits = np.unpackbits(raw.view(np.uint8).reshape(len(raw), -1), axis=1, bitorder="little")
            for t, mask in enumerate(masks):
                packed = np.zeros((len(raw), 8), np.uint8)
                own = np.packbits(bits[:, mask], axis=1, bitorder="little")
                packed[:, : own.shape[1]] = own
                key = packed.view("<u8")[:, 0] | np.uint64(t << 48)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64), pa.int64()), batch.column("raw")], ["key", "raw"])

    # the number of the table above the bits of the entry
    if len(masks) > 1 << 15 or max(map(len, masks)) > 48:
        raise ValueError("at most 32768 tables of 48 bits")
    entries = distinct.select(F.unhex("fingerprint").alias("raw")).mapInArrow(keys, "key long, raw binary")
    return _entry_links(entries, distance, width, chunk)


def _entry_links(entries: DataFrame, distance: int, width: int, chunk: int) -> DataFrame:
    """``a, b``: links between the ``raw`` of entries with one ``key``; fingerprints are the first ``width`` words of ``raw``."""
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = entries.join(sizes, "key")
    pieces = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("raw"), F.col("pieces")).cast("int")
    split = shared.withColumn("pieces", pieces).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    task = ["key", "lo", "hi"]
    tasks = split.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "raw")
    dealt = tasks.repartition(max(2 * partitions(entries.sparkSession), 2), *task).sortWithinPartitions(*task, "raw")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for batch in batches:
            out: list[tuple[str, str]] = []
            columns = [batch.column(c).to_numpy() for c in task]
            change = np.ones(batch.num_rows, bool)
            if batch.num_rows:
                change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            cuts = np.flatnonzero(change).tolist()
            prints = batch.column("raw").to_pylist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                name = tuple(int(c[a]) for c in columns)
                if name != last:
                    out += close(held)
                    last, held = name, []
                held += prints[a:b]
            yield table(out)
        yield table(close(held))

    def close(prints: list[bytes]) -> list[tuple[str, str]]:
        return [(prints[i].hex(), prints[j].hex()) for i, j in _forest([x[: 8 * width] for x in prints], distance)] if len(prints) > 1 else []

    def table(found: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["a", "b"])

    return dealt.mapInArrow(compare, "a string, b string").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, width: int = 1, masks: list[np.ndarray] | None = None, text: str = "text", doc_id: str = "doc_id", chunk: int = 1024) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the smallest id among the documents that can be reached by links.

    Without ``masks`` the pigeonhole tables are used, which miss no pair.
    """
    prints = stored(fingerprints(docs, words, width, text, doc_id))
    firsts = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    found = links(firsts, masks or pigeonhole_masks(64 * width, distance), distance, width, chunk)
    roots = connected(found, "fingerprint")
    named = firsts.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.select("fingerprint", "root").join(lowest, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(_hashes(text, words), np.uint64))
