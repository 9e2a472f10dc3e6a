"""Token ids in ORC files: one row for each document, stripes that tasks read side by side.

``write_tokens`` deals the documents out by ranges of their ids, encodes each range where
it lands and writes it in order. ORC stores the integers run-length encoded, keeps minima
and maxima for every stripe and row group, and a Bloom filter on the document ids:
``read_documents`` finds a few documents by those, without reading the other stripes.

Defined cases: a null text is an empty one, so that it holds the end id alone; a text that spells
a token added to the vocabulary has that token's id, as the library gives it; rows with
a null id come first; rows with one id stay together in the order of their texts, repeated
rows too; very long texts are encoded whole; an empty table gives an empty folder that reads
as no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import blocks, partitions, segments, tune, worker_cache

#: Distinct words that a worker remembers; it starts anew beyond them.
REMEMBERED = 1_200_000
_JOINABLE = re.compile(r" ?\S+")
#: What the tokenizer's pattern takes for white space, and runs of text that none of its words crosses.
_GAP = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f" ?[^{_GAP}]+|[{_GAP}]+(?![^{_GAP}])|[{_GAP}]")


class _Remembered(dict):
    """Numbers strings as they are asked for; their ids lie end to end and are added by the block."""

    def __init__(self) -> None:
        self.fresh: list = []
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def __missing__(self, key) -> int:
        code = self[key] = len(self)
        self.fresh.append(key)
        return code

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the ``fresh`` strings."""
        base = len(self) - len(self.fresh)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[base : len(self)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[base : len(self)] = lengths
        self.used += len(ids)
        self.fresh = []

    def gather(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts of ``counts`` strings each, and how many ids each text has."""
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[codes] - (ends - lengths), lengths)
        before = np.concatenate([[0], ends])
        last = np.cumsum(counts)
        return self.ids[place], before[last] - before[last - counts]


class TextEncoder:
    """Encodes with the tokenizers library and remembers what it gave for each run of text.

    A byte-level tokenizer cuts a text into words by a fixed pattern and encodes each by
    itself. None of its words holds white space but a space at its begin, so runs without
    any can be encoded apart. New ones go to the library, many at a time with line ends
    between. A text that spells a token added to the vocabulary goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids
        self.words = _Remembered()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        given = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, given), np.int64, len(given))
        return np.fromiter(chain.from_iterable(given), np.uint32, int(lengths.sum())), lengths

    def _learn_words(self) -> None:
        """Words with a space or line end inside are encoded one by one, the others 50 at a time."""
        fresh = self.words.fresh
        plain = [w for w in fresh if _JOINABLE.fullmatch(w)] if len(self.line_end) == 1 else []
        ids, lengths = self._encode(["\n".join([*plain[i : i + 50], ""]) for i in range(0, len(plain), 50)])
        ends = np.flatnonzero(ids == self.line_end[0]) if plain else np.empty(0, np.int64)
        if len(ends) != len(plain):
            plain, ids, ends = [], ids[:0], ends[:0]
        known = set(plain)
        rest = [w for w in fresh if w not in known]
        more, more_lengths = self._encode(rest)
        ids = np.concatenate([np.delete(ids, ends), more])
        lengths = np.concatenate([np.diff(ends, prepend=-1) - 1, more_lengths])
        row = {w: i for i, w in enumerate(plain + rest)}
        order = np.fromiter((row[w] for w in fresh), np.int64, len(fresh))
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        run, place = segments(lengths)
        self.words.add(ids[starts[run] + place], lengths)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        if len(self.words) > REMEMBERED:
            self.words = _Remembered()
        whole = [i for i, x in enumerate(texts) if self.added(x)]
        found = [_CHUNK.findall(x) for x in texts]
        for i in whole:
            found[i] = []
        counts = np.fromiter(map(len, found), np.int64, len(found))
        codes = list(map(self.words.__getitem__, chain.from_iterable(found)))
        if self.words.fresh:
            self._learn_words()
        ids, counts = self.words.gather(np.array(codes, np.int64), counts)
        if whole:
            own, lengths = self._encode([texts[i] for i in whole])
            at = (np.cumsum(counts) - counts)[whole]
            ids = np.insert(ids, np.repeat(at, lengths), own)
            counts[whole] = lengths
        return ids, counts


def encoder(path: str) -> TextEncoder:
    known = worker_cache("text_encoders")
    if path not in known:
        known[path] = TextEncoder(path)
    return known[path]


SCHEMA = "doc_id long, n_tokens long, place long, ids array<int>, part int"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``place`` (ids before it in its partition) and ``ids`` of every row, in the order of the rows."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = encoder(tokenizer), 0
        for block in blocks(batches, "text", 1 << 20):
            ids, counts = own.encode([x or "" for x in block.column("text").to_pylist()])
            if end_id is not None:
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts, pa.int64()), pa.array(before + ends - counts, pa.int64()), lists], ["doc_id", "n_tokens", "place", "ids"])
            before += len(ids)

    return rows.mapInArrow(encode, "doc_id long, n_tokens long, place long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, text: str = "text", doc_id: str = "doc_id", parts: int | None = None, stripe_bytes: int = 16 << 20, compress: str = "zstd") -> None:
    """Write the documents' ids below ``path`` in ascending order of ``doc_id``.

    ``part`` numbers the ranges in that order; a file holds rows of one part.
    """
    spark = tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(parts or 2 * partitions(spark), F.col("doc_id").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    (
        encode_documents(ordered, tokenizer, end_id)
        .withColumn("part", F.spark_partition_id())
        .write.mode("overwrite")
        .option("compression", compress)
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", 1000)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: ``start`` counts the ids of all documents before.

    Only the totals of the parts are summed up in one task and sent to all, a row for
    each written partition; the ids are read where they are.
    """
    rows = tune(spark).read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """The rows of a few documents; stripes whose range or Bloom filter excludes them are not read."""
    rows = tune(spark).read.schema(SCHEMA).orc(path)
    return rows.where(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read_tokens`` gives: the crc32 of the ids as little-endian 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = np.ascontiguousarray(lists.values.to_numpy(), "<u4").view(np.uint8)
            ends = 4 * lists.offsets.to_numpy().astype(np.int64)
            found = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(found, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
