"""Importance resampling towards a target distribution of hashed word n-grams.

Each block of texts is counted as one string: the texts are joined with separators that no word can
hold, one regular expression pass finds all words, and a binary search over the documents'
offsets tells which document a word is in, so that n-grams across two documents are masked
out. The checksums of n-grams are not computed from their bytes but from those of their
words: a CRC of a joined string is that of its first part, moved over as many bytes as the
second part has, XOR that of the second, which tables do for all n-grams at once.

Counts of the raw and the target texts are grouped sums over all rows: as many numbers as
buckets. The gains go to all tasks, a second pass adds them up, and the highest scores
(weights plus Gumbel noise of the id's hash) are drawn without replacement: rows are numbered
by ranges of the score, so that no task sees them all.

Defined cases: a null text or one without words has no features and the weight 0; texts with
fewer words than an n-gram have the shorter ones only; a null id is hashed as the empty string
and comes first among ties; ties of score and id go to the smaller weight, and equal
rows are equal; repeated rows count and are drawn by themselves; very long texts and
words are taken whole; empty targets or tables give counts of zero; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import blocks, stored, tune
from mnemospark.operators.folds import number_rows

#: Words of lower-cased UTF-8 bytes: ASCII letters and digits, and all that is not ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Between two texts; no word holds it.
SENTINEL = b"\n"
_POLYNOMIAL = 0xEDB88320
_SHORT = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


_BYTE = _byte_table()


def _moved_tables(steps: int) -> np.ndarray:
    """For each of the four bytes of a CRC what it becomes ``steps`` zero bytes later."""
    out = np.empty((4, 256), np.uint32)
    for k in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(steps):
            value = _BYTE[value & 255] ^ (value >> np.uint32(8))
        out[k] = value
    return out


class Checksums:
    """CRC-32 of joined strings from those of their parts."""

    def __init__(self) -> None:
        self.short = np.stack([_moved_tables(n) for n in range(_SHORT)])
        self.powers: list[np.ndarray] = [self.short[1]]

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]

    def _power(self, k: int) -> np.ndarray:
        """The tables for ``2 ** k`` bytes."""
        while len(self.powers) <= k:
            last = self.powers[-1]
            self.powers.append(np.stack([self._apply(last, last[i]) for i in range(4)]))
        return self.powers[k]

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The CRC of each ``first`` string followed by its ``second``, which has ``length`` bytes."""
        short = self.short.reshape(_SHORT, -1)
        base = np.minimum(length, _SHORT - 1)
        flat, at = short.ravel(), base * 1024
        out = flat[at + (first & 255)] ^ flat[at + 256 + (first >> 8 & 255)] ^ flat[at + 512 + (first >> 16 & 255)] ^ flat[at + 768 + (first >> 24)]
        long = np.flatnonzero(length >= _SHORT)
        if len(long):
            left, value = length[long], first[long]
            for k in range(int(left.max()).bit_length()):
                on = np.flatnonzero(left >> k & 1)
                value[on] = self._apply(self._power(k), value[on])
            out[long] = value
        return out ^ second

    @staticmethod
    def spaced(crc: np.ndarray) -> np.ndarray:
        """The CRC of each string with a space after it."""
        raw = crc ^ np.uint32(0xFFFFFFFF)
        return _BYTE[(raw ^ np.uint32(0x20)) & 255] ^ (raw >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)


def features(texts: list[bytes], sums: Checksums, orders: int = 3, buckets: int = 10_000) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The n-grams of a block of texts: for each order the buckets and the documents of all, and the words of each text."""
    lowered = [x.lower() for x in texts]
    joined = SENTINEL.join(lowered)
    offsets = np.cumsum(np.array([0, *(len(x) + len(SENTINEL) for x in lowered)], np.int64))
    found = list(_WORD.finditer(joined))
    starts = np.fromiter(map(re.Match.start, found), np.int64, len(found))
    words = list(map(re.Match.group, found))
    del found
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    document = np.searchsorted(offsets, starts, "right") - 1
    n_words = np.bincount(document, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    out = [((crc % np.uint32(buckets)).astype(np.int64), document)]
    gram = crc
    for n in range(2, orders + 1):
        if len(words) < n:
            break
        gram = sums.joined(sums.spaced(gram[:-1]), crc[n - 1 :], lengths[n - 1 :])
        inside = document[n - 1 :] == document[: 1 - n]
        out.append(((gram[inside] % np.uint32(buckets)).astype(np.int64), document[n - 1 :][inside]))
    return out, n_words


def bucket_counts(texts: DataFrame, text: str = "text", orders: int = 3, buckets: int = 10_000) -> np.ndarray:
    """How many n-grams of all texts are in each bucket. The driver gets one number for each."""
    tune(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = Checksums(), np.zeros(buckets, np.int64)
        for block in blocks(batches, "text", 1 << 20):
            for own, _ in features(block.column("text").cast(pa.binary()).fill_null(b"").to_pylist(), sums, orders, buckets)[0]:
                total += np.bincount(own, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    found = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, with one added to every count."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, orders: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of the gains of every n-gram of a text."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ship = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, gain = Checksums(), ship.value
        for block in blocks(batches, "text", 1 << 20):
            grams, n_words = features(block.column("text").cast(pa.binary()).fill_null(b"").to_pylist(), sums, orders, len(gain))
            n, weight = np.zeros(block.num_rows, np.int64), np.zeros(block.num_rows, np.int64)
            for own, document in grams:
                n += np.bincount(document, minlength=len(n))
                # sums of integers far below 2 ** 53: exact in doubles
                weight += np.rint(np.bincount(document, gain[own], len(n))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def resample(weighed: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: the ``percent`` of the long enough rows with the highest perturbed weights are ranked."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("long_enough", F.col("n_words") >= min_words)
    order = [F.col("long_enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight"), F.col("n_features")]
    numbered = number_rows(scored, order, "place")
    drawn = numbered.agg(F.floor(F.lit(percent) * F.count_if("long_enough") / 100)).scalar()
    rank = F.when(F.col("long_enough") & (F.col("place") <= drawn), F.col("place"))
    return numbered.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def importance_resampling(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, orders: int = 3, buckets: int = 10_000, text: str = "text", target_text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with its weight, score and, if drawn, its rank."""
    gain = gains(bucket_counts(docs, text, orders, buckets), bucket_counts(target, target_text, orders, buckets))
    # stored: dealing out ranges of the score reads the rows twice
    return resample(stored(weigh(docs, gain, orders, text, doc_id)), percent, min_words)
