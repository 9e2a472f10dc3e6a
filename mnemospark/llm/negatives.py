"""Hard negatives by exact integer scores from float32 matrix products.

Scores are integer inner products. They are computed in a residue number system: the vectors'
components are reduced modulo a few primes, small enough that a float32 product of the
residues is exact, the residue matrices are multiplied, and the signed scores put together
again by Chinese remaindering. The primes follow from the number of components and the
largest one, which one grouped pass finds.

The anchors are a stated query set; they are sent in blocks of fixed size against all rows.
Two passes are made for each block. The first keeps the best rows of an anchor's own
label, in every task and then over all. The second gets the score window of each of those
positives, and keeps the best rows of other labels inside it. Only these short lists are
shuffled.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component,
take no part; nor do rows with a component so large that scores need not fit 64 bits (beyond
``largest_component``); a vector with fewer components counts as having zeros after them, an empty
one scores 0 with all; ties go to the smaller id; rows that repeat id, label and score towards
an anchor count once; an anchor without another row of its label has no positives, a positive
with an empty window no negatives (as for negative scores), and both no rows; an empty table
gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import stored, tune

#: Anchors that travel at once, and those multiplied at once.
BLOCK, TILE = 4096, 512
#: Components multiplied at once: the residues' products must stay below 2 ** 24.
_SPAN = 1024


def largest_component(dims: int, scale: int = 100) -> int:
    """The largest component for which ``scale`` times any score of ``dims`` components fits 62 bits."""
    return math.isqrt((1 << 62) // (scale * max(dims, 1)))


def primes_for(dims: int, largest: int) -> list[int]:
    """Primes whose centred residues multiply exactly in float32, and whose product exceeds twice any score."""
    bound = 2 * max(dims, 1) * max(largest, 1) ** 2 + 1
    top = 2 * math.isqrt(((1 << 24) - 1) // min(max(dims, 1), _SPAN))
    out, product, p = [], 1, min(top, 4093)
    while product <= bound:
        if p < 3:
            raise ValueError("no primes left")
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            out.append(p)
            product *= p
        p -= 1
    return out


def residues(values: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Centred residues of an integer matrix, one float32 matrix for each prime."""
    out = []
    for p in primes:
        r = values % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(rows: list[np.ndarray], anchors: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact signed inner products (int64) of two sets of residue matrices."""
    # mixed radix digits: x = d0 + p0 (d1 + p1 (d2 + ...)), each digit from the residue modulo its prime
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        a, b = rows[i], anchors[i]
        r = np.zeros((len(a), len(b)), np.int64)
        for c in range(0, a.shape[1], _SPAN):
            r += (a[:, c : c + _SPAN] @ b[:, c : c + _SPAN].T).astype(np.int64)
        for d, q in zip(digits, primes):
            r = (r - d) * pow(q, -1, p)
            r %= p
        r %= p
        # centred digits give the signed value at once
        digits.append(np.where(r > p // 2, r - p, r))
    out = digits[-1]
    for d, p in zip(digits[-2::-1], primes[-2::-1]):
        out = out * p + d
    return out


def quantised(vectors: DataFrame, vec_id: str, label, embedding: str, factor: float) -> tuple[DataFrame, int, int]:
    """``id, label, vector`` of the rows that take part (components times ``factor``, floored), their length and largest component."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(factor) * x).cast("double")))
    rows = rows.withColumn("largest", F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0)))
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = rows.where(F.col("largest") <= float(largest_component(dims)))
    largest = rows.agg(F.max("largest")).first()[0] or 0
    return rows.select("id", "label", "vector"), dims, int(largest)


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(lengths), dims), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return out


@dataclass
class _Best:
    """For each of a number of lists its best (score, id), at most ``k``, by falling score and rising id."""

    k: int

    def __post_init__(self) -> None:
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, name: int, score: np.ndarray, ids: np.ndarray) -> None:
        if name in self.held:
            score, ids = np.append(self.held[name][0], score), np.append(self.held[name][1], ids)
        order = np.lexsort((ids, -score))
        score, ids = score[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        self.held[name] = (score[new][: self.k], ids[new][: self.k])

    def batch(self, name: str) -> pa.RecordBatch:
        names = [np.full(len(x[1]), i) for i, x in self.held.items()]
        columns = [np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (names, [x[1] for x in self.held.values()], [x[0] for x in self.held.values()])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [name, "id", "score"])


def _first(found: DataFrame, group: str, k: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), "id")
    return found.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _positives(rows: DataFrame, ship, k: int, dims: int, primes: list[int]) -> DataFrame:
    """``anchor, id, score, place``: of each anchor (by its number) the best other rows of its label."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix = ship.value
        own = residues(matrix, primes)
        kept = _Best(k)
        for batch in batches:
            their_ids, their_labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            theirs = residues(_matrix(batch.column("vector"), dims), primes)
            for a in range(0, len(ids), TILE):
                found = scores(theirs, [x[a : a + TILE] for x in own], primes)
                for j in range(found.shape[1]):
                    same = np.flatnonzero((their_labels == labels[a + j]) & (their_ids != ids[a + j]))
                    if len(same) > k:
                        value = found[same, j]
                        same = same[value >= np.partition(value, len(same) - k)[len(same) - k]]
                    if len(same):
                        kept.add(a + j, found[same, j], their_ids[same])
        yield kept.batch("anchor")

    return _first(rows.mapInArrow(best, "anchor long, id long, score long"), "anchor", k)


def _negatives(rows: DataFrame, ship, windows, k: int, dims: int, primes: list[int]) -> DataFrame:
    """``pair, id, score, place``: for each pair (by its number) the best rows of other labels in its window of scores."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, matrix = ship.value
        anchor, low, high = windows.value
        own = residues(matrix, primes)
        pairs = np.split(np.argsort(anchor, kind="stable"), np.cumsum(np.bincount(anchor, minlength=len(ids)))[:-1])
        kept = _Best(k)
        for batch in batches:
            their_ids, their_labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            theirs = residues(_matrix(batch.column("vector"), dims), primes)
            for a in range(0, len(ids), TILE):
                found = scores(theirs, [x[a : a + TILE] for x in own], primes)
                for j in range(found.shape[1]):
                    if not len(pairs[a + j]):
                        continue
                    other = np.flatnonzero(their_labels != labels[a + j])
                    value = found[other, j]
                    order = np.argsort(-value, kind="stable")
                    falling = -value[order]
                    for p in pairs[a + j].tolist():
                        x, y = np.searchsorted(falling, -high[p], "left"), np.searchsorted(falling, -low[p], "right")
                        if x < y:
                            # all that tie with the k-th may be among the first
                            z = min(y, x + k)
                            z = min(y, np.searchsorted(falling, falling[z - 1], "right"))
                            pick = order[x:z]
                            kept.add(p, value[pick], their_ids[other[pick]])
        yield kept.batch("pair")

    return _first(rows.mapInArrow(best, "pair long, id long, score long"), "pair", k)


def hard_negatives(
    vectors: DataFrame, anchors: str = "id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    factor: float = 256.0, vec_id: str = "vec_id", label=None, embedding: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each row that ``anchors`` (a condition on ``id``) names and each of its first ``positives`` rows of
    the same label, the first ``negatives`` rows of other labels whose score is between ``low`` and ``high`` per
    cent of the positive's. More than ``block`` anchors take further passes over the rows.
    """
    spark = tune(vectors.sparkSession).sparkContext
    rows, dims, largest = quantised(vectors, vec_id, F.col("label") if label is None else label, embedding, factor)
    primes = primes_for(dims, largest)
    asked = rows.where(anchors).distinct()
    blocks = max(1, -(-2 * asked.count() // block)) if asked.limit(block + 1).count() > block else 1
    out = None
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        ids, labels = held.column("id").to_numpy(), held.column("label").to_numpy()
        ship = spark.broadcast((ids, labels, _matrix(held.column("vector").combine_chunks(), dims) if len(ids) else np.zeros((0, dims), np.int64)))
        # at most ``block`` times ``positives`` rows
        near = _positives(rows, ship, positives, dims, primes).toArrow()
        anchor, other, score = (near.column(c).to_numpy() for c in ("anchor", "id", "score"))
        windows = spark.broadcast((anchor, -(-low * score // 100), high * score // 100))
        names = vectors.sparkSession.createDataFrame(pa.table({"pair": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": other, "positive_score": score}))
        found = _negatives(rows, ship, windows, negatives, dims, primes).join(F.broadcast(names), "pair")
        found = found.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        if blocks > 1:
            found = stored(found)
        out = found if out is None else out.union(found)
    return out
