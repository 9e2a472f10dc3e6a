"""Toxicity: cumulative-link ordinal regression over hashed words.

The model has one weight for each hashed word and one threshold below each grade above
the lowest: P(grade >= k) = sigmoid(w . x - b_k), with b_1 <= b_2 <= ... and the weights
shared by all thresholds. A text's score is its expected severity, the sum of those
probabilities. Features are the distinct words of the whole text (letters only, lower
case), so that a long clean text is not worse than a short one.

The fit uses at most ``max_rows`` labelled rows (the smallest hashes of their ids, so
that it does not depend on the order), scaled-down gradient steps in numpy on the driver.
The feature matrix of those rows is sparse; the corpus is only scored.

Defined cases: a text without letters scores as if it had no feature; rows with a null
grade, and those without a document, do not train; without labels every score is 0;
equal texts score alike, and repeated rows each have a row; of a probability that equals the
limit the text is flagged; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import blocks, stored, tune, worker_cache

#: A word also counts by its beginnings of these lengths, for languages that build words from parts.
PREFIXES = (4, 6, 8)
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class SeverityModel:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1


def _features(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed distinct words of the texts end to end, and how many each text has."""
    known = worker_cache(f"words_{buckets}")
    if len(known) > 1_000_000:
        known.clear()
    found, counts = [], []
    for x in texts:
        own = set(_WORDS.findall(x.lower())) if x else ()
        codes = set()
        for w in own:
            own_codes = known.get(w)
            if own_codes is None:
                parts = [w, *(f"{w[:k]}-" for k in PREFIXES if k < len(w))]
                own_codes = known[w] = tuple(xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) % buckets for p in parts)
            codes.update(own_codes)
        found.extend(sorted(codes))
        counts.append(len(codes))
    return np.array(found, np.int64), np.array(counts, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _train(features: np.ndarray, counts: np.ndarray, grades: np.ndarray, buckets: int, steps: int, rate: float, lasso: float) -> SeverityModel:
    """Full-batch steps scaled as in Adam, shrunk towards 0 after each: most words mean nothing. Thresholds stay in order."""
    top = int(grades.max())
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    present = np.bincount(features, minlength=buckets)
    w = np.zeros(buckets)
    at_least = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    b = np.maximum.accumulate(-np.log(at_least / (1 - at_least)))
    moment, square = np.zeros(buckets + top), np.zeros(buckets + top)
    n, index = len(grades), np.arange(len(grades))
    for step in range(1, steps + 1):
        z = np.bincount(row, w[features], n)
        reach = np.column_stack([np.ones(n), _sigmoid(z[:, None] - b), np.zeros(n)])
        slope = reach * (1 - reach)
        p = np.maximum(reach[index, grades] - reach[index, grades + 1], 1e-9)
        low, high = slope[index, grades] / p, slope[index, grades + 1] / p
        toward = low - high  # of the log-likelihood, by z
        gw = np.bincount(features, toward[row], buckets) / n
        gb = np.array([high[grades == k - 1].sum() - low[grades == k].sum() for k in range(1, top + 1)]) / n
        g = np.append(gw, gb)
        moment += 0.1 * (g - moment)
        square += 0.01 * (g * g - square)
        pace = rate * (1 + np.cos(np.pi * step / steps)) / 2 / (np.sqrt(square / (1 - 0.99**step)) + 1e-4)
        move = pace * moment / (1 - 0.9**step)
        w += move[:buckets] * (present > 0)
        w = np.sign(w) * np.maximum(np.abs(w) - lasso * pace[:buckets], 0)
        b = np.maximum.accumulate(b + move[buckets:])
    return SeverityModel(w.astype(np.float32), b)


def severity_grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 clean, 1 toxic in a text of good quality, 2 toxic in one of poor quality; the worst of several labels."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    return labels.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.max("grade").alias("grade"))


def fit_severity(docs: DataFrame, grades: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = 1 << 18, max_rows: int = 4_000, min_texts: int = 4, steps: int = 300, rate: float = 0.1, lasso: float = 1e-3) -> SeverityModel:
    """Fit on the documents of at most ``max_rows`` ids with a grade (0, 1, 2, ...), those with the smallest hashes.

    ``grades`` has a row for each id. The chosen ids are few by that bound, so they are
    sent to the documents and no text is shuffled but theirs. Of several texts with one id
    the first in their order is taken. Buckets that fewer than ``min_texts`` of the
    texts have keep the weight 0.
    """
    tune(docs.sparkSession)
    given = grades.where(F.col("grade").isNotNull()).select(F.col("doc_id").alias("id"), F.col("grade").cast("int").alias("grade"), F.xxhash64("doc_id").alias("place"))
    chosen = stored(given.orderBy("place", "id").limit(max_rows))
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = found.groupBy("id", "place", "grade").agg(F.min("text").alias("text")).select("text", "grade", "place")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            codes, counts = _features(block.column("text").to_pylist(), buckets)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(codes.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column("place"), block.column("grade"), lists], ["place", "grade", "codes"])

    table = rows.mapInArrow(featurise, "place long, grade int, codes array<int>").toArrow().sort_by([("place", "ascending"), ("grade", "ascending")]).combine_chunks()
    if not table.num_rows:
        return SeverityModel(np.zeros(buckets, np.float32), np.array([]))
    lists = table.column("codes").combine_chunks()
    codes, counts = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    often = np.bincount(codes, minlength=buckets) >= min_texts
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    kept = often[codes]
    return _train(codes[kept], np.bincount(row[kept], minlength=len(counts)), table.column("grade").to_numpy().astype(np.int64), buckets, steps, rate, lasso)


def score_severity(docs: DataFrame, model: SeverityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), flag_at: float = 0.3) -> DataFrame:
    """The ``keep`` columns with ``severity`` (expected grade), ``grade`` (the likeliest), ``p_toxic`` (of any grade above 0) and ``toxic`` (``p_toxic`` reaches ``flag_at``)."""
    spark = tune(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", severity double, grade int, p_toxic double, toxic boolean"
    ship = spark.sparkContext.broadcast((model.weights, model.thresholds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = SeverityModel(*ship.value)
        for block in blocks(batches, "__text"):
            codes, counts = _features(block.column("__text").to_pylist(), len(m.weights))
            n = len(counts)
            z = np.bincount(np.repeat(np.arange(n), counts), m.weights[codes], n)
            reach = np.column_stack([np.ones(n), _sigmoid(z[:, None] - m.thresholds), np.zeros(n)])
            severity = reach[:, 1:-1].sum(1)
            grade = (reach[:, :-1] - reach[:, 1:]).argmax(1)
            toxic = reach[:, 1] if m.grades > 1 else np.zeros(n)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array(toxic, pa.float64()), pa.array(toxic >= flag_at)], [*keep, "severity", "grade", "p_toxic", "toxic"])

    return rows.mapInArrow(score, schema)
