"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled row, task by task in numpy, and adds the
counts up in one grouped sum. The model is a matrix of ``2 ** bits`` rows and a column for
each language: its size does not depend on the corpus, so it travels in the closure of
the scoring function. Scoring adds the matrix rows of a text's n-grams.

Defined cases: a text that is null or has no letter (number signs are none) gets ``und`` and the
score 0; a tie goes to the language that sorts first; with no labelled rows every text is
``und``; rows with a null label do not train; repeated rows count as often as they occur; very
long texts are read whole; an empty table gives no rows; columns not kept are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import blocks, tune

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _has_letter(text: str) -> bool:
    """Whether any character is a letter; the pattern alone also takes number signs such as a half."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # (buckets, languages): log-probability of an n-gram
    priors: np.ndarray
    orders: tuple[int, ...]


def _grams(texts: list[str | None], orders: tuple[int, ...], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashed n-grams of the lower-cased texts end to end, and where each text's begin.

    Runs of characters that are no letters count as one space, and enough spaces stand
    between two texts that no n-gram has letters of both.
    """
    gap = "\x00" * max(orders)
    joined = "".join(f"{gap if not x else gap + x.lower().replace(chr(0), ' ')}" for x in texts) + gap
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(gap) + (len(x.lower()) if x else 0) for x in texts], np.int64)
    starts = np.append(0, np.cumsum(lengths))[: len(texts)]
    letter = (points >= 0xAA) | ((points | 0x20) - np.uint32(0x61) < 26)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= points == 0
    points = np.where(letter, points, np.uint32(0x20))[keep]
    at = np.append(0, np.cumsum(keep, dtype=np.int64))[starts]
    mixed = points * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    out = []
    for n in orders:
        size = len(points) - n + 1
        value = mixed[:size] * np.uint32(0x85EBCA6B)
        for k in range(1, n):
            value += mixed[k : k + size]
            value *= np.uint32(0xC2B2AE35 + 2 * k)
        value += np.uint32(n)
        value ^= value >> np.uint32(16)
        value *= np.uint32(0x27D4EB2F)
        out.append(((value >> np.uint32(32 - bits)).astype(np.int32), at))
    return out


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = (2, 3), bits: int = 15, smoothing: float = 0.5) -> LanguageModel:
    """Count the n-grams of every row with a language. Only sums over the rows reach the driver: at most ``2 ** bits`` for each language."""
    tune(labelled.sparkSession)
    buckets = 1 << bits
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for block in blocks(batches, "text"):
            langs = np.array(block.column("lang").to_pylist(), object)
            names = sorted(set(langs))
            code = {x: i for i, x in enumerate(names)}
            codes = np.array([code[x] for x in langs], np.int32)
            counts = np.zeros(len(names) * buckets, np.int64)
            for grams, starts in _grams(block.column("text").to_pylist(), orders, bits):
                sizes = np.diff(np.append(starts, len(grams)))
                counts += np.bincount(np.repeat(codes * buckets, sizes) + grams, minlength=len(counts))
            counts = counts.reshape(-1, buckets)
            documents = np.bincount(codes, minlength=len(names))
            for i, x in enumerate(names):
                total[x] = total.get(x, 0) + np.append(counts[i], documents[i])
        for x, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    languages = tuple(sorted(set(table.column("lang").to_pylist())))
    code = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((buckets + 1, len(languages)))
    counts[table.column("bucket").to_numpy(), [code[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    seen = counts[:-1] + smoothing
    weights = np.log(seen / seen.sum(0)) if languages else seen
    priors = np.log(counts[-1] / counts[-1].sum()) if languages else counts[-1]
    return LanguageModel(languages, np.asfortranarray(weights, np.float32), priors, orders)


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score``, the posterior probability of that language.

    The posterior treats the n-grams of one text as if a text held at most 200 of them,
    since overlapping n-grams are not independent and would drive it to 1.
    """
    tune(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"
    ship = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.priors, model.orders))  # plain types: workers need not import this package

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*ship.value)
        for block in blocks(batches, "__text"):
            texts = block.column("__text").to_pylist()
            n = len(texts)
            total, size = np.zeros((n, len(m.languages))), np.zeros(n)
            for grams, starts in _grams(texts, m.orders, len(m.weights).bit_length() - 1):
                size += np.diff(np.append(starts, len(grams)))
                for j in range(len(m.languages)):
                    total[:, j] += np.add.reduceat(m.weights[:, j][grams], starts, dtype=np.float64)
            names, scores = [UNKNOWN] * n, np.zeros(n)
            if m.languages:
                best = (total + m.priors).argmax(1)
                tempered = total * (np.minimum(size, 200) / np.maximum(size, 1))[:, None] + m.priors
                tempered -= tempered.max(1, keepdims=True)
                share = np.exp(tempered)
                share /= share.sum(1, keepdims=True)
                for i, x in enumerate(texts):
                    if x and _has_letter(x):
                        names[i], scores[i] = m.languages[best[i]], share[i, best[i]]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: those whose crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
