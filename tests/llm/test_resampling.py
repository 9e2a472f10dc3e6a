"""Importance resampling against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from mnemospark.llm import resampling


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def grams_of(text):
    own = words_of(text)
    return [b" ".join(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)]


def brute(rows, target, percent, min_words):
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(zlib.crc32(g) % 10_000 for g in grams_of(text))
    for text in target:
        t.update(zlib.crc32(g) % 10_000 for g in grams_of(text))
    all_s, all_t = s.total(), t.total()

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))

    out = []
    for d, text in rows:
        own = grams_of(text)
        weight = sum(gain(zlib.crc32(g) % 10_000) for g in own)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for i, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def result(docs, target, **how):
    rows = resampling.importance_resampling(docs, target, **how).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in rows), key=str)


@pytest.mark.parametrize("percent, min_words", [(5, 20), (100, 0), (37, 3)])
def test_matches_brute_force(spark, data, corpus, percent, min_words):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    want = brute(rows, [r["text"] for r in benchmark.collect()], percent, min_words)
    assert result(corpus.repartition(6), benchmark, percent=percent, min_words=min_words) == want


def test_edges_match_brute_force(spark, edges, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    target = spark.createDataFrame([(None, "x"), ("the quick brown fox", "y"), ("", "z")], "text string, doc_id string")
    assert result(edges, target, percent=50, min_words=1) == brute(rows, [None, "the quick brown fox", ""], 50, 1)
    assert result(edges, nothing) == brute(rows, [], 5, 20)
    assert result(nothing, target) == []


def test_texts_longer_than_a_block(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(n))) for i, n in enumerate((400_000, 3, 0, 20, 400_000))]
    assert max(len(t) for _, t in rows) > 1 << 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert result(docs, docs.limit(1), percent=50) == brute(rows, [rows[0][1]], 50, 20)


def test_words_do_not_join_across_documents():
    """The last word of a text and the first of the next make no n-gram, whatever stands between."""
    sums = resampling.Checksums()
    texts = [b"a b", b"", b"c", b"!", b"d e f"]
    grams, n_words = resampling.features(texts, sums, 3, 1 << 31)
    got = sorted((d, int(b)) for own, docs in grams for b, d in zip(own.tolist(), docs.tolist()))
    want = sorted((d, zlib.crc32(g) % (1 << 31)) for d, x in enumerate(texts) for g in grams_of(x.decode()))
    assert got == want and n_words.tolist() == [2, 0, 1, 0, 3]


def test_checksums_of_joined_strings():
    rng = random.Random(1)
    sums = resampling.Checksums()
    pairs = [(rng.randbytes(rng.randrange(9)), rng.randbytes(rng.choice((0, 1, 5, 63, 64, 65, 1000, 70_000)))) for _ in range(300)]
    first, second = (np.array([zlib.crc32(x[i]) for x in pairs], np.uint32) for i in (0, 1))
    got = sums.joined(first, second, np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
    assert sums.spaced(first).tolist() == [zlib.crc32(a + b" ") for a, _ in pairs]
