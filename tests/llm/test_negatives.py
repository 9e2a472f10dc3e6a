"""Hard negatives against brute force with Python integers."""

import math
import random

import numpy as np
import pytest

from mnemospark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score long, anchor int"


def brute(rows, every=100, positives=5, count=10, low=30, high=90):
    able = {}
    for v, e, lab in rows:
        if v is None or lab is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        able[(v, lab, tuple(math.floor(256 * float(np.float32(x))) for x in e))] = None
    out = []
    for v, lab, q in able:
        if v % every:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(q, p)), w, other == lab) for w, other, p in able if w != v or other != lab})
        near = [(-s, w) for s, w, same in scored if same and w != v][:positives]
        for s, w in near:
            inside = [(-t, x) for t, x, same in scored if not same and low * s <= 100 * -t <= high * s][:count]
            out += [(v, w, i + 1, x, s, t) for i, (t, x) in enumerate(inside)]
    return sorted(out)


def result(spark, rows, schema=SCHEMA, parts=4, **how):
    extra = [(v, e, lab, "x", 1, 2) for v, e, lab in rows]
    table = spark.createDataFrame(extra, schema).repartition(parts)
    return sorted(tuple(r) for r in negatives.hard_negatives(table, **how).collect())


def clustered(rng, n, dims=8, labels=4):
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(labels)]
    return [(i, [rng.choice((c, 0.5)) + rng.uniform(-0.5, 0.5) for c in centres[i % labels]], i % labels) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 3])
def test_matches_brute_force(spark, block):
    rows = clustered(random.Random(4), 900)
    got = result(spark, rows, block=block)
    assert len(got) > 100 and got == brute(rows)


def test_ties_go_to_the_smaller_id(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice((0.0, 0.5, 1.0)) for _ in range(3)], i % 3) for i in range(400)]
    assert result(spark, rows) == brute(rows)


def test_a_label_with_most_rows(spark):
    rows = [(v, e, 0 if v % 10 else lab) for v, e, lab in clustered(random.Random(9), 600)]
    assert result(spark, rows) == brute(rows)


def test_edges(spark):
    rows = clustered(random.Random(2), 250)
    rows += [(None, [1.0] * 8, 1), (1000, None, 1), (1100, [1.0] * 8, None), (1200, [], 0), (1300, [None] * 8, 0), (1400, [math.nan] * 8, 0)]
    rows += [(1500, [math.inf] * 8, 1), (1600, [-math.inf] + [0.0] * 7, 1), rows[100], rows[7], (1700, [0.0] * 8, 2), (1800, [0.5] * 3, 3), (1900, [1.0] * 8, 77)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    assert result(spark, [(100, [1.0], 3)]) == []
    # beyond what 64-bit scores hold, a row takes no part
    assert result(spark, rows + [(2000, [1e30] * 8, 0), (2001, [-3e38] + [0.0] * 7, 1)]) == brute(rows)


@pytest.mark.parametrize("dims, largest", [(64, 160), (3, 10**8), (2000, 127), (1, 1), (5000, 30_000)])
def test_scores_are_exact(dims, largest):
    rng = np.random.default_rng(dims)
    a, b = (rng.integers(-largest, largest + 1, (n, dims)) for n in (7, 5))
    a[0], b[0] = largest, -largest
    primes = negatives.primes_for(dims, largest)
    assert math.prod(primes) > 2 * dims * largest**2
    assert all(min(dims, 1024) * (p // 2) ** 2 < 1 << 24 for p in primes)
    got = negatives.scores(negatives.residues(a, primes), negatives.residues(b, primes), primes)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert got.tolist() == want
