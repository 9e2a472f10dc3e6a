"""Min-max hashing near-duplicates and the confirmation of candidates against brute force."""

import random
import re

import numpy as np
import pytest

from mnemospark.llm import minhash, verify
from mnemospark.llm.components import connected, joined
from pyspark.sql import functions as F


def set_of(text, k=4):
    own = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()


def brute(rows, k=4, percent=80):
    sets = [set_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = d if not sets[i] else names.get(find(i))
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def result(docs, **how):
    return sorted((tuple(r) for r in minhash.near_duplicates(docs, **how).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_matches_brute_force(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    assert result(corpus) == brute(rows)


def test_edges_match_brute_force(edges, nothing):
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    assert result(edges) == brute(rows)
    assert result(nothing) == []


def edited(rng, words, share):
    return [f"c{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("chunk", [512, 3])
def test_lone_pairs_and_large_groups_match_brute_force(spark, chunk):
    """Pairs about the limit, chains, and a group whose copies are all close to the middle and few to one another."""
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        own = [f"w{rng.randrange(10**5)}" for _ in range(rng.randint(5, 120))]
        texts += [own, edited(rng, own, rng.uniform(0, 0.06))]
    chain = [f"k{i}" for i in range(80)]
    for i in range(25):
        texts.append(list(chain))
        chain[3 * i] = f"n{i}"
    middle = [f"m{i}" for i in range(150)]
    texts += [edited(rng, middle, rng.uniform(0.01, 0.05)) for _ in range(60)] + [middle] * 3
    rows = [(7 * i % 1009, " ".join(x)) for i, x in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(docs, chunk=chunk) == brute(rows)


def test_texts_longer_than_a_block(spark):
    rng = random.Random(5)
    own = [f"w{rng.randrange(10**7)}" for _ in range(600_000)]
    rows = [(3, " ".join(own)), (2, " ".join(own[:590_000])), (1, " ".join(own[:300_000])), (0, "short")]
    assert len(rows[0][1]) > 4 << 20
    got = {d: c for d, _, c, _ in result(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))}
    assert got == {3: 2, 2: 2, 1: 1, 0: 0}


def test_signature_is_unbiased():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (400, 50, 50))
        sets = [np.unique(np.concatenate([both, x])) for x in (a, b)]
        sig = minhash.signatures(np.concatenate(sets), np.array([len(x) for x in sets]), 120)
        errors.append(minhash.estimate(sig[0], sig[1]) - 400 / 500)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_band_keys_meet_only_in_their_band():
    sig = np.tile(np.arange(12, dtype=np.uint32) % 6, (2, 1))
    keys = minhash.band_keys(sig, 2)
    assert keys[0, 0] == keys[1, 0] and keys[0, 0] != keys[0, 1]


@pytest.mark.parametrize("common", [5, 60])
def test_overlaps(common):
    """Shingles of few sets and of many are counted alike."""
    rng = np.random.default_rng(common)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(10**12)) for _ in range(common)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert verify.overlaps(sets).tolist() == want


def test_every_pair_of_a_bucket_is_settled(spark):
    """One bucket with all nodes: links that no hub has are found among the rest."""
    rng = random.Random(8)
    bases = [[f"b{k}w{i}" for i in range(100)] for k in range(6)]
    rows = [(i, " ".join(edited(rng, bases[i % 6], 0.03))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("body", F.xxhash64("doc_id", "text"))
    nodes = docs.select(F.col("doc_id").alias("id"), "doc_id", "body", F.lit(97).cast("long").alias("n"))
    entries = nodes.select(F.lit(1).cast("long").alias("key"), "id").union(nodes.select(F.lit(2).cast("long").alias("key"), "id"))
    roots = {r["id"]: r["root"] for r in verify.true_components(nodes, entries, docs, 4, 80, chunk=7).collect()}
    want = {d: c for d, _, c, _ in brute(rows)}
    assert {d: roots.get(d, d) for d in want} == want


def test_more_links_join_components(spark):
    rng = random.Random(8)
    old = {(rng.randrange(400), rng.randrange(400)) for _ in range(120)}
    new = {(rng.randrange(500), rng.randrange(500)) for _ in range(90)}
    table = lambda links: spark.createDataFrame(sorted(links), "a long, b long")
    roots = connected(table(old), "id")
    whole = sorted(tuple(r) for r in connected(table(old | new), "id").collect())
    assert sorted(tuple(r) for r in joined(roots, table(new), "id").collect()) == whole
    assert sorted(tuple(r) for r in joined(roots, table(new).limit(0), "id").collect()) == sorted(tuple(r) for r in roots.collect())


def test_a_small_graph_is_not_dealt_over_all_partitions(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(held, ("64", "false")):
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("small-graph", "small graph")
    try:
        found = connected(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"), "id").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("small-graph") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)
    assert sorted(tuple(r) for r in found) == [(i, 0) for i in range(61)]
    assert tasks < 400  # thousands before
