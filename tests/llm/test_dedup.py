"""SimHash, substring de-duplication and sketches against brute force."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from mnemospark.llm import similar, simhash, sketch, substrings
from mnemospark.llm.components import connected
from pyspark.sql import functions as F


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text, k):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[i : i + k]), 42) for i in range(max(1, len(own) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance):
    """doc_id -> smallest doc_id that can be reached."""
    root = {d: d for d, _ in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, a) in enumerate(prints):
        for e, b in prints[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d: find(d) for d, _ in prints}


def test_simhash_matches_brute_force(corpus):
    rows = corpus.select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(corpus).collect()}
    prints = [(r["doc_id"], fingerprint(r["text"], 3)) for r in rows]
    want = classes(prints, 3)
    assert got == {d: (f"{p:016x}", want[d]) for d, p in prints}


def test_simhash_finds_every_pair_within_the_distance(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)})
    table = spark.createDataFrame([(f"{p:016x}",) for p in prints], "fingerprint string")
    for chunk in (1024, 5):  # small chunks: every bucket is split
        found = connected(simhash.links(table, simhash.pigeonhole_masks(64, 3), 3, chunk=chunk), "fingerprint").collect()
        roots = {r["fingerprint"]: r["root"] for r in found}
        want = classes([(f"{p:016x}", p) for p in prints], 3)
        groups = {}
        for d, c in want.items():
            groups.setdefault(c, set()).add(roots.get(d, d))
        assert all(len(x) == 1 for x in groups.values()) and len({min(x) for x in groups.values()}) == len(groups)


def test_simhash_wide_fingerprints_start_with_the_narrow_one(corpus):
    narrow = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprints(corpus, words=3).collect()}
    wide = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprints(corpus, words=3, width=4).collect()}
    assert all(wide[d].startswith(p) and len(wide[d]) == 64 for d, p in narrow.items())


def shingles(text):
    own = (text or "").encode().lower().split()
    return {b" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def lone_pairs(rng, n):
    """Pairs of texts with some words replaced, their similarities spread over 0.7 to 0.9."""
    out = []
    while len(out) < n:
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 600))]
        copy = list(own)
        for i in rng.sample(range(len(own)), max(1, round(len(own) * rng.uniform(0.01, 0.035)))):
            copy[i] = f"c{rng.randrange(10**6)}"
        a, b = " ".join(own), " ".join(copy)
        if 0.7 <= jaccard(shingles(a), shingles(b)) <= 0.9:
            out.append((a, b))
    return out


def test_pipeline_near_duplicates_match_true_similarity(spark):
    """Lone pairs, which no larger group links: those at 0.8 or more lose a document, others none."""
    pairs = lone_pairs(random.Random(7), 400)
    rows = [(2 * i + k, x, "en", "a", len(x)) for i, pair in enumerate(pairs) for k, x in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    close = {2 * i + 1 for i, (a, b) in enumerate(pairs) if jaccard(shingles(a), shingles(b)) >= 0.8}
    assert 100 < len(close) < 300
    gone = {r[0] for r in rows} - kept
    assert gone <= close
    assert len(gone) >= 0.99 * len(close)


def test_similar_documents_match_brute_force(spark, corpus, edges):
    """Chains of copies, equal fingerprints of unlike sets, the corpus and odd texts."""
    rng = random.Random(3)
    rows = []
    for d in range(12):
        own = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(8):
            rows.append((len(rows), " ".join(own)))
            own[rng.randrange(150)] = "x"
            own[rng.randrange(150)] = "y"
    rows += [(len(rows) + i, "a b c d e " * 200 + " ".join(f"{z}{k}" for k in range(90))) for i, z in enumerate("pqr")]
    chains = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for table in (chains, corpus.select("doc_id", "text"), edges.where("doc_id is not null")):
        texts = [(r["doc_id"], shingles(r["text"])) for r in table.collect()]
        root = {d: d for d, _ in texts}

        def find(d):
            while root[d] != d:
                d = root[d]
            return d

        for i, (d, a) in enumerate(texts):
            for e, b in texts[:i]:
                if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and jaccard(a, b) >= 0.8:
                    x, y = sorted((find(d), find(e)))
                    root[y] = x
        got = {r["doc_id"]: r["first_id"] for r in similar.similar_documents(table.withColumn("body", F.xxhash64("text"))).collect()}
        assert got == {d: find(d) for d in root}


def test_pipeline_near_duplicates_with_clashing_ids(spark):
    """Rows that share an id are told apart by their texts: of near copies one stays, whatever their ids."""
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(1, a), (2, a + " tail"), (2, b), (3, b), (3, b), (None, a), (None, "c d")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert kept == sorted([(None, a), (2, b), (None, "c d")], key=str)


def test_simhash_edges(edges, nothing):
    rows = simhash.near_duplicates(edges).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == edges.count()
    assert by_id[2]["fingerprint"] == by_id[3]["fingerprint"] == by_id[4]["fingerprint"] == "0" * 16
    assert by_id[4]["component_id"] == 2 and by_id[7]["component_id"] == 1 and by_id[12]["component_id"] == 12
    assert simhash.near_duplicates(nothing).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(60)] + [("a", "b"), ("c", "c")], "a string, b string")
    assert {r["node"]: r["root"] for r in connected(links, "node").collect()} == {**{f"{i:04d}": "0000" for i in range(61)}, "a": "a", "b": "a"}


def removed(rows, n):
    """(doc_id, n_words, kept words) with repeats of n-word windows removed."""
    own = [(d, words_of(t)) for d, t in rows]
    first = {}
    for d, w in own:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in own:
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < (d, i) for j in range(i, i + n)}
        out.append((d, len(w), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("n", [3, 5, 20])
def test_substrings_match_brute_force(spark, n):
    rng = random.Random(n)
    passages = [[rng.choice("a b c d e f".split()) for _ in range(rng.randint(2, 60))] for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randint(0, 40)}" for _ in range(rng.randint(0, 30))] for _ in range(4)]
        rows.append((d, rng.choice([" ", "  ", "\n"]).join(w for p in parts for w in p)))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_words"], r["kept_text"]) for r in substrings.remove_repeats(table, window=n, buckets=7).collect())
    assert got == sorted(removed(rows, n))


def test_substrings_settle_hash_collisions():
    """Windows that share a hash and not their words are told apart by their words."""
    strings = [b"a b c d", b"a b c d", b"a b c e"]
    ids, starts, sizes = np.array([1, 2, 3]), np.array([0, 0, 0], np.int32), np.array([2, 2, 2], np.int32)
    runs = substrings._copies(ids, starts, sizes, strings, 3)
    assert sorted(zip(*(x.tolist() for x in runs))) == [(2, 0, 2), (3, 0, 1)]


def test_substrings_edges(edges, nothing):
    rows = substrings.remove_repeats(edges, keep=("lang", "key", "_key"), respace=False).collect()
    assert len(rows) == edges.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["kept_text"] is None and by_id[2]["n_words"] == 0 and by_id[3]["kept_text"] == "" and by_id[4]["kept_text"] == " \t\n "
    # the row without an id comes first, so that the others lose their copies
    assert by_id[1]["n_removed"] == 33 and by_id[1]["kept_text"] == "" and by_id[8]["kept_text"] == "end"
    assert by_id[12]["n_removed"] == 0 and by_id[1]["_key"] == "x" and by_id[9]["lang"] is None
    assert substrings.remove_repeats(nothing).collect() == []


def brute_sketch(text, fraction=1 / 8):
    own = words_of(text)
    shingles = {" ".join(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    digests = {hashlib.md5(s.encode()).hexdigest() for s in shingles}
    low = [h for h in digests if int(h, 16) < fraction * 2**128] or sorted(digests)[:1]
    return sorted({h[:16] for h in low})


def test_sketch_matches_brute_force_and_merges(corpus, edges):
    rows = corpus.select("text", sketch.sketch(F.col("text")).alias("s")).collect() + edges.select("text", sketch.sketch(F.col("text")).alias("s")).collect()
    assert all(r["s"] == brute_sketch(r["text"]) for r in rows)
    a, b = rows[0]["s"], rows[1]["s"]
    merged = corpus.limit(1).select(sketch.merge(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias("m")).first()["m"]
    bound = f"{2**61:016x}"
    assert merged == ([h for h in sorted({*a, *b}) if h < bound] or [min(a + b)])


def test_sketch_estimates_containment(spark):
    rng = random.Random(1)
    long = [f"w{rng.randint(0, 10**6)}" for _ in range(8000)]
    rows = [(" ".join(long), " ".join(long[:2000])), (" ".join(long), " ".join(f"v{i}" for i in range(2000)))]
    got = spark.createDataFrame(rows, "a string, b string").select(sketch.likeness(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("x")).collect()
    assert got[0]["x"] == 1.0 and got[1]["x"] < 0.02


def test_short_texts_inside_long_ones(spark):
    """A passage without a hash below the bound is compared by all its shingles."""
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        long = [f"w{rng.randint(0, 10**6)}" for _ in range(2000)]
        at = rng.randrange(1900)
        rows.append((" ".join(long), " ".join(long[at : at + 8]), " ".join(f"v{i}" for i in range(6)), ""))
    table = spark.createDataFrame(rows, "a string, b string, c string, d string")
    names = [F.col(c) for c in "abcd"]
    s = [sketch.sketch(c) for c in names]
    got = table.select(*[sketch.text_likeness(s[0], s[i], names[0], names[i]).alias(f"x{i}") for i in (1, 2, 3)]).collect()
    assert all(r["x1"] == 1.0 and r["x2"] == 0.0 and r["x3"] == 0.0 for r in got)


def test_next_rows(spark, edges, nothing):
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 500)
    table = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["next_text"] for r in sketch.with_next(table, ["text"]).collect()}
    ordered = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(ordered, ordered[1:] + ordered[:1])}
    rows = sketch.with_next(edges, ["text", "key"]).collect()
    assert len(rows) == edges.count() and {r["doc_id"]: r["next_text"] for r in rows}[8] == "Zwei drei vier"
    assert sketch.with_next(nothing, ["text"]).collect() == []
    one = spark.createDataFrame([(5, "only")], "doc_id long, text string")
    assert sketch.with_next(one, ["text"]).first()["next_text"] == "only"




def test_hashing_words_takes_memory_by_slices():
    import tracemalloc

    import numpy as np

    texts = [b" ".join(b"%d" % (i * 7919 + j) for j in range(4000)) for i in range(130)]
    whole = substrings._Words([b"x" * 700_000 + b" seven words stand after this one here", *texts])
    assert np.array_equal(whole.hashes[1:8], substrings._Words([b"seven words stand after this one here"]).hashes)
    tracemalloc.start()
    found = substrings._Words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = len(found.line)
    assert np.array_equal(found.hashes, np.concatenate([substrings._Words([x]).hashes for x in texts]))
    assert peak < 30 * size  # about 45 before
