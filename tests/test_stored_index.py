"""Segment logs, stored keyword indexes and inverted lists against plain models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import index, neighbours, retrieval
from mnemospark.operators import stored_index
from mnemospark.operators.stored_index import StoredIndex, entries
from mnemospark.sources.segments import SegmentLog

DOC = "id long, title string, body string"
FIELDS = ("title", "body")


@pytest.fixture
def make_docs(make):
    return lambda rows: make(DOC, rows).coalesce(2)


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# -- segments


def test_log_follows_a_dict(make, spark, tmp_path):
    """Random changes and deletions, replayed batches and merges give what a dict holds."""
    rng = random.Random(2)
    log, model = SegmentLog(spark, str(tmp_path / "log")), {}
    for batch in range(7):
        new = {rng.randrange(12): f"v{batch}-{i}" for i in range(rng.randint(0, 5))}
        gone = [k for k in rng.sample(range(12), 2) if k not in new]
        rows = make("id long, v string", sorted(new.items()))
        touched = make("id long", [(k,) for k in [*new, *gone]])
        assert log.append(touched, batch, {"n": float(len(new))}, rows=rows)
        assert not log.append(touched, batch, rows=rows)
        model = {**{k: v for k, v in model.items() if k not in gone}, **new}
        if batch in (3, 5):
            log.compact()
        assert rows_of(log.read(), "id", "v") == sorted(model.items())
    before = log.measures()
    log.compact(full=True)
    assert len(log.segments()) == 1 and log.measures() == before and rows_of(log.read(), "id", "v") == sorted(model.items())


def test_readers_of_an_older_version_are_undisturbed(make, spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path / "log"))
    log.append(make("id long", [(1,)]), 0, rows=make("id long, v string", [(1, "a")]))
    before = log.read()
    log.append(make("id long", [(1,)]), 1, rows=make("id long, v string", [(1, "b")]))
    log.compact(full=True)
    assert rows_of(before, "id", "v") == [(1, "a")] and rows_of(log.read(), "id", "v") == [(1, "b")]


def test_a_batch_writes_what_it_holds(make, spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path / "log"))
    many = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    log.append(many, 0, rows=many)
    few = many.where("id < 20").withColumn("v", F.lit("x"))
    log.append(few, 1, rows=few)

    def size(seq):
        return sum(p.stat().st_size for p in (tmp_path / "log" / "rows" / f"seq={seq}").rglob("*.parquet"))

    first, second = (s.seq for s in log.segments())
    assert size(second) < size(first) / 50
    assert not log.compact()  # a small segment beside a large one stays
    assert log.read().where("v = 'x'").count() == 20 and log.read().count() == 20_000


# -- stored index


def corpus_rows(rng, n):
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    return [(i, f"t{i % 7}", " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(n)]


QUERIES = ["w0", "w1 w5", "w3 OR w30", "w0 w2 -w1", "w39", "absent", "w0 w1 w2 OR t3", "t3 w0"]


def expected(docs, asked, k, candidates=None):
    postings = index.build_postings(docs, FIELDS)
    stats = index.corpus_stats(index.tokenized(docs, FIELDS))
    return rows_of(retrieval.bm25_search(postings, stats, asked, k, candidates), "qid", "rank", "id", "score")


def test_search_equals_a_scan(make, make_docs, spark, tmp_path):
    """Small blocks, so that most are skipped; a limit below and above the number of results."""
    docs = make_docs(corpus_rows(random.Random(5), 400))
    stored = StoredIndex(spark, str(tmp_path / "ix"), FIELDS, block=8, buckets=4)
    stored.apply(docs)
    asked = retrieval.compile_queries(make("qid int, text string", list(enumerate(QUERIES))))
    assert rows_of(stored.search(asked, 3), "qid", "rank", "id", "score") == expected(docs, asked, 3)
    few = docs.where("id % 5 = 0").select("id")
    assert rows_of(stored.search(asked, 500, few), "qid", "rank", "id", "score") == expected(docs, asked, 500, few)


def test_single_words_read_few_blocks_of_pruned_buckets(make, make_docs, spark, tmp_path):
    docs = make_docs(corpus_rows(random.Random(5), 400))
    stored = StoredIndex(spark, str(tmp_path / "ix"), FIELDS, block=8, buckets=4)
    stored.apply(docs)
    asked = retrieval.compile_queries(make("qid int, text string", [(0, "w0")]))
    chosen, _ = stored.plan(asked, 2)
    every = stored.log.stored("blocks").where("term = 'w0'")
    assert 0 < chosen.count() <= every.count() / 3
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # nothing that was left out weighs as much as the last result
    kept, least = {r["id"] for r in entries(chosen).collect()}, min(r["score"] for r in stored.search(asked, 2).collect())
    rest = [x for x in expected(docs, asked, 500) if x[2] not in kept]
    assert all(x[3] <= least for x in rest)


def test_changes_equal_a_rebuild(make, make_docs, spark, tmp_path):
    """New texts, deletions, a return and a replay: postings, statistics and searches are those of the present texts."""
    rng = random.Random(9)
    stored = StoredIndex(spark, str(tmp_path / "ix"), FIELDS, block=8, buckets=4)
    present = {}
    for tag in range(4):
        new = {d: (d, f"t{tag}", body) for d, _, body in corpus_rows(rng, 60) if rng.random() < 0.5}
        gone = [d for d in rng.sample(range(60), 6) if d not in new]
        deleted = make("id long", [(d,) for d in gone])
        assert stored.apply(make_docs(list(new.values())), deleted, tag, compact=tag == 2)
        assert not stored.apply(make_docs(list(new.values())), deleted, tag)
        present = {**{d: x for d, x in present.items() if d not in gone}, **new}
    docs = make_docs(list(present.values()))
    postings = index.build_postings(docs, FIELDS)
    assert rows_of(stored.postings(), "id", "term", "tf", "doc_len") == rows_of(postings, "id", "term", "tf", "doc_len")
    assert rows_of(stored.term_stats(), "term", "doc_freq") == rows_of(index.term_stats(postings), "term", "doc_freq")
    n, avg = index.corpus_stats(index.tokenized(docs, FIELDS)).first()
    assert stored.stats().first()["n_docs"] == n and abs(stored.stats().first()["avg_len"] - avg) < 1e-9
    asked = retrieval.compile_queries(make("qid int, text string", list(enumerate(QUERIES))))
    assert rows_of(stored.search(asked, 5), "qid", "rank", "id", "score") == expected(docs, asked, 5)


# -- inverted lists


def test_lists_find_clustered_neighbours(make, spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 4
    data = centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16))
    vectors = make("id long, embedding array<float>", [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(9999, None)])
    model = neighbours.train(vectors, lists=20)
    codes = neighbours.encode(vectors, model)
    assert codes.count() == 1500
    asked = vectors.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding")
    found = neighbours.search(codes, model, vectors, asked, 10, share=0.2)
    got = neighbours.recall(found, retrieval.knn(vectors, asked, 10)).first()
    assert got["n_queries"] == 15 and got["n_rows"] == 150 and got["recall"] >= 0.9
    # as many rows as asked for, even from lists that hold fewer
    assert neighbours.search(codes, model, vectors, asked.limit(1), 1400, share=0.01, rescored=1).count() == 1400
    assert neighbours.search(codes, model, vectors, asked.limit(1), 2000).count() == 1500


def test_a_list_lies_together(make, spark):
    """Rows dealt at random meet every list in every batch; laid by list, a list is in one batch or at an edge of two."""
    rng = np.random.default_rng(4)
    vectors = make("id long, embedding array<float>", [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)))]).repartition(6)
    model = neighbours.train(vectors, lists=24)
    codes = neighbours.encode(vectors, model)
    laid = neighbours.by_list(codes)
    assert rows_of(laid, "list", "id", "code") == rows_of(codes, "list", "id", "code")
    met = laid.select("list", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(met) <= 24 + max(r["p"] for r in met)
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    assert rows_of(neighbours.search(laid, model, vectors, asked, 5), "qid", "id", "rank") == rows_of(neighbours.search(codes, model, vectors, asked, 5), "qid", "id", "rank")


def test_no_vectors(make):
    vectors = make("id long, embedding array<float>", [])
    model = neighbours.train(vectors)
    assert neighbours.search(neighbours.encode(vectors, model), model, vectors, vectors.withColumnRenamed("id", "qid"), 3).count() == 0


def test_a_replayed_batch_is_not_read(make_docs, spark, tmp_path):
    stored = StoredIndex(spark, str(tmp_path / "ix"), FIELDS, block=8, buckets=4)
    docs = make_docs([(1, "a", "b b"), (2, "a", "")])
    assert stored.apply(docs)
    assert not stored.apply(docs.withColumn("body", F.raise_error(F.lit("read")).cast("string")))
    assert rows_of(stored.postings(), "id", "term", "tf", "doc_len") == [(1, "a", 1, 3), (1, "b", 2, 3), (2, "a", 1, 1)]


def test_postings_travel_a_row_a_term(make, make_docs, spark, tmp_path):
    """What is exchanged has a row for each term of a task's texts, not for each posting; a merge gives the blocks of the texts that live."""
    docs = make_docs(corpus_rows(random.Random(3), 300)).coalesce(1)
    words = index.tokenized(docs, FIELDS)
    pieces = stored_index._pieces(words.select("id", "doc_len", F.array_join(F.concat(*FIELDS), " ").alias("words")))
    want = rows_of(index.build_postings(docs, FIELDS), "id", "term", "tf", "doc_len")
    assert pieces.count() == len({x[1] for x in want}) < len(want) / 20
    stored = StoredIndex(spark, str(tmp_path / "ix"), FIELDS, block=8, buckets=4)
    stored.apply(docs.withColumn("body", F.when(F.col("id") % 2 == 0, "old w1 w1").otherwise(F.col("body"))))
    stored.apply(docs.where("id % 2 = 0"), make("id long", [(999,)]), tag=1, compact=False)
    for _ in range(2):
        assert rows_of(stored._live(stored.log.stored("blocks")), "id", "term", "tf", "doc_len") == want
        stored.log.compact(full=True)


ODD = [
    "", "   ", None, "-", "Plain ascii, twice: ascii_ASCII 42", "\x00a\tb\x7fc\r\nd", "ends with space ", " É à la crème — naïve ", "ΟΔΟΣ ΣΑΣ", "Straße №5 ½ x²",
    "a\u0301b e\u0301", "日本語 テスト１２", "\U0001d400\U0001f600\U00020000 z", "İstanbul ŒUVRE", "\u00a0nbsp\u2003em",
]


def test_texts_are_cut_as_tokens_are(make_docs):
    """Cutting bytes gives what the pattern gives, at the seams of fields and of texts too."""
    docs = make_docs([(i * len(ODD) + j, x, y) for i, x in enumerate(ODD) for j, y in enumerate(ODD)])
    want = index.tokenized(docs, FIELDS).select("id", "doc_len", F.array_join(F.concat(*FIELDS), " ").alias("words"))
    assert rows_of(stored_index._texts(docs, FIELDS), "id", "doc_len", "words") == rows_of(want, "id", "doc_len", "words")


def test_postings_keep_any_id():
    rng = np.random.default_rng(4)
    ids = np.concatenate([[0, -1, 2**63 - 1, -(2**63), 1 << 32, (1 << 31) - 1, 1 << 31], rng.integers(-(2**63), 2**63 - 1, 500), rng.integers(0, 99, 300) << 32])
    lens, tfs = rng.integers(1, 1 << 40, len(ids)), rng.integers(1, 300, len(ids))
    lens[600:] = 60
    first = np.array([0, 1, 7, 9, 600])
    blobs = stored_index._to_bytes(first, ids, lens, tfs)
    got = stored_index._from_bytes(np.diff(np.append(first, len(ids))), blobs)
    assert all((x == y).all() for x, y in zip(got, (ids, lens, tfs)))
    part = stored_index._from_bytes(np.array([2, 591]), blobs.slice(2, 2))
    assert (part[0] == ids[7:600]).all()
    assert len(blobs[4].as_py()) < 7 * (len(ids) - 600)  # ids of two halves take few bytes


@pytest.fixture
def small_batches(spark):
    """Sets how many rows a batch that goes to Python has at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    yield lambda rows: spark.conf.set(name, rows)
    spark.conf.set(name, before)


def test_long_terms_are_packed_in_runs(spark, make_docs, monkeypatch, small_batches):
    """Terms of many more postings than are put in order at a time: every posting once, blocks numbered through."""
    monkeypatch.setattr(stored_index, "RUN", 20)
    monkeypatch.setattr(stored_index, "CHUNK", 400)
    small_batches("10")
    docs = make_docs(corpus_rows(random.Random(8), 300)).coalesce(1)
    pieces = stored_index._pieces(stored_index._texts(docs, FIELDS))
    blocks = stored_index._packed(pieces, 1, 8, salts=1).withColumn("seq", F.lit(1).cast("long")).cache()
    want = rows_of(index.build_postings(docs, FIELDS), "id", "term", "tf", "doc_len")
    assert pieces.count() > len({x[1] for x in want})
    assert rows_of(entries(blocks), "id", "term", "tf", "doc_len") == want
    seen = {}
    for r in blocks.collect():
        assert 0 < r["n"] <= 8
        seen.setdefault(r["term"], []).append(r["block"])
    assert max(map(len, seen.values())) > 20 and all(sorted(x) == list(range(len(x))) for x in seen.values())
    for r in entries(blocks.select("seq", F.concat_ws("/", "term", "block", "max_tf", "min_len").alias("term"), "n", "data")).collect():
        _, _, max_tf, min_len = r["term"].split("/")
        assert r["tf"] <= int(max_tf) and r["doc_len"] >= int(min_len)


def test_a_merged_index_reads_its_postings(make, make_docs, spark, tmp_path):
    """After a merge the postings come from the blocks; no text is read and counted again."""
    docs = make_docs(corpus_rows(random.Random(6), 100))
    stored = StoredIndex(spark, str(tmp_path / "ix"), FIELDS, block=8, buckets=4)
    stored.apply(docs.withColumn("body", F.upper("title")), tag=0, compact=False)
    stored.apply(docs.where("id < 90"), make("id long", [(i,) for i in range(95, 100)]), tag=1, compact=False)
    stored.log.compact(full=True)
    found = stored.postings()
    assert all("/blocks/" in x for x in found.inputFiles())
    left = docs.where("id < 95").withColumn("body", F.when(F.col("id") < 90, F.col("body")).otherwise(F.upper("title")))
    assert rows_of(found, "id", "term", "tf", "doc_len") == rows_of(index.build_postings(left, FIELDS), "id", "term", "tf", "doc_len")


def test_deleted_ids_are_read_once(make, make_docs, spark, tmp_path):
    """What is to be deleted may be costly to find; a batch looks once."""
    stored = StoredIndex(spark, str(tmp_path / "ix"), FIELDS, block=8, buckets=4)
    stored.apply(make_docs(corpus_rows(random.Random(6), 20)))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    gone = make("id long", [(i,) for i in range(5)]).mapInArrow(seen, "id long")
    stored.apply(make_docs([(50, "a", "b")]), gone, tag=1, compact=False)
    assert read.value == 5
    assert stored.stats().first()["n_docs"] == 16
