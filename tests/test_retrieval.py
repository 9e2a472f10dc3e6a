import math
import random
from collections import Counter

import numpy as np
import pytest

from mnemospark.functions.text import stem_tokens
from mnemospark.functions.vectors import hashing_embedder
from mnemospark.operators import index, retrieval
from mnemospark.operators.retrieval import compile_queries
from mnemospark.plans import search

TEXTS = {
    1: "stakeholder resistance and how to manage resistance in change",
    2: "quarterly budget analysis of the third quarter budget",
    3: "vacation policy update the vacation days",
    4: "project status report the budget is on track",
    5: "status report status report",
}


@pytest.fixture
def corpus(make):
    return make("id long, title string, summary string, full_body string", [(i, f"t{i}", None, x) for i, x in TEXTS.items()])


def queries(make, *texts):
    return make("qid int, text string", list(enumerate(texts)))


def brute_bm25(texts, terms):
    bags = {i: Counter(x.split()) for i, x in texts.items()}
    lengths = {i: sum(b.values()) for i, b in bags.items()}
    mean = sum(lengths.values()) / len(lengths)
    scores = {}
    for i, bag in bags.items():
        if all(t in bag for t in terms):
            total = 0.0
            for t in terms:
                n = sum(t in b for b in bags.values())
                idf = max(1e-6, math.log((len(bags) - n + 0.5) / (n + 0.5)))
                total += idf * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
            scores[i] = round(total, 9)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def run(make, corpus, *texts, k=10, **kw):
    q = compile_queries(queries(make, *texts))
    c = search.adhoc_corpus(corpus, q, ("full_body",))
    rows = retrieval.bm25_search(c.postings, c.stats, q, k, **kw).orderBy("qid", "rank").collect()
    return {n: [(r["id"], r["score"]) for r in rows if r["qid"] == n] for n in range(len(texts))}


def test_bm25_matches_brute_force(make, corpus):
    got = run(make, corpus, "budget", "status report", "vacation resistance", "")
    assert got == {0: brute_bm25(TEXTS, ["budget"]), 1: brute_bm25(TEXTS, ["status", "report"]), 2: [], 3: []}


def test_bm25_operators(make, corpus):
    got = run(make, corpus, "vacation OR resistance", "report -budget", "-budget", "Budget! (ANALYSIS)")
    assert [{i for i, _ in got[n]} for n in range(4)] == [{1, 3}, {5}, set(), {2}]


def test_bm25_phrase(make, corpus):
    fields = index.build_field_postings(corpus, ("full_body",))
    got = run(make, corpus, '"the budget"', '"report status"', '-"the budget" budget', field_postings=fields)
    assert [{i for i, _ in got[n]} for n in range(3)] == [{4}, {5}, {2}]


def test_candidates_apply_before_topk(make, corpus):
    only = make("id long", [(4,)])
    assert [i for i, _ in run(make, corpus, "budget", k=1, candidates=only)[0]] == [4]


def test_stored_postings_equal_matched_ones(make, corpus, spark, tmp_path):
    index.write_postings(index.build_postings(corpus, ("full_body",)), str(tmp_path / "p"), buckets=4, salts=2)
    stored = spark.read.parquet(str(tmp_path / "p"))
    q = compile_queries(queries(make, "budget"))
    stats = index.corpus_stats(index.tokenized(corpus, ("full_body",)))
    rows = retrieval.bm25_search(stored, stats, q, 10).collect()
    assert sorted((r["id"], r["score"]) for r in rows) == sorted(brute_bm25(TEXTS, ["budget"]))


def test_stemmed_index(make, corpus):
    q = compile_queries(queries(make, "managing changes"), stem_tokens)
    c = search.adhoc_corpus(corpus, q, ("full_body",))
    assert [r["id"] for r in retrieval.bm25_search(c.postings, c.stats, q, 5).collect()] == [1]


def test_knn_exact_with_copies(make):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    base[20:40] = base[0]  # a third of all rows are copies
    vectors = make("id long, embedding array<float>", [(i, v.tolist()) for i, v in enumerate(base)]).repartition(5)
    asked = make("qid int, embedding array<float>", [(0, base[0].tolist()), (1, base[50].tolist())])
    rows = retrieval.knn(vectors, asked, 10).orderBy("qid", "rank").collect()
    for q, v in ((0, base[0]), (1, base[50])):
        d = np.round(np.sqrt(((base.astype(float) - v.astype(float)) ** 2).sum(1)), 9)
        want = sorted((x, i) for i, x in enumerate(d))[:10]
        assert [(r["dist"], r["id"]) for r in rows if r["qid"] == q] == want


def test_knn_blocks(make, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rows = [(i, [float(i), 0.0]) for i in range(10)]
    vectors = make("id long, embedding array<float>", rows)
    got = retrieval.knn(vectors, make("qid long, embedding array<float>", rows), 1).collect()
    assert {(r["qid"], r["id"]) for r in got} == {(i, i) for i in range(10)}


def test_knn_candidates_and_cosine(make):
    vectors = make("id long, embedding array<float>", [(1, [1.0, 0.0]), (2, [9.0, 1.0]), (3, [0.0, 1.0])])
    asked = make("qid int, embedding array<float>", [(0, [2.0, 0.0])])
    assert retrieval.knn(vectors, asked, 1, candidates=make("id long", [(3,)])).first()["id"] == 3
    assert [r["id"] for r in retrieval.knn(vectors, asked, 3, metric="cosine").orderBy("rank").collect()] == [1, 2, 3]


def test_lsh_finds_the_near_ones(make):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 16))
    vectors = make("id long, embedding array<float>", [(i, v.tolist()) for i, v in enumerate(base)])
    asked = make("qid int, embedding array<float>", [(0, (base[7] + 0.001).tolist())])
    assert retrieval.knn_lsh(vectors, asked, 3, radius=2.0).first()["id"] == 7


def test_fusion(make):
    leg = "qid int, id long, rank int"
    kw = make(leg, [(0, 1, 1), (0, 2, 2)])
    vec = make(leg, [(0, 2, 1), (0, 3, 2)])
    got = {r["id"]: r["score"] for r in retrieval.rrf(kw, vec, 3).collect()}
    assert got == {1: round(1 / 61 + 1 / 64, 9), 2: round(1 / 62 + 1 / 61, 9), 3: round(1 / 64 + 1 / 62, 9)}
    # With full keyword weight a vector-only row still shows, at the missing rank.
    got = {r["id"]: r["score"] for r in retrieval.rrf_weighted(kw, vec, 3, weight=1.0).collect()}
    assert got[3] == round(1 / 64, 9)


def test_snippet_window(make):
    body = "x " * 30 + "alpha beta " + "y " * 50 + "alpha"
    docs = make("id long, full_body string", [(1, body.strip()), (2, "alpha")])
    fused = make("qid int, id long, kw_rank int", [(0, 1, 1), (0, 2, None)])
    q = compile_queries(make("qid int, text string", [(0, "alpha beta")]))
    rows = {r["id"]: r["snippet"] for r in retrieval.snippets(fused, docs, q, 2, width=4).collect()}
    assert rows == {1: "...x x <mark>alpha</mark> <mark>beta</mark>...", 2: ""}


def end_to_end(make, corpus, text, **filters):
    encode = hashing_embedder(32)
    vectors = make("id long, embedding array<float>", [(i, encode([x])[0].tolist()) for i, x in TEXTS.items()])
    asked = queries(make, text)
    q = compile_queries(asked)
    docs = corpus.selectExpr("*", "concat('d/', id) vault_path", "cast(null as string) project", "cast(null as string) note_type",
                             "timestamp '2026-01-01' updated_at", "array('a') key_topics")
    vec = make("qid int, embedding array<float>", [(0, encode([text])[0].tolist())])
    c = search.adhoc_corpus(docs, q, ("full_body",), vectors)
    return search.search_documents(c, asked, vec, compiled=q, **filters).orderBy("rank").collect()


def test_search_documents(make, corpus):
    rows = end_to_end(make, corpus, "vacation policy")
    assert rows[0]["id"] == 3 and rows[0]["score"] == 1.0 and "<mark>vacation</mark>" in rows[0]["snippet"]
    assert len(rows) == 5  # the vector leg adds the others
    scores = [r["score"] for r in rows]
    assert scores == sorted(scores, reverse=True)
    assert end_to_end(make, corpus, "vacation", location="nowhere") == []


def test_blank_query_lists_newest(make, corpus):
    docs = corpus.selectExpr("*", "concat('d/', id) vault_path", "'p' project", "'n' note_type", "timestamp_seconds(id) updated_at", "array('a') key_topics")
    for texts, asked_rows in ((["  "], {0: [5, 4, 3]}), (["", "budget", "!!!"], {0: [5, 4, 3], 1: [2, 4]})):
        asked = queries(make, *texts)
        q = compile_queries(asked)
        rows = search.search_documents(search.adhoc_corpus(docs, q, ("full_body",)), asked, k=3, compiled=q).collect()
        got = {n: [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["qid"] == n] for n in {r["qid"] for r in rows}}
        assert got == asked_rows
    assert [r["id"] for r in search.list_documents(docs, 2).collect()] == [5, 4]


def test_pluggable_scorer(make, corpus):
    def shortest_first():
        return lambda pairs: [1.0 / (1 + len(snippet)) for _query, snippet in pairs]

    docs = corpus.selectExpr("*", "'p' vault_path", "'p' project", "'n' note_type", "current_timestamp() updated_at", "array('a') key_topics")
    fused = make("qid int, id long, score double, rank int, snippet string", [(0, 1, 0.1, 1, "long text"), (0, 2, 0.1, 2, "x"), (0, 77, 0.1, 3, "")])
    rows = retrieval.rerank(fused, docs, queries(make, "q"), 3, k=5, scorer=retrieval.model_scorer(shortest_first))
    assert [(r["id"], r["rank"]) for r in rows.orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_reindex_covers_both_indexes(make, corpus):
    from pyspark.sql import functions as F

    postings, vectors = index.reindex(corpus, F.col("full_body"), hashing_embedder)
    assert postings.select("id").distinct().count() == vectors.count() == 5
    assert {r["term"] for r in postings.filter("id = 3").collect()} >= {"vacat", "polici"}
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in vectors.collect())


def test_keyword_leg_alone(make, corpus):
    asked = queries(make, "budget")
    q = compile_queries(asked)
    docs = corpus.selectExpr("*", "'p' vault_path", "'p' project", "'n' note_type", "current_timestamp() updated_at", "array('a') key_topics")
    rows = search.search_documents(search.adhoc_corpus(docs, q, ("full_body",)), asked, compiled=q).collect()
    assert {r["id"] for r in rows} == {2, 4}


def test_stale_ranked_row_drops(make):
    docs = make("id long, vault_path string, summary string, title string, project string, note_type string, updated_at string, key_topics array<string>",
                [(1, "p", "s", "t", None, None, None, [])])
    ranked = make("qid int, id long, rank int", [(0, 1, 1), (0, 77, 2)])
    assert [r["id"] for r in retrieval.hydrate_cards(ranked, docs, 2).collect()] == [1]


def test_fact_search_keeps_retired(make):
    rows = [
        (1, "people", "Alice", "role", "Alice is the Engineering Manager responsible for the platform team.", "confident", 0.95, 0.9),
        (2, "process", "standup", "schedule", "Daily standup happens at 9:30 AM every weekday.", "confident", 0.85, 0.7),
        (3, "tools", "deploy", "pipeline", "Deployments go through GitHub Actions CI/CD pipeline.", "pending", 0.5, 0.5),
        (4, "people", "Bob", "role", "Bob is a retired fact that should never appear in search.", "retired", 0.3, 0.1),
    ]
    facts = make("id long, dimension string, entity string, tag string, fact string, status string, confidence double, trust_score double", rows)
    asked = queries(make, "bob retired")
    q = compile_queries(asked)
    found = search.search_facts(search.adhoc_corpus(facts, q, index.FACT_FIELDS), asked, compiled=q).collect()
    assert [(r["id"], r["status"]) for r in found] == [(4, "retired")]


def test_random_bm25(make):
    rnd = random.Random(5)
    texts = {i: " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 30))) for i in range(80)}
    docs = make("id long, title string, summary string, full_body string", [(i, "", "", x) for i, x in texts.items()])
    assert run(make, docs, "a b c", k=1000)[0] == brute_bm25(texts, ["a", "b", "c"])


def test_postings_need_no_shuffle(make):
    """Each document is counted in its own row; empty ones give no rows."""
    docs = make("id long, body string", [(1, "b a b"), (2, ""), (3, None), (4, "c")])
    plain, placed = index.build_postings(docs, ("body",)), index.build_field_postings(docs, ("body",))
    assert sorted((r["id"], r["term"], r["tf"], r["doc_len"]) for r in plain.collect()) == [(1, "a", 1, 3), (1, "b", 2, 3), (4, "c", 1, 1)]
    assert sorted((r["id"], r["term"], r["pos"], r["tf"]) for r in placed.collect()) == [(1, "a", [1], 1), (1, "b", [0, 2], 2), (4, "c", [0], 1)]
    for df in (plain, placed):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
