"""Registered queries: searches over stored indexes, their upkeep, and statistics kept up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import index, neighbours, retrieval
from mnemospark.operators.retrieval import compile_queries
from mnemospark.operators.stored_index import StoredIndex
from mnemospark.plans import search
from mnemospark.plans.queries_search import _FACT_FUSED, _WEIGHT, QUERY_TEXT, _asked, _vector_query
from mnemospark.plans.registry import SQL, query
from mnemospark.session import cut_lineage, scratch_folder


def _indexed(t, docs, fields=index.DOCUMENT_FIELDS) -> StoredIndex:
    found = StoredIndex(t.spark, f"{scratch_folder(t.spark)}/index", fields, buckets=16)
    found.apply(docs)
    return found


def _changed(t, docs, fields) -> StoredIndex:
    """An index that got every document in three batches: old texts and deleted ones first, then what replaces them.

    A third of the documents is stale at first, a third comes later, and the second
    batch holds copies under new ids that the third deletes again.
    """
    stored = StoredIndex(t.spark, f"{scratch_folder(t.spark)}/index", fields, buckets=16)
    turn = F.pmod(F.xxhash64("id"), F.lit(3))
    text = fields[-1]
    stale = docs.where(turn < 2).withColumn(text, F.when(turn == 0, F.concat(F.lit("outdated ing "), F.upper(text))).otherwise(F.col(text)))
    copies = docs.where(turn == 2).withColumn("id", -1 - F.col("id"))
    stored.apply(stale, tag=0, compact=False)
    stored.apply(docs.where(turn == 2).unionByName(copies), tag=1, compact=False)
    stored.apply(docs.where(turn == 0), copies, tag=2, compact=False)
    stored.apply(docs.where("false"), copies, tag=2)  # a batch that comes again changes nothing
    return stored


@query("i4_stored_documents", "SELECT id, score, rank FROM kw")
def _(t):
    """The best documents from a stored index: pruned buckets, and blocks only while they can still hold a result."""
    stored = _indexed(t, t.documents)
    return stored.search(compile_queries(_asked(t, QUERY_TEXT)), 20).select("id", "score", "rank")


@query("i4_stored_operators")
def _(t):
    """OR and exclusion over a stored index of facts."""
    stored = _indexed(t, t.entries, index.FACT_FIELDS)
    return stored.search(compile_queries(_asked(t, "tion OR leaux", "the -ing", "tion ing OR leaux")), 50)


SQL["i4_stored_operators"] = SQL["i4_bm25_operators"]


@query("i4_stored_words", f"""SELECT term AS word, id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, id) AS rank FROM (
        SELECT term, id, round({_WEIGHT}, 9) AS score FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM fact_postings
          WHERE term IN ('tion', 'ing', 'the', 'leaux', 'or')) p, fact_stats) s) r WHERE rank <= 10""")  # fmt: skip
def _(t):
    """Single words, frequent ones included: the first blocks settle the result."""
    words = ["tion", "ing", "the", "leaux", "or"]
    stored = _indexed(t, t.entries, index.FACT_FIELDS)
    found = stored.search(compile_queries(_asked(t, *words)), 10)
    names = F.array(*map(F.lit, words))
    return found.select(F.get(names, F.col("qid")).alias("word"), "id", "score", "rank")


@query(
    "i13_stored_facts",
    f"""WITH {_FACT_FUSED} SELECT f.id, f.rank, f.score, f.by_keyword, coalesce(e.status, '-') AS status, e.entity FROM ff f JOIN entries e ON e.id = f.id""",
)
def _(t):
    """Weighted fusion of a stored index of facts with nearest neighbours."""
    q = compile_queries(_asked(t, QUERY_TEXT))
    stored = _indexed(t, t.entries, index.FACT_FIELDS)
    vectors = t.vectors.select((F.col("id") * 4294967296).alias("id"), "embedding")
    legs = stored.search(q, 20), retrieval.knn(vectors, _vector_query(t), 20)
    rows = search.present_facts(retrieval.rrf_weighted(*legs, 20), t.entries, 20)
    return rows.select("id", "rank", "score", F.col("legs.keyword").alias("by_keyword"), F.coalesce("status", F.lit("-")).alias("status"), "entity")


@query("r15_index_log", "SELECT id, term, tf, doc_len FROM fact_postings")
def _(t):
    """Postings after changes, late rows, deletions and a repeated batch, read through the log of segments."""
    return _changed(t, t.entries, index.FACT_FIELDS).postings()


@query("r15_index_merged", "SELECT id, term, tf, doc_len FROM fact_postings")
def _(t):
    """The same after merging all segments."""
    stored = _changed(t, t.entries, index.FACT_FIELDS)
    stored.log.compact(full=True)
    return stored.postings()


@query("r15_search_log", "SELECT id, score, rank FROM kw")
def _(t):
    """A search over changed documents ranks as one over an index of the present texts."""
    stored = _changed(t, t.documents, index.DOCUMENT_FIELDS)
    return stored.search(compile_queries(_asked(t, QUERY_TEXT)), 20).select("id", "score", "rank")


@query("a11_term_stats_log", "SELECT term, count(*) AS doc_freq FROM fact_postings GROUP BY term")
def _(t):
    """Document frequencies kept up by differences, retractions of changed and deleted facts included."""
    return _changed(t, t.entries, index.FACT_FIELDS).term_stats()


@query("a11_index_stats_log", "SELECT n_docs, round(avg_len, 6) AS avg_len FROM fact_stats")
def _(t):
    """Number and mean length of the facts from the manifest of a changed index."""
    return _changed(t, t.entries, index.FACT_FIELDS).stats().select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("i7_ivf_recall", "SELECT count(*) AS n_queries, (count(*) * least(20, (SELECT count(*) FROM embeddings)))::BIGINT AS n_rows, true AS recall_ok FROM embeddings WHERE vec_id % 100 = 0")
def _(t):
    """Every id divisible by 100 asked of the inverted lists: always 20 rows, nine tenths of them the true ones."""
    model = neighbours.train(t.vectors)
    codes = cut_lineage(neighbours.by_list(neighbours.encode(t.vectors, model)))
    asked = t.vectors.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding")
    found = neighbours.search(codes, model, t.vectors, asked, 20)
    exact = retrieval.knn(t.vectors, asked, 20)
    counted = neighbours.recall(found, exact)
    rows = found.agg(F.count_distinct("qid").alias("n_queries"), F.count("*").alias("n_rows"))
    return rows.select("n_queries", "n_rows", (counted.select("recall").scalar() >= 0.9).alias("recall_ok"))
