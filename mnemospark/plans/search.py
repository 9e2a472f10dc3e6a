"""Composed searches: hybrid documents, facts, both, and the assembled responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import context, index, retrieval
from mnemospark.operators.filters import filter_documents, first_occurrence, listing, top_per_group
from mnemospark.operators.retrieval import QuerySet
from mnemospark.schemas import DEFAULTS
from mnemospark.session import pin


@dataclass
class Corpus:
    """A searchable table: texts, postings, corpus statistics and optional vectors."""

    rows: DataFrame
    postings: DataFrame
    stats: DataFrame
    vectors: DataFrame | None = None
    field_postings: DataFrame | None = None


def adhoc_corpus(rows: DataFrame, queries: QuerySet, fields, vectors: DataFrame | None = None) -> Corpus:
    """Corpus over unindexed texts that keeps only the postings of the asked terms."""
    stem = queries.stemmer is not None
    postings, stats = index.match_postings(rows, queries.terms, queries.words, fields, stem)
    return Corpus(rows, postings, stats, vectors)


def _legs(corpus: Corpus, queries: QuerySet, query_vectors: DataFrame | None, k: int, candidates=None):
    keyword = retrieval.bm25_search(corpus.postings, corpus.stats, queries, k, candidates, corpus.field_postings)
    if corpus.vectors is None or query_vectors is None:
        vector = keyword.limit(0).select("qid", "id", F.lit(0.0).alias("dist"), "rank")
    else:
        vector = retrieval.knn(corpus.vectors, query_vectors, k, candidates)
    return keyword, vector


def search_documents(
    corpus: Corpus,
    queries: DataFrame,
    query_vectors: DataFrame | None = None,
    k: int = DEFAULTS.search_results,
    max_candidates: int = DEFAULTS.search_candidates,
    scorer=retrieval.overlap_score,
    compiled: QuerySet | None = None,
    **filters,
) -> DataFrame:
    """Filter, rank by both legs, fuse, re-rank and build cards.

    A blank query lists the filtered documents, newest first. Without vectors the
    keyword leg stands alone.
    """
    docs = filter_documents(corpus.rows, **filters)
    is_blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    blank = queries.filter(is_blank)
    if not blank.isEmpty():
        listed = _listed_cards(docs, blank, k)
        rest = queries.filter(~is_blank)
        if rest.isEmpty():
            return listed
        found = search_documents(corpus, rest, query_vectors, k, max_candidates, scorer, compiled, **filters)
        return found.unionByName(listed, allowMissingColumns=True)
    candidates = docs.select("id") if any(v is not None for v in filters.values()) else None
    asked = retrieval.compile_queries(queries) if compiled is None else compiled
    bound = max(asked.n, 1) * max_candidates
    keyword, vector = _legs(corpus, asked, query_vectors, max_candidates, candidates)
    fused = pin(retrieval.rrf(keyword, vector, max_candidates), bound)
    shown = retrieval.snippets(fused, corpus.rows, asked, bound)
    return retrieval.rerank(shown, corpus.rows, queries, bound, k, scorer)


def _listed_cards(docs: DataFrame, blank: DataFrame, k: int) -> DataFrame:
    """The k newest documents as unscored cards of every blank query."""
    columns = ["id", "vault_path", "summary", "title", "project", "note_type", "updated_at", "key_topics"]
    newest = top_per_group(
        listing(docs, k).select(*columns, F.lit(0).alias("_all")), ["_all"], [F.col("updated_at").desc_nulls_last(), F.col("id")], k
    )
    cards = newest.agg(F.sort_array(F.collect_list(F.struct("rank", *columns)))).scalar()
    return blank.select("qid", F.inline(cards)).withColumn("snippet", F.lit("")).withColumn("score", F.lit(None).cast("double"))


def list_documents(docs: DataFrame, k: int = DEFAULTS.search_results, **filters) -> DataFrame:
    """The blank-query form of :func:`search_documents`."""
    return listing(filter_documents(docs, **filters), k)


def search_facts(
    corpus: Corpus,
    queries: DataFrame,
    query_vectors: DataFrame | None = None,
    k: int = DEFAULTS.fact_results,
    weight: float = DEFAULTS.keyword_weight,
    compiled: QuerySet | None = None,
) -> DataFrame:
    """Weighted fusion over facts; retired facts are found too and keep their status."""
    asked = retrieval.compile_queries(queries) if compiled is None else compiled
    keyword, vector = _legs(corpus, asked, query_vectors, k)
    bound = max(asked.n, 1) * k
    return present_facts(retrieval.rrf_weighted(keyword, vector, k, weight), corpus.rows, bound)


def present_facts(fused: DataFrame, rows: DataFrame, bound: int) -> DataFrame:
    """The at most ``bound`` fused rows as facts, with the legs that found them."""
    facts = rows.select("id", "dimension", "entity", "tag", "fact", "status", "confidence", "trust_score")
    found = retrieval.attach_by_id(pin(fused, bound), facts, bound)
    legs = F.struct(F.col("kw_rank").isNotNull().alias("keyword"), F.col("vec_rank").isNotNull().alias("vector"))
    return found.withColumn("legs", legs)


def search_dual(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Both result lists under a ``corpus`` column, each without repeated ids."""
    f = first_occurrence(facts, order="rank", per=("qid",)).withColumn("corpus", F.lit("fact"))
    d = first_occurrence(documents, order="rank", per=("qid",)).withColumn("corpus", F.lit("document"))
    return f.unionByName(d, allowMissingColumns=True)


def search_response(
    session: str,
    facts: DataFrame,
    documents: DataFrame,
    entries: DataFrame,
    corrections: DataFrame,
    seen_facts: DataFrame,
    seen_docs: DataFrame,
    cap: int = DEFAULTS.orientation_per_dimension,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of one response: orientation facts, new facts, new documents.

    Also returns the facts surfaced (one event each, for the retrieval score) and
    the documents shown. Result lists are top-k, hence small.
    """
    found = facts.withColumn("session_id", F.lit(session))
    about = context.orientation_for_entities(entries, found.filter(F.col("entity") != "").select("entity"), cap)
    about = context.mark_volatile(about, corrections).withColumn("session_id", F.lit(session))
    shown = about.select("session_id", "id").unionByName(seen_facts.select("session_id", "id"))
    fresh_facts, _ = context.unseen(found, shown)
    fresh_docs, _ = context.unseen(documents.withColumn("session_id", F.lit(session)), seen_docs)
    new_about, _ = context.unseen(about, seen_facts)
    shape = ["block", "type", "rank", "id", "heading", "text", "status", "score"]
    none = F.lit(None)
    orientation = about.select(
        F.lit(1).alias("block"), F.lit("context").alias("type"), "rank", "id",
        F.concat(F.lit("## "), "dimension", F.lit(" — "), "entity").alias("heading"), F.col("bullet").alias("text"),
        "status", none.cast("double").alias("score"),
    )
    fact_blocks = fresh_facts.select(
        F.lit(2).alias("block"), F.lit("fact_result").alias("type"), "rank", "id",
        F.concat("dimension", F.lit("/"), "entity").alias("heading"), F.col("fact").alias("text"), "status", "score",
    )
    doc_blocks = fresh_docs.select(
        F.lit(3).alias("block"), F.lit("result_card").alias("type"), "rank", "id",
        F.col("title").alias("heading"), F.col("summary").alias("text"), none.cast("string").alias("status"), "score",
    )
    blocks = orientation.select(shape).unionByName(fact_blocks.select(shape)).unionByName(doc_blocks.select(shape))
    surfaced = new_about.select("session_id", "id").unionByName(fresh_facts.select("session_id", "id")).distinct()
    return blocks, surfaced, fresh_docs.select("session_id", "id").distinct()
