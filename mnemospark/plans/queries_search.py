"""Registered queries: indexes, ranking, hybrid search and context."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions.vectors import hashing_embedder
from mnemospark.operators import context, index, retrieval
from mnemospark.operators.retrieval import compile_queries
from mnemospark.plans import search
from mnemospark.plans.queries_rows import stamp, stamp_sql
from mnemospark.plans.registry import query
from mnemospark.session import literal_rows

QUERY_TEXT = "tion ing"
_QUERIES = T.StructType([T.StructField("qid", T.IntegerType()), T.StructField("text", T.StringType())])


def _asked(t, *texts):
    return literal_rows(t.spark, list(enumerate(texts)), _QUERIES)


def _vector_query(t):
    return t.vectors.filter("id = 0").select(F.lit(0).alias("qid"), "embedding")


# --- indexes ----------------------------------------------------------------


@query("i1_document_postings", "SELECT id, term, tf, doc_len FROM postings")
def _(t):
    return index.build_postings(t.documents)


@query("i1_document_postings_stemmed")
def _(t):
    return index.build_postings(t.documents, stem=True)


@query(
    "i1_field_postings",
    """SELECT id, field, term, count(*) AS tf, md5(array_to_string(list(pos ORDER BY pos), ',')) AS positions FROM (
      SELECT id, 'entity' AS field, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT id, __ENTITY__ AS w FROM entries) a
      UNION ALL SELECT id, 'fact', unnest(w), unnest(range(len(w))) FROM (SELECT id, __FACT__ AS w FROM entries) b) x GROUP BY ALL""",
)
def _(t):
    p = index.build_field_postings(t.entries, index.FACT_FIELDS)
    return p.select("id", "field", "term", "tf", F.md5(F.array_join("pos", ",")).alias("positions"))


@query("i2_fact_postings", "SELECT id, term, tf, doc_len FROM fact_postings")
def _(t):
    return index.build_postings(t.entries, index.FACT_FIELDS)


@query("a11_index_stats", "SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats")
def _(t):
    return index.corpus_stats(index.tokenized(t.documents)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("a11_term_stats", "SELECT term, count(*) AS doc_freq, sum(tf)::BIGINT AS total_tf FROM postings GROUP BY term")
def _(t):
    return index.term_stats(index.build_postings(t.documents))


@query("i5_embed_documents")
def _(t):
    from mnemospark.functions.text import embedding_text

    line = embedding_text(F.col("title"), F.col("note_type"), F.col("key_topics"), F.col("summary"))
    return index.embed(t.documents, line, hashing_embedder)


@query(
    "r15_incremental_index",
    "SELECT id, term, tf, doc_len FROM fact_postings",
)
def _(t):
    """Index of the old facts, brought up to date by re-indexing those of labelled documents."""
    labelled = t.raw("labels").select("doc_id")
    doc_id = F.floor(F.col("id") / 4294967296).alias("doc_id")
    changed = t.entries.select("id", doc_id).join(labelled, "doc_id", "left_semi").select("id")
    stale = t.entries.join(changed.withColumn("old", F.lit(True)), "id", "left")
    stale = stale.withColumn("fact", F.when(F.col("old"), "outdated text").otherwise(F.col("fact")))
    before = index.build_postings(stale, index.FACT_FIELDS)
    fresh = index.build_postings(t.entries.join(changed, "id", "left_semi"), index.FACT_FIELDS)
    return index.replace_by_id(before, fresh, changed)


# --- ranking ----------------------------------------------------------------


@query("i4_bm25_documents", "SELECT id, score, rank FROM kw")
def _(t):
    q = compile_queries(_asked(t, QUERY_TEXT))
    c = search.adhoc_corpus(t.documents, q, index.DOCUMENT_FIELDS)
    return retrieval.bm25_search(c.postings, c.stats, q, 20).select("id", "score", "rank")


_WEIGHT = (
    "greatest(1e-6::DOUBLE, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE"
    " / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))"
)


@query(
    "i4_bm25_operators",
    f"""WITH w AS (SELECT id, term, {_WEIGHT} AS weight FROM (
        SELECT *, count(*) OVER (PARTITION BY term) AS df FROM fact_postings WHERE term IN ('tion', 'ing', 'leaux', 'the')) p, fact_stats),
      d AS (SELECT id, list(term) AS got, map_from_entries(list((term, weight))) AS m FROM w GROUP BY id),
      r AS (SELECT 0 AS qid, id, coalesce(m['tion'], 0) + coalesce(m['leaux'], 0) AS score FROM d WHERE list_has_any(got, ['tion', 'leaux'])
        UNION ALL SELECT 1, id, m['the'] FROM d WHERE list_contains(got, 'the') AND NOT list_contains(got, 'ing')
        UNION ALL SELECT 2, id, coalesce(m['tion'], 0) + coalesce(m['ing'], 0) + coalesce(m['leaux'], 0) FROM d
          WHERE list_has_all(got, ['tion', 'ing']) OR list_contains(got, 'leaux'))
    SELECT * FROM (SELECT qid, id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM r) x WHERE rank <= 50""",
)
def _(t):
    """Three fact queries with OR and exclusion, in one pass over the postings."""
    q = compile_queries(_asked(t, "tion OR leaux", "the -ing", "tion ing OR leaux"))
    c = search.adhoc_corpus(t.entries, q, index.FACT_FIELDS)
    return retrieval.bm25_search(c.postings, c.stats, q, 50)


@query(
    "i4_phrase",
    """SELECT id FROM (SELECT id, __FOLDED__ AS f FROM entries) x WHERE regexp_matches(f, '(^|[^\\p{L}\\p{N}])of[^\\p{L}\\p{N}]+the([^\\p{L}\\p{N}]|$)')""",
)
def _(t):
    """All facts that hold the phrase, from token positions."""
    q = compile_queries(_asked(t, '"of the"'))
    c = search.adhoc_corpus(t.entries, q, index.FACT_FIELDS)
    fields = index.build_field_postings(t.entries, index.FACT_FIELDS)
    return retrieval.bm25_search(c.postings, c.stats, q, 2**30, field_postings=fields).select("id")


@query(
    "i4_bm25_candidates",
    """SELECT * FROM (SELECT b.id, b.score, row_number() OVER (ORDER BY b.score DESC, b.id) AS rank FROM bm25 b JOIN docs d ON d.id = b.id
      WHERE starts_with(d.vault_path, 'inbox/')) x WHERE rank <= 5""",
)
def _(t):
    """The candidate set restricts the ranking before the top-k cut."""
    q = compile_queries(_asked(t, QUERY_TEXT))
    c = search.adhoc_corpus(t.documents, q, index.DOCUMENT_FIELDS)
    inbox = search.filter_documents(t.documents, location="inbox")
    return retrieval.bm25_search(c.postings, c.stats, q, 5, candidates=inbox).select("id", "score", "rank")


@query("i6_knn", "SELECT id, dist, rank FROM vec")
def _(t):
    return retrieval.knn(t.vectors, _vector_query(t), 20).select("id", "dist", "rank")


@query(
    "i6_knn_per_label",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (
        SELECT q.label AS qid, v.vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding),
          lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 9) AS dist
        FROM embeddings v, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q) d) r WHERE rank <= 10""",
)
def _(t):
    """A batch of queries: the first vector of every label."""
    raw = t.raw("embeddings")
    queries = raw.groupBy(F.col("label").alias("qid")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return retrieval.knn(t.vectors, queries, 10)


@query("i7_knn_lsh")
def _(t):
    return retrieval.knn_lsh(t.vectors, _vector_query(t), 20, radius=1.5)


@query("i8_rrf", "SELECT id, score, kw_rank, vec_rank, rank FROM fused")
def _(t):
    q = compile_queries(_asked(t, QUERY_TEXT))
    c = search.adhoc_corpus(t.documents, q, index.DOCUMENT_FIELDS)
    keyword = retrieval.bm25_search(c.postings, c.stats, q, 20)
    fused = retrieval.rrf(keyword, retrieval.knn(t.vectors, _vector_query(t), 20), 20)
    return fused.select("id", "score", "kw_rank", "vec_rank", "rank")


@query(
    "u3_candidate_ids",
    "SELECT coalesce(k.id, v.id) AS id, k.id IS NOT NULL AS by_keyword, v.id IS NOT NULL AS by_vector FROM kw k FULL JOIN vec v ON k.id = v.id",
)
def _(t):
    """Union of both rankings' ids, before any cut of the fused list."""
    q = compile_queries(_asked(t, QUERY_TEXT))
    c = search.adhoc_corpus(t.documents, q, index.DOCUMENT_FIELDS)
    keyword = retrieval.bm25_search(c.postings, c.stats, q, 20)
    fused = retrieval.rrf(keyword, retrieval.knn(t.vectors, _vector_query(t), 20), 40, missing=21)
    return fused.select("id", F.col("kw_rank").isNotNull().alias("by_keyword"), F.col("vec_rank").isNotNull().alias("by_vector"))


_FACT_FUSED = f"""
    fb AS (SELECT id, round(sum({_WEIGHT}), 9) AS score
      FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM fact_postings WHERE term IN ('tion', 'ing')) p, fact_stats
      GROUP BY id HAVING count(*) = 2),
    fk AS (SELECT * FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM fb) a WHERE rank <= 20),
    fv AS (SELECT id * 4294967296 AS id, rank FROM vec),
    ff AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
      SELECT coalesce(k.id, v.id) AS id, round(0.5::DOUBLE / (60 + coalesce(k.rank, 21)) + 0.5::DOUBLE / (60 + coalesce(v.rank, 21)), 9) AS score,
        k.rank IS NOT NULL AS by_keyword FROM fk k FULL JOIN fv v ON k.id = v.id) s) t WHERE rank <= 20)"""


def _facts_found(t):
    """Facts by text and, for a document's first line, by its document's vector."""
    asked = _asked(t, QUERY_TEXT)
    q = compile_queries(asked)
    vectors = t.vectors.select((F.col("id") * 4294967296).alias("id"), "embedding")
    c = search.adhoc_corpus(t.entries, q, index.FACT_FIELDS, vectors)
    return search.search_facts(c, asked, _vector_query(t), compiled=q)


@query(
    "i13_search_facts",
    f"""WITH {_FACT_FUSED} SELECT f.id, f.rank, f.score, f.by_keyword, coalesce(e.status, '-') AS status, e.entity FROM ff f JOIN entries e ON e.id = f.id""",
)
def _(t):
    rows = _facts_found(t)
    return rows.select("id", "rank", "score", F.col("legs.keyword").alias("by_keyword"), F.coalesce("status", F.lit("-")).alias("status"), "entity")


@query(
    "j1_hybrid_cards",
    f"""SELECT f.id, f.rank, f.score, d.vault_path, d.title, coalesce(d.project, '-') AS project, {stamp_sql('d.updated_at').replace('AS d.updated_at', 'AS updated_at')}
        FROM fused f JOIN docs d ON d.id = f.id""",
)
def _(t):
    """Fused ranking as cards; vectors without a document drop out."""
    q = compile_queries(_asked(t, QUERY_TEXT))
    c = search.adhoc_corpus(t.documents, q, index.DOCUMENT_FIELDS)
    keyword = retrieval.bm25_search(c.postings, c.stats, q, 20)
    fused = retrieval.rrf(keyword, retrieval.knn(t.vectors, _vector_query(t), 20), 20)
    cards = retrieval.hydrate_cards(fused, t.documents, bound=20)
    return cards.select("id", "rank", "score", "vault_path", "title", F.coalesce("project", F.lit("-")).alias("project"), stamp("updated_at"))


def _documents_found(t, **filters):
    asked = _asked(t, QUERY_TEXT)
    q = compile_queries(asked)
    c = search.adhoc_corpus(t.documents, q, index.DOCUMENT_FIELDS, t.vectors)
    return search.search_documents(c, asked, _vector_query(t), compiled=q, **filters)


@query("i12_search_documents")
def _(t):
    """Both legs, fusion, snippets, re-ranking and cards."""
    return _documents_found(t).drop("key_topics")


@query("i12_search_filtered")
def _(t):
    return _documents_found(t, location="inbox", since="2024-01-01 00:30:00").drop("key_topics")


@query("i14_search_dual")
def _(t):
    dual = search.search_dual(_facts_found(t).drop("legs"), _documents_found(t).drop("key_topics"))
    return dual.select("corpus", "id", "rank", "score", "entity", "vault_path")


@query("i15_search_response")
def _(t):
    """Orientation, fact and document blocks of one response, with nothing shown before."""
    seen_schema = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("id", T.LongType())])
    nothing = literal_rows(t.spark, [], seen_schema)
    found = _facts_found(t).drop("legs")
    blocks, _surfaced, _docs = search.search_response("s", found, _documents_found(t), t.entries, t.corrections, nothing, nothing)
    return blocks


# --- context ----------------------------------------------------------------


@query(
    "a1_entity_map",
    """SELECT dimension, entity, cnt, rank, greatest(n - 15, 0) AS extra FROM (
      SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY cnt DESC, entity) AS rank, count(*) OVER (PARTITION BY dimension) AS n FROM (
        SELECT dimension, entity, count(*) AS cnt FROM entries WHERE (status IS NULL OR status <> 'retired') AND entity <> '' GROUP BY ALL) c) r WHERE rank <= 15""",
)
def _(t):
    return context.entity_map(t.entries)


@query("a2_inbox_stats", f"SELECT count(*) AS cnt, {stamp_sql('max(updated_at)').replace('AS max(updated_at)', 'AS last_updated')} FROM docs WHERE vault_path ILIKE 'inbox/%'")
def _(t):
    return context.inbox_stats(t.documents).select("cnt", stamp("last_updated"))


@query("a3_volatility", "SELECT entry_id, count(*) AS cnt, count(*) >= 3 AS volatile FROM corrections GROUP BY entry_id")
def _(t):
    return context.volatility(t.corrections)


@query("a13_dimensions", "SELECT DISTINCT dimension FROM entries WHERE status IS NULL OR status <> 'retired'")
def _(t):
    return context.dimensions(t.entries)


_TOP = """SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY trust_score DESC NULLS LAST, confidence DESC NULLS LAST, updated_at DESC NULLS LAST, id) AS rank
    FROM entries WHERE status <> 'retired'"""


@query("w1_top_entries", f"SELECT dimension, id, rank FROM ({_TOP}) x WHERE rank <= 50")
def _(t):
    return context.top_entries(t.entries).select("dimension", "id", "rank")


_ORIENT = """SELECT *, row_number() OVER (PARTITION BY PER ORDER BY trust_score DESC NULLS LAST, retrieval_score DESC NULLS LAST,
    confidence DESC NULLS LAST, updated_at DESC NULLS LAST, id) AS rank FROM entries WHERE status <> 'retired' AND trust_score >= 0.3::DOUBLE"""


@query("w2_orientation", f"SELECT dimension, id, rank FROM ({_ORIENT.replace('PER', 'dimension')}) x WHERE rank <= 5")
def _(t):
    return context.orientation(t.entries).select("dimension", "id", "rank")


@query(
    "w3_orientation_for_entities",
    f"""WITH top AS (SELECT * FROM ({_ORIENT.replace('PER', 'entity')} AND entity IN (SELECT entity FROM entries WHERE retrieval_score = 9)) x WHERE rank <= 5),
      best AS (SELECT entity, row_number() OVER (ORDER BY trust_score DESC, retrieval_score DESC, confidence DESC, updated_at DESC, id, entity) AS place FROM top WHERE rank = 1),
      claim AS (SELECT dimension, min(place) AS place FROM top JOIN best USING (entity) GROUP BY dimension)
    SELECT dimension, entity, id, rank FROM top JOIN best USING (entity) JOIN claim USING (dimension, place)""",
)
def _(t):
    wanted = t.entries.filter(F.col("retrieval_score") == 9).select("entity")
    return context.orientation_for_entities(t.entries, wanted).select("dimension", "entity", "id", "rank")


@query(
    "f11_fact_bullets",
    f"""SELECT x.id, '- [' || entity || '] ' || fact || ' (confidence: ' || CASE WHEN confidence = 0 THEN '0.0' ELSE confidence::VARCHAR END || ')'
        || CASE WHEN coalesce(n, 0) >= 3 THEN ' [frequently corrected]' ELSE '' END AS bullet
      FROM (SELECT * FROM entries) x LEFT JOIN (SELECT entry_id, count(*) AS n FROM corrections GROUP BY entry_id) c ON c.entry_id = x.id""",
)
def _(t):
    return context.mark_volatile(t.entries, t.corrections).select("id", "bullet")


@query(
    "w4_few_shot",
    """WITH pool AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) - 1 AS idx FROM (
        SELECT c.*, e.dimension, e.entity FROM corrections c JOIN entries e ON e.id = c.entry_id WHERE reason_category = 'ai_error') x),
      target AS (SELECT dimension AS target, list(entity) AS entities FROM (
        SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY cnt DESC, entity) AS r FROM (
          SELECT dimension, entity, count(*) AS cnt FROM entries WHERE (status IS NULL OR status <> 'retired') AND entity <> '' GROUP BY ALL) c) y
        WHERE r <= 15 GROUP BY dimension)
    SELECT target, rank, id, score, line FROM (
      SELECT target, id, score, row_number() OVER (PARTITION BY target ORDER BY score DESC, idx) AS rank,
        '- For [' || entity || '] in [' || dimension || ']: The AI incorrectly extracted "' || old_fact || '".'
          || CASE WHEN new_fact IS NOT NULL THEN ' The correct fact is "' || new_fact || '".' ELSE '' END || ' ' || feedback AS line
      FROM (SELECT *, round(CASE WHEN dimension = target THEN 3::DOUBLE ELSE 0 END + CASE WHEN entity <> '' AND list_contains(entities, lower(entity)) THEN 2 ELSE 0 END
        + greatest(0::DOUBLE, 1 - idx * 0.1::DOUBLE), 9) AS score FROM pool, target) s) r WHERE rank <= 5""",
)
def _(t):
    """Examples for every dimension, preferring its 15 largest entities."""
    top = context.entity_map(t.entries)
    targets = top.groupBy(F.col("dimension").alias("target")).agg(F.collect_list("entity").alias("entities"))
    return context.few_shot(t.corrections, t.entries, targets).select("target", "rank", "id", "score", "line")


@query(
    "j9_attach_comments",
    f"""SELECT e.id, md5('' || coalesce(chr(10) || 'Comments: ' || c.txt, '')) AS reasoning FROM (SELECT * FROM ({_TOP}) x WHERE rank <= 50) e
      LEFT JOIN (SELECT entry_id, string_agg(comment_text, '; ' ORDER BY created_at, id) AS txt FROM comments GROUP BY entry_id) c ON c.entry_id = e.id""",
)
def _(t):
    rows = context.attach_comments(context.top_entries(t.entries), t.comments)
    return rows.select("id", F.md5("reasoning").alias("reasoning"))


@query(
    "j14_extraction_requests",
    f"""WITH dims AS (SELECT unnest(['en', 'fr', 'it']) AS dimension),
      facts AS (SELECT dimension, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM ({_TOP}) x WHERE rank <= 50 GROUP BY dimension),
      todo AS (SELECT id, CASE WHEN full_body <> '' THEN full_body ELSE coalesce(summary, '') END AS content FROM catalog
        WHERE (classify_content_hash IS NULL OR classify_content_hash <> content_hash) AND (status IS NULL OR status <> 'needs-review'))
    SELECT t.id AS doc_id, d.dimension, sha256(content) AS content, coalesce(f.ids, '-') AS fact_ids, 5::BIGINT AS n_shots
    FROM todo t CROSS JOIN dims d LEFT JOIN facts f ON f.dimension = d.dimension""",
)
def _(t):
    rulebook = {d: {"tags": ["other"], "guidance": "notes"} for d in ("en", "fr", "it")}
    docs = t.catalog.withColumn("classify_last_error", F.lit(None).cast("string"))
    rows = context.extraction_requests(docs, t.entries, t.corrections, t.comments, rulebook)
    ids = F.array_join(F.transform("facts", lambda f: f["id"].cast("string")), ",")
    return rows.select(
        "doc_id", "dimension", F.sha2("content", 256).alias("content"), F.coalesce(ids, F.lit("-")).alias("fact_ids"),
        F.size("few_shot").cast("long").alias("n_shots"),
    )


@query(
    "j13_unseen",
    """SELECT DISTINCT event_type AS session_id, user_id AS id FROM events a WHERE value >= 10
      AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = a.event_type AND b.user_id = a.user_id AND b.value < 5)""",
)
def _(t):
    """Users of large events per session that no small event showed before."""
    shown = t.events.select(F.col("event_type").alias("session_id"), F.col("user_id").alias("id"), "value")
    results = shown.filter("value >= 10").select("session_id", "id").distinct()
    fresh, _seen = context.unseen(results, shown.filter("value < 5").select("session_id", "id").distinct())
    return fresh


@query(
    "i16_overview",
    f"""WITH em AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY cnt DESC, entity) AS rank, count(*) OVER (PARTITION BY dimension) AS n FROM (
        SELECT dimension, entity, count(*) AS cnt FROM entries WHERE (status IS NULL OR status <> 'retired') AND entity <> '' GROUP BY ALL) c),
      cc AS (SELECT entry_id, count(*) AS n FROM corrections GROUP BY entry_id)
    SELECT 1 AS section, dimension, rank, '- ' || entity || ' (' || cnt || ')' AS line FROM em WHERE rank <= 15
    UNION ALL SELECT DISTINCT 1, dimension, 2147483647, '+' || (n - 15) || ' more' FROM em WHERE n > 15
    UNION ALL SELECT 2, dimension, rank, '- [' || entity || '] ' || fact || ' (confidence: ' || CASE WHEN confidence = 0 THEN '0.0' ELSE confidence::VARCHAR END || ')'
        || CASE WHEN coalesce(cc.n, 0) >= 3 THEN ' [frequently corrected]' ELSE '' END
      FROM ({_ORIENT.replace('PER', 'dimension')}) x LEFT JOIN cc ON cc.entry_id = x.id WHERE rank <= 5
    UNION ALL SELECT 3, NULL, 1, 'inbox: ' || count(*) || ' notes, last ' || strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') FROM docs WHERE vault_path ILIKE 'inbox/%'""",
)
def _(t):
    return context.overview(t.entries, t.documents, t.corrections)
