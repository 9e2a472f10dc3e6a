"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import langid, lm, minhash, mixing, negatives, outliers, pieces, resampling, simhash, sketch, substrings, token_files, toxicity
from mnemospark.llm.common import documents, scratch_folder, stored, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of every document, fitted on the labelled ones."""
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit_severity(docs, toxicity.severity_grades(labels))
    return toxicity.score_severity(docs, model)


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder), words=3, distance=3)


@query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(documents(spark, folder), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op5_substring_dedup"] = """
    WITH w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
        FROM documents
    ), win AS (
        SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS body
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20)
    ), firsts AS (SELECT body, min((doc_id, s)) AS f FROM win GROUP BY body HAVING count(*) > 1),
    gone AS (
        SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p
        FROM win JOIN firsts USING (body) WHERE (doc_id, s) <> f
    ), g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
    k AS (
        SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
               CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS kept
        FROM w LEFT JOIN g USING (doc_id)
    )
    SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


@query
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = f"{scratch_folder(spark)}/tokens"
    token_files.write_tokens(documents(spark, folder), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.checksums(token_files.read_tokens(spark, path))


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = langid.fit_languages(docs.where(~langid.held_out()))
    found = langid.identify_languages(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")



@query
def op10_threshold_sketch(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = sketch.with_next(docs.withColumn("sketch", sketch.sketch(F.col("text"))), ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", 1, half))
    rows = found.select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", "sketch", "next_text", "next_sketch", edited.alias("edited"))
    both = rows.withColumn("edited_sketch", sketch.sketch(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.as_string(F.col("sketch")).alias("fingerprint"),
        sketch.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.text_likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text"), F.col("edited")).alias("near_edited"),
        sketch.text_likeness(F.col("sketch"), F.col("next_sketch"), F.col("text"), F.col("next_text")).alias("near_next"),
    )


_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
SQL["op10_threshold_sketch"] = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (
        SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id,
               coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text
        FROM d
    ), e AS (
        SELECT doc_id, next_id, text,
               substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited
        FROM n
    ), w AS (
        SELECT doc_id, false AS e, {_WORDS.format("text")} AS ws FROM e
        UNION ALL SELECT doc_id, true, {_WORDS.format("edited")} FROM e
    ), s AS (
        SELECT doc_id, e, list_distinct(list_transform(
                   CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                   ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END,
                   lambda x: md5(x))) AS hs
        FROM w
    ), p AS (
        SELECT doc_id, e, hs AS every, len(hs) > 0 AND list_min(hs) >= '2' AS short,
               CASE WHEN len(list_filter(hs, lambda h: h < '2')) > 0 THEN list_filter(hs, lambda h: h < '2')
                    WHEN len(hs) > 0 THEN [list_min(hs)] ELSE []::VARCHAR[] END AS hs
        FROM s
    ), k AS (SELECT doc_id, e, every, short, list_sort(list_distinct(list_transform(hs, lambda h: h[1:16]))) AS sk FROM p),
    j AS (
        SELECT e.doc_id, length(e.text) AS n_chars, sha256(edited) AS edited_sha256,
               array_to_string(a.sk, '') AS fingerprint, array_to_string(b.sk, '') AS edited_fingerprint,
               CASE WHEN a.short OR b.short THEN a.every ELSE a.sk END AS a1, CASE WHEN a.short OR b.short THEN b.every ELSE b.sk END AS b1,
               CASE WHEN a.short OR c.short THEN a.every ELSE a.sk END AS a2, CASE WHEN a.short OR c.short THEN c.every ELSE c.sk END AS c2
        FROM e JOIN k a ON a.doc_id = e.doc_id AND NOT a.e JOIN k b ON b.doc_id = e.doc_id AND b.e
             JOIN k c ON c.doc_id = e.next_id AND NOT c.e
    )
    SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
           CASE WHEN least(len(a1), len(b1)) = 0 THEN CASE WHEN len(a1) = len(b1) THEN 1.0 ELSE 0.0 END
                ELSE len(list_intersect(a1, b1))::DOUBLE / least(len(a1), len(b1)) END AS near_edited,
           CASE WHEN least(len(a2), len(c2)) = 0 THEN CASE WHEN len(a2) = len(c2) THEN 1.0 ELSE 0.0 END
                ELSE len(list_intersect(a2, c2))::DOUBLE / least(len(a2), len(c2)) END AS near_next
    FROM j
"""


@query
def op8_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    measured = stored(outliers.measure(documents(spark, folder), ["doc_id"]))
    return outliers.judge(measured, outliers.fit_outliers(measured), ["doc_id"])


@query
def op6_temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "source")
    plan = mixing.plan_mix(docs, repetitions=1.5)
    return mixing.mix(docs, plan).select("doc_id", "source", "mix_pass", "mix_block", "mix_place")


@query
def op4_gumbel_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    found = pieces.sample_segmentations(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"), k=2)
    sizes = F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash")
    return found.select("doc_id", "rank", *sizes, "log_prob", "inclusion", "decoded_ok")


@query
def op3_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return lm.score_documents(docs, lm.fit_window_model(docs))


@query
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.importance_resampling(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), percent=5, min_words=20)


SQL["op11_importance_resampling"] = """
    WITH poly AS (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(0, 256) t(i)),
    tab AS (SELECT list(c ORDER BY i) AS tb FROM poly),
    d AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
    w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM d),
    g AS (SELECT kind, id, len(ws) AS n_words, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
          list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS gram FROM w),
    c AS (SELECT kind, id, gram, count(*) AS n FROM g GROUP BY ALL),
    u AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM c) x),
    b AS (SELECT gram, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1),
          lambda a, x: xor(a >> 8, tb[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM u, tab),
    n AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM c JOIN b USING (gram) GROUP BY bucket),
    gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
    x AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN b USING (gram) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id),
    y AS (SELECT w.id AS doc_id, len(ws) >= 20 AS long_enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(w.id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
          FROM w LEFT JOIN x ON x.id = w.id WHERE kind = 0),
    z AS (SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id) AS r, count(*) FILTER (long_enough) OVER () AS n FROM y)
    SELECT doc_id, n_features, weight, score, CASE WHEN long_enough AND r <= 5 * n // 100 THEN r END AS rank FROM z
"""


@query
def op12_minmax_hash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder), words=4, percent=80)


SQL["op12_minmax_hash"] = f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
        FROM documents
    ), s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
               ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh
        FROM w
    ), c AS (SELECT sh, min(doc_id) AS id, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) t WHERE len(sh) > 0 GROUP BY sh),
    e AS (SELECT id, n, hash(x) AS x FROM (SELECT id, n, unnest(sh) AS x FROM c) t),
    l AS (
        SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id
        GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT id AS node, id AS reach FROM c UNION SELECT r.node, t.b FROM r JOIN t ON t.a = r.reach),
    m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
    k AS (SELECT c.sh, m.component_id FROM c JOIN m ON m.node = c.id)
    SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id,
           s.doc_id = coalesce(k.component_id, s.doc_id) AS kept
    FROM s LEFT JOIN k ON k.sh = list_sort(s.sh)
"""


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = tune(spark).read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, anchors="id % 100 = 0", positives=5, negatives=10, low=30, high=90, factor=256.0, label=label)


SQL["op13_hard_negatives"] = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
    ), p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same),
    n AS (
        SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND p.r <= 5 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
