"""Knowledge-base tables derived from the given Parquet tables.

Every derivation is a row-wise projection of whole tables and is stated twice:
as DataFrame code in :class:`Tables` and as SQL in ``VIEWS``.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.text import FOLD_FROM, FOLD_TO, TOKEN

EPOCH = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + seconds)


class Tables:
    """Lazily derived tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        """Read a table; a scan of fewer files than cores is spread over the cores."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        for column, kind in df.dtypes:
            if kind == "timestamp_ntz":
                df = df.withColumn(column, F.col(column).cast("timestamp"))
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if len(df.inputFiles()) < cores else df

    def stream(self, name: str) -> DataFrame:
        """A table's files as a stream, be it one file or a folder of them.

        The source wants a folder or a pattern; as a pattern the name stands for both.
        """
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        rows = self.spark.readStream.schema(schema).parquet(f"{self.folder}/[{name[0]}]{name[1:]}.parquet")
        for column, kind in rows.dtypes:
            if kind == "timestamp_ntz":
                rows = rows.withColumn(column, F.col(column).cast("timestamp"))
        return rows

    @cached_property
    def documents(self) -> DataFrame:
        d = self.raw("documents")
        folder = (
            F.when(F.col("doc_id") % 4 == 0, F.lit("inbox/"))
            .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Projects/"), "source", F.lit("/")))
            .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Domain/"), "lang", F.lit("/")))
            .otherwise("chat/")
        )
        digest = F.sha2("text", 256)
        return d.select(
            F.col("doc_id").alias("id"),
            F.concat(folder, F.col("doc_id").cast("string"), F.lit(".md")).alias("vault_path"),
            F.concat_ws(" ", "source", "lang").alias("title"),
            F.when(F.col("text").contains("\n"), F.split_part("text", F.lit("\n"), F.lit(1))).alias("summary"),
            F.when(F.col("lang") != "de", F.concat("lang", F.lit("-note"))).alias("note_type"),
            ((F.col("n_chars") % 100) / F.lit(100.0)).alias("confidence"),
            _at(F.col("doc_id") * 60).alias("created_at"),
            _at(F.col("doc_id") * 60 + F.col("n_chars")).alias("updated_at"),
            digest.alias("content_hash"),
            F.when(F.col("doc_id") % 4 == 1, F.col("source")).alias("project"),
            F.array("lang", "source").alias("key_topics"),
            F.col("text").alias("full_body"),
            F.octet_length("text").cast("long").alias("file_size_bytes"),
            F.concat(F.lit("blobs/"), digest).alias("blob_ref"),
            F.when(F.col("lang") == "es", "image/png").otherwise("text/markdown").alias("mime_type"),
        )

    @cached_property
    def catalog(self) -> DataFrame:
        """Documents with their work state, taken from the labels."""
        digest = F.col("content_hash")
        lab = self.raw("labels").withColumnRenamed("doc_id", "id")
        return self.documents.join(lab, "id", "left").select(
            *self.documents.columns,
            F.when(F.col("toxic") == 1, "needs-review").alias("status"),
            F.when(F.col("quality") == 1, digest).when(F.col("quality") == 0, "stale").alias("classify_content_hash"),
            F.coalesce("toxic", F.lit(0)).alias("classify_attempts"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")

    @cached_property
    def entries(self) -> DataFrame:
        """Every non-blank line of every document as one fact."""
        lines = self.raw("documents").select(
            "doc_id", "lang", "source", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line")
        )
        fact = F.trim("line")
        n = F.length("fact")
        lines = lines.withColumn("fact", fact).filter(F.col("fact") != "")
        conf = (n % 100) / F.lit(100.0)
        return lines.select(
            (F.col("doc_id") * 4294967296 + F.col("line_no")).alias("id"),
            F.col("lang").alias("dimension"),
            F.regexp_extract(F.lower("fact"), TOKEN, 0).alias("entity"),
            F.col("source").alias("tag"),
            "fact",
            F.when(n % 11 == 0, "retired")
            .when(n % 13 == 0, F.lit(None))
            .when(conf >= 0.85, "confident")
            .otherwise("pending")
            .alias("status"),
            conf.alias("confidence"),
            F.array(F.col("doc_id").cast("string")).alias("sources"),
            F.lit("").alias("reasoning"),
            _at(F.col("doc_id") * 60 + F.col("line_no")).alias("updated_at"),
            (((n * 7) % 101) / F.lit(100.0)).alias("trust_score"),
            (F.col("line_no") % 10).cast("double").alias("retrieval_score"),
        )

    @cached_property
    def corrections(self) -> DataFrame:
        """User events as corrections of the first line of document ``user_id``."""
        op = (
            F.when(F.col("event_type") == "view", "confirm")
            .when(F.col("event_type") == "error", "reject")
            .when(F.col("event_type") == "purchase", "revise")
            .when(F.col("event_type") == "click", "edit_fact")
            .otherwise("promote")
        )
        reason = F.when(F.col("event_type").isin("error", "purchase"), "ai_error").otherwise("stale_source")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            (F.col("user_id") * 4294967296).alias("entry_id"),
            op.alias("operation"),
            reason.alias("reason_category"),
            F.concat(F.lit("value "), (F.col("value") * 100).cast("long").cast("string")).alias("feedback"),
            F.concat(F.lit("old "), F.col("event_id").cast("string")).alias("old_fact"),
            F.when(F.col("event_type") == "purchase", F.concat(F.lit("new "), F.col("event_id").cast("string"))).alias("new_fact"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        """Conversation turns as comments on the first line of document ``conv_id``."""
        return self.raw("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
            (F.col("conv_id") * 4294967296).alias("entry_id"),
            F.col("text").alias("comment_text"),
            _at(F.col("turn") * 60).alias("created_at"),
        )

    @cached_property
    def audit(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("timestamp"),
            F.when(F.col("event_type").isin("view", "click"), "capture").otherwise("classify").alias("pipeline"),
            F.col("event_type").alias("stage"),
            F.array(F.col("user_id").cast("string")).alias("source_ids"),
            F.lit("keep").alias("decision"),
            (F.col("value") / 100).alias("confidence"),
            F.when(F.col("value") >= 10, "APPLIED").otherwise("SKIPPED").alias("outcome"),
            F.when(F.get_json_object("props", "$.k") != "0", F.concat(F.lit("c"), F.get_json_object("props", "$.k"))).alias("correlation_id"),
        )

    @cached_property
    def manifests(self) -> DataFrame:
        """All documents with presence flags and hashes on disk, in cache and on the server.

        Disk lacks toxic documents, the cache holds labelled ones, the server those
        that have a vector. Hashes differ for low quality and are NULL for Spanish.
        """
        d = self.raw("documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("h"), "n_chars")
        lab = self.raw("labels")
        vec = self.raw("embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has_vec"))
        return d.join(lab, "doc_id", "left").join(vec, "doc_id", "left").select(
            F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("vault_path"),
            "h", F.col("n_chars").alias("size"), F.col("doc_id").cast("double").alias("mtime"), "lang",
            F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("on_disk"),
            F.col("toxic").isNotNull().alias("in_cache"),
            F.coalesce("has_vec", F.lit(False)).alias("on_server"),
            F.when(F.col("lang") != "es", F.when(F.col("quality") == 0, F.concat(F.lit("x"), "h")).otherwise(F.col("h"))).alias("server_hash"),
        )

    @property
    def disk(self) -> DataFrame:
        return self.manifests.filter("on_disk").select("vault_path", F.col("h").alias("hash"), "size", "mtime")

    @property
    def cache(self) -> DataFrame:
        return self.manifests.filter("in_cache").select("vault_path", F.col("h").alias("hash"), "size", "mtime")

    @property
    def server(self) -> DataFrame:
        return self.manifests.filter("on_server").select("vault_path", F.col("server_hash").alias("hash"))

    @property
    def unreadable(self) -> DataFrame:
        return self.manifests.filter(F.col("lang") == "fr").select("vault_path")

    @cached_property
    def pages(self) -> DataFrame:
        return self.raw("pages")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.raw("conversations")


FOLD_SQL = f"translate(lower({{0}}), '{FOLD_FROM}', '{FOLD_TO}')"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({FOLD_SQL.format(f'coalesce({text}, {chr(39) * 2})')}, '{TOKEN}')"


VIEWS: dict[str, str] = {
    "docs": f"""
        SELECT d.doc_id AS id,
          CASE d.doc_id % 4 WHEN 0 THEN 'inbox/' WHEN 1 THEN 'Projects/' || source || '/'
               WHEN 2 THEN 'Domain/' || lang || '/' ELSE 'chat/' END || d.doc_id || '.md' AS vault_path,
          source || ' ' || lang AS title,
          CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) END AS summary,
          CASE WHEN lang <> 'de' THEN lang || '-note' END AS note_type,
          (n_chars % 100) / 100::DOUBLE AS confidence,
          make_timestamp(({EPOCH} + d.doc_id * 60) * 1000000) AS created_at,
          make_timestamp(({EPOCH} + d.doc_id * 60 + n_chars) * 1000000) AS updated_at,
          sha256(text) AS content_hash,
          CASE WHEN d.doc_id % 4 = 1 THEN source END AS project,
          [lang, source] AS key_topics, text AS full_body,
          strlen(text)::BIGINT AS file_size_bytes,
          'blobs/' || sha256(text) AS blob_ref,
          CASE WHEN lang = 'es' THEN 'image/png' ELSE 'text/markdown' END AS mime_type
        FROM documents d""",
    "catalog": """
        SELECT docs.*, CASE WHEN toxic = 1 THEN 'needs-review' END AS status,
          CASE WHEN quality = 1 THEN content_hash WHEN quality = 0 THEN 'stale' END AS classify_content_hash,
          coalesce(toxic, 0) AS classify_attempts
        FROM docs LEFT JOIN labels l ON docs.id = l.doc_id""",
    "lines": """
        SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS line_no
        FROM documents""",
    "entries": rf"""
        SELECT doc_id * 4294967296 + line_no AS id, lang AS dimension,
          regexp_extract(lower(fact), '{TOKEN}') AS entity, source AS tag, fact,
          CASE WHEN n % 11 = 0 THEN 'retired' WHEN n % 13 = 0 THEN NULL
               WHEN (n % 100) / 100::DOUBLE >= 0.85::DOUBLE THEN 'confident' ELSE 'pending' END AS status,
          (n % 100) / 100::DOUBLE AS confidence, doc_id,
          make_timestamp(({EPOCH} + doc_id * 60 + line_no) * 1000000) AS updated_at,
          ((n * 7) % 101) / 100::DOUBLE AS trust_score, (line_no % 10)::DOUBLE AS retrieval_score
        FROM (SELECT *, trim(line) AS fact, length(trim(line)) AS n FROM lines) t WHERE fact <> ''""",
    "corrections": """
        SELECT event_id AS id, user_id * 4294967296 AS entry_id,
          CASE event_type WHEN 'view' THEN 'confirm' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'revise'
               WHEN 'click' THEN 'edit_fact' ELSE 'promote' END AS operation,
          CASE WHEN event_type IN ('error', 'purchase') THEN 'ai_error' ELSE 'stale_source' END AS reason_category,
          'value ' || trunc(value * 100)::BIGINT AS feedback, 'old ' || event_id AS old_fact,
          CASE WHEN event_type = 'purchase' THEN 'new ' || event_id END AS new_fact, ts AS created_at
        FROM events""",
    "comments": f"""
        SELECT conv_id * 1000 + turn AS id, conv_id * 4294967296 AS entry_id, text AS comment_text,
          make_timestamp(({EPOCH} + turn * 60) * 1000000) AS created_at FROM conversations""",
    "audit": """
        SELECT event_id AS id, ts AS timestamp,
          CASE WHEN event_type IN ('view', 'click') THEN 'capture' ELSE 'classify' END AS pipeline,
          event_type AS stage, user_id::VARCHAR AS source_id, 'keep' AS decision, value / 100 AS confidence,
          CASE WHEN value >= 10 THEN 'APPLIED' ELSE 'SKIPPED' END AS outcome,
          CASE WHEN props::JSON->>'$.k' <> '0' THEN 'c' || (props::JSON->>'$.k') END AS correlation_id
        FROM events""",
    "manifests": """
        SELECT source || '/' || d.doc_id || '.md' AS vault_path, sha256(text) AS h, n_chars AS size,
          d.doc_id::DOUBLE AS mtime, lang, coalesce(toxic = 0, true) AS on_disk, toxic IS NOT NULL AS in_cache,
          vec_id IS NOT NULL AS on_server,
          CASE WHEN lang <> 'es' THEN CASE WHEN quality = 0 THEN 'x' || sha256(text) ELSE sha256(text) END END AS server_hash
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id""",
    "disk": "SELECT vault_path, h AS hash, size, mtime FROM manifests WHERE on_disk",
    "cache": "SELECT vault_path, h AS hash, size, mtime FROM manifests WHERE in_cache",
    "server": "SELECT vault_path, server_hash AS hash FROM manifests WHERE on_server",
    "unreadable": "SELECT vault_path FROM manifests WHERE lang = 'fr'",
    "tokens": f"""
        SELECT id, concat({tokens_sql('title')}, {tokens_sql('summary')}, {tokens_sql('full_body')}) AS words
        FROM docs""",
    "postings": """
        SELECT id, term, count(*) AS tf, any_value(n) AS doc_len
        FROM (SELECT id, len(words) AS n, unnest(words) AS term FROM tokens) t GROUP BY id, term""",
    "stats": "SELECT count(*) AS n_docs, avg(len(words)) AS avg_len FROM tokens",
    "fact_tokens": f"SELECT id, concat({tokens_sql('entity')}, {tokens_sql('fact')}) AS words FROM entries",
    "fact_postings": """
        SELECT id, term, count(*) AS tf, any_value(n) AS doc_len
        FROM (SELECT id, len(words) AS n, unnest(words) AS term FROM fact_tokens) t GROUP BY id, term""",
    "fact_stats": "SELECT count(*) AS n_docs, avg(len(words)) AS avg_len FROM fact_tokens",
    "bm25": """
        SELECT id, round(sum(greatest(1e-6::DOUBLE, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)))
            * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))), 9) AS score
        FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM postings WHERE term IN ('tion', 'ing')) p, stats
        GROUP BY id HAVING count(*) = 2""",
    "kw": """
        SELECT * FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm25) t
        WHERE rank <= 20""",
    "dists": """
        SELECT v.vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding),
            lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 9) AS dist
        FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""",
    "vec": """
        SELECT * FROM (SELECT id, dist, row_number() OVER (ORDER BY dist, id) AS rank FROM dists) t
        WHERE rank <= 20""",
    "fused": """
        SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
          SELECT coalesce(k.id, v.id) AS id, k.rank AS kw_rank, v.rank AS vec_rank,
            round(1 / (60 + coalesce(k.rank, 21))::DOUBLE + 1 / (60 + coalesce(v.rank, 21))::DOUBLE, 9) AS score
          FROM kw k FULL JOIN vec v ON k.id = v.id) s) t WHERE rank <= 20""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it needs, in dependency order."""
    names: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in names and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                need(body)
                if name not in names:
                    names.append(name)

    need(sql)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.lstrip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
