"""Registered queries: sources, row rules, listings and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import paths, quality, text
from mnemospark.operators import filters, state
from mnemospark.plans.corpus import tokens_sql
from mnemospark.plans.registry import query
from mnemospark.sources import files, tables

STAMP = "yyyy-MM-dd HH:mm:ss"
RULEBOOK = {
    "en": {"tags": ["src0", "src1", "src2", "src3", "other"], "guidance": "English notes"},
    "fr": {"tags": ["src4", "src5", "src6", "src7", "other"], "guidance": "French notes"},
    "it": {"tags": ["src8", "other"], "guidance": "Italian notes"},
}


def stamp(column: str):
    return F.date_format(column, STAMP).alias(column)


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


@query(
    "s1_load_documents",
    f"""SELECT id, vault_path, title, summary, array_to_string(key_topics, ',') AS topics, status IS NULL AS no_status,
        {stamp_sql('updated_at')} FROM docs, (SELECT NULL AS status) x""",
)
def _(t):
    stored = t.documents.withColumn("key_topics", F.to_json("key_topics"))
    docs = tables.as_documents(stored)
    return docs.select(
        "id", "vault_path", "title", "summary", F.array_join("key_topics", ",").alias("topics"),
        F.col("status").isNull().alias("no_status"), stamp("updated_at"),
    )


@query(
    "s2_load_entries",
    """SELECT id, dimension, entity, tag, fact, status, round(confidence, 9) AS confidence, doc_id::VARCHAR AS sources,
        '' AS reasoning, CASE WHEN status IS NULL THEN 0.5::DOUBLE ELSE trust_score END AS trust_score,
        CASE WHEN status IS NULL THEN 0::DOUBLE ELSE retrieval_score END AS retrieval_score FROM entries""",
)
def _(t):
    known = F.col("status").isNotNull()
    stored = (
        t.entries.withColumn("sources", F.to_json("sources"))
        .withColumn("reasoning", F.lit(None).cast("string"))
        .withColumn("trust_score", F.when(known, F.col("trust_score")))
        .withColumn("retrieval_count", F.when(known, F.col("retrieval_score")))
        .drop("retrieval_score")
    )
    e = tables.as_entries(stored)
    return e.select(
        "id", "dimension", "entity", "tag", "fact", "status", F.round("confidence", 9).alias("confidence"),
        F.array_join("sources", ",").alias("sources"), "reasoning", "trust_score", "retrieval_score",
    )


@query("s3_parse_notes", "SELECT vault_path, lang AS note_type, source AS project, sha256(regexp_replace(text, '\\n+$', '')) AS content_hash, length(text) AS n FROM documents d JOIN docs ON docs.id = d.doc_id")
def _(t):
    """Front matter and body of every document written as a note."""
    head = F.concat(F.lit("---\ntype: "), F.col("key_topics")[0], F.lit("\nproject: "), F.col("key_topics")[1], F.lit("\ntags:\n  - a\n  - b\n---\n"))
    raw = t.documents.select("vault_path", F.encode(F.concat(head, "full_body"), "utf-8").alias("content"))
    notes, _rejects = files.parse_notes(raw)
    return notes.select("vault_path", "note_type", "project", "content_hash", F.length("body").cast("long").alias("n"))


@query(
    "s4_scan_drops",
    """WITH listing AS (SELECT CASE WHEN lang = 'de' THEN 'inbox/.summaries/' || doc_id || '.pdf.md'
            WHEN lang = 'fr' THEN 'Projects/' || source || '/attachment/' || doc_id || '.pdf'
            WHEN lang = 'es' THEN source || '/.git/' || doc_id || '.pdf'
            ELSE 'inbox/' || doc_id || '.pdf' END AS vault_path FROM documents
          UNION ALL SELECT 'inbox/.summaries/' || doc_id || '.pdf.md' FROM labels)
       SELECT l.vault_path FROM listing l LEFT JOIN labels b ON l.vault_path = 'inbox/' || b.doc_id || '.pdf'
       WHERE l.vault_path LIKE 'inbox/%' AND l.vault_path NOT LIKE '%.md' AND b.doc_id IS NULL""",
)
def _(t):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))
    path = (
        F.when(F.col("lang") == "de", F.concat(F.lit("inbox/.summaries/"), name, F.lit(".md")))
        .when(F.col("lang") == "fr", F.concat(F.lit("Projects/"), "source", F.lit("/attachment/"), name))
        .when(F.col("lang") == "es", F.concat("source", F.lit("/.git/"), name))
        .otherwise(F.concat(F.lit("inbox/"), name))
    )
    done = t.raw("labels").select(F.concat(F.lit("inbox/.summaries/"), F.col("doc_id").cast("string"), F.lit(".pdf.md")).alias("vault_path"))
    return files.scan_drops(t.raw("documents").select(path.alias("vault_path")).unionByName(done))


@query(
    "s5_manifest",
    "SELECT vault_path, sha256(full_body) AS hash, strlen(full_body)::BIGINT AS size FROM docs WHERE vault_path NOT LIKE 'inbox/%' AND NOT regexp_matches(vault_path, '[^/]*7\\.md$')",
)
def _(t):
    """Hash and size of every stored file outside ignored folders and name patterns."""
    kept = t.documents.filter(~paths.matches_ignore(F.col("vault_path"), ["inbox", "*7.md"]))
    raw = kept.select("vault_path", F.encode("full_body", "utf-8").alias("content"))
    return raw.select("vault_path", F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("size"))


@query("s6_extract_text", "SELECT vault_path, 'text' AS kind, sha256(full_body) AS content_hash, strlen(full_body)::BIGINT AS size, length(rtrim(full_body, chr(10))) AS n FROM docs")
def _(t):
    """Text of all document files."""
    raw = t.documents.select("vault_path", F.encode("full_body", "utf-8").alias("content"))
    rows, _big = files.extract_text(raw.withColumn("size", F.length("content").cast("long")))
    return rows.select("vault_path", "kind", "content_hash", "size", F.length("text").cast("long").alias("n"))


@query("s6_html_to_text")
def _(t):
    return t.pages.select("page_id", files.html_to_text("html").alias("text"))


@query(
    "s7_audit_accepted",
    "SELECT pipeline, correlation_id IS NOT NULL AS accepted, count(*) AS cnt FROM audit GROUP BY ALL",
)
def _(t):
    good, bad = tables.check_audit(t.audit)
    rows = good.select("pipeline", F.lit(True).alias("accepted")).unionByName(bad.select("pipeline", F.lit(False).alias("accepted")))
    return rows.groupBy("pipeline", "accepted").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "p1_filter_documents",
    f"""SELECT id, vault_path, {stamp_sql('updated_at')} FROM docs WHERE project = 'src1'
        AND updated_at >= TIMESTAMP '2024-01-01 01:00:00' AND updated_at <= TIMESTAMP '2024-01-05 00:00:00'
        AND starts_with(vault_path, 'Projects/')""",
)
def _(t):
    rows = filters.filter_documents(
        t.documents, project="src1", since="2024-01-01 01:00:00", until="2024-01-05 00:00:00", location="Projects"
    )
    return rows.select("id", "vault_path", stamp("updated_at"))


@query(
    "p3_location_context",
    """SELECT coalesce(type, '-') AS type, coalesce(name, '-') AS name, count(*) AS cnt FROM (
         SELECT CASE split_part(vault_path, '/', 1) WHEN 'Domain' THEN 'domain' WHEN 'Projects' THEN 'project' WHEN 'inbox' THEN 'inbox' END AS type,
           CASE WHEN split_part(vault_path, '/', 1) IN ('Domain', 'Projects') THEN split_part(vault_path, '/', 2) END AS name FROM docs) x
       GROUP BY ALL""",
)
def _(t):
    where = t.documents.select(paths.location_context(F.col("vault_path")).alias("w")).select("w.*")
    return where.select(F.coalesce("type", F.lit("-")).alias("type"), F.coalesce("name", F.lit("-")).alias("name")).groupBy("type", "name").agg(
        F.count(F.lit(1)).alias("cnt")
    )


_ODD = """SELECT id, CASE entity WHEN 'the' THEN 'Projects/' || entity || '.md' WHEN '' THEN 'inbox/x.md'
    ELSE CASE line_no % 8 WHEN 0 THEN 'Projects/A/' || entity || '.md' WHEN 1 THEN 'Domain/' || entity || '/attachment/b.pdf'
      WHEN 2 THEN 'Domain/Briefings/' || entity || '.md' WHEN 3 THEN 'inbox/.summaries/' || entity || '.md'
      WHEN 4 THEN 'Projects/A/.git/' || entity WHEN 5 THEN 'Projects/A/~$' || entity || '.docx'
      WHEN 6 THEN 'Projects/A/.summaries/' || entity || '.md' ELSE 'inbox/d/' || entity || '.sync-conflict-1.md' END END AS path
  FROM (SELECT *, id % 4294967296 AS line_no FROM entries) e"""


def _odd_paths(t):
    """Paths of every kind, built from the first word of every fact."""
    e, n = F.col("entity"), F.col("id") % 4294967296 % 8
    j = F.concat
    path = (
        F.when(e == "the", j(F.lit("Projects/"), e, F.lit(".md")))
        .when(e == "", "inbox/x.md")
        .when(n == 0, j(F.lit("Projects/A/"), e, F.lit(".md")))
        .when(n == 1, j(F.lit("Domain/"), e, F.lit("/attachment/b.pdf")))
        .when(n == 2, j(F.lit("Domain/Briefings/"), e, F.lit(".md")))
        .when(n == 3, j(F.lit("inbox/.summaries/"), e, F.lit(".md")))
        .when(n == 4, j(F.lit("Projects/A/.git/"), e))
        .when(n == 5, j(F.lit("Projects/A/~$"), e, F.lit(".docx")))
        .when(n == 6, j(F.lit("Projects/A/.summaries/"), e, F.lit(".md")))
        .otherwise(j(F.lit("inbox/d/"), e, F.lit(".sync-conflict-1.md")))
    )
    return t.entries.select("id", path.alias("path"))


@query(
    "p4_p8_path_rules",
    f"""WITH odd AS ({_ODD})
    SELECT id, path,
      regexp_matches(path, '/\\.git/|/~\\$|sync-conflict|/Briefings/') OR (contains(path, '/.summaries/') AND NOT starts_with(path, 'inbox/')) AS excluded,
      regexp_matches(path, '^(Projects|Domain)/[^/]+/attachment/') AS managed_attachment,
      starts_with(path, 'inbox/') OR regexp_matches(path, '^(Projects|Domain)/[^/]+/(attachment|\\.summaries)/') AS managed_summaries,
      regexp_matches(path, '^Projects/[^/]+$') AS misplaced,
      regexp_matches(path, '^inbox/d/|/\\.git/') AS in_batch_folder
    FROM odd""",
)
def _(t):
    p = F.col("path")
    return _odd_paths(t).select(
        "id", "path",
        paths.is_excluded(p).alias("excluded"),
        paths.is_managed_attachment(p).alias("managed_attachment"),
        paths.is_managed_summaries(p).alias("managed_summaries"),
        paths.is_misplaced(p).alias("misplaced"),
        paths.is_batch_folder(paths.parent(p)).alias("in_batch_folder"),
    )


@query(
    "p7_ignore_patterns",
    "SELECT id FROM docs WHERE NOT list_contains(string_split(vault_path, '/'), 'chat') AND NOT regexp_matches(vault_path, '(^|/)1[^/]*\\.md$')",
)
def _(t):
    return t.documents.filter(~paths.matches_ignore(F.col("vault_path"), ["chat", "1*.md"])).select("id")


@query(
    "p9_placement",
    """SELECT id, final_dir, final_dir || '/.summaries' AS sibling_dir, regexp_replace(path, '/[^/]*$', '') <> final_dir AS needs_move FROM (
         SELECT id, CASE WHEN mime_type = 'image/png' THEN 'Projects/' || key_topics[2] || '/attachment' ELSE 'Projects/' || key_topics[2] END AS final_dir,
           CASE WHEN mime_type = 'image/png' THEN replace(vault_path, '.md', '.png') ELSE vault_path END AS path FROM docs) x""",
)
def _(t):
    path = F.when(F.col("mime_type") == "image/png", F.replace("vault_path", F.lit(".md"), F.lit(".png"))).otherwise(F.col("vault_path"))
    p = paths.placement(path, F.lit("project"), F.col("key_topics")[1])
    return t.documents.select("id", p.alias("p")).select("id", "p.*")


@query(
    "p10_route",
    """SELECT CASE WHEN confidence >= 0.85::DOUBLE THEN 'AUTO' WHEN confidence >= 0.6::DOUBLE THEN 'SUGGEST' ELSE 'CLUELESS' END AS route,
      CASE WHEN confidence >= 0.85::DOUBLE THEN 'confident' ELSE 'pending' END AS status, count(*) AS cnt FROM entries GROUP BY ALL""",
)
def _(t):
    c = F.col("confidence")
    return t.entries.groupBy(quality.route(c).alias("route"), quality.status_of(c).alias("status")).agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "p11_choose_content",
    """SELECT id, sha256(CASE WHEN full_body <> '' THEN full_body ELSE coalesce(summary, '') END) AS content,
      length(CASE WHEN full_body <> '' THEN full_body ELSE coalesce(summary, '') END) // 4 < 500 AS fits FROM docs""",
)
def _(t):
    return filters.choose_content(t.documents, 500).select("id", F.sha2("content", 256).alias("content"), "fits")


_REQUESTS = "SELECT conv_id AS request_id, unnest(list(turn * 7 + conv_id ORDER BY turn)) AS id, unnest(range(count(*))) AS pos FROM conversations GROUP BY conv_id"


@query(
    "p12_resolve",
    f"""SELECT request_id, pos, r.id, sha256(coalesce(full_body, summary, '[Summary pending]')) AS content,
        full_body IS NULL AS degraded FROM ({_REQUESTS}) r JOIN docs ON docs.id = r.id""",
)
def _(t):
    """Each conversation asks for the documents its turns name."""
    asked = t.conversations.groupBy(F.col("conv_id").alias("request_id")).agg(
        F.transform(F.sort_array(F.collect_list("turn")), lambda n: n * 7).alias("ids")
    ).withColumn("ids", F.transform("ids", lambda n: n + F.col("request_id")))
    rows = filters.resolve(t.documents, asked, "text")
    return rows.select("request_id", F.col("pos").cast("long").alias("pos"), "id", F.sha2("content", 256).alias("content"), "degraded")


@query(
    "p13_describable",
    """SELECT CASE WHEN mime_type NOT LIKE 'image/%' THEN 'unsupported type' WHEN file_size_bytes > 3000 THEN 'too big' ELSE 'ok' END AS outcome,
      count(*) AS cnt FROM docs GROUP BY ALL""",
)
def _(t):
    outcome = quality.describable(F.col("mime_type"), F.col("file_size_bytes"), max_bytes=3000)
    return t.documents.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "p14_valid_paths",
    """SELECT id, CASE WHEN path = '' THEN 'empty path' WHEN starts_with(path, '/') THEN 'absolute path'
      WHEN list_contains(string_split(path, '/'), '..') THEN 'parent component in path' END AS reason
      FROM (SELECT id, CASE WHEN status = 'retired' THEN '/' || entity WHEN status IS NULL THEN 'a/../' || entity ELSE entity END AS path FROM entries) x""",
)
def _(t):
    e, s = F.col("entity"), F.col("status")
    path = F.when(s == "retired", F.concat(F.lit("/"), e)).when(s.isNull(), F.concat(F.lit("a/../"), e)).otherwise(e)
    ok, bad = paths.split_valid_paths(t.entries.select("id", path.alias("vault_path")))
    return ok.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "reason"))


@query(
    "p15_embedding_text",
    """SELECT id, sha256('title: ' || title || ' | type: ' || coalesce(note_type, 'None') || ' | tags: ' || array_to_string(key_topics, ', ')
      || CASE WHEN coalesce(summary, '') <> '' THEN ' | ' || summary ELSE '' END) AS text FROM docs""",
)
def _(t):
    line = text.embedding_text(F.col("title"), F.col("note_type"), F.col("key_topics"), F.col("summary"))
    return t.documents.select("id", F.sha2(line, 256).alias("text"))


@query(
    "p16_topics_and_title",
    "SELECT id, key_topics[2] AS topics, coalesce(note_type, id::VARCHAR) AS title FROM docs",
)
def _(t):
    tags = F.array(F.concat(F.lit("domain/"), F.col("key_topics")[0]), F.col("key_topics")[1], F.concat(F.lit("type/"), "note_type"))
    tags = F.filter(tags, lambda x: x.isNotNull())
    return t.documents.select(
        "id", F.array_join(text.derive_topics(tags), ",").alias("topics"),
        text.derive_title(F.lit(""), F.col("note_type"), F.col("vault_path")).alias("title"),
    )


@query(
    "p17_audit_tags",
    """SELECT id, CASE WHEN dimension IN ('en', 'fr') THEN 'type/' || dimension || ',' ELSE '' END ||
        CASE WHEN entity = '' OR regexp_matches(entity, '^[0-9]+$') THEN '' ELSE entity || ',' END ||
        CASE WHEN tag IN ('src1', 'src2') THEN 'domain/' || tag ELSE '' END AS valid,
      (CASE WHEN dimension IN ('en', 'fr') THEN 0 ELSE 2 END + CASE WHEN entity = '' OR regexp_matches(entity, '^[0-9]+$') THEN 1 ELSE 0 END
        + CASE WHEN tag IN ('src1', 'src2') THEN 0 ELSE 1 END + 2)::BIGINT AS n_violations FROM entries""",
)
def _(t):
    """Tags made from each fact: a type, its first word, a domain and two bad ones."""
    tags = F.array(
        F.concat(F.lit("type/"), "dimension"), F.col("entity"), F.concat(F.lit("domain/"), "tag"), F.lit("a b"), F.lit("x/y")
    )
    out = quality.audit_tags(t.entries.select("id", tags.alias("tags")), ["en", "fr"], ["src1", "src2"])
    kept = F.concat(
        F.array_join(F.transform(F.filter("valid", lambda v: ~v.startswith("domain/")), lambda v: F.concat(v, F.lit(","))), ""),
        F.array_join(F.filter("valid", lambda v: v.startswith("domain/")), ""),
    )
    return out.select("id", kept.alias("valid"), F.size("violations").cast("long").alias("n_violations"))


@query(
    "p18_fact_tags",
    """SELECT coalesce(reason, 'ok') AS outcome, count(*) AS cnt FROM (
      SELECT CASE WHEN dimension NOT IN ('en', 'fr', 'it') THEN 'unknown dimension'
        WHEN dimension = 'en' AND tag NOT IN ('src0', 'src1', 'src2', 'src3') THEN 'unknown tag'
        WHEN dimension = 'fr' AND tag NOT IN ('src4', 'src5', 'src6', 'src7') THEN 'unknown tag' END AS reason FROM entries) x GROUP BY ALL""",
)
def _(t):
    ok, bad = quality.validate_fact_tags(t.entries, RULEBOOK)
    rows = ok.select(F.lit("ok").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome")))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "p19_rename_plan",
    """WITH f AS (SELECT id, entity AS stem, tag || ': ' || dimension AS title, 'inbox/' || entity || '.md' AS path FROM entries WHERE entity <> ''),
      known AS (SELECT DISTINCT 'inbox/' || lower(split_part(url, '/', 4)) || '.md' AS path FROM pages)
    SELECT id, CASE c WHEN 'generic' THEN 'AUGMENT' WHEN 'illegible' THEN 'FULL_RENAME' ELSE 'SKIP' END AS action,
      CASE c WHEN 'generic' THEN stem || ' - ' || replace(title, ':', '') WHEN 'illegible' THEN replace(title, ':', '') ELSE stem END AS final_stem, c AS reason,
      CASE c WHEN 'existing' THEN 1.0::DOUBLE WHEN 'illegible' THEN 0.9::DOUBLE WHEN 'generic' THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS confidence
    FROM (SELECT f.*, CASE WHEN k.path IS NOT NULL THEN 'existing'
      WHEN stem IN ('untitled', 'notes', 'note', 'meeting', 'draft', 'scratch', 'temp', 'tmp', 'document', 'file', 'inbox', 'todo', 'wip') THEN 'generic'
      WHEN length(stem) <= 2 OR regexp_matches(stem, '^[0-9a-fA-F]{6,}$') OR NOT regexp_matches(stem, '[a-zA-Z]{3,}')
        OR len(list_filter(regexp_extract_all(stem, '[a-zA-Z]{3,}'), lambda w: regexp_matches(w, '[aeiouAEIOU]'))) = 0 THEN 'illegible'
      ELSE 'unclear' END AS c FROM f LEFT JOIN known k ON f.path = k.path) x""",
)
def _(t):
    """Every fact's first word as a file name; page languages stand for known files."""
    to_path = lambda c: F.concat(F.lit("inbox/"), c, F.lit(".md"))
    named = t.entries.filter(F.col("entity") != "").select(
        "id", to_path(F.col("entity")).alias("vault_path"), F.concat("tag", F.lit(": "), "dimension").alias("title")
    )
    known = t.pages.select(to_path(F.lower(F.split_part("url", F.lit("/"), F.lit(4)))).alias("vault_path"))
    return quality.rename_plan(named, known).select("id", "action", "final_stem", "reason", "confidence")


@query(
    "p20_query_audit",
    f"""SELECT id, stage, outcome, {stamp_sql('timestamp')} FROM audit WHERE timestamp::DATE = DATE '2024-01-05' AND pipeline = 'classify'
        ORDER BY id""",
)
def _(t):
    """All audit rows of one day and pipeline, in the order of their ids; there is no default limit."""
    rows = filters.query_audit(t.audit, date="2024-01-05", pipeline="classify")
    return rows.select("id", "stage", "outcome", stamp("timestamp"))


@query("p21_entries_by", "SELECT id, dimension, entity, tag FROM entries WHERE entity = 'the' AND status <> 'retired'")
def _(t):
    return filters.entries_by(t.entries, entity="the", active_only=True).select("id", "dimension", "entity", "tag")


@query(
    "p22_unclassified",
    """SELECT id FROM catalog WHERE (classify_content_hash IS NULL OR classify_content_hash <> content_hash)
      AND (status IS NULL OR status <> 'needs-review')""",
)
def _(t):
    return filters.find_unclassified(t.catalog).select("id")


@query("t1_listing", f"SELECT id, vault_path, {stamp_sql('updated_at')} FROM docs ORDER BY docs.updated_at DESC, id LIMIT 10")
def _(t):
    return filters.listing(t.documents).select("id", "vault_path", stamp("updated_at"))


@query(
    "w5_latest_batch",
    """SELECT tag AS folder_path, arg_max(id, (updated_at, id)) AS batch_id FROM entries GROUP BY tag""",
)
def _(t):
    batches = t.entries.select(F.col("tag").alias("folder_path"), F.col("updated_at").alias("created_at"), F.col("id").alias("batch_id"))
    return filters.latest_batches(batches)


@query(
    "w6_first_occurrence",
    """SELECT coalesce(id, -1) AS id, pos FROM (SELECT user_id AS id, min(event_id) AS pos FROM events WHERE event_type <> 'signup' GROUP BY user_id
      UNION ALL SELECT NULL, event_id FROM events WHERE event_type = 'signup') x""",
)
def _(t):
    shown = t.events.select(F.when(F.col("event_type") != "signup", F.col("user_id")).alias("id"), F.col("event_id").alias("pos"))
    return filters.first_occurrence(shown).select(F.coalesce("id", F.lit(-1)).alias("id"), "pos")


@query(
    "w7_last_write",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq, min(event_id) AS first_seq FROM events GROUP BY user_id",
)
def _(t):
    return filters.last_write(t.events.select("user_id", "event_type", F.col("event_id").alias("seq")), "user_id", "seq")


@query(
    "f1_extract_urls",
    r"""SELECT page_id, pos::BIGINT AS pos, url FROM (SELECT page_id, unnest(urls) AS url, unnest(range(len(urls))) AS pos FROM (
      SELECT page_id, list_filter(list_transform(u, lambda x, i: CASE WHEN list_position(u, x) = i THEN x END), lambda x: x IS NOT NULL AND x <> '') AS urls FROM (
      SELECT page_id, list_transform(regexp_extract_all(doc, 'https?://[^\s\)\]\>"]+'), lambda x: rtrim(x, '.,;:!?')) AS u
      FROM (SELECT page_id, url || ' ' || html || ' (' || url || ').' AS doc FROM pages) y) z) w) v""",
)
def _(t):
    doc = F.concat("url", F.lit(" "), "html", F.lit(" ("), "url", F.lit(")."))
    links = t.pages.select("page_id", F.posexplode(text.extract_urls(doc)).alias("pos", "url"))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), "url")


@query(
    "f2_video_links",
    r"""SELECT page_id, page_id % 2 = 0 OR regexp_extract(url, '^https?://([^/?#]*)', 1) = 'youtu.be' AS is_video,
      CASE WHEN page_id % 2 = 0 THEN 'v' || page_id END AS video_id FROM pages""",
)
def _(t):
    """Page links turned into watch links for even pages."""
    watch = F.concat(F.lit("https://www.youtube.com/watch?x=1&v=v"), F.col("page_id").cast("string"))
    url = F.when(F.col("page_id") % 2 == 0, watch).otherwise(F.col("url"))
    return t.pages.select("page_id", text.is_video_link(url).alias("is_video"), text.video_id(url).alias("video_id"))


@query(
    "f3_slug",
    """SELECT id, left(trim(regexp_replace(lower(fact), '[^a-z0-9]+', '-', 'g'), '-'), 50) AS slug FROM entries""",
)
def _(t):
    return t.entries.select("id", text.slug(F.col("fact")).alias("slug"))


@query(
    "f4_split_summary",
    r"""SELECT doc_id, sha256(CASE WHEN source = 'src1' THEN body ELSE s END) AS summary, CASE WHEN source = 'src1' THEN 'Untitled' ELSE lang || ' note' END AS title
      FROM (SELECT doc_id, lang, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s,
        regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents) x""",
)
def _(t):
    """Every document as a reply, with a closing title line except for one source."""
    reply = F.when(F.col("source") == "src1", F.col("text")).otherwise(F.concat("text", F.lit("\nTitle: "), "lang", F.lit(" note\n")))
    s = t.raw("documents").select("doc_id", text.split_summary(reply).alias("s"))
    return s.select("doc_id", F.sha2("s.summary", 256).alias("summary"), "s.title")


@query("f5_tag_segment", "SELECT id, replace(title, ' ', '-') AS segment FROM docs")
def _(t):
    return t.documents.select("id", text.tag_segment(F.col("title")).alias("segment"))


@query(
    "f6_safe_stem",
    r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(fact), '[/\\:*?"<>|]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS stem FROM entries""",
)
def _(t):
    clean = t.entries.select("id", text.nfc(F.col("fact")).alias("fact"))
    return clean.select("id", text.safe_stem(F.col("fact")).alias("stem"))


@query("f7_note_hash", r"SELECT id, sha256(regexp_replace(full_body, '\n+$', '')) AS hash FROM docs")
def _(t):
    return t.documents.select("id", text.note_hash(F.col("full_body")).alias("hash"))


@query(
    "f9_iso_week",
    "SELECT strftime(ts, '%G-W%V') AS week, count(*) AS cnt FROM events GROUP BY ALL",
)
def _(t):
    return t.events.groupBy(text.iso_week(F.col("ts")).alias("week")).agg(F.count(F.lit(1)).alias("cnt"))


@query("f10_token_estimate", "SELECT id, length(full_body) // 4 AS tokens FROM docs")
def _(t):
    return t.documents.select("id", text.token_estimate(F.col("full_body")).alias("tokens"))


@query(
    "f12_extra_keys",
    "SELECT source AS source, count(*) AS cnt, 'yes' AS pinned, count(DISTINCT lang) AS n_lang FROM documents GROUP BY source",
)
def _(t):
    """Unknown front-matter keys: kept as text, booleans as yes / no, retired keys dropped."""
    head = F.concat(
        F.lit("---\nsrc: "), "source", F.lit("\nlng: "), "lang", F.lit("\npinned: true\ndomain: "), "lang", F.lit("\n---\n")
    )
    raw = t.raw("documents").select(F.col("doc_id").cast("string").alias("vault_path"), F.encode(F.concat(head, "text"), "utf-8").alias("content"))
    notes, _rejects = files.parse_notes(raw)
    extra = files.output_extra(F.col("extra"))
    rows = notes.select(extra["src"].alias("source"), extra["lng"].alias("lng"), extra["pinned"].alias("pinned"), extra["domain"].alias("old"))
    return rows.filter(F.col("old").isNull()).groupBy("source", "pinned").agg(
        F.count(F.lit(1)).alias("cnt"), F.countDistinct("lng").alias("n_lang")
    )


@query("tokens_per_document", f"SELECT id, len({tokens_sql('full_body')}) AS n FROM docs")
def _(t):
    return t.documents.select("id", F.size(text.tokens(F.col("full_body"))).cast("long").alias("n"))


@query(
    "r14_chat_insights",
    """SELECT 'chat/' || strftime(make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000), '%Y%m%d-%H%M%S') || '-' ||
      left(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '-', 'g'), '-'), 50)
      || CASE WHEN length(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '-', 'g'), '-')) > 50
           THEN '-' || left(sha256(split_part(text, chr(10), 1)), 16) ELSE '' END || '.md' AS vault_path,
      sha256(text) AS content_hash FROM conversations""",
)
def _(t):
    turns = t.conversations.select(
        "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title_hint"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 60 + F.col("turn")).alias("ts"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )
    return state.chat_insights(turns).select("vault_path", "content_hash")
