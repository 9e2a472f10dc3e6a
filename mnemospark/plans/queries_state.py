"""Registered queries: catalog transitions, fact actions, corrections, reports, reconcile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import facts, folds, learning, reconcile, reports, state
from mnemospark.plans.classify import classify_pass
from mnemospark.plans.queries_rows import stamp, stamp_sql
from mnemospark.plans.registry import query
from mnemospark.session import scratch_folder
from mnemospark.sources import tables
from mnemospark.streaming import events as ev
from mnemospark.streaming import jobs

NOW = "2024-03-01 00:00:00"


# --- catalog transitions -------------------------------------------------------

_UPLOADS = """SELECT d.id, d.vault_path, d.full_body, d.content_hash, 2 AS seq FROM docs d JOIN labels l ON l.doc_id = d.id
    UNION ALL SELECT id, vault_path, 'draft', sha256('draft'), 1 FROM docs WHERE vault_path LIKE 'Domain/%'
    UNION ALL SELECT c.conv_id, 'chat/c' || c.conv_id || '.md', c.text, sha256(c.text), 10 + c.turn FROM conversations c"""


def _uploads(t):
    """Labelled documents again, Domain documents as drafts, and conversation turns on
    one path per conversation."""
    labelled = t.documents.join(t.raw("labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    again = labelled.select("vault_path", "full_body", "content_hash", F.lit(2).cast("long").alias("seq"))
    drafts = t.documents.filter(F.col("vault_path").startswith("Domain/")).select(
        "vault_path", F.lit("draft").alias("full_body"), F.sha2(F.lit("draft"), 256).alias("content_hash"), F.lit(1).cast("long").alias("seq")
    )
    turns = t.conversations.select(
        F.concat(F.lit("chat/c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("vault_path"),
        F.col("text").alias("full_body"), F.sha2("text", 256).alias("content_hash"), (F.col("turn") + 10).alias("seq"),
    )
    return again.unionByName(drafts).unionByName(turns)


@query(
    "r1_upsert_uploads",
    f"""WITH up AS ({_UPLOADS}),
      last AS (SELECT vault_path, arg_max(content_hash, seq) AS h, max(seq) AS seq, min(seq) AS first_seq,
        count(*) AS n FROM (SELECT u.*, d.content_hash AS stored, lag(u.content_hash) OVER (PARTITION BY u.vault_path ORDER BY seq) AS prev
          FROM up u LEFT JOIN docs d ON d.vault_path = u.vault_path) x WHERE content_hash IS DISTINCT FROM coalesce(prev, stored) GROUP BY vault_path)
    SELECT coalesce(d.id, (SELECT max(id) FROM docs) + row_number() OVER (PARTITION BY d.id IS NULL ORDER BY l.first_seq, l.vault_path)) AS id,
      coalesce(d.vault_path, l.vault_path) AS vault_path, coalesce(l.h, d.content_hash) AS content_hash,
      CASE WHEN l.vault_path IS NULL THEN 'unchanged' WHEN d.id IS NULL THEN 'inserted' ELSE 'updated' END AS action,
      coalesce(d.title, regexp_replace(split_part(l.vault_path, '/', -1), '\\.md$', '')) AS title,
      strftime(CASE WHEN l.vault_path IS NULL THEN d.updated_at ELSE TIMESTAMP '{NOW}' END, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM docs d FULL JOIN last l ON d.vault_path = l.vault_path""",
)
def _(t):
    out = state.upsert_uploads(t.documents, _uploads(t), now=NOW)
    return out.select("id", "vault_path", "content_hash", "action", "title", stamp("updated_at"))


@query(
    "r2_attach_summaries",
    """SELECT d.id, sha256(coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'summary ' || l.quality END, d.summary, '-')) AS summary,
      CASE WHEN l.doc_id IS NOT NULL THEN 'title ' || l.toxic ELSE d.title END AS title FROM docs d LEFT JOIN labels l ON l.doc_id = d.id""",
)
def _(t):
    lab = t.raw("labels").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("summary "), F.col("quality").cast("string")).alias("summary"),
        F.concat(F.lit("title "), F.col("toxic").cast("string")).alias("title"),
    )
    summaries = lab.join(t.documents.select("id", "vault_path"), "id").drop("id")
    docs, _unknown = state.attach_summaries(t.documents, summaries)
    return docs.select("id", F.sha2(F.coalesce("summary", F.lit("-")), 256).alias("summary"), "title")


@query(
    "r3_rename_paths",
    """WITH m AS (SELECT vault_path AS old_path, 'Archive/' || content_hash || '.md' AS new_path FROM docs),
      g AS (SELECT new_path, min(old_path) AS old_path FROM m GROUP BY new_path)
    SELECT id, coalesce(g.new_path, d.vault_path) AS vault_path FROM docs d LEFT JOIN g ON g.old_path = d.vault_path""",
)
def _(t):
    """Name every document after its hash; of identical documents only one can move."""
    moves = t.documents.select(
        F.col("vault_path").alias("old_path"), F.concat(F.lit("Archive/"), "content_hash", F.lit(".md")).alias("new_path")
    )
    docs, _refused = state.rename_paths(t.documents, moves)
    return docs.select("id", "vault_path")


def _inbox_deleted(t):
    return state.delete_paths(t.documents, t.entries, t.documents.filter(F.col("vault_path").startswith("inbox/")).select("vault_path"))


@query(
    "r4_delete_entries",
    """SELECT e.id, CASE WHEN gone THEN 'pending' ELSE e.status END AS status, CASE WHEN gone THEN 0 ELSE 1 END::BIGINT AS n_sources
      FROM (SELECT e.*, starts_with(d.vault_path, 'inbox/') AND e.status IS DISTINCT FROM 'retired' AS gone FROM entries e JOIN docs d ON d.id = e.doc_id) e""",
)
def _(t):
    """Entries after all inbox documents are deleted."""
    return _inbox_deleted(t).entries.select("id", "status", F.size("sources").cast("long").alias("n_sources"))


@query(
    "r4_orphan_blobs",
    """SELECT DISTINCT blob_ref FROM docs WHERE starts_with(vault_path, 'inbox/')
      AND blob_ref NOT IN (SELECT blob_ref FROM docs WHERE NOT starts_with(vault_path, 'inbox/'))""",
)
def _(t):
    return _inbox_deleted(t).orphan_blobs


@query(
    "j11_orphan_blobs",
    "SELECT DISTINCT 'blobs/' || sha256(text) AS blob_ref FROM conversations WHERE sha256(text) NOT IN (SELECT content_hash FROM docs)",
)
def _(t):
    blobs = t.conversations.select(F.concat(F.lit("blobs/"), F.sha2("text", 256)).alias("blob_ref"))
    return state.orphan_blobs(blobs, t.documents)


@query("a9_blob_refcounts", "SELECT blob_ref, count(*) AS cnt FROM docs GROUP BY blob_ref")
def _(t):
    return state.blob_refcounts(t.documents)


@query(
    "r5_replace_paths",
    """SELECT id, vault_path, title FROM docs WHERE id NOT IN (SELECT doc_id FROM labels) UNION ALL
      SELECT (SELECT max(id) FROM docs) + row_number() OVER (ORDER BY d.id, d.vault_path), 'new/' || d.id || '.md', d.id::VARCHAR
      FROM docs d JOIN labels l ON l.doc_id = d.id""",
)
def _(t):
    labelled = t.documents.join(t.raw("labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    rows = labelled.select(
        F.col("vault_path").alias("old_path"), F.concat(F.lit("new/"), F.col("id").cast("string"), F.lit(".md")).alias("vault_path"),
        F.lit("").alias("title"), F.col("key_topics").alias("tags"), "full_body", "content_hash", F.col("id").alias("seq"),
    )
    return state.replace_paths(t.documents, rows, now=NOW).select("id", "vault_path", "title")


@query(
    "r6_apply_outcomes",
    """WITH o AS (SELECT conv_id AS doc_id, role, turn, length(text) % 3 <> 0 AS clean FROM conversations),
      p AS (SELECT doc_id, bool_and(clean) AS clean, string_agg('e' || turn, '; ' ORDER BY role, 'e' || turn) FILTER (NOT clean) AS err FROM o GROUP BY doc_id)
    SELECT c.id, coalesce(CASE WHEN p.clean THEN content_hash ELSE classify_content_hash END, '-') AS classify_content_hash,
      CASE WHEN p.clean THEN 0 WHEN NOT p.clean THEN classify_attempts + 1 ELSE classify_attempts END::BIGINT AS classify_attempts,
      coalesce(CASE WHEN NOT p.clean THEN p.err END, '-') AS classify_last_error,
      coalesce(CASE WHEN NOT p.clean AND classify_attempts + 1 >= 2 THEN 'needs-review' ELSE c.status END, '-') AS status
    FROM catalog c LEFT JOIN p ON p.doc_id = c.id""",
)
def _(t):
    """Conversation turns as per-dimension outcomes, documents parked at two attempts."""
    outcomes = t.conversations.select(
        F.col("conv_id").alias("doc_id"), F.col("role").alias("dimension"), (F.length("text") % 3 != 0).alias("clean"),
        F.concat(F.lit("e"), F.col("turn").cast("string")).alias("error"),
    )
    docs = t.catalog.withColumn("classify_last_error", F.lit(None).cast("string"))
    out = state.apply_outcomes(docs, outcomes, retries=2)
    text = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return out.select(
        "id", text("classify_content_hash"), F.col("classify_attempts").cast("long").alias("classify_attempts"),
        text("classify_last_error"), text("status"),
    )


@query(
    "r6_work_state",
    "SELECT coalesce(status, '-') AS status, classify_attempts::BIGINT AS classify_attempts, classify_content_hash IS NOT DISTINCT FROM content_hash AS stamped, count(*) AS cnt FROM catalog GROUP BY ALL",
)
def _(t):
    rows = state.work_state(t.catalog.withColumn("classify_last_error", F.lit(None).cast("string")))
    stamped = F.col("classify_content_hash").eqNullSafe(F.col("content_hash")).alias("stamped")
    keys = [F.coalesce("status", F.lit("-")).alias("status"), F.col("classify_attempts").cast("long").alias("classify_attempts"), stamped]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "r11_comments",
    """SELECT c.id, c.entry_id, e.id IS NOT NULL AS accepted FROM comments c LEFT JOIN entries e ON e.id = c.entry_id AND e.status IS NOT NULL""",
)
def _(t):
    """Comments on entries that have a status; the others are refused."""
    known = t.entries.filter(F.col("status").isNotNull())
    none_yet = t.comments.limit(0)
    kept, rejects = state.append_comments(none_yet, t.comments, known)
    return kept.select("id", "entry_id", F.lit(True).alias("accepted")).unionByName(rejects.select("id", "entry_id", F.lit(False).alias("accepted")))


_NESTED = "CASE WHEN starts_with(vault_path, 'inbox/') THEN 'inbox/' || key_topics[2] || '/' || id || '.md' ELSE replace(vault_path, '/' || id, '/drop/' || id) END"


@query(
    "r12_folder_batches",
    f"""SELECT folder_path, split_part(folder_path, '/', -1) AS folder_name, CASE split_part(folder_path, '/', 1) WHEN 'inbox' THEN 'inbox' WHEN 'Projects' THEN 'project' ELSE 'domain' END AS destination_type,
      coalesce(CASE WHEN NOT starts_with(folder_path, 'inbox') THEN split_part(folder_path, '/', 2) END, '-') AS destination_name, file_count, last_id FROM (
      SELECT regexp_replace(p, '/[^/]*$', '') AS folder_path, count(*) AS file_count, max(batch_id) AS last_id FROM (
        SELECT {_NESTED} AS p, (md5(key_topics[2]) < 'z')::INT AS batch_id, vault_path FROM docs) x WHERE vault_path NOT LIKE 'chat/%' GROUP BY 1) y""",
)
def _(t):
    nested = F.when(
        F.col("vault_path").startswith("inbox/"), F.concat(F.lit("inbox/"), F.col("key_topics")[1], F.lit("/"), F.col("id").cast("string"), F.lit(".md"))
    ).otherwise(F.regexp_replace("vault_path", "/([0-9]+[.]md)$", "/drop/$1"))
    docs = t.documents.withColumn("vault_path", nested)
    batches = state.folder_batches(docs).withColumn("batch_id", F.lit(1)).withColumn("created_at", F.lit(NOW).cast("timestamp"))
    stamped = state.stamp_batches(docs, batches).groupBy(F.regexp_extract("vault_path", r"^(.*)/[^/]*$", 1).alias("folder_path")).agg(
        F.max("batch_id").cast("int").alias("last_id")
    )
    return batches.join(stamped, "folder_path").select(
        "folder_path", "folder_name", "destination_type", F.coalesce("destination_name", F.lit("-")).alias("destination_name"), "file_count", "last_id"
    )


# --- facts ---------------------------------------------------------------------


@query("j5_twins", "SELECT dimension, entity, tag, min(id) AS twin_id FROM entries WHERE status IS DISTINCT FROM 'retired' GROUP BY ALL")
def _(t):
    return facts.twins(t.entries)


@query(
    "j5_attach_twins",
    """SELECT c.conv_id, c.turn, coalesce(w.twin_id, -1) AS twin_id FROM (SELECT *, regexp_extract(lower(text), '[\\p{L}\\p{N}]+') AS entity FROM conversations) c
      LEFT JOIN (SELECT dimension, entity, tag, min(id) AS twin_id FROM entries WHERE status IS DISTINCT FROM 'retired' GROUP BY ALL) w
      ON w.dimension = 'en' AND w.entity = c.entity AND w.tag = 'src' || c.turn""",
)
def _(t):
    rows = t.conversations.select(
        "conv_id", "turn", F.lit("en").alias("dimension"), F.regexp_extract(F.lower("text"), r"[\p{L}\p{N}]+", 0).alias("entity"),
        F.concat(F.lit("src"), F.col("turn").cast("string")).alias("tag"),
    )
    return facts.attach_twins(rows, t.entries).select("conv_id", "turn", F.coalesce("twin_id", F.lit(-1)).alias("twin_id"))


@query("r8_retire", "SELECT e.id, CASE WHEN c.entry_id IS NOT NULL THEN 'retired' ELSE status END AS status, CASE WHEN c.entry_id IS NOT NULL THEN c.r ELSE '' END AS reasoning FROM entries e LEFT JOIN (SELECT entry_id, last(comment_text ORDER BY created_at, id) AS r FROM comments GROUP BY entry_id) c ON c.entry_id = e.id")
def _(t):
    out = facts.retire(t.entries, t.comments.select(F.col("entry_id").alias("id"), F.col("comment_text").alias("reason"), F.struct("created_at", "id").alias("seq")))
    return out.select("id", "status", "reasoning")


@query(
    "r13_upsert_entries",
    """SELECT e.id, CASE WHEN c.id IS NULL THEN e.status WHEN c.conf >= 0.85::DOUBLE THEN 'confident' ELSE 'pending' END AS status,
      coalesce(c.conf, e.confidence) AS confidence, e.retrieval_score FROM entries e LEFT JOIN (
      SELECT user_id * 4294967296 AS id, max((value / 100)::DOUBLE) AS conf FROM events GROUP BY user_id) c ON c.id = e.id""",
)
def _(t):
    rows = t.events.groupBy((F.col("user_id") * 4294967296).alias("id")).agg(F.max(F.col("value") / 100).alias("confidence"))
    rows = rows.withColumn("status", F.lit(None).cast("string")).withColumn("retrieval_score", F.lit(99.0))
    return facts.upsert_entries(t.entries, rows).select("id", "status", "confidence", "retrieval_score")


@query("u4_merge_sources", "SELECT e.id, e.doc_id || CASE WHEN l.doc_id % 2 = 1 THEN ',' || (l.doc_id - 1) ELSE '' END AS sources FROM entries e JOIN labels l ON l.doc_id = e.doc_id")
def _(t):
    lab = t.raw("labels")
    rows = t.entries.withColumn("doc_id", F.floor(F.col("id") / 4294967296)).join(lab, "doc_id")
    other = F.when(F.col("doc_id") % 2 == 1, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return rows.select("id", F.array_join(facts.merge_source(F.col("sources"), other), ",").alias("sources"))


@query(
    "u5_prune_sources",
    """SELECT e.id, CASE WHEN gone THEN 'pending' ELSE status END AS status, CASE WHEN gone THEN '' ELSE doc_id::VARCHAR END AS sources
      FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels) AND status IS DISTINCT FROM 'retired' AS gone FROM entries) e""",
)
def _(t):
    out = facts.prune_sources(t.entries, t.raw("labels").select(F.col("doc_id").alias("id")))
    return out.select("id", "status", F.array_join("sources", ",").alias("sources"))


def _replies(t):
    """Conversation turns as extractor replies, some of them broken."""
    conf = F.format_string("0.%02d", F.length("text") % 100)
    new = F.concat(
        F.lit('{"action":"new","entity":"'), F.regexp_extract(F.lower("text"), r"[\p{L}\p{N}]+", 0), F.lit('","tag":"t","fact":"f '),
        F.col("turn").cast("string"), F.lit('","confidence":'), conf, F.lit("}"),
    )
    update = F.concat(F.lit('{"action":"update","id":'), F.col("conv_id").cast("string"), F.lit(',"entity":"e","tag":"t","fact":"f","confidence":1.'), (F.length("text") % 2).cast("string"), F.lit("}"))
    item = F.when(F.col("role") == "user", new).when(F.col("role") == "assistant", update).otherwise('{"action":"retire","id":3}')
    n = F.length("text") % 7
    raw = (
        F.when(n == 0, F.concat(F.lit("["), item))
        .when(n == 1, item)
        .when(n == 2, F.concat(F.lit("["), item, F.lit(",3]")))
        .otherwise(F.concat(F.lit("["), item, F.lit(',{"action":"new","entity":"x","tag":"y","fact":"z","confidence":0.5}]')))
    )
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), F.col("conv_id").alias("doc_id"), F.lit("en").alias("dimension"), raw.alias("raw")
    )


_REPLIES = """SELECT conv_id * 1000 + turn AS reply_id, role, length(text) AS n, conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN 'JSON parse error'
    WHEN length(text) % 7 = 1 THEN 'reply must be a JSON array' WHEN length(text) % 7 = 2 THEN 'item[1] is not an object'
    WHEN role = 'system' THEN 'item[0] ''retire'' missing ''reason'''
    WHEN role = 'assistant' AND length(text) % 2 = 1 THEN 'item[0] confidence out of range [0.0, 1.0]'
    WHEN role = 'user' AND regexp_extract(lower(text), '[\\p{L}\\p{N}]+') = '' THEN 'item[0] ''new'' ''entity'' must not be empty' END AS reason FROM conversations"""


@query("r9_reply_rejects", f"SELECT reply_id, reason FROM ({_REPLIES}) x WHERE reason IS NOT NULL")
def _(t):
    _actions, rejects = facts.validate_replies(_replies(t))
    return rejects.select("reply_id", "reason")


@query(
    "r9_reply_actions",
    f"""WITH ok AS (SELECT * FROM ({_REPLIES}) x WHERE reason IS NULL)
    SELECT reply_id, 0 AS item_no, CASE role WHEN 'user' THEN 'new' ELSE 'update' END AS action, coalesce(CASE WHEN role = 'assistant' THEN conv_id END, -1) AS id,
      CASE role WHEN 'user' THEN 'f ' || turn ELSE 'f' END AS fact, CASE role WHEN 'user' THEN (n % 100) / 100::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM ok
    UNION ALL SELECT reply_id, 1, 'new', -1, 'z', 0.5::DOUBLE FROM ok""",
)
def _(t):
    actions, _rejects = facts.validate_replies(_replies(t))
    return actions.select("reply_id", "item_no", "action", F.coalesce("id", F.lit(-1)).alias("id"), "fact", "confidence")


def _actions(t):
    """Conversation turns as fact actions: users add, assistants update, systems retire."""
    role = F.col("role")
    first_word = F.regexp_extract(F.lower("text"), r"[\p{L}\p{N}]+", 0)
    return t.conversations.select(
        F.col("conv_id").alias("doc_id"), F.lit("en").alias("dimension"), F.col("turn").cast("int").alias("item_no"),
        F.when(role == "user", "new").when(role == "assistant", "update").otherwise("retire").alias("action"),
        F.when(role != "user", F.col("conv_id") * 4294967296).alias("id"),
        first_word.alias("entity"), F.concat(F.lit("src"), F.col("turn").cast("string")).alias("tag"), F.col("text").alias("fact"),
        ((F.length("text") % 100) / F.lit(100.0)).alias("confidence"),
        F.when(role == "system", "closed").alias("reason"),
    )


_ACTIONS = """acts AS (SELECT conv_id AS doc_id, turn AS item_no, CASE role WHEN 'user' THEN 'new' WHEN 'assistant' THEN 'update' ELSE 'retire' END AS action,
      CASE WHEN role <> 'user' THEN conv_id * 4294967296 END AS id, regexp_extract(lower(text), '[\\p{L}\\p{N}]+') AS entity, 'src' || turn AS tag, text AS fact,
      (length(text) % 100) / 100::DOUBLE AS confidence FROM conversations),
    known AS (SELECT id, trust_score > 0.5::DOUBLE AS guarded FROM entries),
    twin AS (SELECT dimension, entity, tag, min(id) AS twin_id FROM entries WHERE status IS DISTINCT FROM 'retired' GROUP BY ALL),
    aimed AS (SELECT a.*, CASE WHEN a.action = 'new' THEN w.twin_id ELSE k.id END AS target, CASE WHEN a.action = 'new' THEN kw.guarded ELSE k.guarded END AS guarded
      FROM acts a LEFT JOIN known k ON k.id = a.id LEFT JOIN twin w ON a.action = 'new' AND w.dimension = 'en' AND w.entity = a.entity AND w.tag = a.tag
      LEFT JOIN known kw ON kw.id = w.twin_id),
    good AS (SELECT *, last_value(CASE WHEN action = 'retire' THEN 'retired' WHEN action = 'update' AND NOT guarded THEN 'live' END IGNORE NULLS)
      OVER (PARTITION BY target ORDER BY doc_id, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM aimed WHERE action = 'new' OR target IS NOT NULL),
    placed AS (SELECT * REPLACE (CASE WHEN action = 'new' AND mark = 'retired' THEN NULL ELSE target END AS target,
      CASE WHEN action = 'new' AND mark = 'retired' THEN NULL ELSE guarded END AS guarded) FROM good),
    onrows AS (SELECT *, doc_id * 1000 + item_no AS o FROM placed WHERE target IS NOT NULL AND (action = 'retire' OR NOT guarded)),
    changed AS (SELECT target, arg_max(action, o) AS last_action, arg_max(fact, o) FILTER (action <> 'retire') AS fact,
      arg_max(confidence, o) FILTER (action <> 'retire') AS confidence, arg_max(entity, o) FILTER (action <> 'retire') AS entity,
      bool_or(action = 'retire') AS closed FROM onrows GROUP BY target),
    ins AS (SELECT entity, tag, arg_max(fact, doc_id * 1000 + item_no) AS fact, arg_max(confidence, doc_id * 1000 + item_no) AS confidence, NULL AS competes_with, min(doc_id * 1000 + item_no) AS o
        FROM placed WHERE action = 'new' AND target IS NULL GROUP BY ALL
      UNION ALL SELECT entity, tag, fact, confidence, target, doc_id * 1000 + item_no FROM placed WHERE guarded AND action <> 'retire'),
    numbered AS (SELECT *, (SELECT max(id) FROM entries) + row_number() OVER (ORDER BY o) AS id,
      CASE WHEN competes_with IS NOT NULL THEN 'pending' WHEN confidence >= 0.85::DOUBLE THEN 'confident' ELSE 'pending' END AS status FROM ins)"""


@query(
    "r7_apply_actions",
    f"""WITH {_ACTIONS} SELECT e.id, coalesce(c.entity, e.entity) AS entity, md5(coalesce(c.fact, e.fact)) AS fact, coalesce(c.confidence, e.confidence) AS confidence,
      CASE WHEN c.last_action = 'retire' THEN 'retired' WHEN c.last_action IS NULL THEN coalesce(e.status, '-') WHEN c.confidence >= 0.85::DOUBLE THEN 'confident' ELSE 'pending' END AS status,
      CASE WHEN c.closed THEN 'closed' ELSE '' END AS reasoning, e.trust_score FROM entries e LEFT JOIN changed c ON c.target = e.id
    UNION ALL SELECT id, entity, md5(fact), confidence, status, '', 0.5::DOUBLE FROM numbered""",
)
def _(t):
    out = facts.apply_actions(t.entries, _actions(t), now=NOW).entries
    return out.select("id", "entity", F.md5("fact").alias("fact"), "confidence", F.coalesce("status", F.lit("-")).alias("status"), "reasoning", "trust_score")


@query(
    "r7_source_links",
    f"""WITH {_ACTIONS} SELECT target AS entry_id, doc_id FROM onrows WHERE action <> 'retire'
      UNION SELECT n.id, p.doc_id FROM numbered n JOIN placed p ON n.competes_with IS NOT NULL AND p.doc_id * 1000 + p.item_no = n.o
      UNION SELECT n.id, p.doc_id FROM numbered n JOIN placed p ON n.competes_with IS NULL AND p.action = 'new' AND p.target IS NULL AND p.entity = n.entity AND p.tag = n.tag""",
)
def _(t):
    return facts.apply_actions(t.entries, _actions(t), now=NOW).links.select("entry_id", "doc_id")


@query(
    "r7_reply_outcomes",
    "SELECT conv_id AS doc_id, bool_and(e.id IS NOT NULL OR role = 'user') AS clean, count(*) FILTER (e.id IS NULL AND role <> 'user') AS n_skipped FROM conversations c LEFT JOIN entries e ON e.id = c.conv_id * 4294967296 GROUP BY conv_id",
)
def _(t):
    return facts.apply_actions(t.entries, _actions(t), now=NOW).replies.select("doc_id", "clean", "n_skipped")


# --- the classify pass ------------------------------------------------------------

_PASS = f"""told AS (SELECT conv_id, n % 7 = 3 OR (reason IS NULL AND (role <> 'assistant' OR conv_id IN (SELECT id FROM entries))) AS ok FROM ({_REPLIES}) x),
    outcome AS (SELECT conv_id AS id, bool_and(ok) AS clean FROM told GROUP BY conv_id)"""


def _classified(t):
    """A pass over the replies of :func:`_replies`, of which a seventh are empty lists; any failure parks a document."""
    empty = F.length("text") % 7 == 3
    ids = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), empty.alias("empty"))
    replies = _replies(t).join(ids, "reply_id").withColumn("raw", F.when(F.col("empty"), "[]").otherwise(F.col("raw"))).drop("empty")
    docs = t.catalog.withColumn("classify_last_error", F.lit(None).cast("string"))
    return classify_pass(docs, t.entries, replies, F.lit("run-1"), NOW, retries=1)


@query(
    "r7_classify_pass",
    f"""WITH {_PASS} SELECT c.id, CASE WHEN clean THEN content_hash ELSE classify_content_hash END AS stamp,
      CASE WHEN clean THEN 0 WHEN NOT clean THEN classify_attempts + 1 ELSE classify_attempts END AS classify_attempts,
      CASE WHEN NOT clean THEN 'needs-review' ELSE status END AS status FROM catalog c LEFT JOIN outcome o ON o.id = c.id""",
)
def _(t):
    """Work state of the documents after accepted, empty, rejected and unknown replies."""
    return _classified(t).documents.select("id", F.col("classify_content_hash").alias("stamp"), "classify_attempts", "status")


@query(
    "r16_classify_audit",
    f"""WITH {_PASS} SELECT id::VARCHAR AS source_id, 'en' AS decision, CASE WHEN clean THEN 'classify' ELSE 'needs-retry' END AS outcome FROM outcome""",
)
def _(t):
    rows = _classified(t).audit.filter("stage = 'extract'")
    return rows.select(F.col("source_ids")[0].alias("source_id"), "decision", "outcome")


@query(
    "r16_parked_audit",
    f"""WITH {_PASS} SELECT c.id::VARCHAR AS source_id, 'parked' AS outcome FROM catalog c JOIN outcome o ON o.id = c.id WHERE NOT clean AND status IS DISTINCT FROM 'needs-review'""",
)
def _(t):
    rows = _classified(t).audit.filter("stage = 'park'")
    return rows.select(F.col("source_ids")[0].alias("source_id"), "outcome")


@query("r16_failure_audit", "SELECT vault_path AS source_id, 'FAILED' AS outcome, 'larger than 10000 bytes' AS reasoning FROM docs WHERE file_size_bytes > 10000")
def _(t):
    """Files that were too large to take in."""
    large = t.documents.filter("file_size_bytes > 10000").select("vault_path", F.lit("larger than 10000 bytes").alias("reason"))
    rows = state.failure_audit(large, F.lit("run-1"), NOW)
    return rows.select(F.col("source_ids")[0].alias("source_id"), "outcome", "reasoning")


# --- learning --------------------------------------------------------------------


@query(
    "w8_decayed_scores",
    """WITH sweeps AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS ts FROM events),
      bumps AS (SELECT user_id * 4294967296 AS entry_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS later,
        (SELECT count(*) FROM sweeps s WHERE s.ts > e.ts) AS swept FROM events e WHERE event_type = 'click'),
      g AS (SELECT entry_id, count(*) AS n, sum(pow(0.95::DOUBLE, later + swept)) AS gain FROM bumps GROUP BY entry_id)
    SELECT e.id, round(e.retrieval_score * pow(0.95::DOUBLE, coalesce(g.n, 0) + (SELECT count(*) FROM sweeps)) + coalesce(g.gain, 0), 6) AS retrieval_score
    FROM entries e LEFT JOIN g ON g.entry_id = e.id""",
)
def _(t):
    """Clicks surface a fact, every day of the log ends a decay sweep."""
    bumps = t.events.filter(F.col("event_type") == "click").select((F.col("user_id") * 4294967296).alias("entry_id"), "ts", "event_id")
    sweeps = t.events.select(F.date_trunc("day", "ts").alias("ts")).distinct()
    return folds.decayed_scores(t.entries, bumps, sweeps).select("id", F.round("retrieval_score", 6).alias("retrieval_score"))


_FOLD = """list_reduce(list_prepend(START, list(CODE ORDER BY created_at, id)), lambda acc, x:
    CASE WHEN x = 1 THEN least(1::DOUBLE, acc + 0.05::DOUBLE) WHEN x = 2 THEN greatest(0::DOUBLE, acc - 0.1::DOUBLE) WHEN x = 3 THEN 0.6::DOUBLE ELSE acc END)"""


@query(
    "w9_replay_trust",
    """SELECT e.id, round(coalesce(x.trust, e.trust_score), 6) AS trust_score FROM entries e LEFT JOIN (
      SELECT entry_id, FOLD AS trust FROM (SELECT c.*, e.trust_score AS t0, CASE operation WHEN 'confirm' THEN 1 WHEN 'reject' THEN 2 ELSE 3 END::DOUBLE AS code
        FROM corrections c JOIN entries e ON e.id = c.entry_id WHERE operation IN ('confirm', 'reject', 'revise')) y GROUP BY entry_id) x ON x.entry_id = e.id""".replace(
        "FOLD", _FOLD.replace("START", "any_value(t0)").replace("CODE", "code")
    ),
)
def _(t):
    out, _rejects = folds.replay_trust(t.entries, t.corrections)
    return out.select("id", F.round("trust_score", 6).alias("trust_score"))


def _requests(t):
    kind = F.col("event_type")
    op = F.when(kind == "view", "confirm").when(kind == "error", "reject").when(kind == "purchase", "revise").when(kind == "click", "edit_fact").otherwise("un_retire")
    value = F.when(kind.isin("purchase", "click"), F.concat(F.lit("fact "), F.col("event_id").cast("string")))
    return t.events.select(
        F.col("event_id").alias("id"), (F.col("user_id") * 4294967296).alias("entry_id"), op.alias("operation"), value.alias("value"),
        F.lit(None).cast("string").alias("reason"), F.lit("ai_error").alias("reason_category"), F.lit("").alias("feedback"), F.col("ts").alias("created_at"),
    )


_REQUESTS = """req AS (SELECT r.*, e.fact AS fact0, e.trust_score AS t0, e.dimension, e.entity, e.tag, e.confidence FROM (
      SELECT event_id AS id, user_id * 4294967296 AS entry_id, event_type AS k, ts AS created_at,
        CASE WHEN event_type IN ('purchase', 'click') THEN 'fact ' || event_id END AS value,
        CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 0 END::DOUBLE AS code FROM events) r JOIN entries e ON e.id = r.entry_id),
    seen AS (SELECT *, last_value(CASE WHEN k = 'click' THEN value END IGNORE NULLS) OVER w AS prev_fact, list(code) OVER w AS codes FROM req
      WINDOW w AS (PARTITION BY entry_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "r10_entries",
    f"""WITH {_REQUESTS}, f AS (SELECT entry_id, arg_max(value, (created_at, id)) FILTER (k = 'click') AS fact, {_FOLD.replace('START', 'any_value(t0)').replace('CODE', 'code')} AS trust,
        arg_max(k, (created_at, id)) FILTER (k <> 'click') AS last_k FROM req GROUP BY entry_id)
      SELECT e.id, coalesce(f.fact, e.fact) AS fact, round(coalesce(f.trust, e.trust_score), 6) AS trust_score,
        coalesce(CASE WHEN last_k IN ('error', 'purchase') THEN 'retired' WHEN last_k IS NOT NULL THEN 'confident' ELSE e.status END, '-') AS status
      FROM entries e LEFT JOIN f ON f.entry_id = e.id""",
)
def _(t):
    out = learning.apply_corrections(t.entries, _requests(t)).entries
    return out.select("id", "fact", F.round("trust_score", 6).alias("trust_score"), F.coalesce("status", F.lit("-")).alias("status"))


@query(
    "r10_correction_log",
    f"""WITH {_REQUESTS}, o AS (SELECT *, list_reduce(list_prepend(t0, coalesce(codes, []::DOUBLE[])), lambda acc, x:
        CASE WHEN x = 1 THEN least(1::DOUBLE, acc + 0.05::DOUBLE) WHEN x = 2 THEN greatest(0::DOUBLE, acc - 0.1::DOUBLE) ELSE acc END) AS old_trust FROM seen)
      SELECT id, coalesce(prev_fact, fact0) AS old_fact, coalesce(value, '-') AS new_fact, round(old_trust, 6) AS old_trust_score,
        round(CASE k WHEN 'purchase' THEN 0.6::DOUBLE WHEN 'view' THEN least(1::DOUBLE, old_trust + 0.05::DOUBLE) WHEN 'error' THEN greatest(0::DOUBLE, old_trust - 0.1::DOUBLE) ELSE old_trust END, 6) AS new_trust_score FROM o""",
)
def _(t):
    log = learning.apply_corrections(t.entries, _requests(t)).log
    return log.select(
        "id", "old_fact", F.coalesce("new_fact", F.lit("-")).alias("new_fact"), F.round("old_trust_score", 6).alias("old_trust_score"),
        F.round("new_trust_score", 6).alias("new_trust_score"),
    )


@query(
    "r10_spawned",
    f"""WITH {_REQUESTS} SELECT (SELECT max(id) FROM entries) + row_number() OVER (ORDER BY created_at, id) AS id, entry_id, entity, tag, value AS fact,
      'Revised from entry ' || entry_id AS reasoning FROM seen WHERE k = 'purchase'""",
)
def _(t):
    return learning.apply_corrections(t.entries, _requests(t)).spawned.select("id", "entry_id", "entity", "tag", "fact", "reasoning")


# --- reports -----------------------------------------------------------------------


@query("j3_corrections_enriched", f"SELECT c.id, e.dimension, e.entity, c.operation, {stamp_sql('c.created_at').replace('AS c.created_at', 'AS created_at')} FROM corrections c JOIN entries e ON e.id = c.entry_id")
def _(t):
    return reports.corrections_enriched(t.corrections, t.entries).select("id", "dimension", "entity", "operation", stamp("created_at"))


_ROLES = """roles AS (SELECT *, CASE WHEN status = 'confident' AND trust_score > 0.5::DOUBLE THEN 'trusted' WHEN status = 'pending' THEN 'pending' END AS role FROM entries)"""


@query(
    "j4_conflict_members",
    f"""WITH {_ROLES}, k AS (SELECT entity, dimension, tag, count(*) FILTER (role = 'trusted') AS n_trusted, count(*) FILTER (role = 'pending') AS n_pending FROM roles GROUP BY ALL)
      SELECT r.id, r.role, n_trusted, n_pending FROM roles r JOIN k USING (entity, dimension, tag) WHERE role IS NOT NULL AND n_trusted > 0 AND n_pending > 0""",
)
def _(t):
    return reports.conflict_members(t.entries).select("id", "role", "n_trusted", "n_pending")


@query(
    "j4_conflicts",
    f"""WITH {_ROLES}, k AS (SELECT entity, dimension, tag, arg_max(id, (trust_score, -id)) AS trusted_id, max(trust_score) AS trust_score, count(*) AS n_trusted
        FROM roles WHERE role = 'trusted' GROUP BY ALL)
      SELECT r.id AS pending_id, k.trusted_id, k.trust_score, n_trusted FROM roles r JOIN k USING (entity, dimension, tag) WHERE role = 'pending'""",
)
def _(t):
    return reports.detect_conflicts(t.entries).select("pending_id", "trusted_id", "trust_score", "n_trusted")


@query("j12_uncovered", "SELECT id FROM docs WHERE id NOT IN (SELECT doc_id FROM entries WHERE status = 'confident')")
def _(t):
    """Documents without a confident fact."""
    return reports.uncovered_documents(t.documents, t.entries.filter(F.col("status") == "confident")).select("id")


@query("a4_by_operation", "SELECT operation, count(*) AS cnt FROM corrections GROUP BY ALL")
def _(t):
    return reports.correction_summary(t.corrections, t.entries)["by_operation"]


@query(
    "a4_by_entity",
    "SELECT coalesce(entity, '*') AS entity, coalesce(operation, '*') AS operation, grouping(entity, operation)::BIGINT AS level, count(*) AS cnt FROM corrections c JOIN (SELECT id AS eid, entity FROM entries) e ON e.eid = c.entry_id GROUP BY ROLLUP (entity, operation)",
)
def _(t):
    rows = reports.correction_summary(t.corrections, t.entries)["by_entity"]
    star = lambda c: F.coalesce(c, F.lit("*")).alias(c)
    return rows.select(star("entity"), star("operation"), F.col("level").cast("long").alias("level"), "cnt")


@query("a4_trend", "SELECT strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week, operation, count(*) AS cnt FROM corrections GROUP BY ALL")
def _(t):
    rows = reports.correction_summary(t.corrections, t.entries)["trend"]
    return rows.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "operation", "cnt")


@query(
    "a5_health",
    "SELECT dimension, count(*) FILTER (status = 'confident') AS confident, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'retired') AS retired FROM entries GROUP BY dimension",
)
def _(t):
    return reports.knowledge_health(t.entries)["by_status"]


@query("a5_health_cube", "SELECT coalesce(dimension, '*') AS dimension, coalesce(status, '*') AS status, grouping(dimension, status)::BIGINT AS level, count(*) AS cnt FROM entries GROUP BY CUBE (dimension, status)")
def _(t):
    rows = reports.knowledge_health(t.entries)["cube"]
    star = lambda c: F.coalesce(c, F.lit("*")).alias(c)
    return rows.select(star("dimension"), star("status"), F.col("level").cast("long").alias("level"), "cnt")


@query("a5_coverage", "SELECT *, cnt < avg(cnt) OVER () * 0.5 AS thin FROM (SELECT dimension, count(*) AS cnt FROM entries GROUP BY dimension) x")
def _(t):
    return reports.coverage_by_dimension(t.entries)


@query(
    "a6_volatile_entries",
    """SELECT entry_id, cnt, reasons, e.entity, coalesce(e.status, '-') AS status FROM (SELECT entry_id, count(*) AS cnt, array_to_string(list_sort(list(DISTINCT reason_category)), ',') AS reasons
      FROM corrections GROUP BY entry_id) c JOIN (SELECT id AS eid, entity, status FROM entries) e ON e.eid = c.entry_id WHERE cnt >= 3""",
)
def _(t):
    rows = reports.volatile_entries(t.corrections, t.entries)
    return rows.select("entry_id", "cnt", F.array_join("reasons", ",").alias("reasons"), "entity", F.coalesce("status", F.lit("-")).alias("status"))


_DIGEST = """SELECT 'fact' AS kind, entity AS grp, id, fact AS text FROM entries WHERE updated_at >= TIMESTAMP '2024-01-01 02:00:00' AND status IS DISTINCT FROM 'retired'
    UNION ALL SELECT 'summary', coalesce(project, ''), id, summary FROM docs WHERE updated_at >= TIMESTAMP '2024-01-01 02:00:00' AND summary IS NOT NULL"""


@query("a7_digest_inputs", f"SELECT kind, grp, id, md5(text) AS text FROM ({_DIGEST}) x")
def _(t):
    rows = reports.digest_inputs(t.entries, t.documents, "2024-01-01 02:00:00")
    return rows.select("kind", "grp", "id", F.md5("text").alias("text"))


@query("a7_digest_counts", f"SELECT kind, grp, count(*) AS cnt FROM ({_DIGEST}) x GROUP BY kind, grp")
def _(t):
    return reports.digest_counts(reports.digest_inputs(t.entries, t.documents, "2024-01-01 02:00:00")).select("kind", "grp", "cnt")


_NUM = "CASE WHEN {0} = trunc({0}) THEN {0}::BIGINT || '.0' ELSE {0}::VARCHAR END"


@query(
    "a8_fact_lines",
    f"""SELECT id, '  [' || id || '] ' || dimension || '/' || entity || '/' || tag || ': ' || fact || ' (status=' || coalesce(status, 'None') || ', conf='
      || {_NUM.format('confidence')} || ', trust=' || {_NUM.format('trust_score')} || ')' AS line FROM entries""",
)
def _(t):
    return reports.fact_lines(t.entries).select("id", "line")


@query(
    "a8_correction_lines",
    """SELECT c.id, '  [' || c.id || '] ' || dimension || '/' || entity || ' op=' || operation || ' category=' || reason_category || ' trust:None->None at '
      || strftime(created_at, '%Y-%m-%d %H:%M:%S') AS line FROM corrections c JOIN (SELECT id AS eid, dimension, entity FROM entries) e ON e.eid = c.entry_id""",
)
def _(t):
    none = F.lit(None).cast("double")
    rows = t.corrections.withColumn("old_trust_score", none).withColumn("new_trust_score", none)
    return reports.correction_lines(reports.corrections_enriched(rows, t.entries)).select("id", "line")


@query("a8_summary_lines", "SELECT id, '  [' || id || '] ' || title || ': ' || coalesce(summary, '') AS line FROM docs")
def _(t):
    return reports.summary_lines(t.documents)


@query(
    "a8_conflict_lines",
    f"""WITH {_ROLES}, k AS (SELECT entity, dimension, tag, arg_max(id, (trust_score, -id)) AS tid, arg_max(fact, (trust_score, -id)) AS tfact, max(trust_score) AS ts
        FROM roles WHERE role = 'trusted' GROUP BY ALL)
      SELECT r.id AS pending_id, '  Trusted [' || tid || '] ' || entity || '/' || dimension || '/' || tag || ': "' || tfact || '" (trust=' || {_NUM.format('ts')} || ') vs Pending [' || r.id || ']: "' || r.fact || '"' AS line
      FROM roles r JOIN k USING (entity, dimension, tag) WHERE role = 'pending'""",
)
def _(t):
    return reports.conflict_lines(reports.detect_conflicts(t.entries)).select("pending_id", "line")


@query(
    "a12_audit_rollup",
    """SELECT coalesce(strftime(timestamp::DATE, '%Y-%m-%d'), '*') AS day, coalesce(pipeline, '*') AS pipeline, coalesce(stage, '*') AS stage, coalesce(outcome, '*') AS outcome,
      count(*) AS cnt FROM audit GROUP BY ROLLUP (timestamp::DATE, pipeline, stage, outcome)""",
)
def _(t):
    rows = reports.audit_rollup(t.audit)
    star = lambda c: F.coalesce(c, F.lit("*")).alias(c)
    day = F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("*")).alias("day")
    return rows.select(day, star("pipeline"), star("stage"), star("outcome"), "cnt")


@query(
    "r16_capture_audit",
    f"""WITH up AS ({_UPLOADS}), x AS (SELECT u.*, d.content_hash AS stored, d.id AS did, lag(u.content_hash) OVER (PARTITION BY u.vault_path ORDER BY seq) AS prev
        FROM up u LEFT JOIN docs d ON d.vault_path = u.vault_path)
      SELECT CASE WHEN did IS NULL THEN 'inserted' ELSE 'updated' END AS decision, 'CAPTURED' AS outcome, count(DISTINCT vault_path) AS cnt FROM x
      WHERE content_hash IS DISTINCT FROM coalesce(prev, stored) GROUP BY ALL""",
)
def _(t):
    rows = state.capture_audit(state.upsert_uploads(t.documents, _uploads(t), now=NOW), F.lit("run-1"), NOW)
    return rows.groupBy("decision", "outcome").agg(F.count(F.lit(1)).alias("cnt"))


# --- reconcile -----------------------------------------------------------------------


@query(
    "j6_reconcile_2way",
    """SELECT coalesce(d.vault_path, s.vault_path) AS vault_path, CASE WHEN d.vault_path IS NOT NULL AND s.vault_path IS NULL THEN 'uploaded'
      WHEN d.vault_path IS NOT NULL AND (s.hash IS NULL OR s.hash <> d.hash) THEN 're_uploaded' WHEN d.vault_path IS NOT NULL THEN 'skipped' ELSE 'deleted' END AS action
      FROM disk d FULL JOIN server s ON d.vault_path = s.vault_path
      WHERE d.vault_path IS NOT NULL OR s.vault_path NOT IN (SELECT vault_path FROM unreadable)""",
)
def _(t):
    return reconcile.reconcile_2way(t.disk, t.server, t.unreadable)


_3WAY = """cand AS (SELECT vault_path, 1 AS n FROM manifests WHERE size > 2000),
    judged AS (SELECT m.vault_path, n, CASE WHEN on_disk AND NOT on_server AND NOT in_cache THEN 'uploaded' WHEN on_disk AND NOT on_server THEN 're_uploaded'
      WHEN on_disk AND (server_hash IS NULL OR server_hash <> h) THEN 're_uploaded' WHEN on_disk THEN 'skipped'
      WHEN on_server AND server_hash IS NOT NULL AND lang <> 'fr' THEN CASE WHEN coalesce(n, 0) + 1 >= 2 THEN 'deleted' ELSE 'candidate' END
      WHEN NOT on_disk AND in_cache AND NOT on_server THEN 'forgotten' END AS action, on_disk, on_server
    FROM manifests m LEFT JOIN cand c ON c.vault_path = m.vault_path WHERE on_disk OR in_cache OR on_server)"""


def _reconciled(t):
    waiting = t.manifests.filter("size > 2000").select("vault_path", F.lit(1).alias("n"))
    return reconcile.reconcile_3way(t.disk, t.cache, t.server, t.unreadable, waiting)


@query("j7_reconcile_3way", f"WITH {_3WAY} SELECT vault_path, action FROM judged WHERE action IS NOT NULL")
def _(t):
    return _reconciled(t).actions


@query(
    "j7_candidates",
    f"""WITH {_3WAY} SELECT vault_path, 1::BIGINT AS n FROM judged WHERE action = 'candidate'
      UNION ALL SELECT vault_path, n FROM judged WHERE n IS NOT NULL AND NOT on_disk AND (action IS NULL OR action = 'forgotten')""",
)
def _(t):
    """Counters after the sweep; a path back on disk has none."""
    return _reconciled(t).candidates.select("vault_path", F.col("n").cast("long").alias("n"))


@query("a10_scan_counts", f"WITH {_3WAY} SELECT action, count(*) AS cnt FROM judged WHERE action IS NOT NULL GROUP BY action")
def _(t):
    return reconcile.scan_counts(_reconciled(t).actions)


@query(
    "u1_u2_path_sets",
    """SELECT 'universe' AS part, count(*) AS cnt FROM (SELECT vault_path FROM disk UNION SELECT vault_path FROM server) a
      UNION ALL SELECT 'both', count(*) FROM (SELECT vault_path FROM disk INTERSECT SELECT vault_path FROM server) b
      UNION ALL SELECT 'disk_only', count(*) FROM (SELECT vault_path FROM disk EXCEPT SELECT vault_path FROM server) c
      UNION ALL SELECT 'server_only', count(*) FROM (SELECT vault_path FROM server EXCEPT SELECT vault_path FROM disk EXCEPT SELECT vault_path FROM unreadable) d""",
)
def _(t):
    parts = reconcile.path_sets(t.disk, t.server, t.unreadable)
    rows = [df.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(name).alias("part"), "cnt") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@query(
    "j8_detect_changes",
    """WITH cur AS (SELECT CASE WHEN toxic = 1 THEN 'moved/' || vault_path ELSE vault_path END AS p, content_hash AS h FROM docs LEFT JOIN labels l ON l.doc_id = docs.id WHERE lang_of <> 'de'),
      mir AS (SELECT vault_path AS p, CASE WHEN quality = 0 AND toxic = 0 THEN NULL ELSE content_hash END AS h FROM docs LEFT JOIN labels l ON l.doc_id = docs.id WHERE lang_of <> 'es'),
      a AS (SELECT * FROM cur WHERE p NOT IN (SELECT p FROM mir)), d AS (SELECT * FROM mir WHERE p NOT IN (SELECT p FROM cur)),
      mv AS (SELECT x.p AS path, y.p AS old_path FROM (SELECT h, min(p) AS p FROM a WHERE h IS NOT NULL GROUP BY h HAVING count(*) = 1) x JOIN (SELECT h, min(p) AS p FROM d WHERE h IS NOT NULL GROUP BY h HAVING count(*) = 1) y USING (h))
    SELECT 'added' AS change, p AS path, '-' AS old_path FROM a WHERE p NOT IN (SELECT path FROM mv)
    UNION ALL SELECT 'deleted', p, '-' FROM d WHERE p NOT IN (SELECT old_path FROM mv)
    UNION ALL SELECT 'moved', path, old_path FROM mv
    UNION ALL SELECT 'modified', cur.p, '-' FROM cur JOIN mir ON cur.p = mir.p WHERE coalesce(cur.h = mir.h, false) = false""".replace("lang_of", "key_topics[1]"),
)
def _(t):
    lab = t.raw("labels").withColumnRenamed("doc_id", "id")
    rows = t.documents.join(lab, "id", "left")
    lang, toxic = F.col("key_topics")[0], F.col("toxic") == 1
    current = rows.filter(lang != "de").select(
        F.when(toxic, F.concat(F.lit("moved/"), "vault_path")).otherwise(F.col("vault_path")).alias("vault_path"), "content_hash"
    )
    mirror = rows.filter(lang != "es").select(
        "vault_path", F.when(~F.coalesce((F.col("quality") == 0) & ~toxic, F.lit(False)), F.col("content_hash")).alias("content_hash")
    )
    out = reconcile.detect_changes(current, mirror)
    return out.select("change", "path", F.coalesce("old_path", F.lit("-")).alias("old_path"))


@query(
    "j10_project_registry",
    """WITH p AS (SELECT key_topics[2] || '-' || (id % 50) AS name, list(DISTINCT key_topics[1]) AS ls FROM docs GROUP BY 1),
      x AS (SELECT name, CASE WHEN list_contains(ls, 'fr') THEN 'fr' WHEN list_contains(ls, 'de') THEN 'de' ELSE NULL END AS domain FROM p)
    SELECT coalesce(domain, 'Uncategorized') AS domain, name AS project, domain IS NULL AS flagged FROM x
    UNION ALL SELECT d, NULL, false FROM (SELECT unnest(['fr', 'de', 'zz']) AS d) k WHERE d NOT IN (SELECT domain FROM x WHERE domain IS NOT NULL)""",
)
def _(t):
    """Projects of 50 buckets per source, tagged with the languages they hold."""
    name = F.concat(F.col("key_topics")[1], F.lit("-"), (F.col("id") % 50).cast("string"))
    langs = F.reverse(F.sort_array(F.collect_set(F.concat(F.lit("domain/"), F.col("key_topics")[0]))))
    projects = t.documents.groupBy(name.alias("name")).agg(langs.alias("tags"))
    domains = t.spark.range(1).select(F.explode(F.array(F.lit("fr"), F.lit("de"), F.lit("zz"))).alias("domain"))
    return reconcile.project_registry(projects, domains)


# --- file events (static twins of the streams) ---------------------------------------


def _file_events(t, events=None):
    """User events as file events; the hash is the user's, so copies collide."""
    kind = F.col("event_type")
    return (t.events if events is None else events).select(
        "event_id", "ts",
        F.when(kind == "view", "modify").when(kind == "click", "create").when(kind == "error", "delete").when(kind == "purchase", "move").otherwise("create").alias("kind"),
        F.concat(F.when(kind == "signup", "tmp/").otherwise("n/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"),
        F.when(kind == "purchase", F.concat(F.when(F.col("value") >= 10, "n/").otherwise("tmp/"), F.col("user_id").cast("string"), F.lit("b.md"))).alias("new_path"),
        F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("hash"),
    )


_FILE_EVENTS = """fe AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'modify' WHEN 'click' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'move' ELSE 'create' END AS kind,
    CASE WHEN event_type = 'signup' THEN 'tmp/' ELSE 'n/' END || user_id || '.md' AS path,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN value >= 10 THEN 'n/' ELSE 'tmp/' END || user_id || 'b.md' END AS new_path, 'h' || user_id AS hash FROM events)"""


@query(
    "x1_debounce",
    f"""WITH {_FILE_EVENTS}, g AS (SELECT *, sum(brk) OVER (PARTITION BY kind, path ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY kind, path ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM fe WHERE kind IN ('create', 'modify')) x)
      SELECT kind, path, max(event_id) AS event_id, count(*) AS n_events FROM g GROUP BY kind, path, s""",
)
def _(t):
    """Last event of each busy period, with a gap of six hours for these sparse events."""
    return ev.debounce(_file_events(t), "6 hours").select("kind", "path", "event_id", "n_events")


@query(
    "x2_rewrite_ignored",
    f"""WITH {_FILE_EVENTS} SELECT event_id, CASE WHEN kind = 'move' AND starts_with(new_path, 'tmp/') THEN 'delete' ELSE kind END AS kind, path,
      CASE WHEN kind = 'move' AND NOT starts_with(new_path, 'tmp/') THEN new_path ELSE '-' END AS new_path FROM fe WHERE NOT starts_with(path, 'tmp/')""",
)
def _(t):
    out = ev.rewrite_ignored(_file_events(t), ["tmp"])
    return out.select("event_id", "kind", "path", F.coalesce("new_path", F.lit("-")).alias("new_path"))


@query(
    "x3_unchanged",
    """SELECT e.event_id, CASE WHEN m.size = e.size AND m.mtime = e.mtime THEN 'same' WHEN m.hash = e.hash THEN 'touch' ELSE 'changed' END AS verdict FROM (
        SELECT event_id, 'u' || user_id AS path, event_id % 3 AS size, 1 AS mtime, 'h' || (user_id % 2) AS hash FROM events) e
      LEFT JOIN (SELECT 'u' || doc_id AS vault_path, quality AS size, 1 AS mtime, 'h' || toxic AS hash FROM labels) m ON m.vault_path = e.path""",
)
def _(t):
    name = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    rows = t.events.select(
        "event_id", "ts", name("user_id").alias("path"), (F.col("event_id") % 3).alias("size"), F.lit(1.0).alias("mtime"),
        F.concat(F.lit("h"), (F.col("user_id") % 2).cast("string")).alias("hash"),
    )
    manifest = t.raw("labels").select(
        name("doc_id").alias("vault_path"), F.col("quality").cast("long").alias("size"), F.lit(1.0).alias("mtime"),
        F.concat(F.lit("h"), F.col("toxic").cast("string")).alias("hash"),
    )
    return ev.judge_unchanged(rows, manifest).select("event_id", "verdict")


@query(
    "x4_correlate_moves",
    f"""WITH {_FILE_EVENTS}, b AS (SELECT * FROM fe WHERE kind IN ('create', 'delete')),
      s AS (SELECT *, lag(kind) OVER w AS pk, lag(path) OVER w AS pp, lag(ts) OVER w AS pt, lead(kind) OVER w AS nk, lead(ts) OVER w AS nt FROM b
        WINDOW w AS (PARTITION BY hash ORDER BY ts, CASE WHEN kind = 'delete' THEN 0 ELSE 1 END, path))
      SELECT CASE WHEN kind = 'delete' THEN 'deleted' WHEN pk = 'delete' AND ts - pt <= INTERVAL 12 HOUR THEN 'moved' ELSE 'created' END AS kind,
        CASE WHEN kind = 'create' AND pk = 'delete' AND ts - pt <= INTERVAL 12 HOUR THEN pp ELSE '-' END AS old_path, path, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
      FROM s WHERE NOT (kind = 'delete' AND nk IS NOT NULL AND nt - ts <= INTERVAL 12 HOUR)""",
)
def _(t):
    """Deletes joined to creates of the same content within twelve hours."""
    events = _file_events(t)
    known = events.select(F.col("path").alias("vault_path"), "hash").distinct()
    out = reconcile.correlate_moves(events.drop("event_id"), known, window_seconds=12 * 3600)
    return out.select("kind", F.coalesce("old_path", F.lit("-")).alias("old_path"), "path", stamp("ts"))


@query(
    "x5_settled_folders",
    """WITH f AS (SELECT *, 'inbox/' || user_id AS folder, event_type = 'signup' AS isdir FROM events WHERE event_type IN ('signup', 'click')),
      g AS (SELECT *, sum(brk) OVER (PARTITION BY folder ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY folder ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM f) x)
      SELECT folder, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) FILTER (NOT isdir) AS n_files FROM g GROUP BY folder, s HAVING bool_or(isdir)""",
)
def _(t):
    """Signups create a user's folder, clicks put files in it; six quiet hours settle it."""
    folder = F.concat(F.lit("inbox/"), F.col("user_id").cast("string"))
    rows = t.events.filter(F.col("event_type").isin("signup", "click")).select(
        "ts", F.when(F.col("event_type") == "signup", "create_dir").otherwise("create").alias("kind"),
        F.when(F.col("event_type") == "signup", folder).otherwise(F.concat(folder, F.lit("/"), F.col("event_id").cast("string"))).alias("path"),
    )
    return ev.settled_folders(rows, "6 hours").select("folder", stamp("started"), "n_files")


@query(
    "x6_move_chains",
    """WITH h AS (SELECT event_id, ts, user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR AS near FROM events),
      g AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, coalesce('e' || lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'u' || user_id) AS p FROM h)
      SELECT arg_min(p, event_id) AS src, 'e' || max(event_id) AS dst, count(*) AS hops FROM g GROUP BY user_id, s""",
)
def _(t):
    """Each user's events as hops of one file from place to place."""
    from pyspark.sql import Window

    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    place = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    start = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    hops = t.events.select(F.col("event_id").alias("id"), "ts", F.coalesce(F.lag(place).over(before), start).alias("src"), place.alias("dst"))
    return reconcile.coalesce_chains(hops, settle_seconds=6 * 3600).select("src", "dst", "hops")


@query(
    "x7_suppress_registered",
    """WITH s AS (SELECT *, lag(event_type = 'signup') OVER w AS own, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT event_id FROM s WHERE event_type <> 'signup' AND NOT coalesce(own AND ts - pt < INTERVAL 3 HOUR, false)""",
)
def _(t):
    """Signups claim the user's path for three hours; the next event there is our own."""
    rows = t.events.select("event_id", "ts", F.col("user_id").cast("string").alias("path"), "event_type")
    claims = rows.filter(F.col("event_type") == "signup").select("path", "ts")
    out = ev.suppress_registered(rows.filter(F.col("event_type") != "signup"), claims, ttl_seconds=3 * 3600)
    return out.select("event_id")


@query(
    "x8_confirm_deletes",
    "SELECT d.doc_id::VARCHAR AS path FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 AND l.quality = 1",
)
def _(t):
    """Toxic documents are missing in this sweep, those of good quality also in the last."""
    rows = t.raw("labels").select(F.col("doc_id").cast("string").alias("path"), "quality", "toxic")
    missing_before = rows.filter("quality = 1").select("path", F.lit(1).alias("n"))
    deleted, _counters = ev.confirm_deletes(rows.select("path", (F.col("toxic") == 0).alias("present")), missing_before)
    return deleted


@query("x12_first_shown", "SELECT DISTINCT event_type AS session_id, user_id AS id FROM events")
def _(t):
    shown = t.events.select(F.col("event_type").alias("session_id"), F.col("user_id").alias("id"), "ts")
    return ev.first_shown(shown).select("session_id", "id")


@query("x9_sweeps", "SELECT strftime(ts, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS ts FROM events) x")
def _(t):
    """One decay sweep per day of the event log."""
    days = t.events.agg(F.sequence(F.date_trunc("day", F.min("ts")), F.date_trunc("day", F.max("ts")), F.expr("INTERVAL 1 DAY")).alias("d"))
    return days.select(F.explode("d").alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))



@query(
    "r16_describe_audit",
    """SELECT CASE WHEN mime_type LIKE 'image/%' AND file_size_bytes <= 10485760 THEN 'DESCRIBED' ELSE 'SKIPPED' END AS outcome, count(*) AS cnt FROM docs GROUP BY ALL""",
)
def _(t):
    rows = state.describe_audit(t.documents, F.lit("run-1"), NOW)
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("cnt"))


# --- the same operators on streams over the given files --------------------------------


@query("x2_rewrite_ignored_stream", f"""WITH {_FILE_EVENTS} SELECT event_id, CASE WHEN kind = 'move' AND starts_with(new_path, 'tmp/') THEN 'delete' ELSE kind END AS kind, path FROM fe WHERE NOT starts_with(path, 'tmp/')""")
def _(t):
    out = ev.rewrite_ignored(_file_events(t, t.stream("events")), ["tmp"]).select("event_id", "kind", "path")
    return jobs.run_available(out, scratch_folder(t.spark))


@query("x12_first_shown_stream", "SELECT DISTINCT event_type AS session_id, user_id AS id FROM events")
def _(t):
    shown = t.stream("events").select(F.col("event_type").alias("session_id"), F.col("user_id").alias("id"), "ts")
    return jobs.run_available(ev.first_shown(shown), scratch_folder(t.spark)).select("session_id", "id")


@query(
    "x10_ingest_stream",
    """WITH u AS (SELECT 'chat/c' || conv_id || '.md' AS vault_path, arg_max(sha256(text), [turn % 3, turn]) AS h FROM conversations GROUP BY conv_id)
      SELECT vault_path, content_hash FROM docs UNION ALL SELECT vault_path, h FROM u""",
)
def _(t):
    """Conversation turns ingested in three batches, so that later ones bring older turns and new paths."""
    folder = scratch_folder(t.spark)
    jobs.create_catalog(t.documents, f"{folder}/catalog")
    for part in range(3):
        t.conversations.where(F.col("turn") % 3 == part).write.parquet(f"{folder}/turns/part={part}")
        rows = t.spark.readStream.schema(t.conversations.schema).option("recursiveFileLookup", True).parquet(f"{folder}/turns")
        turns = rows.select(
            F.concat(F.lit("chat/c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("vault_path"), F.col("text").alias("full_body"),
            F.sha2("text", 256).alias("content_hash"), F.col("turn").cast("long").alias("seq"),
        )
        jobs.ingest_stream(turns, f"{folder}/catalog", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return jobs.open_catalog(t.spark, f"{folder}/catalog").read().select("vault_path", "content_hash")


@query(
    "x8_confirm_deletes_stream",
    """WITH s AS (SELECT doc_id, k, (doc_id >> k) & 1 = 1 AS missing FROM documents, (SELECT unnest(range(4)) AS k) x),
      r AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM s WHERE missing)
    SELECT doc_id::VARCHAR AS path, k AS sweep FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY k) AS p FROM r) y WHERE p % 2 = 0""",
)
def _(t):
    """Four sweeps, a batch each: the bits of a document's id say which of them miss it."""
    folder = scratch_folder(t.spark)
    ids = t.raw("documents").select("doc_id")
    for k in range(4):
        seen = F.expr(f"shiftright(doc_id, {k}) & 1 = 0")
        ids.select(F.col("doc_id").cast("string").alias("path"), F.lit(k).cast("long").alias("sweep"), seen.alias("present")).write.parquet(f"{folder}/sweeps/k={k}")
        rows = t.spark.readStream.schema("path string, sweep long, present boolean").option("recursiveFileLookup", True).parquet(f"{folder}/sweeps")
        job = jobs.confirm_delete_job(rows, f"{folder}/state", f"{folder}/log", confirmations=2)
        job.trigger(availableNow=True).start().awaitTermination()
    return jobs.confirmed_deletes(t.spark, f"{folder}/state")


@query(
    "x1_debounce_stream",
    f"""WITH {_FILE_EVENTS}, g AS (SELECT *, sum(brk) OVER (PARTITION BY kind, path ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY kind, path ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM fe WHERE kind IN ('create', 'modify')) x)
      SELECT kind, path, max(event_id) AS event_id, count(*) AS n_events FROM g GROUP BY kind, path, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM fe WHERE kind IN ('create', 'modify'))""",
)
def _(t):
    """Busy periods that the watermark says are over; the open ones wait in the state."""
    rows = ev.debounce(_file_events(t, t.stream("events")), "6 hours", delay="1 hour")
    return jobs.run_available(rows, scratch_folder(t.spark)).select("kind", "path", "event_id", "n_events")


@query(
    "x11_work_stream",
    "SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL OR quality = 0",
)
def _(t):
    """Unclassified documents of a stream, against the labels as static work state."""
    lab = t.raw("labels").select("doc_id", "quality")
    rows = t.stream("documents").join(lab, "doc_id", "left")
    docs = rows.select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), F.lit(None).cast("string").alias("status"),
        F.when(F.col("quality") == 1, F.sha2("text", 256)).when(F.col("quality") == 0, "stale").alias("classify_content_hash"),
        F.timestamp_seconds(F.col("n_chars")).alias("updated_at"),
    )
    return jobs.run_available(jobs.work_stream(docs), scratch_folder(t.spark)).select("id")
