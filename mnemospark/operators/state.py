"""Catalog transitions: the table after a batch of changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.paths import is_batch_folder, location_context, parent
from mnemospark.functions.quality import describable
from mnemospark.functions.text import chat_path, derive_title, derive_topics, path_stem
from mnemospark.operators.facts import prune_sources
from mnemospark.operators.filters import latest_batches
from mnemospark.operators.folds import last_write, number_rows, value_before
from mnemospark.schemas import DEFAULTS

_RAW = ("full_body", "content_hash", "original_filename", "file_size_bytes", "blob_ref", "mime_type")


def _stamp(now: str | None) -> Column:
    return F.lit(now).cast("timestamp") if now else F.current_timestamp()


def upsert_uploads(docs: DataFrame, uploads: DataFrame, now: str | None = None, chunk: int = 1000, top_id: int | None = None) -> DataFrame:
    """Store ``uploads(vault_path, full_body, content_hash, ..., title, seq)`` by path.

    An upload with the hash already stored is ignored, also when the same hash
    comes twice in a row inside the batch. A new hash overwrites the raw columns;
    title changes only when given, summary and classify stamp stay. The result has
    an ``action`` column: inserted, updated or unchanged. Of uploads with one ``seq`` the
    larger hash comes last. New rows are numbered after ``top_id``, by default the
    largest id of ``docs``, which may then be the rows of the uploaded paths alone.
    """
    stored = docs.select("vault_path", F.col("content_hash").alias("_stored"), F.lit(True).alias("_present"))
    seen = value_before(uploads, "vault_path", ["seq", "content_hash"], ["content_hash"], F.floor(F.col("seq") / chunk))
    seen = seen.join(stored, "vault_path", "left")
    last_hash = F.coalesce("prev_content_hash", "_stored")
    effective = seen.filter(~F.coalesce(F.col("content_hash") == last_hash, F.lit(False)))
    raw = [c for c in _RAW if c in uploads.columns]
    title = F.nullif("title", F.lit("")) if "title" in uploads.columns else F.lit(None).cast("string")
    changes = effective.groupBy("vault_path").agg(
        F.max_by(F.struct(*raw), F.struct("seq", "content_hash")).alias("w"),
        F.max_by(title, F.when(title.isNotNull(), F.struct("seq", "content_hash"))).alias("_title"),
        F.min("seq").alias("first_seq"),
        F.max("_present").alias("_present"),
    )
    stamp = _stamp(now)
    joined = docs.join(changes.drop("_present"), "vault_path", "left")
    hit = F.col("w").isNotNull()
    values = {c: F.when(hit, F.col(f"w.{c}")).otherwise(F.col(c)) for c in raw}
    values["title"] = F.coalesce("_title", "title")
    values["updated_at"] = F.when(hit, stamp).otherwise(F.col("updated_at"))
    old = joined.select(
        *[values.get(c, F.col(c)).alias(c) for c in docs.columns],
        F.when(hit, "updated").otherwise("unchanged").alias("action"),
    )
    base = F.coalesce(docs.agg(F.max("id")).scalar(), F.lit(0)) if top_id is None else top_id
    fresh = changes.filter(F.col("_present").isNull())
    ids = number_rows(fresh.select("first_seq", "vault_path"), ["first_seq", "vault_path"], "id", base)
    fresh = fresh.join(ids.select("vault_path", "id"), "vault_path")  # bodies take no part in the numbering
    new = fresh.select(
        "id", "vault_path", F.coalesce("_title", path_stem(F.col("vault_path"))).alias("title"),
        *[F.col(f"w.{c}").alias(c) for c in raw],
        stamp.alias("created_at"), stamp.alias("updated_at"), F.lit("inserted").alias("action"),
    )
    new = new.select(*[c for c in new.columns if c in old.columns])
    return old.unionByName(new, allowMissingColumns=True)


def attach_summaries(docs: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set summary and title (and body when given) by path; also returns unknown paths.

    Of several summaries for one path the last by ``seq`` counts, if there is such a column.
    """
    cols = [c for c in ("summary", "title", "full_body") if c in summaries.columns]
    own = last_write(summaries.select("vault_path", *cols, *(["seq"] if "seq" in summaries.columns else [])), "vault_path")
    new = own.select("vault_path", *[F.col(c).alias(f"n_{c}") for c in cols])
    joined = docs.join(new, "vault_path", "left")
    out = joined.select(
        *[(F.coalesce(f"n_{c}", c) if c in cols else F.col(c)).alias(c) for c in docs.columns]
    )
    return out, summaries.join(docs.select("vault_path"), "vault_path", "left_anti")


def rename_paths(docs: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give ``moves(old_path, new_path)`` their new path, ids kept.

    A move is refused when the source is unknown, or the target exists or is claimed
    by an earlier source of the same batch.
    """
    paths = docs.select("vault_path")
    known = moves.join(paths.withColumnRenamed("vault_path", "old_path"), "old_path", "left_semi")
    free = known.join(paths.withColumnRenamed("vault_path", "new_path"), "new_path", "left_anti")
    granted = (
        free.groupBy("new_path").agg(F.min("old_path").alias("old_path"))
        .groupBy("old_path").agg(F.min("new_path").alias("new_path"))
    )
    refused = moves.join(granted, ["old_path", "new_path"], "left_anti")
    joined = docs.join(granted.withColumnRenamed("old_path", "vault_path"), "vault_path", "left")
    out = joined.select(*[F.coalesce("new_path", "vault_path").alias(c) if c == "vault_path" else F.col(c) for c in docs.columns])
    return out, refused


@dataclass
class Deletion:
    docs: DataFrame
    entries: DataFrame
    postings: DataFrame | None
    vectors: DataFrame | None
    orphan_blobs: DataFrame


def delete_paths(
    docs: DataFrame,
    entries: DataFrame,
    paths: DataFrame,
    postings: DataFrame | None = None,
    vectors: DataFrame | None = None,
) -> Deletion:
    """Delete documents with their index rows, source references and orphaned blobs."""
    gone = docs.join(paths.select("vault_path").distinct(), "vault_path", "left_semi")
    left = docs.join(paths.select("vault_path").distinct(), "vault_path", "left_anti")
    ids = gone.select("id")

    def without(index: DataFrame | None) -> DataFrame | None:
        return None if index is None else index.join(ids, "id", "left_anti")

    return Deletion(
        left,
        prune_sources(entries, ids),
        without(postings),
        without(vectors),
        orphan_blobs(gone.select("blob_ref"), left),
    )


def orphan_blobs(blobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Blob refs that no remaining document names."""
    named = blobs.filter(F.col("blob_ref").isNotNull()).select("blob_ref").distinct()
    return named.join(docs.select("blob_ref"), "blob_ref", "left_anti")


def blob_refcounts(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("blob_ref").isNotNull()).groupBy("blob_ref").agg(F.count(F.lit(1)).alias("cnt"))


def replace_paths(docs: DataFrame, replacements: DataFrame, now: str | None = None) -> DataFrame:
    """Delete each ``old_path`` and insert its replacement as a new row, in one state.

    ``replacements(old_path, vault_path, title, tags, full_body, content_hash, seq)``;
    topics are derived again from the tags.
    """
    left = docs.join(replacements.select(F.col("old_path").alias("vault_path")).distinct(), "vault_path", "left_anti")
    top_id = F.coalesce(docs.agg(F.max("id")).scalar(), F.lit(0))
    keys = replacements.select("seq", "vault_path").distinct()
    numbered = replacements.join(number_rows(keys, ["seq", "vault_path"], "id", top_id), ["seq", "vault_path"])
    stamp = _stamp(now)
    new = numbered.select(
        "id", "vault_path", derive_title(F.col("title"), F.lit(None).cast("string"), F.col("vault_path")).alias("title"),
        derive_topics(F.col("tags")).alias("key_topics"), "full_body", "content_hash",
        stamp.alias("created_at"), stamp.alias("updated_at"),
    )
    return left.unionByName(new.select(*[c for c in new.columns if c in docs.columns]), allowMissingColumns=True)


def apply_outcomes(docs: DataFrame, outcomes: DataFrame, retries: int = DEFAULTS.classify_retries) -> DataFrame:
    """Update work state from ``outcomes(doc_id, dimension, clean, error)``.

    All dimensions clean stamps the content hash and clears the failure state;
    otherwise attempts grow by one and the document is parked after ``retries``.
    """
    failed = F.when(~F.col("clean"), F.struct("dimension", "error"))
    errors = F.transform(F.sort_array(F.collect_list(failed)), lambda e: e["error"])
    per_doc = outcomes.groupBy(F.col("doc_id").alias("id")).agg(
        F.every("clean").alias("_clean"), F.array_join(errors, "; ").alias("_error")
    )
    joined = docs.join(per_doc, "id", "left")
    clean, failed_ = F.coalesce("_clean", F.lit(False)), ~F.coalesce("_clean", F.lit(True))
    attempts = F.coalesce("classify_attempts", F.lit(0))
    values = {
        "classify_content_hash": F.when(clean, F.col("content_hash")).otherwise(F.col("classify_content_hash")),
        "classify_attempts": F.when(clean, 0).when(failed_, attempts + 1).otherwise(F.col("classify_attempts")),
        "classify_last_error": F.when(clean, F.lit(None)).when(failed_, F.col("_error")).otherwise(F.col("classify_last_error")),
        "status": F.when(failed_ & (attempts + 1 >= retries), "needs-review").otherwise(F.col("status")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])


def work_state(docs: DataFrame) -> DataFrame:
    return docs.select(
        "id", "content_hash", "classify_content_hash", F.coalesce("classify_attempts", F.lit(0)).alias("classify_attempts"),
        "classify_last_error", "status",
    )


def append_comments(comments: DataFrame, requests: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``requests(id, entry_id, comment_text, created_at)``; unknown entries are rejected."""
    ids = entries.select(F.col("id").alias("entry_id"))
    good = requests.join(ids, "entry_id", "left_semi")
    rejects = requests.join(ids, "entry_id", "left_anti").withColumn("reason", F.lit("unknown entry"))
    return comments.unionByName(good.select(*comments.columns), allowMissingColumns=True), rejects


def drop_with_entries(log: DataFrame, deleted: DataFrame) -> DataFrame:
    """Correction and comment rows go when their entry is hard-deleted."""
    return log.join(deleted.select(F.col("id").alias("entry_id")), "entry_id", "left_anti")


def folder_batches(docs: DataFrame, status: str = "pending") -> DataFrame:
    """One batch per batch-worthy folder that directly holds documents."""
    rows = docs.withColumn("folder_path", parent(F.col("vault_path"))).filter(is_batch_folder(F.col("folder_path")))
    where = location_context(F.concat("folder_path", F.lit("/x")))
    counted = rows.groupBy("folder_path").agg(F.count(F.lit(1)).alias("file_count"))
    return counted.select(
        F.element_at(F.split("folder_path", "/"), -1).alias("folder_name"),
        where["type"].alias("destination_type"), where["name"].alias("destination_name"),
        F.lit(status).alias("status"), "file_count", "folder_path",
    )


def set_batch_status(batches: DataFrame, changes: DataFrame) -> DataFrame:
    """Of several changes of one batch the last by ``seq`` counts, if there is such a column."""
    own = last_write(changes.select("batch_id", "status", *(["seq"] if "seq" in changes.columns else [])), "batch_id")
    new = own.select("batch_id", F.col("status").alias("_status"))
    joined = batches.join(new, "batch_id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).drop("_status").select(*batches.columns)


def stamp_batches(docs: DataFrame, batches: DataFrame) -> DataFrame:
    """Set ``batch_id`` of the documents directly inside a batch folder to its newest batch."""
    newest = latest_batches(batches).withColumnRenamed("batch_id", "_batch")
    joined = docs.withColumn("folder_path", parent(F.col("vault_path"))).join(newest, "folder_path", "left")
    old = F.col("batch_id") if "batch_id" in docs.columns else F.lit(None).cast("long")
    return joined.withColumn("batch_id", F.coalesce("_batch", old)).drop("_batch", "folder_path")


def chat_insights(turns: DataFrame) -> DataFrame:
    """``turns(text, title_hint, ts, seq)`` as uploads under ``chat/``."""
    return turns.select(
        chat_path(F.col("ts"), F.col("title_hint")).alias("vault_path"),
        F.col("text").alias("full_body"), F.sha2("text", 256).alias("content_hash"), "seq",
    )


def audit_rows(
    df: DataFrame, pipeline: str, stage: str, outcome: Column | str, decision: Column | str,
    source_ids: Column, correlation_id: Column, now: str | None = None, reasoning: Column | str = "",
) -> DataFrame:
    """Audit rows of a transition, ready for the append-only log."""
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.select(
        _stamp(now).alias("timestamp"), F.lit(pipeline).alias("pipeline"), F.lit(stage).alias("stage"),
        source_ids.alias("source_ids"), text(decision).alias("decision"), F.lit(1.0).alias("confidence"),
        text(reasoning).alias("reasoning"), text(outcome).alias("outcome"), correlation_id.alias("correlation_id"),
    )


def capture_audit(upserted: DataFrame, correlation_id: Column, now: str | None = None) -> DataFrame:
    """One CAPTURED row per inserted or updated document."""
    rows = upserted.filter(F.col("action") != "unchanged")
    ids = F.array(F.col("id").cast("string"))
    return audit_rows(rows, "capture", "store", "CAPTURED", F.col("action"), ids, correlation_id, now)


def classify_audit(outcomes: DataFrame, correlation_id: Column, now: str | None = None) -> DataFrame:
    ids = F.array(F.col("doc_id").cast("string"))
    outcome = F.when(F.col("clean"), "classify").otherwise("needs-retry")
    reason = F.coalesce("error", F.lit(""))
    return audit_rows(outcomes, "classify", "extract", outcome, F.col("dimension"), ids, correlation_id, now, reason)


def corrections_audit(log: DataFrame, correlation_id: Column, now: str | None = None) -> DataFrame:
    ids = F.array(F.col("entry_id").cast("string"))
    return audit_rows(log, "correct", "apply", "APPLIED", F.col("operation"), ids, correlation_id, now)



def describe_audit(files: DataFrame, correlation_id: Column, now: str | None = None) -> DataFrame:
    """DESCRIBED or SKIPPED per file ``(id, mime_type, file_size_bytes)`` of the describable gate."""
    gate = describable(F.col("mime_type"), F.col("file_size_bytes"))
    outcome = F.when(gate == "ok", "DESCRIBED").otherwise("SKIPPED")
    return audit_rows(files, "capture", "describe", outcome, "describe", F.array(F.col("id").cast("string")), correlation_id, now, gate)


def failure_audit(rejects: DataFrame, correlation_id: Column, now: str | None = None) -> DataFrame:
    """FAILED per rejected file ``(vault_path, reason)``."""
    return audit_rows(rejects, "capture", "store", "FAILED", "reject", F.array("vault_path"), correlation_id, now, F.col("reason"))


def parked_audit(before: DataFrame, after: DataFrame, correlation_id: Column, now: str | None = None) -> DataFrame:
    """One ``parked`` row per document that became ``needs-review``."""
    old = before.filter(F.col("status") == "needs-review").select("id")
    parked = after.filter(F.col("status") == "needs-review").join(old, "id", "left_anti")
    reason = F.coalesce("classify_last_error", F.lit(""))
    return audit_rows(parked, "classify", "park", "parked", "park", F.array(F.col("id").cast("string")), correlation_id, now, reason)


def report_audit(reports: DataFrame, correlation_id: Column, now: str | None = None) -> DataFrame:
    """GENERATED per stored report ``(id, report_type, title)``."""
    decision = F.concat(F.lit("report:"), "report_type")
    return audit_rows(reports, "reports", "synthesize", "GENERATED", decision, F.array(F.col("id").cast("string")), correlation_id, now, F.col("title"))
