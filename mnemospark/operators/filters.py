"""Row selection over documents, entries and the audit log."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.schemas import DEFAULTS


def bound(value: str, now: str | None = None) -> Column:
    """A time bound: ``Nd`` counts back from ``now``; anything else is a timestamp text."""
    days = re.fullmatch(r"(\d+)d", value)
    if days:
        base = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        stamp = base - F.make_dt_interval(F.lit(int(days.group(1))))
    else:
        stamp = F.lit(value).cast("timestamp")
    return F.date_trunc("second", stamp)


def filter_documents(
    docs: DataFrame,
    project: str | None = None,
    since: str | None = None,
    until: str | None = None,
    location: str | None = None,
    now: str | None = None,
) -> DataFrame:
    """Candidate documents; both time bounds are inclusive at second precision."""
    if project is not None:
        docs = docs.filter(F.col("project") == project)
    if since is not None:
        docs = docs.filter(F.col("updated_at") >= bound(since, now))
    if until is not None:
        docs = docs.filter(F.col("updated_at") < bound(until, now) + F.expr("INTERVAL 1 SECOND"))
    if location is not None:
        docs = docs.filter(F.col("vault_path").startswith(location.rstrip("/") + "/"))
    return docs


def listing(docs: DataFrame, k: int = DEFAULTS.search_results) -> DataFrame:
    """Newest documents first; rows without a time come last."""
    return docs.orderBy(F.col("updated_at").desc_nulls_last(), F.col("id")).limit(k)


def choose_content(docs: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """The whole body, or the summary of a document without one, as ``content``.

    Nothing is cut: ``fits`` tells whether the content is below ``max_tokens`` (all is
    without that), and the caller splits what does not fit.
    """
    body, summary = F.coalesce("full_body", F.lit("")), F.coalesce("summary", F.lit(""))
    content = F.when(body != "", body).otherwise(summary)
    fits = F.lit(True) if max_tokens is None else F.floor(F.length(content) / 4) < max_tokens
    return docs.withColumn("content", content).withColumn("fits", fits)


def resolve(docs: DataFrame, requests: DataFrame, mode: str, max_text_refs: int | None = None) -> DataFrame:
    """Look up requested ids as ``summary``, ``text`` or ``file``.

    ``requests`` has ``request_id`` and an ``ids`` array; an unknown id is dropped
    but keeps its place in the count by which ``max_text_refs``, if given, limits full texts.
    """
    wanted = requests.select("request_id", F.posexplode("ids").alias("pos", "id"))
    rows = wanted.join(docs, "id")
    summary = F.coalesce(F.nullif("summary", F.lit("")), F.lit("[Summary pending]"))
    if mode == "text":
        full = F.col("full_body").isNotNull()
        if max_text_refs is not None:
            full = (F.col("pos") < max_text_refs) & full
        content, degraded = F.when(full, F.col("full_body")).otherwise(summary), ~full
    elif mode == "summary":
        content, degraded = summary, F.lit(False)
    elif mode == "file":
        content, degraded = F.col("vault_path"), F.lit(False)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return rows.select("request_id", "pos", "id", content.alias("content"), degraded.alias("degraded"))


def query_audit(
    audit: DataFrame,
    date: str | None = None,
    pipeline: str | None = None,
    correlation_id: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    if date is not None:
        if "dt" in audit.columns:
            audit = audit.filter(F.col("dt") == F.lit(date).cast("date"))
        day = F.lit(date).cast("timestamp")
        audit = audit.filter((F.col("timestamp") >= day) & (F.col("timestamp") < day + F.expr("INTERVAL 1 DAY")))
    if pipeline is not None:
        audit = audit.filter(F.col("pipeline") == pipeline)
    if correlation_id is not None:
        audit = audit.filter(F.col("correlation_id") == correlation_id)
    ordered = audit.orderBy("id")
    return ordered if limit is None else ordered.limit(limit)


def entries_by(
    entries: DataFrame,
    id: int | None = None,
    dimension: str | None = None,
    entity: str | None = None,
    tag: str | None = None,
    active_only: bool = False,
) -> DataFrame:
    """Entry look-ups. ``active_only`` drops retired rows and rows without status."""
    for column, value in (("id", id), ("dimension", dimension), ("entity", entity), ("tag", tag)):
        if value is not None:
            entries = entries.filter(F.col(column) == value)
    if active_only:
        entries = entries.filter(F.col("status") != "retired")
    return entries.orderBy("dimension", "entity", "tag", "id")


def find_unclassified(docs: DataFrame) -> DataFrame:
    """Never stamped, or stamped for older content; parked rows are left out.

    A stamped row whose content hash is NULL compares as NULL and is not found.
    """
    stale = F.col("classify_content_hash").isNull() | (F.col("classify_content_hash") != F.col("content_hash"))
    open_ = F.col("status").isNull() | (F.col("status") != "needs-review")
    return docs.filter(stale & open_)


def latest_batches(batches: DataFrame) -> DataFrame:
    """The newest batch of each folder."""
    order = F.struct("created_at", "batch_id")
    return batches.groupBy("folder_path").agg(F.max_by("batch_id", order).alias("batch_id"))


def first_occurrence(results: DataFrame, key: str = "id", order: str = "pos", per: tuple[str, ...] = ()) -> DataFrame:
    """Keep the first row of each id; rows without an id are all kept.

    A grouped minimum finds the winner, so a heavily repeated id combines on the
    map side and never gathers in one window.
    """
    keys = [*per, key]
    identified = results.filter(F.col(key).isNotNull())
    others = [c for c in results.columns if c not in keys]
    best = identified.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_row"))
    firsts = best.select(*keys, "_row.*").select(*results.columns)
    return firsts.unionByName(results.filter(F.col(key).isNull()))


def last_write(rows: DataFrame, key: str = "vault_path", order: str = "seq") -> DataFrame:
    """The last row per key, with the key's first order value as ``first_seq``."""
    others = [c for c in rows.columns if c != key]
    grouped = rows.groupBy(key).agg(
        F.max_by(F.struct(*others), F.col(order)).alias("_row"), F.min(order).alias("first_seq")
    )
    return grouped.select(key, "_row.*", "first_seq")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark trims each partition to ``k`` before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
