"""File-event operators that run on streams and on static tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.paths import matches_ignore
from mnemospark.operators.folds import value_before
from mnemospark.schemas import DEFAULTS

_DEBOUNCED = ("create", "modify")


def debounce(events: DataFrame, gap: str = DEFAULTS.debounce, delay: str | None = None) -> DataFrame:
    """The last create or modify event of each (kind, path) once ``gap`` passed quietly.

    Of events with one time the one with the largest ``event_id`` is the last, without such a
    column the one with the largest hash. ``delay`` is the watermark a stream needs; a static table takes none. Deletes
    and moves are not debounced: see :func:`immediate`.
    """
    rows = events.filter(F.col("kind").isin(*_DEBOUNCED))
    if delay is not None:
        rows = rows.withWatermark("ts", delay)
    others = [c for c in events.columns if c not in ("kind", "path")]
    return (
        rows.groupBy(F.session_window("ts", gap).alias("quiet"), "kind", "path")
        .agg(F.max_by(F.struct(*others), F.struct("ts", F.col("event_id") if "event_id" in others else F.xxhash64(*others))).alias("e"), F.count(F.lit(1)).alias("n_events"))
        .select("kind", "path", "e.*", "n_events", F.col("quiet.end").alias("fired_at"))
    )


def immediate(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("kind").isin(*_DEBOUNCED))


def rewrite_ignored(events: DataFrame, patterns: list[str]) -> DataFrame:
    """Drop events on ignored paths; a move across the border becomes delete or create."""
    src = matches_ignore(F.col("path"), patterns)
    dst = matches_ignore(F.coalesce("new_path", F.lit("")), patterns)
    move = F.col("kind") == "move"
    kind = F.when(move & ~src & dst, "delete").when(move & src & ~dst, "create").otherwise(F.col("kind"))
    path = F.when(move & src & ~dst, F.col("new_path")).otherwise(F.col("path"))
    target = F.when(move & ~src & ~dst, F.col("new_path"))
    kept = events.filter(F.when(move, ~(src & dst)).otherwise(~src))
    values = {"kind": kind, "path": path, "new_path": target}
    return kept.select(*[values.get(c, F.col(c)).alias(c) for c in events.columns])


def judge_unchanged(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``verdict``: ``same`` (size and time), ``touch`` (hash only) or ``changed``.

    ``events`` carry size, mtime and hash; the manifest side may be large, so the
    join is left to the optimizer.
    """
    m = manifest.select(
        F.col("vault_path").alias("path"), F.col("size").alias("m_size"), F.col("mtime").alias("m_mtime"), F.col("hash").alias("m_hash")
    )
    same = (F.col("size") == F.col("m_size")) & (F.col("mtime") == F.col("m_mtime"))
    verdict = F.when(same, "same").when(F.col("hash") == F.col("m_hash"), "touch").otherwise("changed")
    return events.join(m, "path", "left").withColumn("verdict", verdict).drop("m_size", "m_mtime", "m_hash")


def touch_manifest(manifest: DataFrame, judged: DataFrame) -> DataFrame:
    """Refresh size and time of manifest rows whose content turned out unchanged."""
    t = judged.filter(F.col("verdict") == "touch").groupBy(F.col("path").alias("vault_path")).agg(
        F.max_by(F.struct("size", "mtime"), "ts").alias("t")
    )
    joined = manifest.join(t, "vault_path", "left")
    return joined.select(
        *[F.coalesce(f"t.{c}", c).alias(c) if c in ("size", "mtime") else F.col(c) for c in manifest.columns]
    )


def owning_folder(path: Column) -> Column:
    """The batch-level folder a file or folder lies in; NULL outside of one."""
    found = F.regexp_extract(path, r"^(inbox/[^/]+|(?:Projects|Domain)/[^/]+/[^/]+)(?:/|$)", 1)
    return F.nullif(found, F.lit(""))


def settled_folders(events: DataFrame, gap: str = DEFAULTS.folder_settle, delay: str | None = None) -> DataFrame:
    """One row per created folder after ``gap`` without new files in it.

    ``events`` have kind ``create_dir`` or ``create``. Activity that does not include
    the folder's own creation is not a settling folder.
    """
    if delay is not None:
        events = events.withWatermark("ts", delay)
    isdir = F.col("kind") == "create_dir"
    inside = events.withColumn("folder", owning_folder(F.col("path"))).filter(
        F.col("folder").isNotNull() & (isdir | (F.col("path") != F.col("folder")))
    )
    return (
        inside.groupBy(F.session_window("ts", gap).alias("active"), "folder")
        .agg(F.max(isdir & (F.col("path") == F.col("folder"))).alias("created"), F.count_if(F.col("kind") == "create").alias("n_files"))
        .filter("created")
        .select("folder", F.col("active.start").alias("started"), F.col("active.end").alias("stable_at"), "n_files")
    )


def loose_files(events: DataFrame, settled: DataFrame) -> DataFrame:
    """Created files that do not belong to a settling folder (static tables).

    Of a folder's settling periods, only the latest that started before the file can
    hold it, so each file meets at most one period.
    """
    files = events.filter(F.col("kind") == "create").withColumn("folder", owning_folder(F.col("path")))
    held = files.filter(F.col("folder").isNotNull() & (F.col("path") != F.col("folder")))
    log = held.select("folder", "ts", F.lit(1).alias("side"), "path", F.lit(None).cast("timestamp").alias("until")).unionByName(
        settled.select("folder", F.col("started").alias("ts"), F.lit(0).alias("side"), F.lit("").alias("path"), F.col("stable_at").alias("until"))
    )
    slot = F.window("ts", "10 minutes").getField("start")
    seen = value_before(log, "folder", ["ts", "side", "path"], ["until"], slot)
    member = seen.filter((F.col("side") == 1) & (F.col("ts") < F.col("prev_until"))).select("ts", "path")
    return files.join(member, ["ts", "path"], "left_anti").drop("folder")


def suppress_registered(events: DataFrame, registrations: DataFrame, ttl_seconds: float = DEFAULTS.move_guard_seconds) -> DataFrame:
    """Events minus those our own jobs caused (static tables).

    A registration ``(path, ts)`` suppresses the first event on its path within the
    time to live, and only that one: of equal events the others stay.
    """
    log = events.select("path", "ts", F.lit("event").alias("side")).unionByName(
        registrations.select("path", "ts", F.lit("claim").alias("side"))
    )
    log = log.withColumn("last", F.struct("side", "ts"))
    slot = F.window("ts", "10 minutes").getField("start")
    seen = value_before(log, "path", ["ts", "side"], ["last"], slot)
    gap = F.col("ts").cast("double") - F.col("prev_last.ts").cast("double")
    own = seen.filter((F.col("side") == "event") & (F.col("prev_last.side") == "claim") & (gap < ttl_seconds))
    # events of one path and time are told apart by their number, in the order of their contents
    copy = F.row_number().over(Window.partitionBy("path", "ts").orderBy(*[F.col("event_id")] if "event_id" in events.columns else [F.xxhash64(*events.columns)]))
    numbered = events.withColumn("_copy", copy)
    return numbered.join(own.select("path", "ts", F.lit(1).alias("_copy")), ["path", "ts", "_copy"], "left_anti").select(*events.columns)


def confirm_deletes(sweep: DataFrame, counters: DataFrame, confirmations: int = DEFAULTS.sweep_confirmations) -> tuple[DataFrame, DataFrame]:
    """``sweep(path, present)`` and ``counters(path, n)`` to (deleted paths, new counters).

    A path missing in ``confirmations`` sweeps in a row is deleted; one that is back
    loses its counter.
    """
    rows = sweep.join(counters, "path", "full_outer")
    n = F.when(F.col("present").isNull(), F.col("n")).when(~F.col("present"), F.coalesce("n", F.lit(0)) + 1)
    counted = rows.select("path", n.alias("n")).filter(F.col("n").isNotNull())
    return counted.filter(F.col("n") >= confirmations).select("path"), counted.filter(F.col("n") < confirmations)


def first_shown(shown: DataFrame) -> DataFrame:
    """One surfacing per (session, id), on a stream too: however late, none is lost.

    A stream keeps the pairs it has shown, two keys each, in its state store.
    """
    return shown.dropDuplicates(["session_id", "id"])
