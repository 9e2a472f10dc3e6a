"""Report tables over facts, corrections, documents and the audit log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.context import volatility
from mnemospark.schemas import DEFAULTS

CONFLICT_KEY = ["entity", "dimension", "tag"]


def corrections_enriched(corrections: DataFrame, entries: DataFrame) -> DataFrame:
    """Corrections with their entry's dimension and entity; order by ``created_at`` to show."""
    keys = entries.select(F.col("id").alias("entry_id"), "dimension", "entity")
    return corrections.join(keys, "entry_id")


def conflict_members(entries: DataFrame, threshold: float = DEFAULTS.trust.overwrite_above) -> DataFrame:
    """Entries of every key that holds both a trusted and a pending fact.

    One row per entry with its ``role``. The conflicting pairs are exactly the
    trusted x pending rows of a key, so this states all of them in linear size.
    """
    role = F.when((F.col("status") == "confident") & (F.col("trust_score") > threshold), "trusted").when(
        F.col("status") == "pending", "pending"
    )
    rows = entries.withColumn("role", role).filter(F.col("role").isNotNull())
    both = (
        rows.groupBy(*CONFLICT_KEY)
        .agg(F.count_if(F.col("role") == "trusted").alias("n_trusted"), F.count_if(F.col("role") == "pending").alias("n_pending"))
        .filter((F.col("n_trusted") > 0) & (F.col("n_pending") > 0))
    )
    return rows.join(both, CONFLICT_KEY).select(
        *CONFLICT_KEY, "role", "id", "fact", "trust_score", "n_trusted", "n_pending"
    )


def detect_conflicts(entries: DataFrame, threshold: float = DEFAULTS.trust.overwrite_above) -> DataFrame:
    """Each contested pending fact with its strongest trusted rival.

    ``n_trusted`` tells how many rivals there are; :func:`conflict_members` lists
    them all and :func:`conflict_pairs` unfolds chosen keys.
    """
    trusted = entries.filter((F.col("status") == "confident") & (F.col("trust_score") > threshold))
    order = F.struct(F.col("trust_score"), -F.col("id"))
    rivals = trusted.groupBy(*CONFLICT_KEY).agg(
        F.max_by(F.struct("id", "fact", "trust_score"), order).alias("t"), F.count(F.lit(1)).alias("n_trusted")
    )
    pending = entries.filter(F.col("status") == "pending").select(
        *CONFLICT_KEY, F.col("id").alias("pending_id"), F.col("fact").alias("pending_fact")
    )
    return pending.join(rivals, CONFLICT_KEY).select(
        F.col("t.id").alias("trusted_id"), *CONFLICT_KEY, F.col("t.fact").alias("trusted_fact"),
        F.col("t.trust_score").alias("trust_score"), "pending_id", "pending_fact", "n_trusted",
    )


def conflict_pairs(entries: DataFrame, keys: DataFrame, threshold: float = DEFAULTS.trust.overwrite_above) -> DataFrame:
    """Every (trusted, pending) pair of the given ``keys(entity, dimension, tag)``, for drill-down."""
    members = conflict_members(entries, threshold).join(keys.select(*CONFLICT_KEY).distinct(), CONFLICT_KEY, "left_semi")
    trusted = members.filter(F.col("role") == "trusted").select(
        *CONFLICT_KEY, F.col("id").alias("trusted_id"), F.col("fact").alias("trusted_fact"), "trust_score"
    )
    pending = members.filter(F.col("role") == "pending").select(
        *CONFLICT_KEY, F.col("id").alias("pending_id"), F.col("fact").alias("pending_fact")
    )
    return trusted.join(pending, CONFLICT_KEY).filter(F.col("trusted_id") != F.col("pending_id"))


def correction_summary(corrections: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """Totals by operation, by entity and operation (with subtotals), and per week."""
    rows = corrections_enriched(corrections, entries)
    count = F.count(F.lit(1)).alias("cnt")
    level = F.grouping_id().alias("level")
    return {
        "by_operation": corrections.groupBy("operation").agg(count),
        "by_entity": rows.rollup("entity", "operation").agg(level, count),
        "trend": corrections.groupBy(F.date_trunc("week", "created_at").alias("week"), "operation").agg(count),
    }


def knowledge_health(entries: DataFrame) -> dict[str, DataFrame]:
    """Facts by dimension and status, as a pivot and as a cube."""
    statuses = ["confident", "pending", "retired"]
    pivot = entries.groupBy("dimension").pivot("status", statuses).agg(F.count(F.lit(1)))
    pivot = pivot.select("dimension", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in statuses])
    cube = entries.cube("dimension", "status").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("cnt"))
    return {"by_status": pivot, "cube": cube}


def volatile_entries(corrections: DataFrame, entries: DataFrame, threshold: int = DEFAULTS.trust.volatile_count) -> DataFrame:
    """Entries corrected at least ``threshold`` times, with the distinct reasons."""
    often = volatility(corrections, threshold).filter("volatile")
    reasons = corrections.groupBy("entry_id").agg(F.sort_array(F.collect_set("reason_category")).alias("reasons"))
    facts = entries.select(F.col("id").alias("entry_id"), "dimension", "entity", "fact", "status", "trust_score")
    return often.select("entry_id", "cnt").join(reasons, "entry_id").join(facts, "entry_id")


def uncovered_documents(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Documents that no fact names as a source."""
    used = entries.select(F.explode("sources").alias("doc")).select(F.col("doc").try_cast("long").alias("id")).distinct()
    return docs.join(used, "id", "left_anti")


def coverage_by_dimension(entries: DataFrame, few: float = 0.5) -> DataFrame:
    """Facts per dimension; ``thin`` marks those below ``few`` times the mean."""
    counts = entries.groupBy("dimension").agg(F.count(F.lit(1)).alias("cnt"))
    mean = counts.agg(F.avg("cnt")).scalar()
    return counts.withColumn("thin", F.col("cnt") < mean * few)


def digest_inputs(entries: DataFrame, docs: DataFrame, since: str, until: str | None = None, group: str = "entity") -> DataFrame:
    """Facts and document summaries of a time window, one row each.

    Rows carry their group (entity, or project for documents) instead of being
    packed into one list per group.
    """
    def window(df: DataFrame) -> DataFrame:
        df = df.filter(F.col("updated_at") >= F.lit(since).cast("timestamp"))
        return df if until is None else df.filter(F.col("updated_at") <= F.lit(until).cast("timestamp"))

    live = window(entries).filter(F.col("status").isNull() | (F.col("status") != "retired"))
    facts = live.select(F.lit("fact").alias("kind"), F.col(group).alias("grp"), "id", F.col("fact").alias("text"), "updated_at")
    summaries = window(docs).filter(F.col("summary").isNotNull()).select(
        F.lit("summary").alias("kind"), F.coalesce("project", F.lit("")).alias("grp"), "id", F.col("summary").alias("text"), "updated_at"
    )
    return facts.unionByName(summaries)


def digest_counts(inputs: DataFrame) -> DataFrame:
    return inputs.groupBy("kind", "grp").agg(F.count(F.lit(1)).alias("cnt"), F.max("updated_at").alias("latest"))


def _text(c: str) -> Column:
    """A value as the report prints it; a missing one prints as None."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def fact_lines(entries: DataFrame) -> DataFrame:
    line = _line(
        "  [", _text("id"), "] ", _text("dimension"), "/", _text("entity"), "/", _text("tag"), ": ", _text("fact"),
        " (status=", _text("status"), ", conf=", _text("confidence"), ", trust=", _text("trust_score"), ")",
    )
    return entries.select("id", "dimension", "entity", line.alias("line"))


def correction_lines(enriched: DataFrame) -> DataFrame:
    line = _line(
        "  [", _text("id"), "] ", _text("dimension"), "/", _text("entity"), " op=", _text("operation"), " category=",
        _text("reason_category"), " trust:", _text("old_trust_score"), "->", _text("new_trust_score"), " at ",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"),
    )
    return enriched.select("id", "created_at", line.alias("line"))


def summary_lines(docs: DataFrame) -> DataFrame:
    """A document's title and its summary."""
    return docs.select("id", _line("  [", _text("id"), "] ", _text("title"), ": ", F.coalesce("summary", F.lit(""))).alias("line"))


def conflict_lines(conflicts: DataFrame) -> DataFrame:
    line = _line(
        "  Trusted [", _text("trusted_id"), "] ", _text("entity"), "/", _text("dimension"), "/", _text("tag"), ': "',
        _text("trusted_fact"), '" (trust=', _text("trust_score"), ") vs Pending [", _text("pending_id"), ']: "',
        _text("pending_fact"), '"',
    )
    return conflicts.select("trusted_id", "pending_id", line.alias("line"))


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Decisions per day by pipeline, stage and outcome, with subtotals."""
    day = audit.withColumn("day", F.to_date("timestamp"))
    return day.rollup("day", "pipeline", "stage", "outcome").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("cnt"), F.round(F.avg("confidence"), 6).alias("avg_confidence")
    )


# Report definitions: name -> builder(entries, corrections, docs). Add an entry to add a report.
REPORTS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], dict[str, DataFrame]]] = {
    "correction_summary": lambda e, c, d: correction_summary(c, e),
    "knowledge_health": lambda e, c, d: knowledge_health(e),
    "volatile_entries": lambda e, c, d: {"entries": volatile_entries(c, e)},
    "coverage_gaps": lambda e, c, d: {"documents": uncovered_documents(d, e), "dimensions": coverage_by_dimension(e)},
    "conflicts": lambda e, c, d: {"members": conflict_members(e), "conflicts": detect_conflicts(e)},
    "meeting_insights": lambda e, c, d: {"facts": fact_lines(e), "summaries": summary_lines(d)},
    "action_items": lambda e, c, d: {"facts": fact_lines(e), "summaries": summary_lines(d)},
    "weekly_digest": lambda e, c, d: {"facts": fact_lines(e), "summaries": summary_lines(d)},
}


def build_report(name: str, entries: DataFrame, corrections: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}")
    return REPORTS[name](entries, corrections, docs)
