"""User corrections applied to entries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.folds import (
    SCAN_CHUNK,
    apply_step,
    clamp_step,
    compose_steps,
    number_rows,
    steps_before,
    value_before,
)
from mnemospark.schemas import DEFAULTS, TrustRules

OPERATIONS = (
    "retire", "edit_fact", "change_tag", "change_entity", "promote",
    "un_retire", "confirm", "reject", "revise",
)
_NEEDS_VALUE = ("edit_fact", "change_tag", "change_entity", "revise")


@dataclass
class AppliedCorrections:
    entries: DataFrame
    log: DataFrame
    rejects: DataFrame
    _spawn: Callable[[], DataFrame]

    @cached_property
    def spawned(self) -> DataFrame:
        """The new entries. Numbering them runs a job, so it waits until they are asked for."""
        return self._spawn()


def apply_corrections(
    entries: DataFrame,
    requests: DataFrame,
    rules: TrustRules = DEFAULTS.trust,
    bucket: str = "1 hour",
    chunk: int = SCAN_CHUNK,
) -> AppliedCorrections:
    """Apply ``requests(id, entry_id, operation, value, reason, reason_category, feedback, created_at)``.

    Fields and status follow the last operation that sets them, trust is a clamped
    fold, and each ``revise`` starts a new entry. All of it works on (entry, time
    slot) pieces, so one much-corrected entry does not gather in a task.
    """
    order = ["created_at", "id"]
    at = F.struct(*order)
    op = F.col("operation")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    present = entries.select(F.col("id").alias("entry_id"), F.lit(True).alias("_known"))
    judged = requests.join(present, "entry_id", "left").withColumn(
        "problem",
        F.when(F.col("_known").isNull(), "unknown entry")
        .when(~F.coalesce(op.isin(*OPERATIONS), F.lit(False)), "unknown operation")
        .when(op.isin(*_NEEDS_VALUE) & blank("value"), "value required")
        .when((op == "retire") & blank("reason"), "reason required"),
    ).drop("_known")
    rejects = judged.filter(F.col("problem").isNotNull())
    ops = judged.filter(F.col("problem").isNull()).drop("problem")
    given = F.when(~blank("reason"), F.col("reason"))
    ops = (
        ops.withColumn("set_fact", F.when(op == "edit_fact", F.col("value")))
        .withColumn("set_tag", F.when(op == "change_tag", F.col("value")))
        .withColumn("set_entity", F.when(op == "change_entity", F.col("value")))
        .withColumn(
            "set_status",
            F.when(op.isin("retire", "reject", "revise"), "retired").when(op.isin("promote", "confirm", "un_retire"), "confident"),
        )
        .withColumn(
            "set_reason",
            F.when(op == "retire", F.struct(given.alias("text")))
            .when(op == "reject", F.struct(F.coalesce(given, F.lit("Rejected by user")).alias("text")))
            .when(op == "revise", F.struct(F.coalesce(given, F.lit("Revised by user")).alias("text")))
            .when(op == "un_retire", F.struct(F.lit(None).cast("string").alias("text"))),
        )
    )
    # A revise retires the old row without touching its trust.
    trust_op = F.when(op.isin("confirm", "promote"), "confirm").when(op == "reject", "reject")
    ops = ops.withColumn("step", clamp_step(F.coalesce(trust_op, F.lit("none")), rules))

    sets = ["set_fact", "set_tag", "set_entity", "set_status", "set_reason"]
    final = ops.groupBy("entry_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in sets])
    total = compose_steps(ops.select("entry_id", *order, "step"), "entry_id", order, bucket)
    state = final.join(total, "entry_id").withColumnRenamed("entry_id", "id")
    joined = entries.join(state, "id", "left")
    values = {c: F.coalesce(f"set_{c}", c) for c in ("fact", "tag", "entity", "status")}
    values["reasoning"] = F.when(F.col("set_reason").isNotNull(), F.col("set_reason.text")).otherwise(F.col("reasoning"))
    values["trust_score"] = F.when(F.col("step").isNull(), F.col("trust_score")).otherwise(
        apply_step(F.coalesce("trust_score", F.lit(0.5)), F.col("step"))
    )
    kept = joined.select(*[values.get(c, F.col(c)).alias(c) for c in entries.columns])

    # What each operation saw: fields from the entry or its last earlier edit.
    slot = F.window("created_at", bucket).getField("start")
    seen = value_before(ops, "entry_id", order, ["set_fact", "set_tag", "set_entity"], slot)
    before = steps_before(ops.select("entry_id", *order, "step"), "entry_id", order, bucket, chunk)
    base = entries.select(
        F.col("id").alias("entry_id"), "dimension", F.col("entity").alias("e_entity"), F.col("tag").alias("e_tag"),
        F.col("fact").alias("e_fact"), "confidence", "sources", F.coalesce("trust_score", F.lit(0.5)).alias("e_trust"),
    )
    seen = seen.join(base, "entry_id")
    logged = seen.join(before, ["entry_id", *order])
    old_trust = apply_step(F.col("e_trust"), F.col("before"))
    is_revise = op == "revise"
    log = logged.select(
        "id", "entry_id", "operation", "reason_category", "feedback",
        F.coalesce("prev_set_fact", "e_fact").alias("old_fact"),
        F.when(op.isin("edit_fact", "revise"), F.col("value")).alias("new_fact"),
        old_trust.alias("old_trust_score"),
        F.when(is_revise, F.lit(rules.revise_base)).otherwise(apply_step(old_trust, F.col("step"))).alias("new_trust_score"),
        "created_at",
    )
    spawned = seen.filter(is_revise).select(
        F.col("id").alias("request_id"), "entry_id", "created_at", "dimension",
        F.coalesce("prev_set_entity", "e_entity").alias("entity"),
        F.coalesce("prev_set_tag", "e_tag").alias("tag"),
        F.col("value").alias("fact"), "confidence", "sources",
        F.lit("pending").alias("status"), F.lit(rules.revise_base).alias("trust_score"),
        F.coalesce(given, F.concat(F.lit("Revised from entry "), F.col("entry_id").cast("string"))).alias("reasoning"),
    )

    def spawn() -> DataFrame:
        top_id = F.coalesce(entries.agg(F.max("id")).scalar(), F.lit(0))
        keys = ops.filter(is_revise).select("created_at", F.col("id").alias("request_id"))
        numbers = number_rows(keys, ["created_at", "request_id"], "id", top_id)
        return spawned.join(numbers.select("request_id", "id"), "request_id")

    return AppliedCorrections(kept, log, rejects, spawn)
