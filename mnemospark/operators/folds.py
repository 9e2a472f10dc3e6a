"""Ordered, per-key replays of event logs, split into time buckets.

A replay of one key in one task breaks when a key holds most of the log. Every
fold here works on (key, bucket) pieces first and combines one small row per
bucket afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.schemas import DEFAULTS, TrustRules
from mnemospark.session import cut_lineage


def clamp_step(op: Column, rules: TrustRules = DEFAULTS.trust) -> Column:
    """One trust operation as ``t -> min(hi, max(lo, t + add))``.

    Such functions are closed under composition, which makes the replay associative.
    Operations that leave trust alone are the identity.
    """
    big = F.lit(1e9)

    def step(add: float, lo, hi) -> Column:
        return F.struct(F.lit(add).alias("add"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"))

    return (
        F.when(op == "confirm", step(rules.confirm_delta, -1e9, 1.0))
        .when(op == "reject", step(-rules.reject_delta, 0.0, 1e9))
        .when(op == "revise", step(0.0, rules.revise_base, rules.revise_base))
        .otherwise(step(0.0, -1e9, 1e9))
    )


def _then(first: Column, second: Column) -> Column:
    def clamp(x: Column) -> Column:
        return F.least(second["hi"], F.greatest(second["lo"], x + second["add"]))

    return F.struct(
        (first["add"] + second["add"]).alias("add"), clamp(first["lo"]).alias("lo"), clamp(first["hi"]).alias("hi")
    )


def _identity() -> Column:
    return F.struct(F.lit(0.0).alias("add"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"))


def apply_step(trust: Column, step: Column) -> Column:
    return F.round(F.least(step["hi"], F.greatest(step["lo"], trust + step["add"])), 9)


CHUNK = 1000
# A scan copies its output array per element, so its pieces are shorter.
SCAN_CHUNK = 200


def positions(rows: DataFrame, key: str, order: list[str], bucket: str = "1 hour") -> DataFrame:
    """Add ``pos``, the 0-based place of each row in its key's ``order`` (a time first).

    Rows are ranked inside (key, time slot) and shifted by the sizes of the key's
    earlier slots.
    """
    rows = rows.withColumn("_slot", F.window(order[0], bucket).getField("start"))
    sizes = rows.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_slot").orderBy(*order)
    ranked = rows.withColumn("_rn", F.row_number().over(inside) - 1).join(offsets, [key, "_slot"])
    return ranked.withColumn("pos", F.col("_offset") + F.col("_rn")).drop("_slot", "_rn", "_offset")


def _fold(items: Column) -> Column:
    return F.aggregate(items, _identity(), lambda acc, x: _then(acc, x["step"]))


def _gather(placed: DataFrame, key: str, size: int | None) -> DataFrame:
    """Steps in arrays of at most ``size`` consecutive ones (all of a key for None)."""
    piece = F.lit(0) if size is None else F.floor(F.col("pos") / size)
    return placed.groupBy(key, piece.cast("long").alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "step"))).alias("items")
    )


def compose_steps(steps: DataFrame, key: str, order: list[str], bucket: str = "1 hour", chunk: int = CHUNK) -> DataFrame:
    """Composition of the ``step`` column per key, in ``order`` (first column a time).

    Steps are folded in pieces of ``chunk``, the pieces in pieces again, and then one
    array per key: a key with 10^9 steps ends in an array of 1000.
    """
    level = positions(steps, key, order, bucket).select(key, "pos", "step")
    for size in (chunk, chunk, None):
        level = _gather(level, key, size).select(key, F.col("piece").alias("pos"), _fold(F.col("items")).alias("step"))
    return level.select(key, "step")


TRUST_OPERATIONS = ("confirm", "reject", "revise")


def replay_trust(entries: DataFrame, corrections: DataFrame, rules: TrustRules = DEFAULTS.trust) -> tuple[DataFrame, DataFrame]:
    """Entries with the trust their confirm / reject / revise log leads to, and the
    log rows whose operation is unknown."""
    known = corrections.filter(F.col("operation").isin(*TRUST_OPERATIONS))
    rejects = corrections.filter(~F.coalesce(F.col("operation").isin(*TRUST_OPERATIONS), F.lit(False))).withColumn(
        "reason", F.lit("unknown operation")
    )
    steps = known.select("entry_id", "created_at", "id", clamp_step(F.col("operation"), rules).alias("step"))
    total = compose_steps(steps, "entry_id", ["created_at", "id"]).withColumnRenamed("entry_id", "id")
    joined = entries.join(total, "id", "left")
    trust = F.when(F.col("step").isNull(), F.col("trust_score")).otherwise(
        apply_step(F.coalesce("trust_score", F.lit(0.5)), F.col("step"))
    )
    return joined.withColumn("trust_score", trust).drop("step"), rejects


def decayed_scores(
    entries: DataFrame,
    surfacings: DataFrame,
    sweeps: DataFrame,
    decay: float = DEFAULTS.retrieval_decay,
    bucket: str = "1 hour",
) -> DataFrame:
    """Retrieval score after a log of surfacings ``(entry_id, ts, event_id)`` and sweeps ``(ts)``.

    A surfacing does ``s*d + 1`` on its entry, a sweep ``s*d`` on all. Each surfacing
    contributes ``d`` to the number of later operations on its entry. Sweeps come
    once a day, so their sorted times fit one array.
    """
    times = sweeps.agg(F.sort_array(F.collect_list("ts"), asc=False).alias("t")).scalar()
    # Newest first: the sweeps after an event are a prefix of the array.
    swept = surfacings.withColumn("sweeps", times).withColumn(
        "later_sweeps", F.size(F.filter("sweeps", lambda s: s > F.col("ts")))
    )
    slot = F.window("ts", bucket).getField("start")
    bumps = swept.select("entry_id", "ts", "event_id", "later_sweeps", slot.alias("slot"))
    behind = Window.partitionBy("entry_id", "slot").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    ranked = bumps.withColumn("later_bumps", F.row_number().over(behind) - 1)
    per_slot = ranked.groupBy("entry_id", "slot").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pow(F.lit(decay), F.col("later_bumps") + F.col("later_sweeps"))).alias("part"),
    )
    after = Window.partitionBy("entry_id").orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    totals = (
        per_slot.withColumn("newer", F.coalesce(F.sum("n").over(after), F.lit(0)))
        .groupBy("entry_id")
        .agg(F.sum("n").alias("n"), F.sum(F.col("part") * F.pow(F.lit(decay), "newer")).alias("gain"))
        .withColumnRenamed("entry_id", "id")
    )
    n_sweeps = sweeps.agg(F.count(F.lit(1))).scalar()
    base = F.coalesce("retrieval_score", F.lit(0.0)) * F.pow(F.lit(decay), F.coalesce("n", F.lit(0)) + n_sweeps)
    score = F.round(base + F.coalesce("gain", F.lit(0.0)), 9)
    return entries.join(totals, "id", "left").withColumn("retrieval_score", score).drop("n", "gain")


def value_before(log: DataFrame, key: str, order: list[str], values: list[str], slot: Column) -> DataFrame:
    """Last non-NULL of each value column over the key's earlier rows, as ``prev_*``.

    ``slot`` cuts the order into pieces. Windows run inside (key, slot); one summary
    row per slot carries the values on.
    """
    log = log.withColumn("_slot", slot)
    inside = Window.partitionBy(key, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    last = log.groupBy(key, "_slot").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in values])
    carried = last.select(key, "_slot", *[F.last(v, ignorenulls=True).over(before).alias(f"_c_{v}") for v in values])
    local = log.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(f"_l_{v}") for v in values])
    out = local.join(carried, [key, "_slot"])
    for v in values:
        out = out.withColumn(f"prev_{v}", F.coalesce(f"_l_{v}", f"_c_{v}")).drop(f"_l_{v}", f"_c_{v}")
    return out.drop("_slot")


def _scan(items: Column) -> Column:
    """``struct<now, out>``: the fold of an array and, per element, the fold before it."""
    step = "struct<add:double,lo:double,hi:double>"
    none = F.array().cast(f"array<struct<pos:bigint,before:{step}>>")
    return F.aggregate(
        items,
        F.struct(_identity().alias("now"), none.alias("out")),
        lambda acc, x: F.struct(
            _then(acc["now"], x["step"]).alias("now"),
            F.concat(acc["out"], F.array(F.struct(x["pos"].alias("pos"), acc["now"].alias("before")))).alias("out"),
        ),
    )


def steps_before(
    steps: DataFrame, key: str, order: list[str], bucket: str = "1 hour", chunk: int = SCAN_CHUNK
) -> DataFrame:
    """``(key, *order, before)``: composition of the key's steps ahead of each row.

    Pieces of ``chunk`` steps are scanned on their own; scans over the pieces, and
    over pieces of pieces, give what came before each.
    """
    placed = positions(steps, key, order, bucket)
    level, scans = placed.select(key, "pos", "step"), []
    for size in (chunk, 5 * chunk, None):
        scanned = _gather(level, key, size).withColumn("r", _scan(F.col("items"))).select(key, "piece", "r")
        scans.append(scanned.select(key, "piece", F.inline("r.out")))
        level = scanned.select(key, F.col("piece").alias("pos"), F.col("r.now").alias("step"))
    rows, pieces, groups = scans
    pieces = pieces.select(key, F.col("pos").alias("piece"), F.col("piece").alias("group"), F.col("before").alias("b1"))
    groups = groups.select(key, F.col("pos").alias("group"), F.col("before").alias("b2"))
    full = rows.join(pieces, [key, "piece"]).join(groups, [key, "group"])
    before = full.select(key, "pos", _then(F.col("b2"), _then(F.col("b1"), F.col("before"))).alias("before"))
    return placed.select(key, "pos", *order).join(before, [key, "pos"]).select(key, *order, "before")


def number_rows(df: DataFrame, order: list, name: str, start: Column | int = 0) -> DataFrame:
    """Consecutive numbers in a total order without sorting everything in one task.

    Rows are dealt out by ranges of the order, sorted there and stored, so that their
    places stay. A range starts at the sum of the sizes of those before: one row for each
    partition is all that is summed up together. Give slim rows, and join the rest back.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(placed.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    base = F.lit(start) if isinstance(start, int) else start
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, (base + F.col("_offset") + F.col("_place") + 1).cast("long")).drop("_part", "_place", "_offset")


def last_write(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """One row for each key: of every column the value written last that is not null.

    Rows are in the order of the column ``order``; without such a column the largest row
    as a whole wins (compared column by column), so that the result is one that was
    written and does not depend on how the rows lie.
    """
    columns = [c for c in df.columns if c not in (key, order)]
    if order not in df.columns:
        return df.groupBy(key).agg(F.max(F.struct(*columns)).alias("_w")).select(key, "_w.*")
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
