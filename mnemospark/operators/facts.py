"""Extractor replies and the fact actions they carry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.quality import status_of
from mnemospark.operators.folds import last_write, number_rows, value_before
from mnemospark.schemas import DEFAULTS, Bands
from mnemospark.session import cut_lineage

KEY = ["dimension", "entity", "tag"]

# Fields each reply action must carry.
REQUIRED = {
    "retire": ("id", "reason"),
    "update": ("id", "entity", "tag", "fact", "confidence"),
    "new": ("entity", "tag", "fact", "confidence"),
}


def _item_problem(item: Column) -> Column:
    """NULL for a sound reply item, else the first thing wrong with it."""
    action = item["action"]
    problem = F.when(~F.coalesce(action.isin(*REQUIRED), F.lit(False)), F.concat(F.lit("unknown action "), F.coalesce(action, F.lit("None"))))
    for name, fields in REQUIRED.items():
        for field in fields:
            absent = (action == name) & ~F.map_contains_key(item, field)
            problem = problem.when(absent, f"'{name}' missing '{field}'")
    is_new = action == "new"
    problem = problem.when(is_new & F.map_contains_key(item, "id"), "'new' must not include 'id'")
    for field in ("entity", "tag", "fact"):
        blank = F.coalesce(item[field], F.lit("None")).rlike(r"^\s*$")
        problem = problem.when(is_new & blank, f"'new' '{field}' must not be empty")
    conf = item["confidence"].try_cast("double")
    rated = action.isin("new", "update")
    return problem.when(rated & conf.isNull(), "confidence is not a number").when(
        rated & ~conf.between(0.0, 1.0), "confidence out of range [0.0, 1.0]"
    )


def validate_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``replies(reply_id, doc_id, dimension, raw)`` to (actions, rejects).

    One bad item rejects its whole reply with the first problem found.
    """
    parsed = F.try_parse_json("raw")
    items = F.from_json("raw", "array<map<string,string>>")
    kinds = F.try_variant_get(parsed, "$", "array<variant>")
    not_dict = F.array_position(F.transform(kinds, lambda v: F.schema_of_variant(v).startswith("OBJECT")), F.lit(False))
    judged = replies.withColumn("items", items).withColumn(
        "problems",
        F.filter(
            F.transform("items", lambda x, i: F.struct(i.alias("i"), _item_problem(x).alias("why"))),
            lambda p: p["why"].isNotNull(),
        ),
    )
    first = F.try_element_at("problems", F.lit(1))
    reason = (
        F.when(parsed.isNull(), "JSON parse error")
        .when(~F.schema_of_variant(parsed).startswith("ARRAY"), "reply must be a JSON array")
        .when(not_dict > 0, F.format_string("item[%d] is not an object", (not_dict - 1).cast("long")))
        .when(F.size("problems") > 0, F.concat(F.lit("item["), first["i"].cast("string"), F.lit("] "), first["why"]))
    )
    judged = judged.withColumn("reason", reason)
    rejects = judged.filter(F.col("reason").isNotNull()).select("reply_id", "doc_id", "dimension", "reason")
    good = judged.filter(F.col("reason").isNull()).select(
        "reply_id", "doc_id", "dimension", F.posexplode("items").alias("item_no", "item")
    )
    item = F.col("item")
    actions = good.select(
        "reply_id", "doc_id", "dimension", "item_no",
        item["action"].alias("action"),
        item["id"].try_cast("long").alias("id"),
        item["entity"].alias("entity"), item["tag"].alias("tag"), item["fact"].alias("fact"),
        item["confidence"].try_cast("double").alias("confidence"),
        item["reason"].alias("reason"),
    )
    return actions, rejects


def twins(entries: DataFrame) -> DataFrame:
    """Lowest id of the non-retired entries of each (dimension, entity, tag)."""
    live = entries.filter(F.col("status").isNull() | (F.col("status") != "retired"))
    return live.groupBy(*KEY).agg(F.min("id").alias("twin_id"))


def attach_twins(facts: DataFrame, entries: DataFrame) -> DataFrame:
    return facts.join(twins(entries), KEY, "left")


def upsert_status(explicit: Column, confidence: Column, existing: Column, bands: Bands | None = DEFAULTS.bands) -> Column:
    """Explicit status, else the band of the confidence, else the old status, else pending."""
    banded = status_of(confidence, bands) if bands else F.lit(None).cast("string")
    return F.coalesce(explicit, banded, existing, F.lit("pending"))


def upsert_entries(entries: DataFrame, rows: DataFrame, bands: Bands | None = DEFAULTS.bands) -> DataFrame:
    """Overwrite entries by id; the retrieval score never changes here.

    Of several rows with one id the last by ``seq`` counts, if there is such a column.
    """
    rows = last_write(rows, "id")
    new = rows.select("id", *[F.col(c).alias(f"n_{c}") for c in rows.columns if c != "id"], F.lit(True).alias("_hit"))
    joined = entries.join(new, "id", "left")
    status = upsert_status(F.col("n_status"), F.col("n_confidence"), F.col("status"), bands)
    kept = {c: F.coalesce(f"n_{c}", c) for c in rows.columns if c not in ("id", "status", "retrieval_score")}
    kept["status"] = F.when(F.col("_hit"), status).otherwise(F.col("status"))
    return joined.select(*[kept.get(c, F.col(c)).alias(c) for c in entries.columns])


def retire(entries: DataFrame, retirements: DataFrame) -> DataFrame:
    """Mark ``retirements(id, reason)`` retired; the rows stay searchable.

    Of several reasons the last by ``seq`` stays, if there is such a column.
    """
    own = retirements.select("id", F.col("reason").alias("_reason"), *(["seq"] if "seq" in retirements.columns else []))
    hit = last_write(own, "id").withColumn("_hit", F.lit(True))
    joined = entries.join(hit, "id", "left")
    return (
        joined.withColumn("status", F.when(F.col("_hit"), "retired").otherwise(F.col("status")))
        .withColumn("reasoning", F.when(F.col("_hit"), F.col("_reason")).otherwise(F.col("reasoning")))
        .drop("_hit", "_reason")
    )


def merge_source(sources: Column, doc_id: Column) -> Column:
    """Existing sources plus one document, first occurrences kept in order."""
    return F.array_distinct(F.concat(sources, F.array(doc_id.cast("string"))))


def prune_sources(entries: DataFrame, deleted: DataFrame) -> DataFrame:
    """Take ``deleted(id)`` documents out of the sources of non-retired entries.

    An entry left without sources becomes pending. Entries that name no deleted
    document are passed through unchanged.
    """
    live = entries.filter(F.col("status").isNull() | (F.col("status") != "retired"))
    links = live.select("id", F.explode("sources").alias("doc_id"))
    gone = deleted.select(F.col("id").cast("string").alias("doc_id")).distinct()
    hits = links.join(gone, "doc_id").groupBy("id").agg(F.collect_set("doc_id").alias("_gone"))
    left = F.array_except("sources", F.col("_gone"))
    touched = F.col("_gone").isNotNull()
    return (
        entries.join(hits, "id", "left")
        .withColumn("status", F.when(touched & (F.size(left) == 0), "pending").otherwise(F.col("status")))
        .withColumn("sources", F.when(touched, left).otherwise(F.col("sources")))
        .drop("_gone")
    )


@dataclass
class AppliedActions:
    """``entries`` after the batch, new ``links(entry_id, doc_id, at)`` to source
    documents, ``inserted`` rows, ``skipped`` actions and ``replies`` cleanliness."""

    entries: DataFrame
    inserted: DataFrame
    links: DataFrame
    skipped: DataFrame
    replies: DataFrame


def apply_actions(
    entries: DataFrame,
    actions: DataFrame,
    bands: Bands | None = DEFAULTS.bands,
    overwrite_above: float = DEFAULTS.trust.overwrite_above,
    now: str | None = None,
    chunk: int = 1000,
    answered: DataFrame | None = None,
) -> AppliedActions:
    """Apply new / update / retire actions in (document, dimension, item) order.

    The last write to a row wins and a row's trust never changes here, so each
    target needs grouped aggregates only; no group is gathered. Twins are looked up
    at the start of the batch. A ``new`` whose twin was retired earlier in the batch
    starts a fresh row.

    ``answered(doc_id, dimension)`` lists the accepted replies, so that one without any
    action has its outcome too: it is clean.
    """
    stamp = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    order = F.struct("doc_id", "dimension", "item_no")
    acts = actions.select("doc_id", "dimension", "item_no", "action", "id", "entity", "tag", "fact", "confidence", "reason")

    # 1. Targets. Explicit ids must exist; `new` looks for a twin.
    known = entries.select(
        F.col("id"), (F.coalesce("trust_score", F.lit(0.5)) > overwrite_above).alias("guarded")
    )
    explicit = acts.filter(F.col("action").isin("update", "retire")).join(known, "id", "left")
    skipped = explicit.filter(F.col("guarded").isNull()).drop("guarded")
    explicit = explicit.filter(F.col("guarded").isNotNull()).withColumn("target", F.col("id"))
    fresh = attach_twins(acts.filter(F.col("action") == "new"), entries)
    fresh = fresh.join(known.withColumnRenamed("id", "twin_id"), "twin_id", "left").withColumnRenamed("twin_id", "target")

    # 2. Twins retired earlier in the batch. Only targets with a retire are replayed.
    closing = explicit.filter(F.col("action") == "retire").select("target").distinct()
    marker = F.when(F.col("action") == "retire", "retired").when(
        (F.col("action") == "update") & ~F.col("guarded"), "live"
    )
    columns = [*acts.columns, "target", "guarded"]
    disputed = fresh.join(closing, "target", "left_semi").select(columns)
    replay = explicit.join(closing, "target", "left_semi").select(columns).unionByName(disputed)
    replay = value_before(
        replay.withColumn("mark", marker), "target", ["doc_id", "dimension", "item_no"], ["mark"],
        F.floor(F.col("doc_id") / chunk),
    )
    disputed = replay.filter(F.col("action") == "new")
    was_retired = F.coalesce(F.col("prev_mark") == "retired", F.lit(False))
    disputed = disputed.withColumn("target", F.when(~was_retired, F.col("target"))).withColumn(
        "guarded", F.when(~was_retired, F.col("guarded"))
    )
    settled = fresh.join(closing, "target", "left_anti").select(columns)
    news = settled.unionByName(disputed.select(columns))
    # Five branches below read the placed actions; they are stored once.
    placed = cut_lineage(explicit.select(columns).unionByName(news))

    # 3. Existing rows: last write per target.
    writes = (F.col("action") != "retire") & ~F.coalesce("guarded", F.lit(False))
    on_rows = placed.filter(F.col("target").isNotNull() & ((F.col("action") == "retire") | writes))
    is_write = F.col("action") != "retire"
    body = F.struct("dimension", "entity", "tag", "fact", "confidence")
    given = F.coalesce("reason", F.lit("")) != ""
    changes = on_rows.groupBy(F.col("target").alias("id")).agg(
        F.max_by(body, F.when(is_write, order)).alias("w"),
        F.max_by("action", order).alias("last_action"),
        F.max_by("reason", F.when(~is_write | given, order)).alias("new_reason"),
        F.max(~is_write | given).alias("has_reason"),
    )
    hit, written = F.col("last_action").isNotNull(), F.col("w").isNotNull()
    status = (
        F.when(F.col("last_action") == "retire", "retired")
        .when(hit, upsert_status(F.lit(None).cast("string"), F.col("w.confidence"), F.lit(None).cast("string"), bands))
        .otherwise(F.col("status"))
    )
    updated = entries.join(changes, "id", "left")
    new_values = {c: F.when(written, F.col(f"w.{c}")).otherwise(F.col(c)) for c in (*KEY, "fact", "confidence")}
    new_values["status"] = status
    new_values["reasoning"] = F.when(F.col("has_reason"), F.col("new_reason")).otherwise(F.col("reasoning"))
    if "updated_at" in entries.columns:
        new_values["updated_at"] = F.when(hit, stamp).otherwise(F.col("updated_at"))
    kept = updated.select(*[new_values.get(c, F.col(c)).alias(c) for c in entries.columns])

    # 4. Inserts: one row per fresh key, and one competing row per guarded write.
    unplaced = placed.filter((F.col("action") == "new") & F.col("target").isNull())
    started = unplaced.groupBy(*KEY).agg(
        F.max_by(F.struct("fact", "confidence"), order).alias("w"),
        F.max_by("reason", F.when(given, order)).alias("reasoning"),
        F.min(order).alias("first"),
    )
    rows = ["dimension", "entity", "tag", "fact", "confidence", "reasoning", "status", "competes_with", "first"]
    started = started.select(
        *KEY, "w.fact", "w.confidence", F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        upsert_status(F.lit(None).cast("string"), F.col("w.confidence"), F.lit(None).cast("string"), bands).alias("status"),
        F.lit(None).cast("long").alias("competes_with"), "first",
    ).select(rows)
    competing = placed.filter(F.col("guarded") & (F.col("action") != "retire")).select(
        *KEY, "fact", "confidence", F.coalesce("reason", F.lit("")).alias("reasoning"), F.lit("pending").alias("status"),
        F.col("target").alias("competes_with"), order.alias("first"),
    ).select(rows)
    top_id = F.coalesce(entries.agg(F.max("id")).scalar(), F.lit(0))
    inserted = number_rows(started.unionByName(competing), ["first"], "id", top_id)
    inserted = inserted.withColumn("trust_score", F.lit(0.5))  # its rows are stored by the numbering

    # 5. Source links, one per (row, document).
    touched = on_rows.filter(is_write).select(F.col("target").alias("entry_id"), "doc_id", order.alias("at"))
    own = inserted.filter(F.col("competes_with").isNotNull()).select(
        F.col("id").alias("entry_id"), F.col("first.doc_id").alias("doc_id"), F.col("first").alias("at")
    )
    keyed = inserted.filter(F.col("competes_with").isNull()).select(F.col("id").alias("entry_id"), *KEY)
    begun = unplaced.select(*KEY, "doc_id", order.alias("at")).join(keyed, KEY).select("entry_id", "doc_id", "at")
    links = (
        touched.unionByName(own).unionByName(begun).groupBy("entry_id", "doc_id").agg(F.min("at").alias("at"))
    )
    heard = acts if answered is None else acts.select("doc_id", "dimension").unionByName(answered.select("doc_id", "dimension"))
    replies = (
        heard.select("doc_id", "dimension", F.lit(0).alias("bad"))
        .unionByName(skipped.select("doc_id", "dimension", F.lit(1).alias("bad")))
        .groupBy("doc_id", "dimension")
        .agg((F.sum("bad") == 0).alias("clean"), F.sum("bad").alias("n_skipped"))
    )
    full = kept.unionByName(
        inserted.select(*[c for c in entries.columns if c in inserted.columns]), allowMissingColumns=True
    )
    return AppliedActions(full, inserted.drop("first"), links, skipped, replies)


def reply_outcomes(applied: AppliedActions, rejects: DataFrame) -> DataFrame:
    """``doc_id, dimension, clean, error`` of every reply, for :func:`state.apply_outcomes`.

    A reply is clean when it was accepted and none of its actions was skipped; of
    several replies to one question any failure counts.
    """
    kept = applied.replies.select(
        "doc_id", "dimension", "clean",
        F.when(~F.col("clean"), F.format_string("%d actions name unknown entries", "n_skipped")).alias("error"),
    )
    refused = rejects.select("doc_id", "dimension", F.lit(False).alias("clean"), F.col("reason").alias("error"))
    return kept.unionByName(refused).groupBy("doc_id", "dimension").agg(F.every("clean").alias("clean"), F.max("error").alias("error"))


def accepted_replies(replies: DataFrame, rejects: DataFrame) -> DataFrame:
    """``doc_id, dimension`` of the replies that were not rejected, those without items too."""
    return replies.join(rejects.select("reply_id"), "reply_id", "left_anti").select("doc_id", "dimension").distinct()


def pack_sources(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Fold new source links into the ``sources`` arrays, for display.

    The arrays are as long as a row's list of documents; operators work on the
    links table instead.
    """
    gathered = links.groupBy(F.col("entry_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "doc_id"))), lambda x: x["doc_id"].cast("string")).alias("_new")
    )
    none = F.array().cast("array<string>")
    merged = F.array_distinct(F.concat(F.coalesce("sources", none), F.coalesce("_new", none)))
    return entries.join(gathered, "id", "left").withColumn("sources", merged).drop("_new")
