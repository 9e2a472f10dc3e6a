"""Facts to show: entity map, ranked orientation facts, few-shot examples, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.quality import check_rulebook
from mnemospark.functions.text import fact_bullet, few_shot_line
from mnemospark.operators.filters import choose_content, find_unclassified, top_per_group
from mnemospark.schemas import DEFAULTS
from mnemospark.session import cut_lineage


def orientation_order() -> list[Column]:
    return [
        F.col("trust_score").desc(),
        F.col("retrieval_score").desc(),
        F.col("confidence").desc(),
        F.col("updated_at").desc(),
        F.col("id"),
    ]


def entity_map(entries: DataFrame, cap: int = DEFAULTS.entities_per_dimension) -> DataFrame:
    """Largest entities per dimension and how many more there are.

    Rows without status count here; only ``retired`` is left out.
    """
    live = entries.filter((F.col("status").isNull() | (F.col("status") != "retired")) & (F.col("entity") != ""))
    counts = live.groupBy("dimension", "entity").agg(F.count(F.lit(1)).alias("cnt"))
    top = top_per_group(counts, ["dimension"], [F.col("cnt").desc(), F.col("entity")], cap)
    # Counted apart from the window, so the window keeps only `cap` rows per task.
    totals = counts.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"))
    extra = F.greatest(F.col("n") - cap, F.lit(0))
    return top.join(totals, "dimension").select("dimension", "entity", "cnt", "rank", extra.alias("extra"))


def inbox_stats(docs: DataFrame) -> DataFrame:
    inbox = docs.filter(F.lower("vault_path").startswith("inbox/"))
    return inbox.agg(F.count(F.lit(1)).alias("cnt"), F.max("updated_at").alias("last_updated"))


def volatility(corrections: DataFrame, threshold: int = DEFAULTS.trust.volatile_count) -> DataFrame:
    counts = corrections.groupBy("entry_id").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("volatile", F.col("cnt") >= threshold)


def dimensions(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("status").isNull() | (F.col("status") != "retired")).select("dimension").distinct()


def top_entries(entries: DataFrame, cap: int = DEFAULTS.entries_per_dimension) -> DataFrame:
    """Entries shown to the extractor, best first, at most ``cap`` per dimension."""
    order = [F.col("trust_score").desc(), F.col("confidence").desc(), F.col("updated_at").desc(), F.col("id")]
    return top_per_group(entries.filter(F.col("status") != "retired"), ["dimension"], order, cap)


def orientation(
    entries: DataFrame,
    cap: int = DEFAULTS.orientation_per_dimension,
    min_trust: float | None = DEFAULTS.trust.context_floor,
    per: str = "dimension",
) -> DataFrame:
    """Best facts per dimension. Rows without status or trust are left out."""
    rows = entries.filter(F.col("status") != "retired")
    if min_trust is not None:
        rows = rows.filter(F.col("trust_score") >= min_trust)
    return top_per_group(rows, [per], orientation_order(), cap)


def orientation_for_entities(entries: DataFrame, entities: DataFrame, cap: int = DEFAULTS.orientation_per_dimension) -> DataFrame:
    """Top facts of each entity; a dimension shows only under the first entity that has it.

    Entities are ordered by their best fact, then by name.
    """
    wanted = entries.join(entities.select("entity").distinct(), "entity", "left_semi")
    top = orientation(wanted, cap, per="entity")
    key = F.struct(
        *[
            F.struct(c.isNull().alias("missing"), (-c).alias("value")).alias(f"k{i}")
            for i, c in enumerate(
                [F.col("trust_score"), F.col("retrieval_score"), F.col("confidence"), F.unix_micros("updated_at")]
            )
        ],
        F.col("id"),
    )
    best = top.groupBy("entity").agg(F.min(key).alias("best"))
    placed = top.join(best, "entity")
    claims = placed.groupBy("dimension").agg(F.min_by("entity", F.struct("best", "entity")).alias("entity"))
    return top.join(claims, ["dimension", "entity"])


def mark_volatile(facts: DataFrame, corrections: DataFrame, threshold: int = DEFAULTS.trust.volatile_count) -> DataFrame:
    """Add the formatted ``bullet`` with its mark for frequently corrected facts."""
    counts = corrections.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_corrections"))
    joined = facts.join(counts.withColumnRenamed("entry_id", "id"), "id", "left")
    bullet = fact_bullet(F.col("entity"), F.col("fact"), F.col("confidence"), F.col("n_corrections"), threshold)
    return joined.withColumn("bullet", bullet).drop("n_corrections")


def attach_comments(ranked: DataFrame, comments: DataFrame) -> DataFrame:
    """Append an entry's comments, oldest first, to its reasoning.

    Meant for ranked (capped) entries: only their comments are gathered.
    """
    own = comments.join(ranked.select(F.col("id").alias("entry_id")).distinct(), "entry_id", "left_semi")
    lines = F.sort_array(F.collect_list(F.struct("created_at", "id", "comment_text")))
    text = own.groupBy("entry_id").agg(F.array_join(F.transform(lines, lambda c: c["comment_text"]), "; ").alias("_c"))
    joined = ranked.join(text.withColumnRenamed("entry_id", "id"), "id", "left")
    extended = F.concat(F.coalesce("reasoning", F.lit("")), F.lit("\nComments: "), F.col("_c"))
    return joined.withColumn("reasoning", F.when(F.col("_c").isNotNull(), extended).otherwise(F.col("reasoning"))).drop("_c")


def few_shot(
    corrections: DataFrame,
    entries: DataFrame,
    targets: DataFrame,
    cap: int = DEFAULTS.trust.few_shot_cap,
) -> DataFrame:
    """Best recent extraction mistakes for each ``targets(target, entities)`` dimension.

    A match of dimension or entity outweighs recency, which only the newest ten have. So
    the best ``cap`` are among the newest ``cap`` of each dimension, of each entity and
    of all, and the newest ten: the whole log is searched, and few rows go on.
    """
    keyed = entries.select(F.col("id").alias("entry_id"), "dimension", "entity")
    errors = corrections.filter(F.col("reason_category") == "ai_error").join(keyed, "entry_id")
    columns = ["created_at", "id", "dimension", "entity", "old_fact", "new_fact", "feedback"]
    # stored: the five branches below would each join the log again; texts join the few chosen rows at the end
    slim = ["created_at", "id", "dimension", "entity"]
    errors = cut_lineage(errors.select(*slim, F.lower("entity").alias("_entity")))
    newest_first = [F.col("created_at").desc(), F.col("id").desc()]
    newest = errors.orderBy(*newest_first).limit(max(10, cap))
    ages = newest.agg(F.reverse(F.sort_array(F.collect_list(F.struct("created_at", "id")))).alias("a")).select(
        F.posexplode("a").alias("_age", "c")
    ).select("_age", F.col("c.id").alias("id"))
    wanted = targets.select("target", F.transform("entities", lambda e: F.lower(e)).alias("_names"))
    named = wanted.select("target", F.explode("_names").alias("_entity")).distinct()
    of_dimension = top_per_group(errors, ["dimension"], newest_first, cap).select(*slim, "_entity")
    with_entity = errors.filter(F.col("_entity") != "")
    of_entity = top_per_group(with_entity, ["_entity"], newest_first, cap).select(*slim, "_entity")
    of_both = top_per_group(with_entity, ["dimension", "_entity"], newest_first, cap).select(*slim, "_entity")
    any_target = wanted.select("target", F.lit(1).alias("_all"))
    found = (
        of_dimension.withColumn("target", F.col("dimension")).join(wanted.select("target"), "target")
        .unionByName(of_entity.join(named, "_entity"))
        .unionByName(of_both.join(named, "_entity").filter(F.col("dimension") == F.col("target")))
        .unionByName(newest.withColumn("_all", F.lit(1)).join(any_target, "_all").drop("_all"))
        .dropDuplicates(["target", "id"])
    )
    rows = found.join(wanted, "target").join(F.broadcast(ages), "id", "left")
    score = (
        F.when(F.col("dimension") == F.col("target"), 3.0).otherwise(0.0)
        + F.when(F.array_contains("_names", F.coalesce("_entity", F.lit(""))) & (F.col("_entity") != ""), 2.0).otherwise(0.0)
        + F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce("_age", F.lit(10)) * 0.1)
    )
    scored = rows.select("target", F.round(score, 9).alias("score"), *slim)
    best = top_per_group(scored, ["target"], [F.col("score").desc(), *newest_first], cap)
    best = best.join(corrections.select("id", "old_fact", "new_fact", "feedback"), "id").select("target", "score", *columns, "rank")
    line = few_shot_line(F.col("entity"), F.col("dimension"), F.col("old_fact"), F.col("new_fact"), F.col("feedback"))
    return best.withColumn("line", line)


def extraction_requests(
    docs: DataFrame,
    entries: DataFrame,
    corrections: DataFrame,
    comments: DataFrame,
    rulebook: dict[str, dict],
    max_tokens: int = DEFAULTS.content_tokens,
    cap: int = DEFAULTS.entries_per_dimension,
) -> DataFrame:
    """One row per unclassified document and rulebook dimension.

    Facts and examples depend on the dimension alone: they are gathered once, at
    most ``cap`` facts each, and join the documents as one row per dimension.
    """
    check_rulebook(rulebook)
    names = F.array(*[F.lit(d) for d in rulebook])
    spark = entries.sparkSession
    dims = spark.range(1).select(F.explode(names).alias("dimension"))
    ranked = attach_comments(top_entries(entries, cap), comments)
    fact = F.struct("rank", "id", "entity", "tag", "fact", "confidence", "reasoning")
    facts = ranked.groupBy("dimension").agg(F.sort_array(F.collect_list(fact)).alias("facts"))
    shown = ranked.groupBy("dimension").agg(F.collect_set("entity").alias("entities"))
    names_of = F.coalesce("entities", F.array().cast("array<string>")).alias("entities")
    targets = dims.join(shown, "dimension", "left").select(F.col("dimension").alias("target"), names_of)
    shots = few_shot(corrections, entries, targets).groupBy(F.col("target").alias("dimension")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("few_shot")
    )
    per_dimension = dims.join(facts, "dimension", "left").join(shots, "dimension", "left")
    todo = choose_content(find_unclassified(docs), max_tokens).select(
        F.col("id").alias("doc_id"), "content", "fits", F.col("classify_last_error").alias("feedback"), F.explode(names).alias("dimension")
    )
    empty_shots = F.array().cast("array<string>")
    return todo.join(F.broadcast(per_dimension), "dimension").withColumn("few_shot", F.coalesce("few_shot", empty_shots))


def unseen(results: DataFrame, seen: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Results not yet shown in their session, and the extended seen table."""
    fresh = results.join(seen.select("session_id", key), ["session_id", key], "left_anti")
    shown = fresh.select("session_id", key).distinct()
    return fresh, seen.select("session_id", key).unionByName(shown)


def overview(entries: DataFrame, docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Lines of the overview: entity map, orientation facts, inbox count.

    A long table of lines with a sort key (``section``, ``dimension``, ``rank``)
    instead of one text, so it has no size limit.
    """
    shape = ["section", "dimension", "rank", "line"]
    ents = entity_map(entries)
    line = F.format_string("- %s (%d)", "entity", "cnt")
    mapped = ents.select(F.lit(1).alias("section"), "dimension", "rank", line.alias("line"))
    more = (
        ents.filter((F.col("extra") > 0) & (F.col("rank") == 1))
        .select(F.lit(1).alias("section"), "dimension", F.lit(2**31 - 1).alias("rank"), F.format_string("+%d more", "extra").alias("line"))
    )
    key = mark_volatile(orientation(entries), corrections)
    facts = key.select(F.lit(2).alias("section"), "dimension", "rank", F.col("bullet").alias("line"))
    inbox = inbox_stats(docs).select(
        F.lit(3).alias("section"), F.lit(None).cast("string").alias("dimension"), F.lit(1).alias("rank"),
        F.format_string("inbox: %d notes, last %s", "cnt", F.coalesce(F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"), F.lit("never"))).alias("line"),
    )
    return mapped.select(shape).unionByName(more.select(shape)).unionByName(facts.select(shape)).unionByName(inbox.select(shape))
