"""Mixing sources to target weights: temperature on the token shares, realised in blocks.

With share p of the tokens a source gets the weight p^a / sum(p^a). The exponent a between
0 (all sources alike) and 1 (as they are) is bisected, 64 candidates at a time, to meet a
target entropy or a limit on repetition. A source with the weight w has w times the budget
in tokens: so many whole passes over its rows, and then rows of one more pass in the order
of a seeded hash as long as the tokens suffice.

Each pass of a source is a permutation of its own, by hashes of the row and the pass, and
lies in the part of the blocks that is its turn: every block holds the sources by their
weights, and copies of one row are far apart.

Where the last pass ends is found by two histograms of 4096 bins of the hash, each inside
the bin of the one before in which the tokens run out; only the rows of the last bin, one
in 16 million, are summed up in order. So no task orders the rows of a source.

Defined cases: a null source is a source; a null text has no tokens; rows without tokens
cost nothing and come with the pass they lie in; a source without any tokens has weight 0
and keeps each row once; repeated rows are rows of their own; rows whose permuted keys are equal may
change places; very long texts are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import WORD_GAPS, stored
from mnemospark.session import small

_BINS = 12


@dataclass(frozen=True)
class Mix:
    """``sources`` has a row for each: ``source, tokens, weight, passes`` (its budget in passes), and where the last pass ends."""

    exponent: float
    budget: float
    blocks: int
    seed: int
    sources: DataFrame
    last_rows: DataFrame


def count_words(text: Column) -> Column:
    """The number of words, without an array of them kept."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{WORD_GAPS}|{WORD_GAPS}\z", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, WORD_GAPS))).cast("long")


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def _place(key: Column, number: Column, seed: int) -> Column:
    """The hash that orders rows in a pass: 60 bits."""
    return F.shiftrightunsigned(F.xxhash64(key, number.cast("long"), F.lit(seed)), 4)


def find_exponent(totals: DataFrame, budget: float, entropy: float | None = None, repetitions: float | None = None) -> float:
    """The exponent for ``totals`` (source, tokens).

    ``entropy`` (a share of the logarithm of the number of sources): the largest exponent
    whose weights have at least that. ``repetitions``: the smallest whose budget passes over no
    source more often. Where no exponent does it is the nearest, 0 or 1.
    """
    if (entropy is None) == (repetitions is None):
        raise ValueError("give either entropy or repetitions")
    shares = totals.where("tokens > 0").select((F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0)))).alias("p"), F.sum("tokens").over(Window.partitionBy(F.lit(0))).alias("all"))
    low, high, parts = 0.0, 1.0, 64
    for _ in range(5):
        grid = [low + (high - low) * i / parts for i in range(parts + 1)]
        table = shares.withColumn("a", F.explode(F.array(*map(F.lit, grid)))).groupBy("a").agg(
            F.sum(F.pow("p", "a")).alias("z"),
            F.sum(F.pow("p", "a") * F.log("p")).alias("s"),
            F.max(F.pow(F.col("p"), F.col("a") - 1)).alias("most"),
            F.count("*").alias("n"),
            F.max("all").alias("all"),
        )
        met = {}
        for r in table.collect():  # 65 rows
            if entropy is not None:
                met[r["a"]] = math.log(r["z"]) - r["a"] * r["s"] / r["z"] >= entropy * math.log(r["n"]) - 1e-12
            else:
                met[r["a"]] = r["most"] / r["z"] * budget / r["all"] <= repetitions + 1e-12
        if not met:
            return 1.0
        if entropy is not None:  # met from 0 up to some exponent
            good = [a for a in grid if met[a]]
            if not good:
                return 0.0
            low = max(good)
            high = min((a for a in grid if a > low), default=low)
        else:  # met from some exponent up to 1
            good = [a for a in grid if met[a]]
            if not good:
                return 1.0
            high = min(good)
            low = max((a for a in grid if a < high), default=high)
        if low == high:
            break
    return low if entropy is not None else high


def plan_mix(docs: DataFrame, budget_share: float = 1.0, entropy: float | None = None, repetitions: float | None = None, block_tokens: int = 1 << 20, seed: int = 42, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> Mix:
    """Weights for a budget of ``budget_share`` times all tokens, and where each source's last pass ends."""
    rows = docs.select(F.col(source).cast("string").alias("source"), row_key(doc_id, text).alias("key"), count_words(F.col(text)).alias("tokens"))
    rows = stored(rows)
    totals = stored(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = budget_share * everything
    exponent = find_exponent(totals, budget, entropy, repetitions)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(everything, 1))), F.lit(exponent))).otherwise(0.0)
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    weight = power / z
    passes = F.when(F.col("tokens") > 0, weight * budget / F.col("tokens")).otherwise(1.0)
    whole = F.floor(F.col("passes") + 1e-12)
    sources = totals.withColumn("weight", weight).withColumn("passes", passes).withColumn("whole", whole)
    sources = stored(sources.withColumn("rest", F.greatest((F.col("passes") - whole) * F.col("tokens"), F.lit(0.0))))

    last = _with_source(rows, sources.select("source", "whole", "rest")).withColumn("u", _place(F.col("key"), F.col("whole"), seed))
    ends = sources.select("source", "rest").withColumns({"before": F.lit(0.0), "at": F.lit(0).cast("long")})
    for depth in (1, 2):
        # of the rows in the bin in which the tokens run out so far, the bin one level further down
        shift = 60 - _BINS * depth
        here = _with_source(rows.join(small(_names(sources.select("source", "whole"))), rows["source"].eqNullSafe(F.col("_source"))).drop("_source"), ends)
        here = here.withColumn("u", _place(F.col("key"), F.col("whole"), seed)).where(F.shiftrightunsigned("u", shift + _BINS) == F.col("at"))
        bins = here.groupBy("source", F.shiftrightunsigned("u", shift).alias("bin")).agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("base"))
        running = Window.partitionBy("source").orderBy("bin")
        upto = bins.withColumn("upto", F.col("base") + F.sum("t").over(running))
        crossing = upto.where("upto > rest").groupBy("source").agg(F.min("bin").alias("at"), F.min_by(F.col("upto") - F.col("t"), "bin").alias("before"))
        ends = stored(_with_source(sources.select("source", "rest"), crossing.select("source", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("at", F.lit(-1)).alias("at")), how="left").fillna({"before": 0.0, "at": -1}))
    # rows of the last bin, in order
    near = _with_source(last.select("source", "key", "tokens", "u"), ends).where(F.shiftrightunsigned("u", 60 - 2 * _BINS) == F.col("at"))
    order = Window.partitionBy("source").orderBy("u", "key").rowsBetween(Window.unboundedPreceding, 0)
    chosen = stored(near.withColumn("upto", F.col("before") + F.sum("tokens").over(order)).where("upto <= rest").select("source", "key").distinct())
    final = stored(_with_source(sources, ends.select("source", "at")))
    return Mix(exponent, budget, max(1, round(budget / block_tokens)), seed, final, chosen)


def _names(table: DataFrame) -> DataFrame:
    return table.withColumnRenamed("source", "_source")


def _with_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(small(_names(table)), rows["source"].eqNullSafe(F.col("_source")), how).drop("_source")


def mix(docs: DataFrame, plan: Mix, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as its source's passes have it, with ``mix_pass``, ``mix_block`` and ``mix_place``.

    Reading the rows by block and place gives the mixture; texts are not shuffled here.
    """
    own = docs.select(F.struct("*").alias("_row"), F.col(source).cast("string").alias("_s"), row_key(doc_id, text).alias("_key"))
    table = plan.sources.select(F.col("source").alias("_name"), "passes", "whole", "at")
    rows = own.join(small(table), F.col("_s").eqNullSafe(F.col("_name")))
    chosen = plan.last_rows.select(F.col("source").alias("_cs"), F.col("key").alias("_ck"), F.lit(True).alias("_in"))
    rows = rows.join(small(chosen), F.col("_s").eqNullSafe(F.col("_cs")) & (F.col("_key") == F.col("_ck")), "left")
    u = _place(F.col("_key"), F.col("whole"), plan.seed)
    below = F.shiftrightunsigned(u, 60 - 2 * _BINS)
    # at -1: the tokens of the last pass never run out
    partial = (F.col("passes") > F.col("whole")) & (F.coalesce(F.col("_in"), F.lit(False)) | (below < F.col("at")) | (F.col("at") == -1))
    copies = (F.col("whole") + F.when(partial, 1).otherwise(0)).cast("int")
    spread = rows.withColumn("_copies", copies).where("_copies > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    place = _place(F.col("_key"), F.col("mix_pass"), plan.seed)
    turn = (F.col("mix_pass") + place / F.lit(float(1 << 60))) / F.greatest(F.col("passes"), F.lit(1e-12))
    block = F.least(F.floor(turn * plan.blocks), F.lit(plan.blocks - 1)).cast("long")
    return spread.select("_row.*", "mix_pass", block.alias("mix_block"), _place(F.xxhash64("_key", "mix_pass"), F.lit(-1), plan.seed).alias("mix_place"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixture in its order: ranges of blocks, sorted inside."""
    return mixed.repartitionByRange("mix_block", "mix_place").sortWithinPartitions("mix_block", "mix_place")
