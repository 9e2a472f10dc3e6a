"""Document fingerprints: every shingle hash below a fixed fraction of the hash range is kept.

Whether a hash stays depends on that hash alone. So the sketch of a union is the union of
the sketches, and the share of one sketch that another has estimates how much of the one
text the other contains, however unequal their lengths. The smallest hash of a text always
stays as well, so that a text too short to have a hash below the fraction is still known
by one of its shingles.

Hashes are the first 16 hex digits of the MD5 of a shingle of ``words`` words, joined by one
space; a sketch is their sorted array, its string form their concatenation.

Defined cases: a null text is an empty one; a text without words has the empty sketch; one
with fewer words than a shingle has its whole word sequence as its shingle; the likeness
of two empty sketches is 1, that of an empty and another 0; texts too short for a hash below the
bound are compared by all their hashes where the texts are at hand (``text_likeness``); very
long texts are hashed whole; an empty table gives no rows; repeated rows have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm.common import let, partitions, words
from mnemospark.session import literal_rows

FRACTION = 1 / 8


def shingle_hashes(own: Column, size: int) -> Column:
    """MD5 digests of the shingles of an array of words."""

    def at(i: Column) -> Column:
        return F.md5(F.concat_ws(" ", *(F.get(own, i + k) for k in range(size))).cast("binary"))

    many = F.transform(F.sequence(F.lit(0), F.size(own) - size), at)
    return F.when(F.size(own) >= size, many).when(F.size(own) > 0, F.array(F.md5(F.array_join(own, " ").cast("binary"))))


def sketch(text: Column, size: int = 5, fraction: float = FRACTION) -> Column:
    """The sorted distinct hashes below ``fraction``, and the smallest one, of a text's shingles."""
    bound = f"{min(int(fraction * 2**64), 2**64 - 1):016x}"

    def pick(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: h < bound)
        return F.when(F.size(low) > 0, low).otherwise(F.array(F.array_min(hashes)))

    def cut(hashes: Column) -> Column:
        kept = F.array_sort(F.array_distinct(F.transform(pick(hashes), lambda h: F.substring(h, 1, 16))))
        return F.when(hashes.isNotNull(), kept)

    found = let(words(text), lambda own: let(shingle_hashes(own, size), cut))
    return F.coalesce(found, F.array().cast("array<string>"))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts together, shingles across their seam left out."""
    bound = f"{min(int(fraction * 2**64), 2**64 - 1):016x}"
    return let(F.array_sort(F.array_union(a, b)), lambda both: let(F.filter(both, lambda h: h < bound), lambda low: F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))))


def containment(a: Column, b: Column) -> Column:
    """The share of the first sketch that the second has, 0 to 1."""
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the larger has, 0 to 1."""
    return F.when(F.size(a) <= F.size(b), containment(a, b)).otherwise(containment(b, a))


def text_likeness(a: Column, b: Column, text: Column, other: Column, size: int = 5, fraction: float = FRACTION) -> Column:
    """The likeness of two sketches; where one has no hash below the bound, of all hashes of the two texts.

    Such a text is short, and its smallest hash alone says nothing about a longer text that holds it.
    """
    bound = f"{min(int(fraction * 2**64), 2**64 - 1):016x}"

    def short(sketch: Column) -> Column:
        return (F.size(sketch) == 1) & (F.get(sketch, F.lit(0)) >= bound)

    needed = (short(a) | short(b)) & (F.size(a) > 0) & (F.size(b) > 0)

    def pick(sketch: Column, of: Column) -> Column:
        return F.when(needed, let(words(of), lambda own: F.array_distinct(shingle_hashes(own, size)))).otherwise(sketch)

    return let(pick(a, text), lambda x: let(pick(b, other), lambda y: likeness(x, y)))


def as_string(found: Column) -> Column:
    return F.array_join(found, "")


def with_next(docs: DataFrame, carry: list[str], doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``next_*`` columns: the ``carry`` columns of the next row by ``doc_id``, after the last the first.

    Rows are dealt out by ranges of the id, whose bounds are quantiles: as many as there
    are ranges, whatever the number of rows. Each range also gets the first row of the
    next one, so every row meets its successor in one shuffle. Rows with one id are in
    the order of the ``carry`` columns; a null id comes first.
    """
    spark = docs.sparkSession
    ranges = 4 * partitions(spark)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = docs.select(key.alias("k")).agg(F.percentile_approx("k", steps, 10_000).alias("b")).first()["b"]
    cuts = sorted(set(bounds or []))
    # the range of a key: how many bounds are below it, found by halving over the sorted bounds
    part = _place(F.col("_key"), cuts)
    rows = docs.select(*[F.col(c) for c in dict.fromkeys([doc_id, *carry])], key.alias("_key")).withColumn("_part", part)
    firsts = rows.groupBy("_part").agg(F.min("_key").alias("_low"))
    seen = sorted(firsts.collect(), key=lambda r: r["_part"])
    if not seen:
        return rows.select(doc_id, *[c for c in carry if c != doc_id], *[F.col(c).alias(f"next_{c}") for c in carry])
    ghosts = F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("g")))
    before = {r["_low"]: (seen[i - 1]["_part"], int(i == 0) + 1) for i, r in enumerate(seen)}
    shape = T.StructType().add("_low", "long").add("_to", "integer").add("_ghost", "integer")
    lows = literal_rows(spark, [(low, p, g) for low, (p, g) in before.items()], shape)
    joined = rows.join(F.broadcast(lows), rows["_key"] == lows["_low"], "left")
    again = F.when(F.col("_to").isNotNull(), F.array_append(ghosts, F.struct(F.col("_to").alias("p"), F.col("_ghost").alias("g")))).otherwise(ghosts)
    dealt = joined.withColumn("_at", F.explode(again)).drop("_part", "_to", "_low", "_ghost").select("*", F.col("_at.p").alias("_part"), F.col("_at.g").alias("_ghost")).drop("_at")
    order = Window.partitionBy("_part").orderBy("_ghost", "_key", *carry)
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in carry]
    return dealt.select(doc_id, *[c for c in carry if c != doc_id], *nexts, "_ghost").where("_ghost = 0").drop("_ghost")


def _place(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie below ``key``: looked up in two steps of a square root each."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    runs = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    table = F.array(*[F.array(*[F.lit(c).cast("long") for c in run]) for run in runs])
    heads = F.array(*[F.lit(run[0]).cast("long") for run in runs])

    def below(run: Column) -> Column:
        return F.size(F.filter(run, lambda c: c < key))

    return let(below(heads), lambda n: F.when(n == 0, 0).otherwise((n - 1) * step + below(F.get(table, n - 1))))
