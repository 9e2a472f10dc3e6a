"""Quality rules: documents whose text statistics lie far from those of their language and source.

Statistics of each text (words, characters, symbols, repeated lines and word windows) are
transformed to a vector. For each group of rows with one language and source the minimum
covariance determinant estimate is found by concentration steps: from medians and quartile
ranges, distances are taken, the ``share`` of rows with the smallest is kept, and mean and
covariance of those are the next estimate. Rows are kept if their Mahalanobis distance is
below a quantile of the chi-square distribution.

Each step is two grouped aggregations over a slim table, an approximate quantile of the
distances and sums of products; both combine before the shuffle, so that a group with a
third of all rows is no burden. What joins back has a row for each group.

Groups of fewer than ``min_rows`` rows are pooled by language, then all together; rows in
a pool that is still smaller are kept. Repeated rows count as often as they occur.

Defined cases: a null text has no words, so the base rules fail it; null languages and
sources are groups of their own; statistics without spread get a floor on their variance,
so that no covariance is singular; repeated rows count as often as they occur; distances equal
to the limit pass; very long texts are measured whole; an empty table gives no rows; columns
not kept are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import WORD_GAPS, let, stored, words
from mnemospark.session import small

WINDOW = 8
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
#: Standard deviations that an estimate has at least. Small enough that each statistic can reject a document by itself where its group
#: has no spread: at the usual tail from 0.8 % of symbols, 36 % of repeated lines or 18 % of repeated words on, and not for one repeated line.
FLOORS = (0.2, 0.04, 0.015, 0.1, 0.07)


def _repeat_words(own: Column) -> Column:
    """How many words lie in windows of 8 words that occur twice or more in the text."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(own) - WINDOW), lambda i: F.xxhash64(*(F.get(own, i + k) for k in range(WINDOW))))

    def marked(pairs: Column) -> Column:
        def twice(e: Column, j: Column) -> Column:
            return F.coalesce(F.get(pairs, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(pairs, j + 1)["h"] == e["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(pairs, twice), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(pairs, marked), covered))

    return F.when(F.size(own) <= WINDOW, 0).otherwise(let(hashes, count)).cast("long")


def statistics(text: Column) -> list[Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` of a text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(
        words(text),
        lambda own: F.struct(
            F.size(own).cast("long").alias("n_words"),
            F.aggregate(own, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            _repeat_words(own).alias("n_repeat_words"),
        ),
    )
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long")
    return [by_words.alias("by_words"), by_lines.alias("by_lines"), symbols.alias("n_symbols")]


def measure(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The ``keep`` columns with ``q``, a struct of statistics, features, group keys and ``base_failed``."""
    found = docs.select(*keep, F.col(lang).alias("_lang"), F.col(source).alias("_source"), *[c.alias(f"_s{i}") for i, c in enumerate(statistics(F.col(text)))])
    stats = {"n_words": F.col("_s0.n_words"), "word_chars": F.col("_s0.word_chars"), "n_symbols": F.col("_s2"), "n_dup_lines": F.col("_s1.n_dup_lines"), "n_repeat_words": F.col("_s0.n_repeat_words")}
    n, chars = F.greatest(stats["n_words"], F.lit(1)), F.greatest(stats["word_chars"], F.lit(1))
    features = (
        F.log1p(stats["n_words"]),
        F.log(chars / n),
        F.sqrt(stats["n_symbols"] / chars),
        F.sqrt(stats["n_dup_lines"] / F.greatest(F.col("_s1.n_lines"), F.lit(1))),
        F.sqrt(stats["n_repeat_words"] / n),
    )
    failed = (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])
    fields = [c.alias(k) for k, c in stats.items()] + [c.cast("double").alias(k) for k, c in zip(FEATURES, features)]
    return found.select(*keep, F.struct(*fields, F.col("_lang").cast("string").alias("lang"), F.col("_source").cast("string").alias("source"), failed.alias("base_failed")).alias("q"))


def _chi_square(x: float, k: int) -> float:
    """The distribution function, by the series of the incomplete gamma function."""
    term = total = 1 / math.gamma(k / 2 + 1)
    for i in range(1, 2000):
        term *= (x / 2) / (k / 2 + i)
        total += term
        if term < 1e-16 * total:
            break
    return total * math.exp(-x / 2) * (x / 2) ** (k / 2)


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(mid, k) < p else (low, mid)
    return low


def _distance(scale: float) -> Column:
    """The squared Mahalanobis distance by means ``m_i`` and the inverse Cholesky factor ``w_i_j``; covariances times ``scale``."""
    p = len(FEATURES)
    off = [F.col(f) - F.col(f"m_{i}") for i, f in enumerate(FEATURES)]
    solved = [sum((F.col(f"w_{i}_{j}") * off[j] for j in range(1, i + 1)), F.col(f"w_{i}_0") * off[0]) for i in range(p)]
    return sum((y * y for y in solved[1:]), solved[0] * solved[0]) / scale


def _estimate(rows: DataFrame) -> DataFrame:
    """``grp``, means and the inverse Cholesky factor of the covariance of each group's rows."""
    p = len(FEATURES)
    sums = [F.avg(f).alias(f"m_{i}") for i, f in enumerate(FEATURES)]
    products = [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
    out = rows.groupBy("grp").agg(*sums, *products)
    for i in range(p):
        for j in range(i + 1):
            inner = F.col(f"c_{i}_{j}")
            if i == j:
                inner = F.greatest(inner, F.lit(FLOORS[i] ** 2))
            for k in range(j):
                inner = inner - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(inner, F.lit(FLOORS[i] ** 2 / 4))) if i == j else inner / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", value)
    for i in range(p):
        out = out.withColumn(f"w_{i}_{i}", 1 / F.col(f"l_{i}_{i}"))
        for j in range(i):
            inner = sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j + 1, i)), F.col(f"l_{i}_{j}") * F.col(f"w_{j}_{j}"))
            out = out.withColumn(f"w_{i}_{j}", -inner / F.col(f"l_{i}_{i}"))
    return out.drop(*[f"{x}_{i}_{j}" for x in "cl" for i in range(p) for j in range(i + 1)])


def fit_outliers(measured: DataFrame, share: float = 0.75, steps: int = 5, min_rows: int = 200) -> DataFrame:
    """``lang, source`` with the robust mean and inverse Cholesky factor that judge their rows.

    ``measured`` is what ``measure`` gives; rows that the base rules fail take no part.
    """
    sound = measured.where(~F.col("q.base_failed")).select("q.lang", "q.source", *[F.col(f"q.{f}") for f in FEATURES])
    sound = stored(sound)
    pairs = sound.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = pairs.where(F.col("n") < min_rows).groupBy("lang").agg(F.sum("n").alias("m"))
    joined = pairs.alias("p").join(by_lang.alias("l"), F.col("p.lang").eqNullSafe(F.col("l.lang")), "left").select("p.lang", "p.source", "n", "m")
    own = F.struct(F.lit(0).alias("level"), F.col("lang").alias("a"), F.col("source").alias("b"))
    of_lang = F.struct(F.lit(1).alias("level"), F.col("lang").alias("a"), F.lit(None).cast("string").alias("b"))
    pooled = F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    named = stored(joined.select("lang", "source", F.when(F.col("n") >= min_rows, own).when(F.col("m") >= min_rows, of_lang).otherwise(pooled).alias("grp")))
    grouped = stored(_with_pair(sound, named).drop("lang", "source"))
    large = grouped.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).select("grp")

    quartiles = grouped.groupBy("grp").agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], 10_000).alias(f"q_{i}") for i, f in enumerate(FEATURES)])
    start = quartiles.join(large, "grp").select(
        "grp",
        *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(len(FEATURES))],
        *[(1 / F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(FLOORS[i])) if i == j else F.lit(0.0)).alias(f"w_{i}_{j}") for i in range(len(FEATURES)) for j in range(i + 1)],
    )
    groups = stored(start)
    for _ in range(steps):
        far = grouped.join(small(groups), "grp").select("grp", *FEATURES, _distance(1.0).alias("d"))
        bound = far.groupBy("grp").agg(F.percentile_approx("d", share, 10_000).alias("bound"))
        near = far.join(small(bound), "grp").where("d <= bound")
        groups = stored(_estimate(near))
    return stored(named.join(groups, "grp").drop("grp"))


def _with_pair(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of the ``table`` row of their language and source, null for none."""
    there = small(table.withColumnsRenamed({"lang": "_l", "source": "_s"}))
    return rows.join(there, rows["lang"].eqNullSafe(F.col("_l")) & rows["source"].eqNullSafe(F.col("_s")), "left").drop("_l", "_s")


def judge(measured: DataFrame, model: DataFrame, keep: list[str], share: float = 0.75, tail: float = 1e-4) -> DataFrame:
    """The ``keep`` columns with the statistics, ``base_failed``, ``distance`` and ``kept``.

    ``tail`` is the share of normally distributed rows that the cut would reject.
    """
    p = len(FEATURES)
    consistency = share / _chi_square(chi_square_quantile(share, p), p + 2)
    cut = chi_square_quantile(1 - tail, p)
    there = small(model.withColumnsRenamed({"lang": "_l", "source": "_s"}))
    rows = measured.select(*keep, F.col("q.*")) if not keep else measured.select(F.struct(*keep).alias("_keep"), "q.*")
    judged = rows.join(there, rows["lang"].eqNullSafe(F.col("_l")) & rows["source"].eqNullSafe(F.col("_s")), "left")
    judged = judged.withColumn("distance", _distance(consistency))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return judged.select(*[F.col("_keep")[k].alias(k) for k in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
