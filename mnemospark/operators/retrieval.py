"""Keyword, vector and hybrid ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions.text import tokens
from mnemospark.operators.filters import top_per_group
from mnemospark.schemas import DEFAULTS
from mnemospark.session import BROADCAST_ROWS, literal_rows, small

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
SCORE_DIGITS = 9
QUERY_BLOCK = 4096
WORD_LIST = 1000


# --- keyword leg ------------------------------------------------------------


def parse_queries(queries: DataFrame, stemmer: Callable[[Column], Column] | None = None) -> DataFrame:
    """``queries(qid, text)`` to one row per (qid, group, unit).

    Groups are joined by ``OR``; the units of a group must all match, except those
    marked ``-``. A quoted unit is a phrase. ``terms`` holds a unit's tokens.
    """
    groups = queries.select("qid", F.posexplode(F.split("text", r"\s+OR\s+")).alias("grp", "part"))
    unit = F.posexplode(F.regexp_extract_all("part", F.lit(r'-?"[^"]*"|\S+'), F.lit(0)))
    units = groups.select("qid", "grp", unit.alias("unit", "raw"))
    terms = tokens(F.col("raw"))
    units = units.select(
        "qid", "grp", "unit",
        F.col("raw").startswith("-").alias("negated"),
        F.col("raw").contains('"').alias("quoted"),
        (stemmer(terms) if stemmer else terms).alias("terms"),
    ).filter(F.size("terms") > 0)
    return units.withColumn("phrase", F.col("quoted") & (F.size("terms") > 1)).drop("quoted")


def query_terms(units: DataFrame) -> DataFrame:
    """Distinct (qid, term); ``scored`` unless the term is only ever excluded."""
    rows = units.select("qid", "negated", F.explode("terms").alias("term"))
    return rows.groupBy("qid", "term").agg(F.max(~F.col("negated")).alias("scored"))


@dataclass
class QuerySet:
    """``n`` parsed queries: ``units``, distinct ``terms`` and one ``spec`` row per query
    that has terms. ``words`` lists the terms when they are few."""

    n: int
    units: DataFrame
    terms: DataFrame
    spec: DataFrame
    stemmer: Callable[[Column], Column] | None = None
    words: list[str] | None = None


def compile_queries(queries: DataFrame, stemmer: Callable[[Column], Column] | None = None) -> QuerySet:
    """Parse once. A batch that fits the broadcast bound becomes local relations."""
    units = parse_queries(queries, stemmer)
    spec = units.groupBy("qid").agg(
        F.collect_list(F.struct("grp", "unit", "negated", "phrase", "terms")).alias("units")
    )
    rows = spec.limit(BROADCAST_ROWS + 1).toArrow()
    if rows.num_rows > BROADCAST_ROWS:
        return QuerySet(queries.count(), units, query_terms(units), spec, stemmer)
    spark = queries.sparkSession
    fixed = spark.createDataFrame(rows, spec.schema)
    scored: dict[tuple, bool] = {}
    for row in rows.to_pylist():
        for unit in row["units"]:
            for term in unit["terms"]:
                key = (row["qid"], term)
                scored[key] = scored.get(key, False) or not unit["negated"]
    schema = T.StructType([spec.schema["qid"], T.StructField("term", T.StringType()), T.StructField("scored", T.BooleanType())])
    terms = literal_rows(spark, [(*key, value) for key, value in scored.items()], schema)
    flat = fixed.select("qid", F.inline("units"))
    words = sorted({term for _, term in scored})
    return QuerySet(
        queries.count(), flat, F.broadcast(terms), F.broadcast(fixed), stemmer, words if len(words) <= WORD_LIST else None
    )


def impact(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    """The weight of a term in a document before its rarity: rises with ``tf``, falls with ``doc_len``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def bm25_search(
    postings: DataFrame,
    stats: DataFrame,
    queries: QuerySet,
    k: int,
    candidates: DataFrame | None = None,
    field_postings: DataFrame | None = None,
    doc_freq: DataFrame | None = None,
) -> DataFrame:
    """``(qid, id, score, rank)`` of the k best documents per query.

    ``candidates(id)`` restricts the ranking, not the term statistics. Phrases need
    ``field_postings``; without it they match like plain terms. ``doc_freq(term, doc_freq)``
    is needed where ``postings`` are not all of a term.
    """
    terms = queries.terms
    hits = postings.join(terms.select("term"), "term", "left_semi")
    if doc_freq is None:
        # Reads the columns of the scoring branch, so that both share one exchange.
        doc_freq = hits.groupBy("term").agg(
            F.count_if((F.col("tf") > 0) & (F.col("doc_len") > 0) & F.col("id").isNotNull()).alias("doc_freq")
        )
    corpus = stats.select(F.struct(*stats.columns)).scalar()
    n_docs, avg_len = corpus.getField("n_docs"), corpus.getField("avg_len")
    idf = F.greatest(
        F.lit(IDF_FLOOR),
        F.log((n_docs - F.col("doc_freq") + 0.5) / (F.col("doc_freq") + 0.5)),
    )
    weight = impact(F.col("tf"), F.col("doc_len"), avg_len)
    # One row per query term: at most as many rows as `terms`, whose size is checked.
    weighted = terms.join(doc_freq.select("term", idf.alias("idf")), "term")
    if candidates is not None:
        hits = hits.join(candidates.select("id").distinct(), "id", "left_semi")
    matched = (
        hits.join(weighted, "term")
        .groupBy("qid", "id")
        .agg(
            F.sum(F.when(F.col("scored"), F.col("idf") * weight).otherwise(0.0)).alias("score"),
            F.collect_set("term").alias("got"),
        )
    )
    if field_postings is not None:
        matched = matched.join(phrase_matches(field_postings, queries.units), ["qid", "id"], "left")
    else:
        matched = matched.withColumn("phrases", F.lit(None).cast("array<struct<grp:int,unit:int>>"))
    check_phrases = field_postings is not None

    def unit_matches(u: Column) -> Column:
        present = F.size(F.array_except(u["terms"], F.col("got"))) == 0
        if not check_phrases:
            return present
        key = F.struct(u["grp"].alias("grp"), u["unit"].alias("unit"))
        in_place = F.coalesce(F.array_contains("phrases", key), F.lit(False))
        return present & (~u["phrase"] | in_place)

    grp_ids = F.array_distinct(F.transform("units", lambda u: u["grp"]))

    def group_matches(g: Column) -> Column:
        own = F.filter("units", lambda u: u["grp"] == g)
        wanted = F.exists(own, lambda u: ~u["negated"])
        return wanted & F.forall(own, lambda u: unit_matches(u) != u["negated"])

    ok = matched.join(queries.spec, "qid").filter(F.exists(grp_ids, group_matches))
    scored = ok.select("qid", "id", F.round("score", SCORE_DIGITS).alias("score"))
    return top_per_group(scored, ["qid"], [F.col("score").desc(), F.col("id")], k)


def phrase_matches(field_postings: DataFrame, units: DataFrame) -> DataFrame:
    """``(qid, id, phrases)``: the quoted units whose words stand next to each other."""
    words = units.filter("phrase").select(
        "qid", "grp", "unit", F.size("terms").alias("n"), F.posexplode("terms").alias("at", "term")
    )
    placed = field_postings.join(small(words), "term").select(
        "qid", "grp", "unit", "n", "id", "field", "at",
        F.transform("pos", lambda p: p - F.col("at")).alias("starts"),
    )
    per_field = placed.groupBy("qid", "grp", "unit", "n", "id", "field").agg(F.collect_list("starts").alias("lists"))
    common = F.aggregate(
        F.slice("lists", 2, F.col("n")), F.get("lists", F.lit(0)), lambda acc, x: F.array_intersect(acc, x)
    )
    full = per_field.filter((F.size("lists") == F.col("n")) & (F.size(common) > 0))
    return full.groupBy("qid", "id").agg(F.collect_set(F.struct("grp", "unit")).alias("phrases"))


# --- vector leg -------------------------------------------------------------


def _distances(block: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norms = np.linalg.norm(block, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        return 1.0 - (block @ queries.T) / np.where(norms == 0, 1, norms)
    return (block**2).sum(1)[:, None] + (queries**2).sum(1)[None, :] - 2 * block @ queries.T


def _exact(rows: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return _distances(rows, query[None, :], metric)[:, 0]
    return np.sqrt(((rows - query) ** 2).sum(1))


def _block_knn(vectors: DataFrame, qids: list, matrix: np.ndarray, k: int, metric: str) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast(matrix)

    def local_best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = held.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf["id"].to_numpy()
            block = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            rough = _distances(block, queries, metric)
            keep = min(k, len(ids))
            # The matrix product is only a filter: rows within its rounding error of
            # the k-th value are recomputed exactly.
            slack = 1e-6 * (1.0 + np.abs(rough).max())
            for q in range(len(queries)):
                near = rough[:, q] <= np.partition(rough[:, q], keep - 1)[keep - 1] + slack
                dist = np.round(_exact(block[near], queries[q], metric), SCORE_DIGITS)
                all_ids, all_dist = ids[near], dist
                if q in best:
                    all_ids, all_dist = np.append(best[q][0], all_ids), np.append(best[q][1], all_dist)
                order = np.lexsort((all_ids, all_dist))[:k]
                best[q] = (all_ids[order], all_dist[order])
        for q, (ids, dist) in best.items():
            yield pd.DataFrame({"q": q, "id": ids, "dist": dist})

    local = vectors.select("id", "embedding").mapInPandas(local_best, "q int, id long, dist double")
    names = F.array(*[F.lit(q) for q in qids])
    return local.select(F.get(names, F.col("q")).alias("qid"), "id", "dist")


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    candidates: DataFrame | None = None,
    metric: str = "l2",
) -> DataFrame:
    """``(qid, id, dist, rank)``, the exact k nearest of ``vectors(id, embedding)``.

    Each partition keeps its own k best per query, so only those rows are shuffled.
    The query matrix is sent in blocks of bounded size; more queries take more
    passes over the vectors instead of a bigger broadcast.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    if candidates is not None:
        vectors = vectors.join(candidates.select("id").distinct(), "id", "left_semi")
    vectors = vectors.filter(F.col("embedding").isNotNull())
    asked = queries.select("qid", "embedding")
    first = asked.limit(QUERY_BLOCK + 1).collect()
    blocks = 1 if len(first) <= QUERY_BLOCK else -(-2 * queries.count() // QUERY_BLOCK)
    found = None
    for b in range(blocks):
        in_block = F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b
        rows = first if blocks == 1 else asked.filter(in_block).collect()
        if not rows:
            continue
        matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
        block = _block_knn(vectors, [r["qid"] for r in rows], matrix, k, metric)
        found = block if found is None else found.unionByName(block)
    if found is None:
        found = vectors.limit(0).select(F.lit(None).cast("int").alias("qid"), "id", F.lit(0.0).alias("dist"))
    return top_per_group(found, ["qid"], [F.col("dist"), F.col("id")], k)


def knn_lsh(
    vectors: DataFrame, queries: DataFrame, k: int, radius: float, bucket_length: float = 1.0, tables: int = 4
) -> DataFrame:
    """Approximate nearest neighbours within ``radius`` by random projection buckets."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    def as_vectors(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))

    data, asked = as_vectors(vectors, "id"), as_vectors(queries, "qid")
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=7
    )
    pairs = lsh.fit(data).approxSimilarityJoin(asked, data, radius, "dist")
    rows = pairs.select(
        F.col("datasetA.qid").alias("qid"), F.col("datasetB.id").alias("id"), F.round("dist", SCORE_DIGITS).alias("dist")
    )
    return top_per_group(rows, ["qid"], [F.col("dist"), F.col("id")], k)


# --- fusion -----------------------------------------------------------------


def rrf(keyword: DataFrame, vector: DataFrame, k: int, missing: int | None = None, c: int = DEFAULTS.rrf_k) -> DataFrame:
    """Reciprocal rank fusion; a document absent from one leg takes rank ``missing``."""
    return rrf_weighted(keyword, vector, k, weight=None, missing=missing, c=c)


def rrf_weighted(
    keyword: DataFrame,
    vector: DataFrame,
    k: int,
    weight: float | None = DEFAULTS.keyword_weight,
    missing: int | None = None,
    c: int = DEFAULTS.rrf_k,
) -> DataFrame:
    missing = k + 1 if missing is None else missing
    legs = keyword.select("qid", "id", F.col("rank").alias("kw_rank")).join(
        vector.select("qid", "id", F.col("rank").alias("vec_rank")), ["qid", "id"], "full_outer"
    )
    kw = 1.0 / (c + F.coalesce("kw_rank", F.lit(missing)))
    vec = 1.0 / (c + F.coalesce("vec_rank", F.lit(missing)))
    score = kw + vec if weight is None else weight * kw + (1.0 - weight) * vec
    fused = legs.select("qid", "id", F.round(score, SCORE_DIGITS).alias("score"), "kw_rank", "vec_rank")
    return top_per_group(fused, ["qid"], [F.col("score").desc(), F.col("id")], k)


# --- presentation -----------------------------------------------------------


def attach_by_id(ranked: DataFrame, table: DataFrame, bound: int, key: str = "id") -> DataFrame:
    """Inner join of at most ``bound`` ranked rows with a large table."""
    return table.join(F.broadcast(ranked) if bound <= BROADCAST_ROWS else ranked, key)


def snippets(
    fused: DataFrame,
    docs: DataFrame,
    queries: QuerySet,
    bound: int,
    width: int = 40,
) -> DataFrame:
    """Best window of at most ``width`` words of the body, hits marked.

    Rows that only the vector leg found get an empty snippet.
    """
    wanted = F.flatten(F.transform(F.filter("units", lambda u: ~u["negated"]), lambda u: u["terms"]))
    spec = queries.spec.select("qid", wanted.alias("terms"))
    found = fused.filter(F.col("kw_rank").isNotNull()).select("qid", "id").join(spec, "qid")
    words = attach_by_id(found, docs.select("id", "full_body"), bound).select(
        "qid", "id", "terms", F.posexplode(F.split("full_body", r"\s+")).alias("at", "word")
    )
    own = tokens(F.col("word"))
    words = words.withColumn("hit", F.arrays_overlap(queries.stemmer(own) if queries.stemmer else own, "terms"))
    ahead = Window.partitionBy("qid", "id").orderBy("at").rowsBetween(0, width - 1)
    counted = words.withColumn("hits", F.sum(F.col("hit").cast("int")).over(ahead))
    starts = counted.groupBy("qid", "id").agg(
        F.min_by("at", F.struct(-F.col("hits"), F.col("at"))).alias("start"), F.max("at").alias("last")
    )
    marked = F.when(F.col("hit"), F.concat(F.lit("<mark>"), F.col("word"), F.lit("</mark>"))).otherwise(F.col("word"))
    window = words.join(starts, ["qid", "id"]).filter(
        (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + width)
    )
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("at", marked.alias("w")))), lambda x: x["w"]), " "
    )
    built = window.groupBy("qid", "id", "start", "last").agg(text.alias("text"))
    snippet = F.concat(
        F.when(F.col("start") > 0, "...").otherwise(""),
        F.col("text"),
        F.when(F.col("start") + width - 1 < F.col("last"), "...").otherwise(""),
    )
    return fused.join(built.select("qid", "id", snippet.alias("snippet")), ["qid", "id"], "left").withColumn(
        "snippet", F.coalesce("snippet", F.lit(""))
    )


def hydrate_cards(ranked: DataFrame, docs: DataFrame, bound: int) -> DataFrame:
    """Result cards without the body; ranked ids that left the catalog drop out."""
    meta = docs.select("id", "vault_path", "summary", "title", "project", "note_type", "updated_at", "key_topics")
    return attach_by_id(ranked, meta, bound)


def overlap_score(query: Column, snippet: Column) -> Column:
    """Share of distinct query words that occur in the snippet."""
    asked = F.array_distinct(tokens(query))
    return F.coalesce(
        F.size(F.array_intersect(asked, tokens(snippet))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0)
    )


def model_scorer(make_model: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable:
    """Wrap a (query, snippet) pair scorer; the model is built once per task."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make_model()
        for query, snippet in batches:
            yield pd.Series(model(list(zip(query, snippet))), dtype=float)

    return score


def rerank(
    fused: DataFrame,
    docs: DataFrame,
    queries: DataFrame,
    bound: int,
    k: int = DEFAULTS.search_results,
    scorer: Callable[[Column, Column], Column] = overlap_score,
) -> DataFrame:
    """Score (query, snippet) pairs of the fused rows and keep the k best cards.

    The fused rank only breaks ties between equal scores.
    """
    asked = small(queries.select("qid", F.col("text").alias("query_text")))
    rows = fused.withColumnRenamed("rank", "fused_rank").drop("score").join(asked, "qid")
    scored = rows.withColumn("score", F.round(scorer(F.col("query_text"), F.col("snippet")), SCORE_DIGITS))
    cards = hydrate_cards(scored.drop("query_text"), docs, bound)
    return top_per_group(cards, ["qid"], [F.col("score").desc(), F.col("fused_rank")], k)
