"""Approximate nearest neighbours: inverted lists with residual codes and exact re-scoring.

Centroids and code books are trained on a bounded sample (``sample`` rows by the hash of the id);
every row is then put on the list of its nearest centroid, with a code of ``parts`` bytes that
says which code word is nearest to each part of its residual. A query visits the nearest
lists, as many as hold enough rows, ranks their rows by table look-ups over the codes
and scores the best of them exactly on the vectors. So a query gets ``k`` rows
whenever there are as many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.filters import top_per_group
from mnemospark.operators.retrieval import QUERY_BLOCK, SCORE_DIGITS

SAMPLE = 20_000
#: Lists at most: the model must stay small enough to send to every task.
MOST_LISTS = 4096


@dataclass(frozen=True)
class NeighbourModel:
    centroids: np.ndarray  # (lists, dims)
    books: np.ndarray  # (parts, words, dims of a part)

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * rows @ centres.T).argmin(1)


def _means(rows: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """``n`` centres of the rows by Lloyd's iterations; an empty one moves to a row that is far off."""
    rng = np.random.default_rng(seed)
    n = min(n, len(rows))
    centres = rows[rng.choice(len(rows), n, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        count = np.bincount(own, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        if not full.all():
            far = np.argsort(-((rows - centres[own]) ** 2).sum(1))[: int((~full).sum())]
            centres[~full] = rows[far]
    return centres


def train(vectors: DataFrame, lists: int | None = None, parts: int = 16, words: int = 256, sample: int = SAMPLE, seed: int = 7) -> NeighbourModel:
    """Fit on at most ``sample`` rows of ``vectors(id, embedding)``; without ``lists``, about the root of the number of rows."""
    rows = vectors.where("embedding IS NOT NULL")
    total = rows.count()
    # the smallest hashes: the same rows however the table is dealt
    held = rows.select("embedding").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column("embedding").to_pylist()
    if not held:
        return NeighbourModel(np.zeros((1, 1)), np.zeros((1, 1, 1)))
    data = np.array(held, np.float64)
    n = min(max(1, lists or round(total**0.5)), MOST_LISTS)
    centroids = _means(data, n, seed)
    rest = data - centroids[_nearest(data, centroids)]
    parts = next(p for p in range(min(parts, data.shape[1]), 0, -1) if data.shape[1] % p == 0)
    books = np.stack([_means(x, words, seed + 1 + i) for i, x in enumerate(np.split(rest, parts, axis=1))])
    return NeighbourModel(centroids, books)


def encode(vectors: DataFrame, model: NeighbourModel) -> DataFrame:
    """``list, id, code`` of every row; a row without a vector is on no list."""
    ship = vectors.sparkSession.sparkContext.broadcast((model.centroids, model.books))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, books = ship.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            own = _nearest(rows, centroids)
            codes = np.stack([_nearest(x, book) for x, book in zip(np.split(rows - centroids[own], len(books), axis=1), books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("id"), pa.array([x.tobytes() for x in codes], pa.binary())], ["list", "id", "code"])

    rows = vectors.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), "embedding")
    return rows.mapInArrow(assign, "list int, id long, code binary")


def by_list(codes: DataFrame) -> DataFrame:
    """The codes with the rows of a list side by side, a long list in several ranges.

    :func:`search` makes the tables of a list and its queries once for each batch that holds rows of it;
    in this order these are few, in any other every batch meets every list.
    """
    spark = codes.sparkSession
    # a number that is given is kept: codes are small, but to rank them is work
    ranges = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return codes.repartitionByRange(ranges, "list", "id").sortWithinPartitions("list", "id")


def write_lists(codes: DataFrame, path: str, salts: int = 8) -> None:
    """Store the lists as partitions; a long list is spread over ``salts`` files."""
    dealt = codes.repartition("list", F.pmod(F.xxhash64("id"), F.lit(salts)))
    dealt.sortWithinPartitions("list", "id").write.mode("overwrite").partitionBy("list").parquet(path)


def _visits(matrix: np.ndarray, model: NeighbourModel, sizes: np.ndarray, least: int, share: float) -> list[np.ndarray]:
    """The lists each query visits: the nearest ``share`` of all, and on until they hold ``least`` rows."""
    order = np.argsort((model.centroids**2).sum(1)[None, :] - 2 * matrix @ model.centroids.T, axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1)
    enough = np.minimum((held < least).sum(1) + 1, len(sizes))
    return [own[: max(n, int(np.ceil(share * len(sizes))))] for own, n in zip(order, enough.tolist())]


def search(codes: DataFrame, model: NeighbourModel, vectors: DataFrame, queries: DataFrame, k: int, share: float = 0.75, rescored: int = 30) -> DataFrame:
    """``qid, id, dist, rank``: the ``k`` nearest among ``rescored * k`` rows that the codes rank first.

    Queries are sent in blocks of bounded size. Every task keeps the best rows of each query, so
    that only those are shuffled, and exact distances are worked out where the vectors are.
    """
    spark = codes.sparkSession
    per_list = codes.groupBy("list").count().collect()  # at most ``MOST_LISTS`` rows
    sizes = np.zeros(len(model.centroids), np.int64)
    for r in per_list:
        sizes[r["list"]] = r["count"]
    asked = queries.where("embedding IS NOT NULL").select("qid", "embedding")
    n_asked = asked.count()
    blocks = 1 if n_asked <= QUERY_BLOCK else -(-2 * n_asked // QUERY_BLOCK)
    out, keep = None, rescored * k
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        matrix = np.array([r["embedding"] for r in rows], np.float64)
        visits = _visits(matrix, model, sizes, keep, share)
        by_list: dict[int, list[int]] = {}
        for q, own in enumerate(visits):
            for x in own.tolist():
                by_list.setdefault(x, []).append(q)
        ship = spark.sparkContext.broadcast((model.centroids, model.books, matrix, {x: np.array(q) for x, q in by_list.items()}))

        def rank(batches: Iterator[pa.RecordBatch], ship=ship, keep=keep) -> Iterator[pa.RecordBatch]:
            centroids, books, matrix, by_list = ship.value
            parts = len(books)
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists, ids = batch.column("list").to_numpy(), batch.column("id").to_numpy()
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                for x in np.unique(lists).tolist():
                    if x not in by_list:
                        continue
                    at = np.flatnonzero(lists == x)
                    asking = by_list[x]
                    rest = matrix[asking] - centroids[x]
                    # squared distances of every part of a query to every code word
                    table = np.stack([((y[:, None, :] - book[None]) ** 2).sum(2) for y, book in zip(np.split(rest, parts, axis=1), books)], axis=1)
                    rough = sum(table[:, i, :][:, code[at, i]] for i in range(parts))
                    for j, q in enumerate(asking.tolist()):
                        dist, own = rough[j], ids[at]
                        if q in best:
                            dist, own = np.append(best[q][0], dist), np.append(best[q][1], own)
                        if len(own) > keep:
                            first = np.argpartition(dist, keep - 1)[:keep]
                            dist, own = dist[first], own[first]
                        best[q] = (dist, own)
            for q, (dist, own) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), q, np.int32)), pa.array(own), pa.array(dist)], ["q", "id", "rough"])

        reached = codes.where(F.col("list").isin(sorted(by_list))) if len(by_list) < len(sizes) else codes
        found = top_per_group(reached.mapInArrow(rank, "q int, id long, rough double"), ["q"], [F.col("rough"), F.col("id")], keep).select("q", "id")
        names = spark.createDataFrame([(i, r["qid"], list(map(float, r["embedding"]))) for i, r in enumerate(rows)], f"q int, qid {asked.schema['qid'].dataType.simpleString()}, asked array<double>")
        near = found.join(F.broadcast(names), "q").join(vectors.select("id", "embedding"), "id")
        gap = F.zip_with("asked", F.col("embedding").cast("array<double>"), lambda a, b: (a - b) * (a - b))
        dist = F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)), SCORE_DIGITS)
        block = near.select("qid", "id", dist.alias("dist"))
        out = block if out is None else out.unionByName(block)
    if out is None:
        out = vectors.limit(0).select(F.lit(None).cast("long").alias("qid"), "id", F.lit(0.0).alias("dist"))
    return top_per_group(out, ["qid"], [F.col("dist"), F.col("id")], k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n_queries, n_rows, recall``: the share of the exact neighbours that were found."""
    hits = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.agg(F.count_distinct("qid").alias("n_queries"), F.count("*").alias("n_rows"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
