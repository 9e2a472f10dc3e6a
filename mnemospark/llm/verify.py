"""True links among candidates: sets of shingles are compared, whatever table proposed them.

Candidates are buckets: rows ``key, id`` that say which nodes (distinct sets of shingles) may be
alike. Comparing all pairs of a bucket is quadratic, so it is done in two steps. First every
member is compared with the hub of its bucket, which is linear and joins the bulk of a group
of near copies (a node with several hubs with one of them first, with the others only where they
are still apart). What is left are buckets with members in two or more components: only there
all pairs of different components are compared, in tasks of at most two chunks, by one
overlap count of all sets of a task. Every pair that shares a bucket has then been
compared or is in one component already.

Defined cases: a bucket of one member has nothing to compare; equal buckets are compared once;
repeated rows of a representative are read once; long texts are compared whole, and chunks are
bounded by their shingles as well as by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import counted, partitions, stored, tune
from mnemospark.llm.components import connected, joined
from mnemospark.llm.simhash import _shingles

#: Shingles that occur in at most so many sets of a task are counted pair by pair, others by a matrix product.
_RARE = 16


def _perhaps(rows: DataFrame, wanted: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """The ``rows`` whose ``body`` may be one of ``wanted``: all that are, and few others. The filter has a fixed size."""
    at = F.pmod("body", F.lit(bits))
    filled = wanted.groupBy(F.floor(at / 64).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(body, {bits}) % 64 as int)))").alias("b")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[filled.column("word").to_numpy()] = filled.column("b").to_numpy().view(np.uint64)
    ship = rows.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def there(body: pa.Array) -> pa.Array:
        own = body.to_numpy(zero_copy_only=False) % bits
        return pa.array((ship.value[own // 64] >> (own % 64).astype(np.uint64)) & np.uint64(1) == 1)

    return rows.where(there("body"))


def _pack(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets (sorted, distinct) share."""
    m = len(sets)
    out = np.zeros(m * m, np.int64)
    of = np.repeat(np.arange(m), [len(x) for x in sets])
    values, inverse, degree = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = of[np.argsort(inverse, kind="stable")]
    starts = np.cumsum(degree) - degree
    for d in range(2, min(_RARE, m) + 1):
        own = starts[degree == d]
        for a in range(0, len(own), 1 << 16):
            rows = of[own[a : a + (1 << 16), None] + np.arange(d)]
            for i in range(d):
                for j in range(i + 1, d):
                    out += np.bincount(rows[:, i] * m + rows[:, j], minlength=m * m)
    common = np.flatnonzero(degree > _RARE)
    table = out.reshape(m, m)
    table += table.T
    for a in range(0, len(common), 2048):
        own = common[a : a + 2048]
        held = np.zeros((m, len(own)), np.float32)
        sizes = degree[own]
        at = np.repeat(starts[own], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held[of[at], np.repeat(np.arange(len(own)), sizes)] = 1
        table += np.rint(held @ held.T).astype(np.int64)
    sizes = np.array([len(x) for x in sets])
    np.fill_diagonal(table, sizes)
    return table


def _bucket_links(ids: list[int], labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the alike sets of different labels."""
    if len(set(labels)) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    both = overlaps(sets)
    ok = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (both > 0)
    code = np.unique(labels, return_inverse=True)[1]
    root = list(range(int(code.max()) + 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in np.argwhere(np.triu(ok, 1) & (code[:, None] != code[None, :])).tolist():
        a, b = find(int(code[i])), find(int(code[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def _with_texts(tasks: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``tasks`` (column ``id``) with the text of each node's representative."""
    held = tasks.join(nodes.select("id", "doc_id", "body"), "id")
    return held.join(texts, (F.col("body") == F.col("_body")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("doc_id", "body", "_id", "_body")


def _star_links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int, chunk: int) -> DataFrame:
    """``a, b``: the pairs (``id``, ``hub``) that are alike. A hub's text goes to every chunk of its members."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / chunk).cast("int").alias("pieces"))
    members = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("part"), "id")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"), F.col("hub").alias("id"))
    rows = _with_texts(members.union(hubs), nodes, texts).withColumn("role", (F.col("id") != F.col("hub")).cast("int"))
    dealt = rows.repartition(max(2 * partitions(pairs.sparkSession), 2), "hub", "part").sortWithinPartitions("hub", "part", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, done = None, None, set()
        for batch in batches:
            out = []
            raw = batch.column("text").cast(pa.binary()).fill_null(b"")
            for i, (h, part, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "id")))):
                if (h, part) != hub:
                    hub, own, done = (h, part), None, set()
                if node in done:
                    continue
                done.add(node)
                found = _shingles(raw[i].as_py(), words)
                if node == h:
                    own = found
                elif own is not None and _alike(own, found, percent):
                    out.append((node, h))
            yield _pack(out)

    return dealt.select("hub", "part", "id", "text").mapInArrow(compare, "a long, b long")


def _rest_links(shared: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int, chunk: int, chunk_shingles: int) -> DataFrame:
    """``a, b``: links between members of a bucket whose components differ."""
    named = shared.where("members > 2").join(roots, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    open_ = named.groupBy("key").agg(
        F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.sum("n").alias("weight"), F.sum(F.xxhash64("id") % (1 << 40)).alias("s1"), F.sum(F.xxhash64("id", F.lit(7)) % (1 << 40)).alias("s2"),
    ).where("low < high")
    once = open_.groupBy("size", "s1", "s2").agg(F.min("key").alias("key"), F.first("weight").alias("weight"))
    pieces = F.greatest(F.ceil(F.col("size") / chunk), F.ceil(F.col("weight") / chunk_shingles)).cast("int")
    split = named.join(once.select("key", pieces.alias("pieces")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    tasks = split.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "label", "id")
    dealt = _with_texts(tasks, nodes, texts).repartition(max(2 * partitions(shared.sparkSession), 2), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}

        def close() -> list[tuple[int, int]]:
            return _bucket_links(list(held), [x[0] for x in held.values()], [x[1] for x in held.values()], percent) if len(held) > 1 else []

        for batch in batches:
            out = []
            raw = batch.column("text").cast(pa.binary()).fill_null(b"")
            for i, (key, lo, hi, label, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi", "label", "id")))):
                if (key, lo, hi) != last:
                    out += close()
                    last, held = (key, lo, hi), {}
                if node not in held:
                    held[node] = (label, _shingles(raw[i].as_py(), words))
            yield _pack(out)
        yield _pack(close())

    return dealt.select("key", "lo", "hi", "label", "id", "text").mapInArrow(compare, "a long, b long")


def true_components(nodes: DataFrame, entries: DataFrame, rows: DataFrame, words: int, percent: int = 80, chunk: int = 512, chunk_shingles: int = 1 << 20) -> DataFrame:
    """``id, root``: the components of the nodes that have a link, by links of true similarity.

    ``nodes``: ``id, doc_id, body, n`` with the document whose text stands for the node, the
    hash ``body`` of that row and the number ``n`` of its shingles. ``entries``: ``key, id``.
    ``rows``: ``doc_id, text, body``. Two nodes link if their sets of ``words``-word shingles
    share at least ``percent`` per cent of their union.
    """
    tune(nodes.sparkSession)
    buckets = entries.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("hub")).where("members > 1")
    shared = stored(entries.join(buckets, "key").join(nodes.select("id", "n"), "id"))
    pairs = shared.where("id <> hub").select("id", "hub", "n").distinct()
    size = nodes.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"))
    pairs, _ = counted(pairs.join(size, "hub").where(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select("id", "hub"))
    wanted = shared.select("id").distinct().join(nodes, "id").select("body")
    texts = stored(_perhaps(rows, wanted).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "text"))
    # a node meets many hubs in its buckets: one of them first, then those that are not in its component yet
    once, _ = counted(pairs.groupBy("id").agg(F.min("hub").alias("hub")))
    roots = connected(counted(_star_links(once, nodes, texts, words, percent, chunk))[0], "id")
    left = pairs.join(roots, "id", "left").join(roots.select(F.col("id").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
    left, n = counted(left.where(F.coalesce("root", "id") != F.coalesce("hub_root", "hub")).select("id", "hub"))
    if n:
        roots = joined(roots, _star_links(left, nodes, texts, words, percent, chunk), "id")
    return joined(roots, _rest_links(shared, roots, nodes, texts, words, percent, chunk, chunk_shingles), "id")
