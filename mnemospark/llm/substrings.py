"""Substring de-duplication by super-k-mers: every word of a repeated window but its first copy goes.

A window is ``window`` consecutive words. Its minimiser is its rarest word pair, by counts
of hashed pairs over the whole corpus, ties by hash: very common pairs are chosen only
where all pairs are common, so that no bucket is made of one of them. Consecutive windows
with one minimiser overlap and form one super-k-mer, which travels as one packed string to
the bucket of the minimiser; equal windows have equal minimisers and meet there. The
bucket sorts its windows by hash, compares the words of equal hashes, and keeps the window
that starts first.

A super-k-mer that a task has seen before need not travel: all its windows have earlier
copies, so the task reports them at once. A passage in a third of all documents reaches
its bucket once for each block of text, not once for each document. Strings of a block
for one bucket are compressed together.

Defined cases: a null text has no words; a text shorter than a window keeps all; a null id
sorts before the others; rows that share an id are one document as to order: none of two
windows with the same id and start is the earlier one; repeated rows stay for the same
reason; very long texts are cut into pieces that overlap by a window, so that none is lost;
an empty table gives no rows; columns not kept are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import BLOCK, blocks, give_back, partitions, stored, tune

PAIR_BITS = 14
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NO_ID = -(1 << 63)
#: Bytes of words that are hashed at a time; a longer word is hashed whole.
SLICE = 1 << 18
_HELD: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of ``base``; those of a slice are worked out once."""
    if n <= SLICE and int(base) in _HELD:
        return _HELD[int(base)][:n]
    out = np.full(max(n, SLICE), base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if n <= SLICE:
        _HELD[int(base)] = out
    return out[:n]


class _Words:
    """Texts as words with one space between, laid end to end, with a hash of each word.

    ``first`` and ``last`` hold where each word begins and ends in ``line``; ``counts``
    has the number of words of each text.
    """

    def __init__(self, texts: list[bytes]) -> None:
        split = [x.split() for x in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.line = b" ".join([w for x in split for w in x])
        data = np.frombuffer(self.line, np.uint8)
        gaps = np.flatnonzero(data == 32)
        self.first = np.append(0, gaps + 1)[: int(self.counts.sum())]
        self.last = np.append(gaps, len(data))[: int(self.counts.sum())]
        self.hashes = np.empty(len(self.first), np.uint64)
        at = 0
        while at < len(self.first):  # a slice of the line at a time: the sums take eight bytes for each of its bytes, several times
            to = max(at + 1, int(np.searchsorted(self.last, self.first[at] + SLICE, "right")))
            begin, end = int(self.first[at]), int(self.last[to - 1])
            powers, back = _powers(_ODD, end - begin), _powers(_INVERSE, end - begin)
            sums = np.zeros(end - begin + 1, np.uint64)
            np.add(data[begin:end], np.uint64(1), out=sums[1:])
            sums[1:] *= powers
            np.cumsum(sums, out=sums)
            first = self.first[at:to] - begin
            self.hashes[at:to] = _mix((sums[self.last[at:to] - begin] - sums[first]) * back[first])
            at = to

    def pairs(self) -> np.ndarray:
        """The hash of each word with the next; those over the end of a text are there too."""
        nxt = np.append(self.hashes[1:], np.uint64(0))
        return _mix(self.hashes * np.uint64(3) + nxt)

    def windows(self, width: int) -> np.ndarray:
        """Indices of the words that begin a window inside their text."""
        ends = np.repeat(np.cumsum(self.counts), self.counts)
        return np.flatnonzero(np.arange(len(ends)) + width <= ends)


def _sliding(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over every ``width`` neighbours, by doubling; shorter by width - 1."""
    span, out = 1, values
    while 2 * span <= width:
        out = join(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = join(out[: len(out) - (width - span)], out[width - span :])
    return out


def pair_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often the pairs of each of ``2 ** PAIR_BITS`` hash buckets occur in all texts; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PAIR_BITS, np.int64)
        for block in blocks(batches, "text"):
            found = _Words(block.column("text").cast(pa.binary()).fill_null(b"").to_pylist())
            total += np.bincount((found.pairs() >> np.uint64(64 - PAIR_BITS)).astype(np.int64), minlength=len(total))
        give_back()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "pair int, n long")
    table = rows.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << PAIR_BITS, np.int64)
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out


def _pack(ids: list[int], starts: list[int], sizes: list[int], strings: list[bytes]) -> bytes:
    """Columns of super-k-mers (or, with empty strings, of windows known to be copies) as one compressed string."""
    body = b"\n".join(strings)
    head = np.array([len(ids), len(body)], np.int64).tobytes()
    whole = head + np.array(ids, np.int64).tobytes() + np.array(starts, np.int32).tobytes() + np.array(sizes, np.int32).tobytes() + body
    return np.int64(len(whole)).tobytes() + pa.compress(whole, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    whole = pa.decompress(packed[8:], int(np.frombuffer(packed, np.int64, 1)[0]), codec="zstd", asbytes=True)
    n, _ = np.frombuffer(whole, np.int64, 2)
    ids = np.frombuffer(whole, np.int64, n, 16)
    starts = np.frombuffer(whole, np.int32, n, 16 + 8 * n)
    sizes = np.frombuffer(whole, np.int32, n, 16 + 12 * n)
    return ids, starts, sizes, whole[16 + 16 * n :].split(b"\n")


def super_kmers(docs: DataFrame, counts: np.ndarray, buckets: int, window: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``bucket, packed``: the super-k-mers of every block of text, packed by bucket."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ship = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 24) - 1).astype(np.uint64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ship.value << np.uint64(40)
        for block in blocks(batches, "text", BLOCK):
            ids = block.column("doc_id").fill_null(_NO_ID).to_numpy()
            order = np.argsort(ids, kind="stable")
            texts = block.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            ids = ids[order]
            found = _Words([texts[i] for i in order])
            begin = found.windows(window)
            if not len(begin):
                continue
            pairs = found.pairs()
            value = rank[pairs >> np.uint64(64 - PAIR_BITS)] | (pairs >> np.uint64(24))
            least = _sliding(value[: len(value) - 1], window - 1, np.minimum)[begin]
            ends = np.cumsum(found.counts)
            doc = np.searchsorted(ends, begin, "right")
            fresh = np.ones(len(begin), bool)
            fresh[1:] = (least[1:] != least[:-1]) | (begin[1:] != begin[:-1] + 1)
            head = np.flatnonzero(fresh)
            size = np.diff(np.append(head, len(begin)))
            at = begin[head]
            bucket = (_mix(least[head]) % np.uint64(buckets)).astype(np.int64)
            place = at - (ends - found.counts)[doc[head]]
            owner = ids[doc[head]]
            left, right = found.first[at].tolist(), found.last[at + size + window - 2].tolist()
            seen: dict[bytes, tuple[int, int]] = {}
            again = np.zeros(len(head), bool)
            strings = []
            for k, (a, b, o, p) in enumerate(zip(left, right, owner.tolist(), place.tolist())):
                string = found.line[a:b]
                if seen.setdefault(string, (o, p)) != (o, p):
                    again[k] = True
                    string = b""
                strings.append(string)
            bucket[again] = (_mix(owner[again].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
            out_bucket, packed = [], []
            for a, b in zip(cuts, np.append(cuts[1:], len(by))):
                own = by[a:b]
                out_bucket.append(bucket[own[0]])
                packed.append(_pack(owner[own], place[own], size[own], [strings[i] for i in own.tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(packed, pa.binary())], ["bucket", "packed"])
        give_back()

    return rows.mapInArrow(cut, "bucket int, packed binary")


def _copies(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (id, start, windows) of the windows of one bucket that have an earlier equal one."""
    known = np.fromiter((not x for x in strings), bool, len(strings))
    told = ids[known], starts[known], sizes[known]
    order = np.flatnonzero(~known)
    order = order[np.lexsort((starts[order], ids[order]))]
    ids, starts, sizes = ids[order], starts[order], sizes[order]
    found = _Words([strings[i] for i in order.tolist()])
    begin = found.windows(window)
    if not len(begin):
        return told
    # a hash of each window: a polynomial in the hashes of its words
    odd = np.full(len(found.hashes) + 1, _ODD, np.uint64)
    odd[0] = 1
    np.multiply.accumulate(odd, out=odd)
    inverse = np.full(len(found.hashes) + 1, _INVERSE, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.append(np.uint64(0), np.cumsum(found.hashes * odd[:-1]))
    hashed = (sums[begin + window] - sums[begin]) * inverse[begin]
    kmer = np.repeat(np.arange(len(ids)), sizes)
    own = ids[kmer]
    start = starts[kmer] + np.arange(len(kmer)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    by = np.argsort(hashed, kind="stable")
    leader = np.ones(len(by), bool)
    leader[1:] = hashed[by][1:] != hashed[by][:-1]
    first = np.maximum.accumulate(np.where(leader, np.arange(len(by)), 0))
    copy = np.zeros(len(by), bool)
    line, left, right = found.line, found.first[begin], found.last[begin + window - 1]
    suspects = np.flatnonzero(~leader)
    a, b = by[suspects], by[first[suspects]]
    same = np.fromiter((line[p:q] == line[r:s] for p, q, r, s in zip(left[a].tolist(), right[a].tolist(), left[b].tolist(), right[b].tolist())), bool, len(a))
    copy[a] = same & ((own[a] != own[b]) | (start[a] != start[b]))
    if not same.all():  # windows that share a hash and not the words: settle those groups by their words
        for g in np.unique(first[suspects][~same]).tolist():
            seen: dict[bytes, int] = {}
            k = g
            while k == g or (k < len(by) and not leader[k]):
                w = by[k]
                f = seen.setdefault(line[left[w] : right[w]], w)
                copy[w] = (own[f], start[f]) != (own[w], start[w])
                k += 1
    hit = np.flatnonzero(copy)
    if not len(hit):
        return told
    fresh = np.ones(len(hit), bool)
    fresh[1:] = (own[hit][1:] != own[hit][:-1]) | (start[hit][1:] != start[hit][:-1] + 1)
    head = np.flatnonzero(fresh)
    length = np.diff(np.append(head, len(hit)))
    return tuple(np.concatenate([x, y]) for x, y in zip(told, (own[hit][head], start[hit][head], length)))


def repeated_windows(docs: DataFrame, window: int = 20, text: str = "text", doc_id: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """``doc_id, runs``: for each document with any, the runs (start, windows) of windows with an earlier copy.

    ``window`` is 3 words at least. Buckets are sorted one after another in their task;
    more ``buckets`` make each smaller.
    """
    spark = tune(docs.sparkSession)
    buckets = buckets or 8 * partitions(spark)
    packed = super_kmers(docs, pair_counts(docs, text), buckets, window, text, doc_id)
    dealt = packed.repartition(max(2 * partitions(spark), 2), "bucket").sortWithinPartitions("bucket")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts):
            columns = [np.concatenate(x) for x in list(zip(*parts))[:3]]
            return _copies(*columns, [s for p in parts for s in p[3]], window)

        bucket, parts = None, []
        for batch in batches:
            for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if b != bucket and parts:
                    yield as_batch(close(parts))
                    parts = []
                bucket = b
                parts.append(_unpack(packed))
        if parts:
            yield as_batch(close(parts))

    def as_batch(runs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(runs[0], pa.int64()), pa.array(runs[1], pa.int32()), pa.array(runs[2], pa.int32())], ["doc_id", "start", "n"])

    runs = dealt.mapInArrow(settle, "doc_id long, start int, n int")
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def remove_repeats(docs: DataFrame, window: int = 20, text: str = "text", doc_id: str = "doc_id", buckets: int | None = None, keep: tuple[str, ...] = (), respace: bool = True) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, the ``keep`` columns, ``n_words, n_removed, kept_text``.

    ``kept_text`` has the kept words joined by one space; without ``respace`` a text that
    loses nothing stays as it is, a null one null.
    """
    runs = stored(repeated_windows(docs, window, text, doc_id, buckets))
    kind = {c: docs.schema[c].dataType.simpleString() for c in keep}
    carried = {c: f"_keep{i}" for i, c in enumerate(keep)}
    own = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in carried.items()]]
    rows = docs.select(*own, F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("_key"))
    joined = rows.join(runs.withColumnRenamed("doc_id", "_key"), "_key", "left").select("doc_id", "text", *carried.values(), F.col("runs.start").alias("starts"), F.col("runs.n").alias("sizes"))
    names = ["doc_id", *carried.values(), "n_words", "n_removed", "kept_text"]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            n_words, n_removed, kept = [], [], []
            texts = block.column("text").cast(pa.binary()).to_pylist()
            for x, starts, sizes in zip(texts, block.column("starts").to_pylist(), block.column("sizes").to_pylist()):
                own = (x or b"").split()
                n_words.append(len(own))
                if not starts:
                    n_removed.append(0)
                    kept.append(b" ".join(own) if respace else x)
                    continue
                change = np.zeros(len(own) + 1, np.int32)
                np.add.at(change, starts, 1)
                np.add.at(change, np.array(starts) + np.array(sizes) + window - 1, -1)
                stay = np.cumsum(change)[:-1] == 0
                n_removed.append(int(len(own) - stay.sum()))
                kept.append(b" ".join([w for w, s in zip(own, stay.tolist()) if s]))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(block.column(n) for n in carried.values()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names)

    shape = ", ".join(["doc_id long", *[f"{n} {kind[c]}" for c, n in carried.items()], "n_words long", "n_removed long", "kept_text string"])
    return joined.mapInArrow(strip, shape).withColumnsRenamed({n: c for c, n in carried.items()})
