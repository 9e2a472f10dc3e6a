"""Keyword search over a stored index: pruned buckets, impact-ordered blocks, early stops.

The index is a log of segments (:mod:`mnemospark.sources.segments`) with three row sets:

* ``docs``: ``id, doc_len, words`` of each document, its tokens joined by spaces, by which a change
  finds what it retracts, and from which a merge makes the postings;
* ``terms``: the dictionary, ``term, df``; a segment holds the difference it makes, so that
  sums over the live segments are the document frequencies of the live documents;
* ``blocks``: the postings of a term, best impact first, in blocks of at most ``block`` entries, as bytes,
  with the highest ``tf`` and the lowest ``doc_len`` in it. Whatever the mean length has
  become, no entry of a block weighs more than those two would together.

A search reads the buckets of its terms alone. A probe of the first blocks of each term
gives every query a score that its k-th best document reaches; a block whose best entry,
together with the best of all other terms, stays below it cannot hold a result and is not
read. Queries that exclude words or ask for phrases read all blocks of their terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import FOLD_FROM, FOLD_TO
from mnemospark.operators.index import DOCUMENT_FIELDS, count_terms
from mnemospark.operators.retrieval import B, IDF_FLOOR, K1, QuerySet, bm25_search, impact
from mnemospark.session import BROADCAST_ROWS, cut_lineage
from mnemospark.sources.segments import RowSet, Segment, SegmentLog

BUCKETS = 64
BLOCK = 1024
#: Bytes of text whose postings a task counts at a time, and the postings of a term that are put in order at a time.
CHUNK = 16 << 20
RUN = 1 << 18
_TEXTS = "id long, doc_len long, words string"
_PIECES = "term string, n int, data binary"
_BLOCKS = "bucket int, term string, block int, n int, max_tf long, min_len long, data binary"
_ENTRIES = "seq long, term string, id long, tf long, doc_len long"
#: A space for each byte of ASCII that is neither letter nor digit.
_SPACED = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def bucket_of(term: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bucket_numbers(spark: SparkSession, words: list[str], buckets: int = BUCKETS) -> list[int]:
    """The buckets of a few words, from the function that wrote them."""
    rows = spark.createDataFrame(pa.table({"w": pa.array(words, pa.string())}))
    return sorted({r["b"] for r in rows.select(bucket_of("w", buckets).alias("b")).collect()})


def _texts(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``id, doc_len, words``: the tokens of all fields, as :func:`~mnemospark.operators.index.tokenized` finds them, joined by spaces.

    A text that is ASCII once folded is cut at bytes, a block of texts at a time; others get their spaces by the pattern first.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.string())
            if not len(text):
                continue
            _, at, data = text.buffers()
            at = np.frombuffer(at, np.int32)[text.offset : text.offset + len(text) + 1]
            raw = _SPACED[np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]]
            at = at - at[0]
            keep = raw != 32
            opens = keep.copy()  # the first byte of each word
            opens[1:] &= ~keep[:-1]
            heads = at[:-1][at[:-1] < len(raw)]
            opens[heads] = keep[heads]
            starts = np.flatnonzero(opens)
            first = np.searchsorted(starts, at)
            n = np.diff(first)
            later = np.ones(len(starts), bool)
            later[first[:-1][n > 0]] = False
            keep[starts[later] - 1] = True  # of the bytes between two words the last, a space
            ends = np.append(0, np.cumsum(keep, dtype=np.int32)).astype(np.int32)[at]
            words = pa.StringArray.from_buffers(len(text), pa.py_buffer(ends), pa.py_buffer(raw[keep]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), words], ["id", "doc_len", "words"])

    text = F.col("text")
    ascii = F.octet_length(text) == F.char_length(text)
    rows = docs.select(F.col("id").cast("long").alias("id"), F.lower(F.concat_ws(" ", *fields)).alias("text"))
    rows = rows.select("id", F.when(ascii, text).otherwise(F.translate(text, FOLD_FROM, FOLD_TO)).alias("text"))
    rows = rows.select("id", F.when(ascii, text).otherwise(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")).alias("text"))
    return rows.mapInArrow(cut, _TEXTS)


def _shorten(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as bytes of 7 bits each, as many as a number needs, and the number of bytes before each."""
    long = np.flatnonzero(values > 127)
    sizes, which, rest = np.ones(len(values), np.uint8), long, values[long]
    while len(which):
        sizes[which] += 1
        rest = rest >> np.uint64(7)
        which, rest = which[rest > 127], rest[rest > 127]
    at = np.append(0, np.cumsum(sizes, dtype=np.int64))
    out = np.empty(at[-1], np.uint8)
    out[at[:-1]] = values.astype(np.uint8) & 127
    place, rest = at[long], values[long]
    while len(place):
        out[place] |= 128  # another byte follows
        place, rest = place + 1, rest >> np.uint64(7)
        out[place] = rest.astype(np.uint8) & 127
        place, rest = place[rest > 127], rest[rest > 127]
    return out, at


def _lengthen(data: np.ndarray) -> np.ndarray:
    """The numbers that :func:`_shorten` has written."""
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    out = (data[starts] & 127).astype(np.uint64)
    k, more = 1, np.flatnonzero(ends > starts)
    while len(more):
        out[more] |= (data[starts[more] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
        k += 1
        more = more[ends[more] >= starts[more] + k]
    return out


def _to_bytes(first: np.ndarray, ids: np.ndarray, lens: np.ndarray, tfs: np.ndarray) -> pa.Array:
    """Postings as bytes, a value for each place in ``first``, at which it starts: the gap to the id before, length and count.

    A gap goes as the next multiple of 2^32 and the rest, as ids often have their parts in either half.
    """
    gaps = np.diff(ids, prepend=0)
    gaps[first] = ids[first]
    high = (gaps + (1 << 31)) >> 32
    values = np.empty((len(ids), 4), np.uint64)
    for i, x in enumerate((high, gaps - (high << 32))):
        values[:, i] = ((x << 1) ^ (x >> 63)).view(np.uint64)  # small numbers, be they below zero or above
    values[:, 2], values[:, 3] = lens, tfs
    data, at = _shorten(values.ravel())
    at = at[np.append(4 * first, 4 * len(ids))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _from_bytes(n: np.ndarray, blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``id, doc_len, tf`` of all postings in the values of :func:`_to_bytes`, of which each holds ``n``."""
    blobs = blobs.cast(pa.binary())
    _, at, data = blobs.buffers()
    at = np.frombuffer(at, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    values = _lengthen(np.frombuffer(data, np.uint8)[at[0] : at[-1]]).reshape(-1, 4)
    high, low = ((x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64) for x in (values[:, 0].copy(), values[:, 1].copy()))
    gaps = (high << 32) + low
    first = np.cumsum(n) - n
    sums = np.cumsum(gaps)
    return sums - np.repeat(sums[first] - gaps[first], n), values[:, 2].astype(np.int64), values[:, 3].astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their rows have some ``RUN`` postings."""
    for batch in batches:
        if batch.num_rows:
            runs = np.cumsum(batch.column("n").to_numpy().astype(np.int64)) // RUN
            edges = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(x, y - x) for x, y in zip(edges, edges[1:]))


def _occurrences(words: pa.Array, place: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some documents, and by word and ``place`` of the document the pairs of both that occur, and how often."""
    lists = pc.split_pattern(words, " ")
    flat = lists.flatten().dictionary_encode()
    pairs = flat.indices.to_numpy().astype(np.int64) * len(place) + np.repeat(place, pc.list_value_length(lists).to_numpy())
    pairs.sort()
    starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return flat.dictionary, *np.divmod(pairs[starts], len(place)), np.diff(np.append(starts, len(pairs)))


def _counted(ids: np.ndarray, lens: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """One row per term of some documents: how many hold it, and their postings, by rising id."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    names, term, doc, tfs = _occurrences(words, place)
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    doc = order[doc]
    n = pa.array(np.diff(np.append(first, len(doc))), pa.int32())
    return pa.RecordBatch.from_arrays([names.take(pa.array(term[first])), n, _to_bytes(first, ids[doc], lens[doc], tfs)], ["term", "n", "data"])


def _lost(ids: np.ndarray, lens: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """One row per term of some documents: what their leaving adds to its frequency."""
    names, term, _, _ = _occurrences(words, np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([names, pa.array(-np.bincount(term, minlength=len(names)))], ["term", "df"])


def _by_chunk(docs: DataFrame, count: Callable[[np.ndarray, np.ndarray, pa.Array], pa.RecordBatch], schema: str) -> DataFrame:
    """The rows that ``count`` makes of the texts of ``docs(id, doc_len, words)``, some megabytes of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            found = count(table.column("id").to_numpy(), table.column("doc_len").to_numpy(), table.column("words").combine_chunks())
            for at in range(0, found.num_rows, 10_000):
                yield found.slice(at, 10_000)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("words").nbytes
            if size >= CHUNK:
                yield from close()
                held, size = [], 0
        if held:
            yield from close()

    return docs.where("doc_len > 0").select(F.col("id").cast("long").alias("id"), "doc_len", "words").mapInArrow(run, schema)


def _pieces(docs: DataFrame) -> DataFrame:
    """``term, n, data``: the postings of ``docs(id, doc_len, words)``, a row for each term of some megabytes of texts.

    So an exchange carries a term once for many documents, and few bytes for each of them.
    """
    return _by_chunk(docs, _counted, _PIECES)


def _packed(pieces: DataFrame, buckets: int, block: int = BLOCK, salts: int = 16) -> DataFrame:
    """Runs of at most ``block`` postings of one term as one row, by falling impact within ``RUN`` postings at least.

    The pieces of a frequent term, those that would fill a block, are dealt over ``salts`` tasks. Blocks are numbered within a task.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # pieces: bucket, term, number of postings; and their postings: id, length, count
        size, own, number = 0, None, 0  # of the last term that was packed, which may go on, the blocks so far

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, own, number
            buckets_, n, ids, lens, tfs = (np.concatenate([x[i] for x in held]) for i in (0, 2, 3, 4, 5))
            terms = pa.concat_arrays([x[1] for x in held])
            first = np.flatnonzero(np.append(True, pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)))
            sizes = np.add.reduceat(n, first)
            held, size = [], 0
            if not last and sizes[-1] < RUN:  # a term that may go on stays together
                k, size = first[-1], int(sizes[-1])
                held = [(buckets_[k:], terms[k:], n[k:], *(x[len(ids) - size :] for x in (ids, lens, tfs)))]
                first, sizes, ids, lens, tfs = first[:-1], sizes[:-1], *(x[: len(ids) - size] for x in (ids, lens, tfs))
                if not len(first):
                    return
            falling = ((1 - tfs / (tfs + K1 * (1 - B + B * lens / 1000.0))) * (1 << 20)).astype(np.int64)
            order = np.argsort((np.repeat(np.arange(len(first)), sizes) << 21) | falling, kind="stable")
            ids, lens, tfs = ids[order], lens[order], tfs[order]
            several = -(-sizes // block)
            at = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)  # of each block its number within the term
            cuts = np.repeat(np.cumsum(sizes) - sizes, several) + at * block
            ends = np.append(cuts, len(ids))
            names = terms.take(pa.array(first))
            at[: several[0]] += number if names[0].as_py() == own else 0
            own, number = names[-1].as_py(), int(at[-1]) + 1
            which = np.repeat(np.arange(len(first)), several)
            columns = [pa.array(buckets_[first[which]], pa.int32()), names.take(pa.array(which)), pa.array(at, pa.int32()), pa.array(np.diff(ends), pa.int32())]
            columns += [pa.array(np.maximum.reduceat(tfs, cuts)), pa.array(np.minimum.reduceat(lens, cuts)), _to_bytes(cuts, ids, lens, tfs)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "term", "block", "n", "max_tf", "min_len", "data"])

        for part in _parts(batches):
            n = part.column("n").to_numpy().astype(np.int64)
            held.append((part.column("bucket").to_numpy(), part.column("term"), n, *_from_bytes(n, part.column("data"))))
            size += int(n.sum())
            if size >= 2 * RUN:
                yield from close(False)
        if held:
            yield from close(True)

    spread = max(1, -(-4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets))
    salt = F.when(F.col("n") >= block, F.pmod(F.xxhash64("data"), F.lit(salts))).otherwise(0)
    dealt = pieces.repartition(bucket_of("term", buckets), F.pmod(F.xxhash64("term", salt), F.lit(spread))).withColumn("bucket", bucket_of("term", buckets))
    return dealt.sortWithinPartitions("term").select("bucket", "term", "n", "data").mapInArrow(pack, _BLOCKS)


def _least_tf(weight: float) -> int:
    """The smallest ``tf`` that can weigh as much, in a document without other words: a bound that storage can check."""
    most = K1 + 1
    if weight <= 0:
        return 0
    return 1 << 62 if weight >= most else int(weight * K1 * (1 - B) / (most - weight))


def entries(blocks: DataFrame) -> DataFrame:
    """``seq, term, id, tf, doc_len`` of the entries of blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            n = part.column("n").to_numpy().astype(np.int64)
            ids, lens, tfs = map(pa.array, _from_bytes(n, part.column("data")))
            which = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([part.column("seq").take(which), part.column("term").take(which), ids, tfs, lens], ["seq", "term", "id", "tf", "doc_len"])

    return blocks.select("seq", "term", "n", "data").mapInArrow(read, _ENTRIES)


def _merge_terms(log: SegmentLog, terms: DataFrame, merged: list[Segment]) -> DataFrame:
    return terms.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df <> 0")


@dataclass
class StoredIndex:
    """An index below ``path``, created by the first :meth:`apply`."""

    spark: SparkSession
    path: str
    fields: tuple[str, ...] = DOCUMENT_FIELDS
    block: int = BLOCK
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        # batches of texts and of postings differ in length by orders
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(CHUNK))

        def postings(log: SegmentLog, docs: DataFrame, merged: list[Segment]) -> DataFrame:
            return _pieces(docs)

        def arrange(rows: DataFrame) -> DataFrame:
            return _packed(rows, self.buckets, self.block)

        sets = {
            "docs": RowSet(),
            "blocks": RowSet(bucket="bucket", keyed=False, merge=postings, arrange=arrange, source="docs"),
            "terms": RowSet(bucket="bucket", sort=("term",), keyed=False, merge=_merge_terms),
        }
        self.log = SegmentLog(self.spark, self.path, "id", sets)

    # --- upkeep -------------------------------------------------------------

    def apply(self, docs: DataFrame, deleted: DataFrame | None = None, tag: int = 0, compact: bool = True) -> bool:
        """Index new and changed ``docs(id, <fields>)`` and drop the ``deleted(id)``, as one segment.

        Writes in proportion to the batch. A replayed ``tag`` does nothing.
        """
        live = self.log.segments()
        if live and max(s.tag for s in live) >= tag:
            return False
        replaced: list[DataFrame] = []  # ``id, doc_len, seq`` of the documents that the batch replaces
        ids: list[DataFrame] = []

        def touched(written) -> DataFrame:
            if not ids:  # what is deleted is read once
                new = written("docs").select("id")
                ids.append(new if deleted is None else cut_lineage(new.unionByName(deleted.select("id")).distinct()))
            return ids[0]

        def terms(written) -> DataFrame:
            found = written("blocks").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
            if live:
                now = self.log.alive(self.log.stored("docs").select("id", "doc_len", "seq"), live)
                replaced.append(cut_lineage(now.join(touched(written), "id", "left_semi")))
                n = replaced[0].count()
                if n:
                    own = replaced[0].select("id", "seq")
                    old = self.log.stored("docs", live).join(F.broadcast(own) if n <= BROADCAST_ROWS else own, ["id", "seq"], "left_semi")
                    lost = _by_chunk(old, _lost, "term string, df long").withColumn("bucket", bucket_of("term", self.buckets))
                    found = found.unionByName(lost).groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df <> 0")
            return found

        def measures(written) -> dict[str, float]:
            rows = [written("docs"), *replaced]
            (n, length), *old = [x.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first() for x in rows]
            return {"n_docs": float(n - sum(x[0] for x in old)), "total_len": float(length - sum(x[1] for x in old))}

        done = self.log.append(
            touched, tag, measures,
            docs=_texts(docs, self.fields),
            blocks=lambda written: _pieces(written("docs")),
            terms=terms,
        )
        if done and compact:
            self.log.compact()
        return done

    # --- reading ------------------------------------------------------------

    def stats(self) -> DataFrame:
        """One row ``n_docs, avg_len`` of the live documents, from the manifest alone."""
        m = self.log.measures()
        n, total = int(m.get("n_docs", 0)), m.get("total_len", 0.0)
        return self.spark.createDataFrame([(n, total / n if n else None)], "n_docs long, avg_len double")

    def postings(self) -> DataFrame:
        """``id, term, tf, doc_len`` of all live documents: the entries of the blocks where all are alive, else counted a document at a time."""
        live = self.log.segments()
        if len(live) == 1:
            return entries(self.log.stored("blocks", live)).select("id", "term", "tf", "doc_len")
        docs = self.log.read("docs").where("doc_len > 0")
        return count_terms(docs.select("id", "doc_len", F.split("words", " ").alias("words")))

    def _pruned(self, name: str, words: list[str]) -> DataFrame:
        numbers = bucket_numbers(self.spark, words, self.buckets)
        return self.log.stored(name).where(F.col("bucket").isin(numbers) & F.col("term").isin(words))

    def term_stats(self, words: list[str] | None = None) -> DataFrame:
        """``term, doc_freq`` of the live documents, of all terms or the given ones."""
        rows = self.log.stored("terms") if words is None else self._pruned("terms", words)
        return rows.groupBy("term").agg(F.sum("df").alias("doc_freq")).where("doc_freq > 0")

    def plan(self, queries: QuerySet, k: int, candidates: DataFrame | None = None, probe: int = 4) -> tuple[DataFrame, DataFrame]:
        """The blocks that can hold a result of the queries, and the frequencies of their terms.

        Of each term the blocks with the best bounds that hold ``probe * k`` entries are scored first.
        """
        doc_freq = self.term_stats(queries.words)
        freq = {r["term"]: r["doc_freq"] for r in doc_freq.collect()}  # at most as many as words
        doc_freq = self.spark.createDataFrame(pa.table({"term": pa.array(list(freq), pa.string()), "doc_freq": pa.array(list(freq.values()), pa.int64())}))
        blocks = self._pruned("blocks", queries.words)
        n, avg = self.stats().first()
        idf = {t: max(IDF_FLOOR, float(np.log((n - f + 0.5) / (f + 0.5)))) for t, f in freq.items()}
        names = F.create_map(*[x for t, v in idf.items() for x in (F.lit(t), F.lit(v))]) if idf else F.create_map().cast("map<string,double>")
        bound = names[F.col("term")] * impact(F.col("max_tf"), F.col("min_len"), F.lit(avg))
        heads = blocks.select("seq", "bucket", "term", "block", "n", "max_tf", "min_len").withColumn("bound", bound)
        best = {r["term"]: r["b"] for r in heads.groupBy("term").agg(F.max("bound").alias("b")).collect()}
        asked: dict = {}
        plain: dict = {}
        for r in queries.units.select("qid", "negated", "phrase", "terms").collect():
            plain[r["qid"]] = plain.get(r["qid"], True) and not r["negated"] and not r["phrase"]
            for t in r["terms"]:
                asked.setdefault(r["qid"], set()).add(t)
        if not all(plain.values()) or not best:
            return blocks, doc_freq
        # the probe: blocks by falling bound until they hold enough entries
        order = Window.partitionBy("term").orderBy(F.col("bound").desc(), "seq", "block").rowsBetween(Window.unboundedPreceding, -1)
        first = heads.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < probe * k)
        limits = first.groupBy("term").agg(F.min("bound").alias("least")).collect()
        tried = blocks.where(reduce(lambda a, b: a | b, [(F.col("term") == r["term"]) & (bound >= r["least"]) for r in limits]))
        found = bm25_search(self._live(tried), self.stats(), queries, k, candidates, doc_freq=doc_freq)
        reached = {r["qid"]: r["s"] for r in found.groupBy("qid").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        need: dict[str, float] = {}  # of each term the least bound that a block must have for some query
        for q, terms in asked.items():
            total = sum(best.get(t, 0.0) for t in terms)
            for t in terms:
                least = reached.get(q, 0.0) - 1e-8 - (total - best.get(t, 0.0)) if q in reached else 0.0
                need[t] = min(need.get(t, least), least)
        kept = [(F.col("term") == t) & (F.col("max_tf") >= _least_tf(v / idf[t])) & (bound >= v) for t, v in need.items() if t in idf]
        return blocks.where(reduce(lambda a, b: a | b, kept)), doc_freq

    def _live(self, blocks: DataFrame) -> DataFrame:
        return self.log.alive(entries(blocks)).select("id", "term", "tf", "doc_len")

    def search(self, queries: QuerySet, k: int, candidates: DataFrame | None = None) -> DataFrame:
        """``qid, id, score, rank`` of the k best documents per query, as :func:`~mnemospark.operators.retrieval.bm25_search` on the whole index."""
        if queries.words is None:  # too many terms for a list: all postings, found by a join
            return bm25_search(self.postings(), self.stats(), queries, k, candidates)
        blocks, doc_freq = self.plan(queries, k, candidates)
        return bm25_search(self._live(blocks), self.stats(), queries, k, candidates, doc_freq=doc_freq)
