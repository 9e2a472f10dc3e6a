"""Stateful and continuous jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from mnemospark.operators.filters import find_unclassified
from mnemospark.operators.reconcile import coalesce_chains
from mnemospark.operators.state import upsert_uploads
from mnemospark.schemas import DEFAULTS
from mnemospark.session import ROCKSDB, cut_lineage
from mnemospark.sources.files import text_column
from mnemospark.sources.segments import SegmentLog
from mnemospark.sources.tables import latest_version, read_snapshot, write_snapshot

FILE_EVENT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("old_path", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _rows(batches: Iterator[pd.DataFrame]) -> list[tuple]:
    frames = [b for b in batches if not b.empty]
    if not frames:
        return []
    rows = pd.concat(frames).sort_values(["ts", "rank", "path"], kind="stable")
    return list(rows[["ts", "kind", "path"]].itertuples(index=False, name=None))


class MoveMatcher(StatefulProcessor):
    """Per content hash: one waiting delete, matched by the next create in time."""

    def __init__(self, window_seconds: float) -> None:
        self.window_ms = int(window_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        state = T.StructType([T.StructField("path", T.StringType()), T.StructField("ms", T.LongType())])
        self.waiting = handle.getValueState("waiting", state)

    @staticmethod
    def _ms(ts: pd.Timestamp) -> int:
        return int(pd.Timestamp(ts).value // 1_000_000)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["kind", "old_path", "path", "ts"])
        frame["ts"] = pd.to_datetime(frame["ts"])
        return frame

    def _park(self, path: str, ms: int) -> None:
        self.waiting.update((path, ms))
        self.handle.registerTimer(ms + self.window_ms)

    def _release(self, ms: int) -> None:
        self.waiting.clear()
        self.handle.deleteTimer(ms + self.window_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for ts, kind, path in _rows(rows):
            now = self._ms(ts)
            held = self.waiting.get() if self.waiting.exists() else None
            if held is not None and now - held[1] > self.window_ms:
                out.append(("deleted", None, held[0], pd.Timestamp(held[1], unit="ms")))
                self._release(held[1])
                held = None
            if kind == "delete":
                if held is not None:
                    self._release(held[1])
                self._park(path, now)
            elif held is not None:
                out.append(("moved", held[0], path, pd.Timestamp(ts)))
                self._release(held[1])
            else:
                out.append(("created", None, path, pd.Timestamp(ts)))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.waiting.exists():
            path, ms = self.waiting.get()
            if ms + self.window_ms <= expiredTimerInfo.getExpiryTimeInMs():
                out.append(("deleted", None, path, pd.Timestamp(ms, unit="ms")))
                self.waiting.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def correlate_move_stream(
    events: DataFrame, known: DataFrame, window_seconds: float = DEFAULTS.move_window_seconds, delay: str = "2 seconds"
) -> DataFrame:
    """Streaming form of :func:`~mnemospark.operators.reconcile.correlate_moves`.

    Deletes of unknown paths pass at once; the rest is keyed by hash, so the state
    of one key is a single waiting delete.
    """
    use_rocksdb(events.sparkSession)
    hashes = known.select(F.col("vault_path").alias("path"), F.col("hash").alias("known_hash"))
    rows = events.withWatermark("ts", delay).join(hashes, "path", "left")
    is_delete = F.col("kind") == "delete"
    rows = rows.withColumn("hash", F.when(is_delete, F.col("known_hash")).otherwise(F.col("hash"))).drop("known_hash")
    keyed = rows.filter(F.col("kind").isin("create", "delete") & F.col("hash").isNotNull()).select(
        "hash", "ts", "kind", "path", F.when(is_delete, 0).otherwise(1).alias("rank")
    )
    matched = keyed.groupBy("hash").transformWithStateInPandas(
        statefulProcessor=MoveMatcher(window_seconds), outputStructType=FILE_EVENT, outputMode="Append", timeMode="EventTime"
    )
    at_once = rows.filter(is_delete & F.col("hash").isNull()).select(
        F.lit("deleted").alias("kind"), F.lit(None).cast("string").alias("old_path"), "path", "ts"
    )
    return matched.unionByName(at_once)


class ClaimMatcher(StatefulProcessor):
    """Per path: a claim by our own job swallows one event before it expires."""

    def __init__(self, ttl_seconds: float) -> None:
        self.ttl_ms = int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for ts, kind, path in _rows(rows):
            now = MoveMatcher._ms(ts)
            if kind == "claim":
                self.claim.update((now,))
                self.handle.registerTimer(now + self.ttl_ms)
                continue
            claimed = self.claim.exists() and now - self.claim.get()[0] < self.ttl_ms
            if self.claim.exists():
                self.claim.clear()
            if not claimed:
                out.append((path, pd.Timestamp(ts)))
        frame = pd.DataFrame(out, columns=["path", "ts"])
        frame["ts"] = pd.to_datetime(frame["ts"])
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.claim.exists() and self.claim.get()[0] + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.claim.clear()
        yield pd.DataFrame({"path": pd.Series(dtype=str), "ts": pd.Series(dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def suppress_stream(
    events: DataFrame, registrations: DataFrame, ttl_seconds: float = DEFAULTS.move_guard_seconds, delay: str = "2 seconds"
) -> DataFrame:
    """Streaming form of :func:`~mnemospark.streaming.events.suppress_registered`."""
    use_rocksdb(events.sparkSession)
    both = events.select("path", "ts", F.lit("event").alias("kind"), F.lit(1).alias("rank")).unionByName(
        registrations.select("path", "ts", F.lit("claim").alias("kind"), F.lit(0).alias("rank"))
    )
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("ts", T.TimestampType())])
    return (
        both.withWatermark("ts", delay)
        .groupBy("path")
        .transformWithStateInPandas(
            statefulProcessor=ClaimMatcher(ttl_seconds), outputStructType=out, outputMode="Append", timeMode="EventTime"
        )
    )


def _step_once(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether a micro-batch still has to write its state version."""
    done = latest_version(spark, path)
    return done is None or done < batch_id + 1


def create_catalog(docs: DataFrame, path: str) -> SegmentLog:
    """A document catalog as a log of segments, with ``docs`` as its first one."""
    log = SegmentLog(docs.sparkSession, path, "vault_path")
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    log.append(docs, 0, {"top_id": float(top)}, rows=docs)
    return log


def open_catalog(spark: SparkSession, path: str) -> SegmentLog:
    return SegmentLog(spark, path, "vault_path")


def ingest_stream(texts: DataFrame, catalog_path: str, checkpoint: str) -> DataStreamWriter:
    """Upsert ``texts(vault_path, full_body, content_hash, seq, ...)`` into a catalog (:func:`create_catalog`).

    What arrives later replaces what is stored if its hash differs, however old its ``seq``:
    a file may be replaced by an older copy of it. Within a batch ``seq`` is the order.
    The state store keeps the (path, hash, seq) of all rows, so that one that is delivered again is
    left out. A micro-batch appends the rows it changed; a replayed batch finds its
    segment in the manifest and does nothing.
    """
    use_rocksdb(texts.sparkSession)

    def apply(batch: DataFrame, batch_id: int) -> None:
        log = open_catalog(batch.sparkSession, catalog_path)
        if any(s.tag > batch_id for s in log.segments()):
            return
        fresh = cut_lineage(batch)
        top = int(log.measures().get("top_id", 0))
        own = log.read().join(fresh.select("vault_path").distinct(), "vault_path", "left_semi")
        changed = cut_lineage(upsert_uploads(own, fresh, top_id=top).filter("action <> 'unchanged'").drop("action"))
        new_top = changed.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(top))).first()[0]
        log.append(changed, batch_id + 1, {"top_id": float(new_top - top)}, rows=changed)
        log.compact()

    once = texts.dropDuplicates(["vault_path", "content_hash", "seq"]).drop("ts")
    return once.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)


class MissCounter(StatefulProcessor):
    """Per path: the sweeps in a row that missed it. Plain rows, as a path has few of them in a batch."""

    def __init__(self, confirmations: int, ttl_ms: int | None) -> None:
        self.confirmations, self.ttl_ms = confirmations, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.missed = handle.getValueState("missed", T.StructType([T.StructField("n", T.LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.missed.get()
        n = held[0] if held else 0
        for sweep, present in sorted((r["sweep"], r["present"]) for r in rows):
            n = 0 if present else n + 1
            if n >= self.confirmations:
                yield Row(path=key[0], sweep=sweep)
                n = 0
        if n:
            self.missed.update((n,))
        elif held:
            self.missed.clear()

    def close(self) -> None:
        pass


def confirm_delete_stream(sweeps: DataFrame, confirmations: int = DEFAULTS.sweep_confirmations, ttl_ms: int | None = None) -> DataFrame:
    """``path, sweep``: paths of ``sweeps(path, sweep, present)`` once ``confirmations`` sweeps in a row missed them.

    Streaming form of :func:`~mnemospark.streaming.events.confirm_deletes`: the state of a path is one
    number, kept only while it is missing; a path that is back, or is confirmed, starts anew.
    With ``ttl_ms`` a counter that no sweep touched for so long is forgotten; such a stream looks
    at the clock, so it runs until stopped and does not suit ``availableNow``.
    """
    use_rocksdb(sweeps.sparkSession)
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("sweep", T.LongType())])
    rows = sweeps.select("path", F.col("sweep").cast("long").alias("sweep"), "present")
    return rows.groupBy("path").transformWithState(
        statefulProcessor=MissCounter(confirmations, ttl_ms), outputStructType=out, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )


def confirm_delete_job(sweeps: DataFrame, state_path: str, checkpoint: str, confirmations: int = DEFAULTS.sweep_confirmations) -> DataStreamWriter:
    """:func:`confirm_delete_stream` without a call per path, for sweeps that report every path: see :func:`confirmed_deletes`.

    Each micro-batch writes one version: ``path, n, confirmed``, the counter of every path that is
    missing and the sweeps that confirmed a deletion. A replayed batch finds its version and does nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not _step_once(spark, state_path, batch_id):
            return
        none = F.lit(None)
        rows = batch.select("path", F.struct(F.col("sweep").cast("long").alias("sweep"), F.coalesce("present", F.lit(False)).alias("present")).alias("x"), none.cast("long").alias("n"))
        if batch_id > 0:
            held = read_snapshot(spark, state_path, batch_id).where("n > 0")
            rows = rows.unionByName(held.select("path", none.cast("struct<sweep:bigint,present:boolean>").alias("x"), "n"))
        paths = rows.groupBy("path").agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), F.sort_array(F.collect_list("x")).alias("xs"))

        def step(acc: Column, x: Column) -> Column:
            n = F.when(x["present"], F.lit(0).cast("long")).otherwise(acc["n"] + 1)
            hit = n >= confirmations
            out = F.when(hit, F.concat(acc["confirmed"], F.array(x["sweep"]))).otherwise(acc["confirmed"])
            return F.struct(F.when(hit, F.lit(0).cast("long")).otherwise(n).alias("n"), out.alias("confirmed"))

        start = F.struct(F.col("n"), F.array().cast("array<bigint>").alias("confirmed"))
        folded = paths.select("path", F.aggregate("xs", start, step).alias("s")).select("path", "s.n", "s.confirmed")
        write_snapshot(folded.where("n > 0 OR size(confirmed) > 0"), state_path, batch_id + 1)

    return sweeps.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)


def confirmed_deletes(spark: SparkSession, state_path: str) -> DataFrame:
    """``path, sweep`` of all deletions a :func:`confirm_delete_job` has confirmed so far."""
    last = latest_version(spark, state_path) or 0
    if not last:
        return spark.createDataFrame([], "path string, sweep long")
    rows = spark.read.parquet(*[f"{state_path}/version={v}" for v in range(1, last + 1)])
    return rows.select("path", F.explode("confirmed").alias("sweep"))


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """New files of a folder as a stream of ``path, modificationTime, length, content``.

    Names that start with a dot or underscore are hidden from this source.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)


def upload_stream(files: DataFrame, root: str, max_bytes: int = DEFAULTS.max_file_bytes) -> DataFrame:
    """Extract a :func:`file_stream` to upload rows, ordered by modification time.

    Larger files are the rows of :func:`oversize_stream`.
    """
    base = len(root.rstrip("/")) + 1
    bare = F.regexp_replace("path", r"^[a-zA-Z0-9]+:(//[^/]*)?(?=/)", "")
    named = files.select(
        F.substring(bare, base + 1, 2**30).alias("vault_path"), F.col("length").alias("size"), "content", F.col("modificationTime").alias("ts")
    )
    return named.filter(F.col("size") <= max_bytes).select(
        "vault_path", text_column(F.col("vault_path"), F.col("content")).alias("full_body"),
        F.sha2("content", 256).alias("content_hash"), F.col("size").alias("file_size_bytes"),
        F.unix_millis("ts").alias("seq"), "ts",
    )


def oversize_stream(files: DataFrame, max_bytes: int = DEFAULTS.max_file_bytes) -> DataFrame:
    """The files of a :func:`file_stream` that are too large to extract, with the reason."""
    large = files.filter(F.col("length") > max_bytes)
    return large.select("path", F.col("length").alias("size"), F.format_string("larger than %d bytes", F.lit(max_bytes)).alias("reason"))


def work_stream(documents: DataFrame) -> DataFrame:
    """Unclassified documents, each (id, content) once; run with ``availableNow`` to catch up.

    What was given out is kept for good, a row of two keys each, so that a document
    with an old time is still found.
    """
    return find_unclassified(documents).dropDuplicates(["id", "content_hash"]).select("id", "content_hash", "updated_at")


def chain_stream(
    moves: DataFrame,
    state_path: str,
    checkpoint: str,
    sink: Callable[[DataFrame, int], None],
    settle_seconds: float = DEFAULTS.binary_settle_seconds,
) -> DataStreamWriter:
    """Coalesce move hops ``(id, ts, src, dst)`` across micro-batches.

    Chains whose last hop is older than the settle time go to ``sink``; hops of
    open chains wait in a snapshot. A chain crosses keys, so it is solved with the
    batch operator instead of per-key state.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not _step_once(spark, state_path, batch_id):
            return
        hops = batch.select("id", "ts", "src", "dst")
        if batch_id > 0:
            hops = hops.unionByName(read_snapshot(spark, state_path, batch_id))
        newest = hops.agg(F.max("ts")).scalar()
        chains = coalesce_chains(hops, settle_seconds, keep_members=True)
        age = newest.cast("double") - F.col("last_ts").cast("double")
        settled = chains.filter(age > settle_seconds)
        open_ = chains.filter(age <= settle_seconds).select("id").distinct()
        sink(settled.select("src", "dst", "first_ts", "last_ts", "hops").distinct(), batch_id)
        write_snapshot(hops.join(open_, "id", "left_semi"), state_path, batch_id + 1)

    return moves.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Drain what a stream has now into ``folder`` and read the result."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def sweep_rows(spark: SparkSession, start: str, end: str, every: str = "1 day") -> DataFrame:
    """Decay sweep times between two timestamps, for the retrieval score log."""
    days = F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {every}"))
    return spark.range(1).select(F.explode(days).alias("ts"))
