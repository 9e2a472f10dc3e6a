"""A table kept as a log of segments: changes are appended, and merged away later.

A segment holds the new rows of the keys it touched; a key without rows is a deletion.
Earlier rows of a touched key are dead. What is live is listed in a manifest, of which each
commit writes a new version, so that readers of the one before are undisturbed, and a
commit that was lost half-way leaves nothing but files nobody reads. Appending costs what
the batch costs, whatever the table holds. Segments of like size are merged (each row is
rewritten a logarithmic number of times), so that a reader meets few of them.

A log may keep several row sets by name, which share keys, segments and manifest. Counts
of a segment (``measures``) are kept in the manifest and sum up over the live ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.session import BROADCAST_ROWS
from mnemospark.sources.tables import latest_version, read_snapshot, write_snapshot

_MANIFEST = "seq long, size long, keys long, tag long, measures map<string,double>"


@dataclass(frozen=True)
class Segment:
    seq: int
    size: int
    keys: int
    tag: int
    measures: dict[str, float] = field(default_factory=dict)


#: Makes something of a segment from its sets that are written already.
Made = Callable[[Callable[[str], DataFrame]], object]


@dataclass(frozen=True)
class RowSet:
    """How one row set is stored: ``bucket`` names a partition column, ``sort`` the order in a file.

    ``merge`` makes the rows of a merged segment from those of several (with their ``seq``);
    without it the live ones are kept as they are. With a ``source`` it makes them from the rows of
    that set in the merged segment, which comes earlier in the list of sets.
    """

    bucket: str | None = None
    sort: tuple[str, ...] = ()
    keyed: bool = True
    merge: Callable[[SegmentLog, DataFrame, list[Segment]], DataFrame] | None = None
    arrange: Callable[[DataFrame], DataFrame] | None = None
    source: str | None = None


class SegmentLog:
    """``key`` identifies what a change replaces; ``sets`` are the row sets by name."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", sets: dict[str, RowSet] | None = None) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.sets = sets or {"rows": RowSet()}

    # --- manifest -----------------------------------------------------------

    def version(self) -> int:
        found = latest_version(self.spark, f"{self.path}/manifest")
        return 0 if found is None else found

    def segments(self, version: int | None = None) -> list[Segment]:
        """The live segments, oldest first: few, as merging keeps their sizes falling by halves."""
        version = self.version() if version is None else version
        if version == 0:
            return []
        rows = read_snapshot(self.spark, f"{self.path}/manifest", version).collect()
        return sorted((Segment(r["seq"], r["size"], r["keys"], r["tag"], dict(r["measures"] or {})) for r in rows), key=lambda s: s.seq)

    def _commit(self, live: list[Segment], version: int) -> None:
        rows = [(s.seq, s.size, s.keys, s.tag, s.measures) for s in live]
        write_snapshot(self.spark.createDataFrame(rows, _MANIFEST).coalesce(1), f"{self.path}/manifest", version)

    def measures(self) -> dict[str, float]:
        """Sums of the segments' measures."""
        out: dict[str, float] = {}
        for s in self.segments():
            for name, value in s.measures.items():
                out[name] = out.get(name, 0) + value
        return out

    # --- writing ------------------------------------------------------------

    def _write(self, name: str, rows: DataFrame, seq: int) -> None:
        kind = self.sets[name]
        if kind.arrange is not None:
            rows = kind.arrange(rows)
        elif kind.bucket:
            rows = rows.repartition(kind.bucket).sortWithinPartitions(kind.bucket, *kind.sort)
        writer = rows.write.mode("overwrite").option("compression", "zstd")
        if kind.bucket:
            writer = writer.partitionBy(kind.bucket)
        writer.parquet(f"{self.path}/{name}/seq={seq}")

    def part(self, name: str, seq: int) -> DataFrame:
        """The rows of a set in one segment."""
        return self.spark.read.parquet(f"{self.path}/{name}/seq={seq}")

    def append(self, touched: DataFrame | Made, tag: int, measures: dict[str, float] | Made | None = None, **rows: DataFrame | Made) -> bool:
        """Add a segment with the ``rows`` of each set and the ``touched`` keys. A ``tag`` seen before is skipped.

        Returns whether anything was written. Row sets left out have no rows. Each argument may be a
        function instead, which gets a reader of the sets written before it, by name.
        """
        version = self.version()
        live = self.segments(version)
        if live and max(s.tag for s in live) >= tag:
            return False
        seq = version + 1

        def made(x):
            return x(lambda name: self.part(name, seq)) if callable(x) else x

        for name, df in rows.items():
            self._write(name, made(df), seq)
        keys = made(touched).select(self.key).distinct()
        keys.write.mode("overwrite").parquet(f"{self.path}/_keys/seq={seq}")
        n = self.spark.read.parquet(f"{self.path}/_keys/seq={seq}").count()
        self._commit([*live, Segment(seq, n, n, tag, made(measures) or {})], seq)
        return True

    # --- reading ------------------------------------------------------------

    def touched(self, live: list[Segment]) -> DataFrame | None:
        """``key, _last``: the last segment that touched a key, over all but the oldest; None if there is one only."""
        later = live[1:]
        if not later:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/_keys").parquet(*[f"{self.path}/_keys/seq={s.seq}" for s in later])
        last = rows.groupBy(self.key).agg(F.max("seq").cast("long").alias("_last"))
        return F.broadcast(last) if sum(s.keys for s in later) <= BROADCAST_ROWS else last

    def stored(self, name: str, live: list[Segment] | None = None) -> DataFrame:
        """All rows of a set with their ``seq``, dead ones included."""
        live = self.segments() if live is None else live
        base = f"{self.path}/{name}"
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/seq={s.seq}" for s in live]).withColumn("seq", F.col("seq").cast("long"))

    def alive(self, rows: DataFrame, live: list[Segment] | None = None) -> DataFrame:
        """The rows (with ``seq`` and the key) that no later segment touched."""
        live = self.segments() if live is None else live
        last = self.touched(live)
        if last is None:
            return rows
        return rows.join(last, self.key, "left").where("_last IS NULL OR seq >= _last").drop("_last")

    def read(self, name: str = "rows") -> DataFrame:
        """The live rows of a set."""
        live = self.segments()
        kind = self.sets[name]
        rows = self.stored(name, live)
        rows = self.alive(rows, live) if kind.keyed else rows
        return rows.drop("seq", *([kind.bucket] if kind.bucket else []))

    # --- merging ------------------------------------------------------------

    def compact(self, ratio: float = 2.0, full: bool = False) -> bool:
        """Merge the newest segments while one is not ``ratio`` times as large as all after it; ``full``: all of them."""
        version = self.version()
        live = self.segments(version)
        first, size = len(live) - 1, live[-1].size if live else 0
        while first > 0 and (full or live[first - 1].size < ratio * size):
            first -= 1
            size += live[first].size
        if first >= len(live) - 1:
            return False
        merged, seq = live[first:], version + 1
        for name, kind in self.sets.items():
            rows = self.part(kind.source, seq) if kind.source else self.stored(name, merged)
            if kind.merge is not None:
                rows = kind.merge(self, rows, merged)
            elif kind.keyed:
                rows = self.alive(rows, merged).drop("seq")
            else:
                rows = rows.drop("seq")
            self._write(name, rows, seq)
        base = f"{self.path}/_keys"
        keys = self.spark.read.parquet(*[f"{base}/seq={s.seq}" for s in merged]).select(self.key).distinct()
        keys.write.mode("overwrite").parquet(f"{base}/seq={seq}")
        total: dict[str, float] = {}
        for s in merged:
            for measure, value in s.measures.items():
                total[measure] = total.get(measure, 0) + value
        n = self.spark.read.parquet(f"{base}/seq={seq}").count()
        self._commit([*live[:first], Segment(seq, n, n, merged[-1].tag, total)], seq)
        return True
