"""Comparing a folder with the cached and the server manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.folds import value_before
from mnemospark.schemas import DEFAULTS
from mnemospark.session import cut_lineage


def reconcile_2way(disk: DataFrame, server: DataFrame, unreadable: DataFrame) -> DataFrame:
    """``(vault_path, action)`` for every path on disk or on the server."""
    d = disk.select("vault_path", F.col("hash").alias("d_hash"), F.lit(True).alias("on_disk"))
    s = server.select("vault_path", F.col("hash").alias("s_hash"), F.lit(True).alias("on_server"))
    u = unreadable.select("vault_path").distinct().withColumn("unreadable", F.lit(True))
    rows = d.join(s, "vault_path", "full_outer").join(u, "vault_path", "left")
    here, there = F.col("on_disk").isNotNull(), F.col("on_server").isNotNull()
    action = (
        F.when(here & ~there, "uploaded")
        .when(here & F.col("s_hash").isNull(), "re_uploaded")
        .when(here & (F.col("s_hash") != F.col("d_hash")), "re_uploaded")
        .when(here, "skipped")
        .when(F.col("unreadable").isNull(), "deleted")
    )
    return rows.select("vault_path", action.alias("action")).filter(F.col("action").isNotNull())


@dataclass
class Reconciled:
    actions: DataFrame
    cache: DataFrame
    candidates: DataFrame


def reconcile_3way(
    disk: DataFrame,
    cache: DataFrame,
    server: DataFrame,
    unreadable: DataFrame,
    candidates: DataFrame,
    confirmations: int = DEFAULTS.sweep_confirmations,
) -> Reconciled:
    """One sweep over disk, cache and server manifests.

    ``candidates(vault_path, n)`` counts consecutive sweeps in which a server file
    was missing; at ``confirmations`` it is deleted. The returned cache holds the
    disk rows that are already in sync; rows whose upload is acknowledged are added
    by :func:`advance_cache`.
    """
    d = disk.select("vault_path", F.struct("hash", "size", "mtime").alias("d"))
    c = cache.select("vault_path", F.struct("hash").alias("c"))
    s = server.select("vault_path", F.struct("hash").alias("s"))
    u = unreadable.select("vault_path").distinct().withColumn("unreadable", F.lit(True))
    n = candidates.select("vault_path", "n")
    rows = (
        d.join(c, "vault_path", "full_outer")
        .join(s, "vault_path", "full_outer")
        .join(u, "vault_path", "left")
        .join(n, "vault_path", "left")
    )
    here, cached, there = F.col("d").isNotNull(), F.col("c").isNotNull(), F.col("s").isNotNull()
    missing = ~here & there & F.col("s.hash").isNotNull() & F.col("unreadable").isNull()
    count = F.coalesce("n", F.lit(0)) + 1
    action = (
        F.when(here & ~there & ~cached, "uploaded")
        .when(here & ~there, "re_uploaded")
        .when(here & (F.col("s.hash").isNull() | (F.col("s.hash") != F.col("d.hash"))), "re_uploaded")
        .when(here, "skipped")
        .when(missing & (count >= confirmations), "deleted")
        .when(missing, "candidate")
        .when(~here & cached & ~there, "forgotten")
    )
    judged = rows.withColumn("action", action).withColumn("count", count)
    kept = judged.filter(F.col("action") == "skipped").select("vault_path", "d.hash", "d.size", "d.mtime")
    # A counter survives when its path was not judged this time (e.g. unreadable).
    untouched = judged.filter(~here & F.col("n").isNotNull() & ~missing).select("vault_path", "n")
    waiting = judged.filter(F.col("action") == "candidate").select("vault_path", F.col("count").alias("n"))
    unseen = n.join(judged.select("vault_path"), "vault_path", "left_anti")
    return Reconciled(
        judged.select("vault_path", "action").filter(F.col("action").isNotNull()),
        kept,
        waiting.unionByName(untouched).unionByName(unseen),
    )


def advance_cache(cache: DataFrame, disk: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Cache rows in sync plus the disk rows whose upload the server acknowledged."""
    acked = disk.join(acknowledged.select("vault_path").distinct(), "vault_path", "left_semi")
    return cache.join(acked, "vault_path", "left_anti").unionByName(acked.select(*cache.columns))


def scan_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("cnt"))


def path_sets(disk: DataFrame, server: DataFrame, unreadable: DataFrame) -> dict[str, DataFrame]:
    """The set algebra over path keys behind the two-way comparison."""
    d, s, u = (df.select("vault_path") for df in (disk, server, unreadable))
    return {
        "universe": d.union(s).distinct(),
        "both": d.intersect(s),
        "disk_only": d.subtract(s),
        "server_only": s.subtract(d).subtract(u),
    }


def detect_changes(current: DataFrame, mirror: DataFrame) -> DataFrame:
    """``(change, path, old_path)`` between a listing and its mirror.

    A deleted and an added path with the same hash form a move only when no other
    deleted or added path has that hash. A mirror row without hash counts as modified.
    """
    now = current.select("vault_path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("here"))
    old = mirror.select("vault_path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("there"))
    rows = now.join(old, "vault_path", "full_outer")
    here, there = F.col("here").isNotNull(), F.col("there").isNotNull()
    added = rows.filter(here & ~there).select("vault_path", F.col("new_hash").alias("hash"))
    deleted = rows.filter(~here & there).select("vault_path", F.col("old_hash").alias("hash"))

    def lone(df: DataFrame, name: str) -> DataFrame:
        # Grouped, not windowed: copies of one file combine on the map side.
        counted = df.filter(F.col("hash").isNotNull()).groupBy("hash")
        return counted.agg(F.count(F.lit(1)).alias("k"), F.min("vault_path").alias(name)).filter("k = 1").drop("k")

    moves = lone(added, "path").join(lone(deleted, "old_path"), "hash").select("path", "old_path")
    moved_in, moved_out = moves.select(F.col("path").alias("vault_path")), moves.select(F.col("old_path").alias("vault_path"))
    none = F.lit(None).cast("string").alias("old_path")
    same = F.coalesce(F.col("new_hash") == F.col("old_hash"), F.lit(False))
    modified = rows.filter(here & there & ~same)

    def labelled(df: DataFrame, change: str) -> DataFrame:
        return df.select(F.lit(change).alias("change"), F.col("vault_path").alias("path"), none)

    return (
        labelled(added.join(moved_in, "vault_path", "left_anti"), "added")
        .unionByName(labelled(modified, "modified"))
        .unionByName(labelled(deleted.join(moved_out, "vault_path", "left_anti"), "deleted"))
        .unionByName(moves.select(F.lit("moved").alias("change"), "path", "old_path"))
    )


def project_registry(projects: DataFrame, domains: DataFrame) -> DataFrame:
    """``(domain, project, flagged)`` from ``projects(name, tags)`` and ``domains(domain)``.

    A project belongs to the first known domain among its ``domain/X`` tags, else to
    ``Uncategorized`` and is flagged. A known domain without projects has one row
    with a NULL project. Order by flagged, domain, project to show.
    """
    known = domains.select("domain").distinct()
    tags = projects.select("name", F.posexplode("tags").alias("pos", "tag")).filter(F.col("tag").startswith("domain/"))
    named = tags.select("name", "pos", F.substring("tag", 8, 2**30).alias("domain"))
    first = named.join(known, "domain", "left_semi").groupBy("name").agg(F.min_by("domain", "pos").alias("domain"))
    placed = projects.select("name").distinct().join(first, "name", "left")
    listed = known.join(placed.filter(F.col("domain").isNotNull()), "domain", "left")
    others = placed.filter(F.col("domain").isNull()).select(F.lit("Uncategorized").alias("domain"), "name")
    return listed.select("domain", F.col("name").alias("project"), F.lit(False).alias("flagged")).unionByName(
        others.select("domain", F.col("name").alias("project"), F.lit(True).alias("flagged"))
    )


# --- event correlation, batch form --------------------------------------------


def correlate_moves(events: DataFrame, known: DataFrame, window_seconds: float = DEFAULTS.move_window_seconds) -> DataFrame:
    """``(kind, old_path, path, ts)`` from delete and create events.

    A delete takes its hash from ``known(vault_path, hash)``. Of several waiting
    deletes with one hash the latest wins; the create that follows within the window
    makes it a move. A delete of an unknown path is final at once.
    """
    hashes = known.select(F.col("vault_path").alias("path"), F.col("hash").alias("known_hash"))
    deletes = events.filter(F.col("kind") == "delete").join(hashes, "path", "left")
    unknown = deletes.filter(F.col("known_hash").isNull())
    parked = deletes.filter(F.col("known_hash").isNotNull()).select("ts", "path", F.col("known_hash").alias("hash"))
    creates = events.filter((F.col("kind") == "create") & F.col("hash").isNotNull()).select("ts", "path", "hash")
    # Per hash, each event looks at the one before it: a create right after a delete
    # consumes it, a delete right after a delete replaces it.
    both = parked.withColumn("kind", F.lit("delete")).unionByName(creates.withColumn("kind", F.lit("create")))
    both = both.withColumn("order_kind", F.when(F.col("kind") == "delete", 0).otherwise(1))
    both = both.withColumn("last", F.struct("kind", "path", "ts"))
    hour = F.window("ts", "10 minutes").getField("start")
    seen = value_before(both, "hash", ["ts", "order_kind", "path"], ["last"], hour)
    gap = F.col("ts").cast("double") - F.col("prev_last.ts").cast("double")
    is_move = (F.col("kind") == "create") & (F.col("prev_last.kind") == "delete") & (gap <= window_seconds)
    moves = seen.filter(is_move)
    columns = ["kind", "old_path", "path", "ts"]
    moved = moves.select(F.lit("moved").alias("kind"), F.col("prev_last.path").alias("old_path"), "path", "ts")
    created = seen.filter((F.col("kind") == "create") & ~F.coalesce(is_move, F.lit(False))).select(
        F.lit("created").alias("kind"), F.lit(None).cast("string").alias("old_path"), "path", "ts"
    )
    consumed = moves.select("hash", F.col("prev_last.path").alias("path"), F.col("prev_last.ts").alias("ts"))
    # A delete that a later delete with the same hash replaced within the window is
    # forgotten, as the waiting slot holds one path per hash.
    replaced = seen.filter(
        (F.col("kind") == "delete") & (F.col("prev_last.kind") == "delete") & (gap <= window_seconds)
    ).select("hash", F.col("prev_last.path").alias("path"), F.col("prev_last.ts").alias("ts"))
    expired = parked.join(consumed.unionByName(replaced), ["hash", "path", "ts"], "left_anti")
    gone = expired.unionByName(unknown.select("ts", "path", F.col("known_hash").alias("hash"))).select(
        F.lit("deleted").alias("kind"), F.lit(None).cast("string").alias("old_path"), "path", "ts"
    )
    return moved.select(columns).unionByName(created.select(columns)).unionByName(gone.select(columns))


def coalesce_chains(
    moves: DataFrame,
    settle_seconds: float = DEFAULTS.binary_settle_seconds,
    max_rounds: int = 40,
    keep_members: bool = False,
) -> DataFrame:
    """Join hops ``(id, ts, src, dst)`` A->B, B->C within the settle time into A->C.

    Each hop links back to the one that arrived at its source in time. The links are
    then doubled until every hop points at the head of its chain, so a chain of n
    hops takes log2(n) rounds, each cut by a checkpoint. ``keep_members`` returns one
    row per hop (``id``) instead of one per chain.
    """
    hop = moves.select("id", "ts", "src", "dst")
    # Per path, arrivals and departures in time order: a departure continues the
    # arrival right before it.
    log = hop.select(F.col("dst").alias("path"), "ts", "id", F.lit("in").alias("side")).unionByName(
        hop.select(F.col("src").alias("path"), "ts", "id", F.lit("out").alias("side"))
    )
    log = log.withColumn("last", F.struct("side", "id", "ts"))
    seen = value_before(log, "path", ["ts", "id", "side"], ["last"], F.window("ts", "10 minutes").getField("start"))
    gap = F.col("ts").cast("double") - F.col("prev_last.ts").cast("double")
    joined = (F.col("prev_last.side") == "in") & (gap <= settle_seconds)
    back = seen.filter(F.col("side") == "out").select("id", F.when(joined, F.col("prev_last.id")).alias("prev"))
    links = cut_lineage(back.select("id", F.coalesce("prev", "id").alias("head")))
    for _ in range(max_rounds):
        ahead = links.select(F.col("id").alias("head"), F.col("head").alias("far"))
        doubled = links.join(ahead, "head").select("id", F.col("far").alias("head"), (F.col("far") != F.col("head")).alias("moved"))
        doubled = cut_lineage(doubled)
        links = doubled.select("id", "head")
        if doubled.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError("move chains did not settle; raise max_rounds")
    at = F.struct("ts", "id")
    chains = links.join(hop, "id").groupBy("head").agg(
        F.min_by("src", at).alias("src"), F.max_by("dst", at).alias("dst"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("hops"),
    )
    if keep_members:
        return links.join(chains, "head").drop("head")
    return chains.drop("head")
