"""Connected components of a graph given as a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import FULL, counted, stored
from mnemospark.session import BROADCAST_ROWS


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def connected(links: DataFrame, node: str) -> DataFrame:
    """``node, root``: for every node of a link the smallest node that can be reached.

    ``links`` has columns ``a`` and ``b`` of one orderable type. Each round takes two steps: every
    node hands its larger neighbours to its smallest neighbour, then its smaller ones.
    The number of rounds grows with the logarithm of the longest path. Links of a node
    are never gathered: the steps are grouped minima, which combine before the shuffle,
    and joins that adaptive execution can split. Each round is written to the shared
    folder, so that a lost executor does not replay the ones before. Links that fill one
    partition only are not dealt over others.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, n = counted(e)
    before = _checksum(e)
    while before[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        one, hint = (lambda df: df.coalesce(1), F.broadcast) if n <= FULL else (lambda df: df, lambda df: df)
        both = one(both)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(hint(low), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(hint(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e, n = counted(one(small.union(least.select("a", F.col("m").alias("b")))).distinct())
        after = _checksum(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias(node), F.col("b").alias("root")).union(e.select(F.col("b").alias(node), F.col("b").alias("root")).distinct())


def joined(roots: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """``node, root``: the components ``roots`` of a graph (as ``connected`` gives them) that has got more ``links``.

    Only the graph of the roots is worked on, which has a link for each two components that meet.
    """
    links, n = counted(links)
    if not n:
        return roots
    hint = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    own = roots.select(F.col(node).alias("_node"), F.col("root").alias("_root"))
    ends = links.select(F.col("a").alias("_node")).union(links.select("b")).distinct()
    known, _ = counted(own.join(hint(ends), "_node", "left_semi"))
    named = links
    for end in "a", "b":
        named = named.join(hint(known.select(F.col("_node").alias(end), F.col("_root").alias(f"_{end}"))), end, "left")
    tops = connected(named.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")), "_root").withColumnRenamed("root", "top")
    old = own.join(hint(tops), "_root", "left").select(F.col("_node").alias(node), F.coalesce("top", "_root").alias("root"))
    new = tops.join(hint(known.select("_root").distinct()), "_root", "left_anti").select(F.col("_root").alias(node), F.col("top").alias("root"))
    return counted(old.union(new))[0]
