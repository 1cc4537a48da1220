"""List ranking: chains and cycles of linked rows, followed by pointer doubling.

Every round each row's link reaches twice as far, so a chain of n rows takes log n joins on keys that are unique, and no
task ever holds a chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.session import removed, stored


def _twice_as_far(jump: DataFrame, keys: Sequence[str], merge: dict) -> DataFrame:
    """Each link followed by the link of where it leads; ``merge`` gives the other columns from both (as t.*, u.*)."""
    t, u = jump.alias("t"), jump.alias("u")
    on = F.col("t.next") == F.col("u.node")
    for k in keys:
        on &= F.col(f"t.{k}") == F.col(f"u.{k}")
    return t.join(u, on).select(*[f"t.{k}" for k in keys], "t.node", "u.next", *[v.alias(k) for k, v in merge.items()])


def follow(links: DataFrame, starts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., node, start, step, along) of each node that a start's links lead to, the start being step 0.

    ``links`` is (keys..., node, next, length), at most one for a node; ``starts`` is (keys..., node). A chain ends
    where a node has no link or was passed before: a node has its first step. Rows with a null key or node are in
    no chain. Chains that run together keep the smaller step, then the smaller ``along`` and start.
    """
    jump = stored(links.select(*keys, "node", "next", F.col("length").cast("double").alias("length")))
    found = stored(starts.select(*keys, "node", F.col("node").alias("start"), F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("along")))
    reach, known = 1, found.count()
    while known:
        ahead = found.join(jump, [*keys, "node"]).select(*keys, F.col("next").alias("node"), "start", (F.col("step") + reach).alias("step"), (F.col("along") + F.col("length")).alias("along"))
        first = found.unionByName(ahead).groupBy(*keys, "node").agg(F.min(F.struct("step", "along", "start")).alias("f"))
        before, found = found, stored(first.select(*keys, "node", "f.start", "f.step", "f.along"))
        removed(before)
        if (now := found.count()) == known:
            break
        known, reach = now, 2 * reach
        before, jump = jump, stored(_twice_as_far(jump, keys, {"length": F.col("t.length") + F.col("u.length")}))
        removed(before)
    removed(jump)
    return found


def rank_cycles(links: DataFrame) -> DataFrame:
    """(node, start, step) of every node of the cycles in (node, next): start is the cycle's smallest node, step its
    distance from there. ``next`` must be a permutation of ``node``."""
    pointers = stored(links.select("node", "next"))
    jump = stored(pointers.withColumn("least", F.least("node", "next")))
    while True:
        further = stored(_twice_as_far(jump, (), {"least": F.least("t.least", "u.least"), "moved": F.col("u.least") < F.col("t.least")}))
        removed(jump)
        jump = further
        if further.where("moved").isEmpty():  # the least of each node's stretch is no longer less further on: it is the cycle's
            break
    starts = jump.where("least = node").select("node")
    return follow(pointers.withColumn("length", F.lit(1.0)), starts).select("node", "start", "step")
