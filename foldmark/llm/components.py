"""Groups of records that are linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.operators.skew import split_join
from foldmark.session import Scratch

#: A vertex with more than this share of the links, and at least HUB_LINKS of them, is relabelled by broadcast; there are at most 2 / HUB_SHARE such vertices.
HUB_SHARE = 1 / 2000
HUB_LINKS = 10_000


def connected_groups(links: DataFrame, left: str, right: str) -> DataFrame:
    """One row per linked record: ``vertex`` and ``group_id``, the smallest record reached over links.

    Random contraction: in each round every vertex hooks to the member of its
    closed neighbourhood that comes first in a fresh hash order, links are
    relabelled to the chosen vertices and deduplicated, until no link is left.
    A third or more of the vertices vanish per round in expectation, so
    the rounds grow with the logarithm of the graph, long chains included. Then
    the mappings are expanded from the last round back to the first.

    Links with a null side or two equal sides are no links; repeated and
    swapped ones count once. Without links the result is empty. Each round is
    written to the shared folder.
    """
    scratch = Scratch(links.sparkSession, "components")
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    edges = scratch.write(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges-0")
    hooks: list[DataFrame] = []
    while (n := edges.count()) > 0:
        k = len(hooks)
        order = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        near = edges.groupBy("a").agg(F.min(order("b")).alias("first"), F.count("*").alias("degree"))
        hook = scratch.write(near.select("a", F.least(order("a"), F.col("first"))["v"].alias("to"), "degree"), f"hook-{k}")
        hooks.append(hook.select("a", "to"))
        hubs = hook.where(F.col("degree") >= max(HUB_LINKS, n * HUB_SHARE)).select("a", "to")
        rest = hook.where(F.col("degree") < max(HUB_LINKS, n * HUB_SHARE)).select("a", "to")
        if hubs.isEmpty():
            half = _relabel(edges, rest)
            edges = scratch.write(_relabel(half, rest).where("a <> b").distinct(), f"edges-{k + 1}")
        else:
            half = scratch.write(_relabel(edges, rest, hubs), f"half-{k}")
            edges = scratch.write(_relabel(half, rest, hubs).where("a <> b").distinct(), f"edges-{k + 1}")
            scratch.drop(f"half-{k}")
        scratch.drop(f"edges-{k}")
    if not hooks:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("group_id"))
    label = hooks[-1]
    for k in range(len(hooks) - 2, -1, -1):
        # a vertex without a label of its own was left alone by then and is its group's
        deeper = label.select(F.col("a").alias("to"), F.col("to").alias("top"))
        label = scratch.write(split_join(hooks[k], deeper, ["to"], "left").select("a", F.coalesce("top", "to").alias("to")), f"label-{k}")
    least = label.groupBy("to").agg(F.min("a").alias("group_id"))
    return split_join(label, least, ["to"]).select(F.col("a").alias("vertex"), "group_id")


def _relabel(edges: DataFrame, rest: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Replace side a by what it hooks to and swap the sides. Links of hubs meet a broadcast table; the others shuffle by a key that none of them dominates."""
    if hubs is None:
        moved = edges.join(rest, "a")
    else:
        moved = edges.join(F.broadcast(hubs), "a").unionByName(edges.join(F.broadcast(hubs), "a", "left_anti").join(rest, "a"))
    return moved.select(F.col("b").alias("a"), F.col("to").alias("b"))
