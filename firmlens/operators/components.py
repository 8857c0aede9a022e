"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.sources.shared import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Distributed union-find: (node, component) for each node of an edge, component = smallest node.

    Each round unites every node with its first neighbour and contracts the graph: edges are
    renamed to the united nodes, and what became a loop or equal goes. First is the smallest
    node in the first two rounds and every other one after, which settle stars, and the one
    of the smallest hash between, where chains of any order shrink by a constant share.
    Minima combine map-side, and labels are written before they are joined, so that AQE can
    split a node with very many edges. Null ends and loops are ignored; an empty table gives an empty table.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stored(_plain(edges.select(x.alias("a"), y.alias("b"))), "edges")
    labels: list[DataFrame] = []
    while not now.isEmpty():
        if len(labels) == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        labels.append(_hooked(now, len(labels)))
        now = stored(_plain(_renamed(_renamed(now, labels[-1], "a"), labels[-1], "b")), "edges")
    if not labels:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = labels.pop()
    for before in reversed(labels):  # later nodes are nodes of earlier rounds too
        out = stored(_followed(before, out), "united")
    least = stored(out.groupBy("component").agg(F.min("node").alias("least")), "least")
    return out.join(least.hint("shuffle_merge"), "component").select("node", F.col("least").alias("component"))


def extended(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) after more edges (a, b), from the components before them; only edges between components count."""
    at = components.select(F.col("node").alias("x"), F.col("component").alias("_c"))
    more = edges.select("a", "b")
    for end in ("a", "b"):
        more = more.join(at.hint("shuffle_merge"), more[end] == at["x"], "left").withColumn(end, F.coalesce("_c", end)).select("a", "b")
    united = stored(connected_components(more), "united")
    if united.isEmpty():
        return components
    new = united.join(components.select("node").hint("shuffle_merge"), "node", "left_anti")
    return stored(_followed(components, united).unionByName(new.select("node", "component")), "components")


def _plain(edges: DataFrame) -> DataFrame:
    """Each edge once, the larger end first; no nulls, no loops."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _hooked(edges: DataFrame, turn: int) -> DataFrame:
    """(node, component): each node's first one among itself and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by_id = turn < 2 or turn % 2
    if by_id:
        first = F.least(F.min("b"), F.col("a"))
    else:
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("id"))
        first = F.least(F.min(order("b")), order("a"))["id"]
    labels = stored(both.groupBy("a").agg(first.alias("component")).withColumnRenamed("a", "node"), "labels")
    return labels if by_id else stored(_followed(labels, labels), "labels")


def _followed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node, component): where `before` leads, then on where `after` leads."""
    on = after.select(F.col("node").alias("x"), F.col("component").alias("_c"))
    return before.join(on.hint("shuffle_merge"), before["component"] == on["x"], "left").select("node", F.coalesce("_c", "component").alias("component"))


def _renamed(edges: DataFrame, labels: DataFrame, end: str) -> DataFrame:
    at = labels.select(F.col("node").alias("x"), "component")
    return edges.join(at.hint("shuffle_merge"), edges[end] == at["x"]).withColumn(end, F.col("component")).select("a", "b")
