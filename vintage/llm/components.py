"""Connected components over an edge table, by repeated contraction.

Each round gives every node the smallest of itself and its neighbours as parent, follows parents until
they no longer change (the number of steps grows with the logarithm of a chain's length), replaces the
ends of all edges by their parents and drops loops and repeats. Only the ever smaller edge table enters
the next round. Joins read settled tables on both sides, so that a hub with very many edges is split by
adaptive execution, and the aggregations are partial before they shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, settle, small


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has two columns a and b of one orderable type; null ends and loops are ignored. Returns
    (node, component) for every node with an edge, component being the smallest node it reaches."""
    edges = settle(_clean(edges), "cc-edges")
    labels, read = None, []
    while not edges.isEmpty():
        ways = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
        parents = settle(ways.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("p")), "cc-parents")
        while True:
            up = small(parents.select(F.col("x").alias("p"), F.col("p").alias("pp")))
            old, parents = parents, settle(parents.join(up, "p").select("x", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "cc-jump")
            dropped(old)
            if parents.filter("moved").isEmpty():
                break
        parents = parents.select("x", "p")
        if labels is None:  # the first round's parents are the labels
            labels = parents.select(F.col("x").alias("node"), F.col("p").alias("component"))
        else:
            up = small(parents.select(F.col("x").alias("component"), "p"))
            old, labels = labels, settle(labels.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "cc-labels")
            dropped(old)
            read = [parents]
        ends = small(parents)
        moved = edges.join(ends.select(F.col("x").alias("a"), F.col("p").alias("pa")), "a").join(ends.select(F.col("x").alias("b"), F.col("p").alias("pb")), "b")
        old, edges = edges, settle(_clean(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "cc-edges")
        dropped(old, *read)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(first, member) for the other members of each connected part of a symmetric matrix."""
    out, seen = [], np.zeros(len(near), bool)
    for i in np.flatnonzero(near.any(1)):
        if not seen[i]:
            part, edge = np.zeros(len(near), bool), np.array([i])
            part[i] = True
            while len(edge):
                edge = np.flatnonzero(near[edge].any(0) & ~part)
                part[edge] = True
            seen |= part
            out += [(int(i), int(j)) for j in np.flatnonzero(part) if j != i]
    return out
