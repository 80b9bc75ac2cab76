"""Connected components on DataFrames: edges are contracted in chunks, then large-star and small-star steps alternate
(Kiveris et al., 2014) if there is more than one chunk left."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

CHUNK = 1 << 20  # edges that one task connects by itself


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of all nodes of the edges (a, b) but the least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # roots hang themselves under lesser ones, so the least of a component stays
        rx, ry = root[x], root[y]
        if not (apart := rx != ry).any():
            break
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(up := root[root], root):
            root = up
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what the given ones connect: of each partition's chunks of CHUNK edges at most, stars."""

    def run(batches):
        held, size = [], 0
        for x in batches:
            if held and size + len(x) > CHUNK:
                yield stars(held)
                held, size = [], 0
            held.append(x)
            size += len(x)
        if held:
            yield stars(held)

    def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
        e = pd.concat(held)
        return pd.DataFrame(dict(zip("ab", contract(e["a"].to_numpy(np.int64), e["b"].to_numpy(np.int64)), strict=True)))

    return edges.select("a", "b").mapInPandas(run, "a long, b long")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (large-star) or smaller-or-equal neighbours of every node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # edges have a > b
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) for every node of an edge of (a, b), which are long: the component is its least node.

    Every partition contracts its edges.  What is left is connected by one task if it is a chunk of CHUNK edges at most.
    Else no neighbourhood is collected: each step is an aggregation and a join on the node, and the number of steps
    grows with the logarithm of the number of nodes.  A step costs the driver some seven exchanges with their threads,
    plans and broadcasts, so that small tables do without.
    """
    now = materialize(_contracted(edges.filter("a <> b")), tag)
    if now.count() <= CHUNK:
        old, now = now, materialize(_contracted(now.coalesce(1)), tag)
        discard(old)
    else:
        mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())
        before, state = None, mark(now)
        while state != before:
            old, now = now, materialize(_stars(_stars(now, True), False), tag)
            discard(old)
            before, state = state, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
