"""Connected components of a graph, by alternating large-star and small-star rounds.

Edges stay a DataFrame; each round is written to the shared folder, which cuts the lineage. Rounds end
when the edges don't change, which takes about the logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _spark as S


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes, in memory."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        on = x != y
        if not on.any():
            return label
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


#: Neighbours of a node from which its edges are no longer gathered by node.
MANY = 1000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with the ``m`` of their ``u``. Nodes of many edges are few, at most edges / ``MANY``: they are joined
    where the edges are, so that the edges of one node stay spread."""
    least = S.written(least, "least")
    hubs = least.filter(F.col("n") > MANY).select("u", "m")
    if not 0 < hubs.count() <= 1_000_000:
        return edges.join(least.select("u", "m"), "u")
    rest = edges.join(F.broadcast(hubs), "u", "left_anti").join(least.filter(F.col("n") <= MANY).select("u", "m"), "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(rest)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = S.written(edges, "star")
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return _with_least(edges, least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v), long: a row (node, root) for each node, root the least node of its component, but for roots themselves."""
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = S.written(ordered, "edges")
    state = _state(now)
    while state[0]:
        now = S.written(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
