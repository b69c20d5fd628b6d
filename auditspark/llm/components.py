"""Connected components of a graph whose edges are a table.

Rounds of two star operations (large star, then small star) hang every node ever closer to the
smallest node of its component. A round shuffles edges by node and writes them, so lineage stays
short and a lost executor costs one round at most. Neighbours of a node are never gathered: the
smallest comes from a partial aggregate and meets the edges in a join, which adaptive execution
splits for nodes with very many edges.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.session import materialize


def _ordered(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    ends = edges.join(smallest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the component's smallest node.

    Edges with a null end count for nothing. An empty table gives an empty table.
    """
    current = materialize(_ordered(edges))
    mark = _mark(current)
    while mark[0]:
        following = materialize(_small_star(_large_star(current)))
        seen = _mark(following)
        current = following
        if seen == mark:
            break
        mark = seen
    roots = current.select("v").distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


def hook(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the trees of the pairs in ``labels`` (in place): each index points at its smallest relative."""
    while len(left):
        a, b = labels[left], labels[right]
        differ = a != b
        if not differ.any():
            return
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = labels[labels]
            if np.array_equal(above, labels):
                break
            labels[:] = above
