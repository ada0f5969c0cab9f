"""Connected components by alternating stars, with nothing but edges in flight.

Every round turns the edges into stars around ever smaller numbers: first each node hands its larger
neighbours its smallest one, then its smaller ones. Rounds grow with the logarithm of a component's
size; each is cut off from its lineage in the shared folder. A node with very many neighbours is
joined with them where they are (see ``hot``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hot
from .common import stored


def as_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within one task: edges that join the same nodes as (a, b), each from its group's smallest node."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(node))
    while True:
        least = np.minimum(label[x], label[y])
        now = label.copy()
        np.minimum.at(now, label[x], least)
        np.minimum.at(now, label[y], least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    ends = label != np.arange(len(node))
    return node[label[ends]], node[ends]


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or the end of one edge: one aggregation tells."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("ends"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("ends"), F.lit(1).alias("centre")))
    odd = ends.groupBy("node").agg(F.sum("ends").alias("ends"), F.max("centre").alias("centre")).where("ends + centre > 1")
    return not odd.limit(1).count()


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return hot.left_join(both.where("b > a"), least, "a", "n", total).select(F.col("m").alias("a"), "b").where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b")
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Rows (node, component) of every node that has an edge to another; the
    component is its smallest node. Loops, repeats and nulls among the edges have no effect."""
    now = stored(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not _stars(now):
        now = stored(_small_star(_large_star(now, now.count())))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
