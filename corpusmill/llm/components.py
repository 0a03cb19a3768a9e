"""Connected components of an edge table, without any node's neighbours in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Each round a node and its present root learn the smallest root among the node's
    neighbours, and roots then skip to their own roots, so rounds grow with the logarithm of
    a component's width. All steps are equi-joins and minima, which combine before they are
    shuffled: a node with very many neighbours is no group of rows. Rounds are cut by
    checkpoints. Null ends and loops are left out.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct()
    both = cut(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        heard = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("low")), "b").select("a", "low")
        told = heard.groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        known = roots.join(told, "node")
        hooks = known.select(F.explode(F.array("node", "root")).alias("node"), F.least("low", "root").alias("low")).groupBy("node").agg(F.min("low").alias("low"))
        new = roots.join(hooks, "node", "left").select("node", F.least("root", "low").alias("mid"), F.col("root").alias("was"))
        skip = new.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        new = cut(new.join(skip, "mid", "left").select("node", F.least("mid", "far").alias("root"), (F.least("mid", "far") != F.col("was")).alias("moved")))
        roots = new.select("node", "root")
        if new.filter("moved").isEmpty():
            return roots


def joined(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each element's smallest fellow, fully resolved) after joining i[k] with j[k]."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            far = labels[labels]
            if np.array_equal(far, labels):
                break
            labels = far
