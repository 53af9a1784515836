"""Connected components of a graph whose edges are too many for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Edges become stars in alternation: each node's larger neighbours are hung under its smallest one, then its
    smaller ones. Rounds end when nothing changes; their number grows with the logarithm of the longest path. Each
    round is written to the shared folder. Hubs are sums and joins on a key that AQE may split. Nulls and loops are
    dropped; an empty graph has no rows.
    """
    spark = edges.sparkSession

    def write(df: DataFrame):
        path = scratch(spark, "edges")
        df.write.parquet(path)
        got = spark.read.schema("a long, b long").parquet(path)
        return got, path, got.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    # a > b throughout
    now, path, sign = write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while sign[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star, with every a above its b
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        new, new_path, new_sign = write(small)
        drop_scratch(spark, path)
        if new_sign == sign:
            now, path = new, new_path
            break
        now, path, sign = new, new_path, new_sign
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as connect what the edges i-j connect: every node to the smallest one of its component."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[label])
        while not np.array_equal(step := new[new], new):
            new = step
        if np.array_equal(new, label):
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]
