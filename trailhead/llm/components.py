"""Connected components of an edge table: each node hooks to its smallest neighbour, chains are shortened, edges contracted.

Every round halves at least the number of components that still have edges; stars are done in one. Only tables are kept
between rounds, written to the shared folder; the driver sees nothing but whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the smallest id of its component for every id in an edge."""
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    left = settle(left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = left.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
    while not left.isEmpty():
        hook = settle(left.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "hooks")
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        hook = settle(hook, "hooks")
        labels = settle(labels.join(hook.select(F.col("a").alias("root"), "p"), "root", "left")
                        .select("id", F.coalesce("p", "root").alias("root")), "labels")
        ends = left.join(hook.select("a", F.col("p").alias("pa")), "a").join(hook.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        left = settle(ends.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "edges")
    return labels
