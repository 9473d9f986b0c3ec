"""Connected components of an edge table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterkit.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs); nodes of one component share a root.

    Each round hooks every node to its smallest neighbour, follows the hooks twice and replaces all nodes by where they
    lead, so the graph shrinks and no hub keeps its edges.  Sums and minima combine before the shuffle; each round is
    written to the shared folder.
    """
    edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                      .select("node", F.least("node", "near").alias("root")), "hooks")
        for _ in range(2):
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            hooks = stage(hooks.join(onward, "root").select("node", F.col("onward").alias("root")), "hooks")
        if roots is None:
            roots = hooks
        else:
            onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            roots = stage(roots.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root")), "roots")
        left, right = (hooks.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        edges = stage(edges.join(left, "a").join(right, "b").filter("a_root <> b_root")
                      .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
