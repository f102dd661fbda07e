"""Connected components of a graph of links, by hooking and shortcutting over tables.

Each round joins the links with the current parents, hooks parents onto the smallest grandparent
among their neighbours, and halves the paths (after Zhang, Azad and Buluc's FastSV): the number of
rounds grows with the logarithm of a component's size. Every round ends in a table of the shared
folder, and the tables of the round before are deleted; nothing is gathered on the driver but a count.
Nodes with many neighbours and parents with many children are hot keys: see ``join_counted``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import discard, join_counted, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs to (node, component): the smallest node that each linked node reaches."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    total = both.count()
    degrees = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("parent"), F.count(F.lit(1)).alias("degree"))
    parents = materialize(degrees, "parents")
    while total:  # a parent only ever becomes smaller
        children = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
        up = children.join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")
        state = materialize(join_counted(parents, up, "parent", "children", total).select("node", "parent", "grand", "degree"), "grandparents")
        near = join_counted(both, state.select(F.col("node").alias("b"), "grand", "degree"), "b", "degree", total).groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("best"))
        with_best = state.join(near, "node")
        none = F.lit(None).cast("long")
        own = with_best.select("node", F.least("parent", "grand", "best").alias("p"), "degree", F.col("parent").alias("before"))
        hooked = with_best.groupBy(F.col("parent").alias("node")).agg(F.min("best").alias("p")).select("node", "p", none.alias("degree"), none.alias("before"))
        new = materialize(own.unionByName(hooked).groupBy("node").agg(F.min("p").alias("parent"), F.max("degree").alias("degree"), F.max("before").alias("before")), "parents")
        discard(state, parents)
        parents = new.select("node", "parent", "degree")
        parents.staged_at = new.staged_at
        if new.where("parent <> before").isEmpty():
            break
    discard(both)
    return parents.select("node", F.col("parent").alias("component"))
