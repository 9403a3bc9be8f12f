"""Connected components of an edge table, by hooking and contraction.

Every round hooks each node to its smallest neighbour (one partial/final
aggregate), which makes trees, and follows the hooks by doubling until every
node knows the root of its tree; then both ends of every edge are replaced by
their roots.  A tree has two nodes at least, so a round halves the nodes that
still have edges, and a tree of depth d takes log d doublings: a path in id
order, however long, is one tree.  Each step's table is written to the shared
folder; nothing but an emptiness test a step reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b; any order, repeats and loops allowed).

    ``component`` is one node of the component, the same for all of it.
    No edges: no rows.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node"))
    if left.isEmpty():
        return labels
    while True:
        both = left.union(left.select("b", "a"))
        hooks = written(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("low")).select("x", F.least("x", "low").alias("y")), "hooks")
        while True:
            further = hooks.select(F.col("x").alias("y"), F.col("y").alias("to"))
            jump = written(hooks.join(further, "y").select("x", "to", (F.col("to") < F.col("y")).alias("moved")), "jumps")
            if jump.where("moved").isEmpty():
                break
            hooks = jump.select("x", F.col("to").alias("y"))
        labels = written(labels.join(jump, labels["component"] == jump["x"], "left")
                         .select("node", F.coalesce("to", "component").alias("component")), "labels")
        ends_a, ends_b = (jump.select(F.col("x").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        left = written(left.join(ends_a, "a").join(ends_b, "b").where("to_a <> to_b")
                       .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return labels
