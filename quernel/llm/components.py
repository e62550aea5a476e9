"""Connected components over an edge table, by hooking and shortcutting.

Each round lets every node's parent take the least grandparent seen across an
edge and then jumps pointers, so the rounds grow with the logarithm of the
longest path. Rounds are written to the shared folder, and the tables of past ones
removed from it; only counts reach the driver. Joins are plain equi-joins, which adaptive execution splits where one
node holds many edges; minima are combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import delete, stored_at


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, root): root is the least node reachable.

    Direction, repeats and self-loops don't matter; rows with a null end are
    left out. Nodes without an edge have no row.
    """
    # Both directions from one pass: a union would run what makes the edges twice.
    both = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    edges, edges_path = stored_at(both.distinct(), "edges")
    found, path = stored_at(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "parents")
    while True:
        up = found.select(F.col("node").alias("p"), F.col("root").alias("grand"))
        far = found.join(up, found.root == up.p).select("node", "root", "grand")
        near = edges.join(far.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("m"))
        own = far.join(near, far.node == near.a).select("node", "root", "grand", "m")
        old = F.lit(None).cast(found.schema["root"].dataType)
        offers = own.select(F.inline(F.array(
            F.struct(F.col("node").alias("node"), F.least("grand", "m").alias("offer"), F.col("root").alias("old")),
            F.struct(F.col("root").alias("node"), F.col("m").alias("offer"), old.alias("old")),
        )))
        new, new_path = stored_at(
            offers.groupBy("node").agg(F.min("offer").alias("offer"), F.max("old").alias("old")).select("node", F.least("offer", "old").alias("root"), (F.col("offer") < F.col("old")).alias("moved")),
            "parents",
        )
        delete(edges.sparkSession, path)
        found, path = new.select("node", "root"), new_path
        if new.where("moved").isEmpty():
            delete(edges.sparkSession, edges_path)
            return found
