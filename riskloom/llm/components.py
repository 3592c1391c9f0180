"""Connected components of a link table, by contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``links``: (u, v) longs.  Returns (node, root), one row per node of a
    link; the root is one node of the component, the same for all of it.

    Every round each node hooks to its smallest neighbour if that is smaller
    (an aggregate with map-side combine, so a hub costs no more than its
    links), two pointer jumps shorten the chains, and the links are redrawn
    between the new labels.  A round merges every node that has a smaller
    neighbour, so the link table shrinks geometrically; the loop ends when it
    is empty.  Each round's tables are written to the shared folder, which
    cuts the lineage and lets Spark split hot labels in the joins."""
    links = written(links.where("u <> v").select("u", "v").distinct(), "cc-links")
    nodes = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct()
    mapping = written(nodes.select("node", F.col("node").alias("root")), "cc-map")
    while not links.isEmpty():
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = written(both.groupBy("u").agg(F.min("v").alias("p"))
                         .select("u", F.least("u", "p").alias("p")), "cc-parent")
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = written(parent.join(up, "p").select("u", F.col("pp").alias("p")), "cc-jump")
        to_root = parent.select(F.col("u").alias("root"), F.col("p").alias("new"))
        mapping = written(mapping.join(to_root, "root", "left")
                          .select("node", F.coalesce("new", "root").alias("root")), "cc-map")
        pu = parent.select("u", F.col("p").alias("a"))
        pv = parent.select(F.col("u").alias("v"), F.col("p").alias("b"))
        links = written(links.join(pu, "u").join(pv, "v").where("a <> b")
                        .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-links")
    return mapping
