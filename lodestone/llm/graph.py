"""Connected components of a link table, by contraction, in DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b), two longs each; comp is the least node reachable.

    Each round hooks every node to its least neighbour, shortens these chains by pointer jumping, and contracts the links to
    those between roots; a round at least halves the nodes that still have links. Links, nodes and labels stay distributed.
    Self links count as nodes; no links give an empty result.
    """
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = cut(links.select(least, most).distinct(), "links")
    found = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp")), "parents")
        while True:
            up = parents.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            jumped = cut(parents.join(up, "comp").select("node", F.col("root").alias("comp"), (F.col("root") != F.col("comp")).alias("moved")), "jumps")
            parents = jumped.select("node", "comp")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = parents
        else:
            later = parents.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            found = cut(found.join(later, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "components")
        a = parents.select(F.col("node").alias("a"), F.col("comp").alias("ra"))
        b = parents.select(F.col("node").alias("b"), F.col("comp").alias("rb"))
        rest = edges.join(a, "a").join(b, "b").where(F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = cut(rest.distinct(), "links")
        if edges.isEmpty():
            return found
