"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.rows import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``links`` (a, b), for every node that has a link.

    Each round points every node at its smallest neighbour, follows the pointers to their roots by doubling and contracts the links
    to links between roots, so the table shrinks fast. All of it are aggregates with map-side combine and joins against a side with
    one row per node; rounds end in stored tables, and only counts reach the driver. Self links and repeated links do no harm.
    """
    edges = stored(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    labels = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "roots")
        while True:
            up = roots.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = stored(roots.join(up, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "roots")
            roots = jumped.select("node", "label")
            if not jumped.where("moved").limit(1).count():
                break
        to = roots.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = stored(
            edges.join(roots.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(to, "b")
            .where(F.col("la") != F.col("lb")).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")
        labels = roots if labels is None else stored(relabel(labels, roots), "labels")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0) if labels is None else labels


def relabel(labels: DataFrame, further: DataFrame) -> DataFrame:
    """``labels`` with each label replaced by the one that ``further`` gives it."""
    to = further.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
