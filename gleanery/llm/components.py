"""Connected components of a graph given as links, by contraction.

Each round every node takes its smallest neighbour, or itself, as its label and the links
are drawn between labels; links inside a label go. With node numbers that are hashes the number
of labels falls by a constant factor a round. Nothing is gathered: a hub's links are reduced by
partial aggregates, and joins on a hub are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links`` (columns ``a``, ``b``); a component is its smallest node's label.

    Labels are some node of the component, equal for all of them.
    """
    both = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = cut_lineage(both.distinct())
    label = None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        least = ends.groupBy("node").agg(F.min("other").alias("_other"))
        step = cut_lineage(least.select("node", F.least("node", "_other").alias("next")))
        if label is None:
            label = step.select("node", F.col("next").alias("component"))
        else:
            moved = step.select(F.col("node").alias("component"), "next")
            label = cut_lineage(
                label.join(moved, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
            )
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), F.col("next").alias(f"_{end}")), end)
        edges = edges.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        edges = cut_lineage(edges.filter("a <> b").distinct())
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return label
