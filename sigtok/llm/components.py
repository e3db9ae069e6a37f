"""Connected components of a table of links, by alternating large and small stars.

A large star hangs a node's larger neighbours on its smallest neighbour, a small star its smaller ones;
repeated, every node hangs on the smallest id of its component. Each round is two grouped minima and
joins over the links, so hubs are combined map-side and skewed joins can be split; each round is
written to the shared folder, which cuts its lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtok.llm.common import drop_shared, write_shared


def _star(arcs: DataFrame, wanted: Column) -> DataFrame:
    """Hangs b on the smallest of a's neighbours and a itself, for the arcs (a, b) where ``wanted``."""
    least = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = arcs.where(wanted).join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    return hung.where("u != v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none: then components are read off."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
    return n == nodes and not edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").head(1)


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of each node of ``links`` (u, v), component being its smallest node."""
    edges = write_shared(
        links.where("u != v")
        .select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
        .distinct(),
        "links",
    )

    while not _stars(edges):
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
        both = both.union(edges.select("v", "u"))
        large = write_shared(_star(both, F.col("b") > F.col("a")), "large-star")
        down = large.select(F.col("u").alias("a"), F.col("v").alias("b"))
        # the node itself hangs there too
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a")
            .select(F.col("b").alias("u"), F.col("m").alias("v"))
            .union(least.select("a", "m"))
            .where("u != v")
            .distinct()
        )
        small = write_shared(small, "small-star")
        drop_shared(edges, large)
        edges = small
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v").distinct())
