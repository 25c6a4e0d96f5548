"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.session import materialize


def _towards(edges: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller, without loops."""
    return edges.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """``edges(u, v)`` of long nodes → ``(node, root)``: every node with the least node it can reach.

    Large star: a node hangs its larger neighbours on the least node near it; small star: it hangs its
    smaller ones there. Both keep connectivity and never add links, and they end when every link points at a
    root, after about log² n rounds. Links live in written tables, so a lost executor costs one round at
    most; only a count and a checksum reach the driver. A node with very many links is one join key and one
    partially aggregated group; nothing gathers its links in one row.
    """
    links, seen = materialize(_towards(edges), label), None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _towards(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(_towards(small.union(least.select("u", F.col("m").alias("v")))), label)
        state = links.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20)))")).first()
        if state == seen:
            break
        seen = state
    roots = links.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
