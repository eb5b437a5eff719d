"""Connected components of a graph given as edges, by alternating star operations.

The large-star step hangs a node's larger neighbours on its smallest neighbour,
the small-star step does so with the smaller ones. Each round is two
aggregations with a join back, is written to the shared folder, and makes no
more edges than it had. Only two numbers a round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _hang(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (v, least of u) for edges (u, v)."""
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _hang(both.filter("v > u"), least).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _hang(down, least).unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("bigint"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Edges may repeat and have either direction; an edge with a null end or from
    a node to itself is none. No edges give no rows.
    """
    clean = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).filter("u <> v")
    now = store(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = store(_small_star(_large_star(now)), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    # at rest every edge is (node, smallest node of its component)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
