"""Connected components of a large link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut, few


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()


def components(links: DataFrame) -> DataFrame:
    """(node, component_id) for every end of ``links(a, b)``: the smallest node that can be reached.

    Each round lets every node hand its smallest neighbour to its larger neighbours, then to its smaller ones; a
    component shrinks to a star in a logarithmic number of rounds. All work is grouping and joining on nodes, so a hot
    node is pre-aggregated by the grouping and split by Spark's skew join; tasks follow the number of links. Null ends, loops and repeated links count
    for nothing; no links give no rows.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    mark = _mark(edges)
    edges = few(edges, mark["n"])
    while mark["n"]:
        both = few(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), mark["n"])
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(small, "a")
        edges = cut(
            stars.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        )
        mark, last = _mark(edges), mark
        edges = few(edges, mark["n"])
        if mark == last:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id")).unionByName(roots)
