"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import common


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sources(source, size)`` with ``target``: ``share`` of all sizes dealt by weight, at most ``most`` x a source's size.

    Sources by code point (null last) take the weights in turn. What a full source leaves goes to the others by weight
    until none is above its limit: that is min(limit, level * weight), and the level is the largest that any number of
    full sources, fullest first, allows. One row a source goes through the ordered windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = (F.col("size") * F.lit(float(most))).alias("limit")
    rows = sources.withColumn("weight", weight).select("*", limit)
    full = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max((F.sum("size").over(all_rows) * F.lit(float(share)) - F.col("used")) / F.col("left")).over(all_rows))
    )
    return rows.select("source", "size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, source, size, *carry, source_size, target, copies): how often the mix takes each document.

    A document's expected copies are its source's target over the source's size, at most ``most``. Within a source the
    documents stand by size and doc_id; the running sum of expected copies starts at one random offset a source, and a
    document is emitted once for each integer that the sum passes. Neighbours in that order are of like size, so the
    words taken stay within about one document of the target. The offset is a hash of seed and source: reruns agree.

    The running sum is built from range partitions: rows are dealt by (source, size, doc_id), so that a hot source
    spreads over as many partitions as it needs, each counts its own rows, and only the counts go through an ordered
    window. A null source is a source of its own; a text without words has size 0 and adds no words; repeated rows
    count as documents each; of rows that tie in size and doc_id it is open which is taken. A very long text counts
    whole. ``carry`` names columns to pass through (none of the result's names); all others are left out. An empty table
    gives an empty result.
    """
    if clash := {"doc_id", "source", "size", "source_size", "target", "copies", "part", "place", "rate", "offset"} & {*carry}:
        raise ValueError(f"carried columns clash with the result's: {sorted(clash)}")
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD)).cast("long").alias("size"), *carry)
    n = common.parts(docs)
    dealt = common.cut(
        sized.repartitionByRange(n, F.col("source").asc_nulls_last(), "size", "doc_id")
        .withColumn("part", F.spark_partition_id())
    )
    counts = dealt.groupBy("source", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    level = targets(counts.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("earlier"))
    starts = starts.alias("s").join(level.alias("l"), F.expr("s.source <=> l.source")).select(
        F.expr("s.source AS source_"), F.expr("s.part AS part_"), "earlier", F.expr("l.size AS source_size"), "target"
    )
    rows = dealt.join(starts, F.expr("part = part_ AND source <=> source_"))
    here = Window.partitionBy("source", "part").orderBy("size", "doc_id")
    place = F.col("earlier") + F.row_number().over(here)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rows = rows.withColumn("place", place).withColumn("rate", rate).withColumn("offset", offset)
    copies = F.floor(F.expr("offset + place * rate")) - F.floor(F.expr("offset + (place - 1) * rate"))
    return rows.select("doc_id", "source", "size", *carry, "source_size", "target", copies.cast("long").alias("copies"))
