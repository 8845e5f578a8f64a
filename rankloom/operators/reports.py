"""Explanations, result records and summaries of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import gains
from rankloom.operators.metrics import QUERY, ideal, labelled
from rankloom.operators.ranking import KEYS, discount, ranked


def explained(run: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(*KEYS, rank, doc_id, grade, gain, contribution): what each of the top ``k`` adds to nDCG@k."""
    rows = ranked(labelled(run, labels), "group_mean").filter(F.col("rank") <= k)
    best = ideal(labels, [k]).select(*QUERY, F.col(f"ideal_{k}").alias("ideal"))
    share = F.coalesce(F.try_divide(F.col("gain") / discount(F.col("rank")), "ideal"), F.lit(0.0))
    return rows.join(best, list(QUERY)).select(*KEYS, "rank", "doc_id", "grade", "gain", share.alias("contribution"))


def records(values: DataFrame, metric: str, k: int) -> DataFrame:
    """(record_id, system, metrics) of ``values(system, dataset, value)``: one record a system, a metric entry a data set.

    A record's identity is the digest of its entries in order, so that equal results have equal ids.
    """
    entry = F.struct("dataset", F.lit(metric).alias("metric"), F.lit(k).alias("k"), "value")
    rows = values.groupBy("system").agg(F.array_sort(F.collect_list(entry)).alias("metrics"))
    line = F.transform("metrics", lambda m: F.concat_ws("|", m["dataset"], m["metric"], m["k"].cast("string"), F.format_number(m["value"], 6)))
    return rows.select(F.sha2(F.concat_ws("\n", F.col("system"), F.array_join(line, "\n")), 256).alias("record_id"), "system", "metrics")


def flat_records(rows: DataFrame) -> DataFrame:
    """One row a metric entry; a record without any keeps one row of nulls."""
    return rows.select("record_id", "system", F.explode_outer("metrics").alias("m")).select("record_id", "system", "m.dataset", "m.metric", "m.k", "m.value")


def pool_summary(pools: DataFrame) -> DataFrame:
    """(dataset, queries, smallest, mean, largest) of pool sizes."""
    sizes = pools.groupBy(*QUERY).agg(F.count("*").alias("n"))
    return sizes.groupBy("dataset").agg(F.count("*").alias("queries"), F.min("n").alias("smallest"), F.avg("n").alias("mean"), F.max("n").alias("largest"))


def opponents(thetas: DataFrame, bins: int) -> DataFrame:
    """(*QUERY, bin, doc_id, value): of each bin of the order by ability, the document whose comparison tells most.

    That is p (1 - p) / log2(place + 1), p the chance against the query's mean ability; ties go to the earlier place.
    """
    order = Window.partitionBy(*QUERY).orderBy(F.col("theta").desc(), "doc_id")
    every = Window.partitionBy(*QUERY)
    rows = thetas.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("bin", F.floor((F.col("place") - 1) * F.lit(bins) / F.count("*").over(every)).cast("long"))
    p = gains.sigmoid(F.col("theta") - F.avg("theta").over(every))
    rows = rows.withColumn("value", F.round(p * (1 - p) / F.log2(F.col("place") + 1), 9))
    best = rows.groupBy(*QUERY, "bin").agg(F.max_by(F.struct("doc_id", "value"), F.struct("value", -F.col("place"))).alias("b"))
    return best.select(*QUERY, "bin", "b.doc_id", "b.value")
