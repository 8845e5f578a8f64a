"""Scoring protocols: which candidates count, how gains are taken, what is rounded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import gains
from rankloom.operators import metrics
from rankloom.operators.metrics import QUERY
from rankloom.operators.ranking import KEYS


@dataclass(frozen=True)
class Protocol:
    """ties, gain of a grade, whether only pooled documents count, whether a document named as its query goes."""

    ties: str = "group_mean"
    qrel_gain: str = "linear"
    restrict_to_candidates: bool = False
    drop_identical_ids: bool = False
    round_digits: int | None = None


PRESETS = {
    "nanobeir": Protocol(restrict_to_candidates=True, round_digits=5),
    "bright": Protocol(round_digits=5),
    "vidore": Protocol(restrict_to_candidates=True),
    "trecdl": Protocol(restrict_to_candidates=True),
    "mteb": Protocol(restrict_to_candidates=True),
    "plain": Protocol(),
}


def without_excluded(rows: DataFrame, excluded: DataFrame, protocol: Protocol) -> DataFrame:
    """Rows but for the excluded documents of their query."""
    rows = rows.join(excluded.select(*QUERY, "doc_id").distinct(), [*QUERY, "doc_id"], "left_anti")
    return rows.filter("doc_id <> query_id") if protocol.drop_identical_ids else rows


def restricted(run: DataFrame, pools: DataFrame, excluded: DataFrame, protocol: Protocol) -> DataFrame:
    """The run as the protocol scores it: excluded documents go; pooled ones come first, in the pool's order.

    With restriction the rest goes too, else it follows in its own order; ``pos`` holds that order.
    """
    rows = without_excluded(run, excluded, protocol)
    pool = pools.groupBy(*QUERY, "doc_id").agg(F.min("pos").alias("pool_pos"))
    rows = rows.join(pool, [*QUERY, "doc_id"], "inner" if protocol.restrict_to_candidates else "left")
    return rows.withColumn("pos", F.coalesce("pool_pos", F.col("pos") + F.lit(1 << 62))).drop("pool_pos")


def scored(run: DataFrame, labels: DataFrame, pools: DataFrame, excluded: DataFrame, protocol: Protocol, k: int) -> DataFrame:
    """(*KEYS, ndcg) under a protocol: its candidates, its gain of a grade, its ties, its rounding (half to even).

    A query without a positive label is undefined: null, and left out by the means. Rankings that share no query with
    the labels are a ValueError.
    """
    if not run.join(labels, list(QUERY), "left_semi").head(1):
        raise ValueError("the rankings and the labels have no query in common")
    rows = restricted(run, pools, excluded, protocol)
    judged = without_excluded(labels, excluded, protocol).withColumn("gain", gains.qrel_gain(F.col("grade"), protocol.qrel_gain))
    out = metrics.ndcg(rows, judged, [k], protocol.ties)
    value = F.when(F.col("idcg") > 0, F.col("ndcg"))
    return out.select(*KEYS, (F.bround(value, protocol.round_digits) if protocol.round_digits is not None else value).alias("ndcg"))


def report(values: DataFrame, value: str) -> DataFrame:
    """(system, dataset, value, num_queries): each data set's mean, and with a null dataset the mean of those."""
    inner = values.groupBy("system", "dataset").agg(F.avg(value).alias(value), F.count(value).alias("num_queries"))
    outer = inner.groupBy("system").agg(F.avg(value).alias(value), F.sum("num_queries").alias("num_queries"))
    return inner.unionByName(outer.withColumn("dataset", F.lit(None).cast("string")))
