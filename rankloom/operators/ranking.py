"""Orders of a ranking. Four tie rules exist side by side; each has its own window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("system", "dataset", "query_id")
TIES = ("group_mean", "doc_id_desc", "input_order")


def metric_order(keys: tuple[str, ...] = KEYS) -> Window:
    """Score descending, then doc_id descending by code point."""
    return Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").desc())


def input_order(keys: tuple[str, ...] = KEYS) -> Window:
    """Score descending, then as the rows came (``pos``)."""
    return Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("pos").asc())


def retrieval_order(keys: tuple[str, ...] = KEYS) -> Window:
    """Score descending, then doc_id ascending: what retrieval cuts by."""
    return Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc())


def ranked(rows: DataFrame, ties: str = "group_mean", gain: str = "gain") -> DataFrame:
    """``rows`` with ``rank``, and ``gain`` as the tie rule credits it.

    ``group_mean`` gives each of a class of equal scores the class's mean gain, over the full ranking; who of them
    stands before a cut then makes no difference.
    """
    if ties not in TIES:
        raise ValueError(f"unknown tie rule {ties!r}")
    order = input_order() if ties == "input_order" else metric_order()
    rows = rows.withColumn("rank", F.row_number().over(order))
    if ties == "group_mean":
        rows = rows.withColumn(gain, F.avg(gain).over(Window.partitionBy(*KEYS, "score")))
    return rows


def top(run: DataFrame, depth: int) -> DataFrame:
    """The best ``depth`` of each ranking in retrieval order, with ``rank``."""
    return run.withColumn("rank", F.row_number().over(retrieval_order())).filter(F.col("rank") <= depth)


def discount(rank: Column) -> Column:
    return F.log2(rank + 1)


def scores_from_order(lists: DataFrame) -> DataFrame:
    """Rows of ``lists(*KEYS, doc_ids)`` to one row a document with score n, n - 1, ... 1 and its place."""
    return lists.select(*KEYS, F.size("doc_ids").alias("n"), F.posexplode("doc_ids").alias("pos", "doc_id")).select(
        *KEYS, "doc_id", (F.col("n") - F.col("pos")).cast("double").alias("score"), F.col("pos").cast("long").alias("pos")
    )


def fused(run: DataFrame, rankers: list[str], constant: int = 60, depth: int | None = None, name: str = "fused") -> DataFrame:
    """Reciprocal rank fusion of the rankers: sum of 1 / (constant + rank), ties by the earliest appearance.

    Appearance is the ranker's place in the list, then the rank there.
    """
    order = F.array_position(F.array(*[F.lit(r) for r in rankers]), F.col("system"))
    ranks = run.filter(F.col("system").isin(rankers)).withColumn("rank", F.row_number().over(retrieval_order()))
    rows = ranks.groupBy("dataset", "query_id", "doc_id").agg(
        F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"), F.min(F.struct(order.alias("o"), F.col("rank").alias("r"))).alias("first")
    )
    best = Window.partitionBy("dataset", "query_id").orderBy(F.round("score", 12).desc(), "first")
    rows = rows.withColumn("rank", F.row_number().over(best)).withColumn("system", F.lit(name))
    if depth is not None:
        rows = rows.filter(F.col("rank") <= depth)
    return rows.select(*KEYS, "doc_id", "score", "rank")
