"""Rank metrics of every (system, dataset, query), all cutoffs in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ranking import KEYS, discount, ranked

QUERY = ("dataset", "query_id")


def ideal(labels: DataFrame, ks: list[int]) -> DataFrame:
    """(dataset, query_id, positives, ideal_k...): the best sum of discounted gains of the whole labelled set."""
    order = Window.partitionBy(*QUERY).orderBy(F.col("gain").desc())
    rows = labels.withColumn("rank", F.row_number().over(order))
    part = F.col("gain") / discount(F.col("rank"))
    return rows.groupBy(*QUERY).agg(
        F.count_if(F.col("grade") > 0).alias("positives"),
        *[F.coalesce(F.sum(F.when(F.col("rank") <= k, part)), F.lit(0.0)).alias(f"ideal_{k}") for k in ks],
    )


def labelled(run: DataFrame, labels: DataFrame) -> DataFrame:
    """The run with each document's gain and grade; a document without a label has 0."""
    known = labels.select(*QUERY, "doc_id", "gain", "grade")
    rows = run.join(known, [*QUERY, "doc_id"], "left")
    return rows.withColumn("gain", F.coalesce("gain", F.lit(0.0))).withColumn("relevant", F.coalesce((F.col("grade") > 0).cast("int"), F.lit(0)))


def _cutoff(ks: list[int], of) -> list[Column]:
    return [of(k) for k in ks]


def ndcg(run: DataFrame, labels: DataFrame, ks: list[int], ties: str = "group_mean") -> DataFrame:
    """(*KEYS, k, dcg, idcg, ndcg) of every ranked query; 0 where the ideal is 0."""
    rows = ranked(labelled(run, labels), ties)
    part = F.col("gain") / discount(F.col("rank"))
    sums = rows.groupBy(*KEYS).agg(*_cutoff(ks, lambda k: F.coalesce(F.sum(F.when(F.col("rank") <= k, part)), F.lit(0.0)).alias(f"dcg_{k}")))
    both = sums.join(ideal(labels, ks), list(QUERY))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"dcg_{k}").alias("dcg"), F.col(f"ideal_{k}").alias("idcg")) for k in ks])
    out = both.select(*KEYS, F.inline(cells))
    return out.withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)))


def classic(run: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(*KEYS, positives, map, recall, precision, success, mrr, recall_cap) at ``k`` of every ranked query.

    Reciprocal rank and capped recall break ties as the rows came, the rest by doc_id descending. Queries without a
    positive label have null recall and average precision.
    """
    rows = labelled(run, labels)
    by_id = ranked(rows, "doc_id_desc").withColumnRenamed("rank", "by_id")
    by_id = by_id.withColumn("hits", F.sum("relevant").over(_running()))
    both = by_id.withColumn("by_pos", F.row_number().over(_by_pos()))
    near, first = F.col("by_id") <= k, F.col("by_pos") <= k
    sums = both.groupBy(*KEYS).agg(
        F.coalesce(F.sum(F.when(near & (F.col("relevant") == 1), F.col("hits") / F.col("by_id"))), F.lit(0.0)).alias("precisions"),
        F.sum(F.when(near, F.col("relevant")).otherwise(0)).alias("found"),
        F.min(F.when(first & (F.col("relevant") == 1), F.col("by_pos"))).alias("first"),
        F.sum(F.when(first, F.col("relevant")).otherwise(0)).alias("found_first"),
    )
    out = sums.join(ideal(labels, [k]), list(QUERY))
    positives = F.col("positives")
    return out.select(
        *KEYS, "positives",
        F.try_divide("precisions", positives).alias("map"), F.try_divide("found", positives).alias("recall"),
        (F.col("found") / F.lit(float(k))).alias("precision"), (F.col("found") > 0).cast("double").alias("success"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.try_divide("found_first", F.least(positives, F.lit(k))).alias("recall_cap"),
    )


def _running() -> Window:
    return Window.partitionBy(*KEYS).orderBy("by_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _by_pos() -> Window:
    return Window.partitionBy(*KEYS).orderBy(F.col("score").desc(), F.col("pos").asc())


def with_unranked(per_query: DataFrame, labels: DataFrame, systems: list[str], value: str) -> DataFrame:
    """Every labelled query for every system; a query that a system did not rank counts 0."""
    queries = labels.select(*QUERY).distinct().withColumn("system", F.explode(F.array(*[F.lit(s) for s in systems])))
    return queries.join(per_query.select(*KEYS, value), list(KEYS), "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def two_level_mean(per_query: DataFrame, value: str) -> DataFrame:
    """(system, value, queries, datasets): the unweighted mean of the datasets' means; nulls leave both."""
    inner = per_query.groupBy("system", "dataset").agg(F.avg(value).alias(value), F.count(value).alias("queries"))
    return inner.groupBy("system").agg(F.avg(value).alias(value), F.sum("queries").alias("queries"), F.count(value).alias("datasets"))


def leaderboard(per_query: DataFrame, datasets: list[str], value: str) -> DataFrame:
    """One row a system: its mean in each dataset, and their mean, the best first."""
    inner = per_query.groupBy("system", "dataset").agg(F.avg(value).alias(value))
    wide = inner.groupBy("system").agg(*[F.max(F.when(F.col("dataset") == d, F.col(value))).alias(d) for d in datasets], F.avg(value).alias("mean"))
    return wide.orderBy(F.col("mean").desc(), "system")


def holes(run: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(*KEYS, hole): share of the top ``k`` that no query has ever labelled."""
    seen = labels.select("doc_id").distinct().withColumn("seen", F.lit(1))
    rows = ranked(run, "doc_id_desc").filter(F.col("rank") <= k).join(seen, "doc_id", "left")
    return rows.groupBy(*KEYS).agg((F.count_if(F.col("seen").isNull()) / F.lit(float(k))).alias("hole"))


def paired_accuracy(run: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """(system, dataset, accuracy, pairs) over ``groups(dataset, query_id, group_id)`` of exactly two queries.

    A pair counts when each query scores its own first positive document strictly above the other's; a document that
    a system did not score stands below all.
    """
    first = labels.filter("grade > 0").groupBy(*QUERY).agg(F.min_by("doc_id", "pos").alias("own"))
    rows = groups.join(first, list(QUERY))
    two = rows.groupBy("dataset", "group_id").agg(F.min(F.struct("query_id", "own")).alias("a"), F.max(F.struct("query_id", "own")).alias("b"), F.count("*").alias("n")).filter("n = 2")
    asked = two.select("dataset", "group_id", F.inline(F.array(
        F.struct(F.col("a.query_id").alias("query_id"), F.col("a.own").alias("own"), F.col("b.own").alias("other")),
        F.struct(F.col("b.query_id").alias("query_id"), F.col("b.own").alias("own"), F.col("a.own").alias("other")),
    )))
    wanted = asked.select("dataset", "group_id", "query_id", F.inline(F.array(
        F.struct(F.col("own").alias("doc_id"), F.lit(1).alias("mine")), F.struct(F.col("other").alias("doc_id"), F.lit(0).alias("mine"))
    )))
    systems = run.select("system", "dataset").distinct()
    cells = wanted.join(systems, "dataset").join(run.select(*KEYS, "doc_id", "score"), [*KEYS, "doc_id"], "left")
    low = F.lit(float("-inf"))
    sides = cells.groupBy("system", "dataset", "group_id", "query_id").agg(
        F.coalesce(F.max(F.when(F.col("mine") == 1, F.col("score"))), low).alias("own"), F.coalesce(F.max(F.when(F.col("mine") == 0, F.col("score"))), low).alias("other")
    )
    pairs = sides.groupBy("system", "dataset", "group_id").agg(F.bool_and(F.col("own") > F.col("other")).alias("both"))
    return pairs.groupBy("system", "dataset").agg(F.avg(F.col("both").cast("double")).alias("accuracy"), F.count("*").alias("pairs"))


def coverage(answers: DataFrame, threshold: float) -> DataFrame:
    """(system, dataset, coverage): share of answers whose probability ``p`` reaches the threshold."""
    return answers.groupBy("system", "dataset").agg(F.avg((F.col("p") >= threshold).cast("double")).alias("coverage"))


#: Metrics of ``classic`` by name; others are added by ``register``.
METRICS = {name: (lambda run, labels, k, name=name: classic(run, labels, k).select(*KEYS, F.col(name).alias("value"))) for name in ("map", "recall", "precision", "success", "mrr", "recall_cap")}
METRICS["ndcg"] = lambda run, labels, k: ndcg(run, labels, [k]).select(*KEYS, F.col("ndcg").alias("value"))
METRICS["hole"] = lambda run, labels, k: holes(run, labels, k).select(*KEYS, F.col("hole").alias("value"))


def register(name: str, metric) -> None:
    """Adds a metric: a function of (run, labels, k) that gives (*KEYS, value). A name that is taken is a ValueError."""
    if name in METRICS:
        raise ValueError(f"there is a metric {name!r}")
    METRICS[name] = metric


def by_name(run: DataFrame, labels: DataFrame, names: list[str], k: int) -> DataFrame:
    """(*KEYS, metric, value) of the named metrics; those of ``classic`` come from one pass."""
    if unknown := [n for n in names if n not in METRICS]:
        raise ValueError(f"no metric {unknown}")
    shared = [n for n in names if n in ("map", "recall", "precision", "success", "mrr", "recall_cap")]
    parts = [METRICS[n](run, labels, k).withColumn("metric", F.lit(n)).select(*KEYS, "metric", "value") for n in names if n not in shared]
    if shared:
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in shared])
        parts.append(classic(run, labels, k).select(*KEYS, F.inline(cells)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
