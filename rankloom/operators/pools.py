"""Rankings, candidate pools and abilities as sets: what is taken, joined, overlaid or left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.lineage import cut
from rankloom.operators.metrics import QUERY
from rankloom.operators.ranking import KEYS
from rankloom.operators.validate import duplicates


def selected(run: DataFrame, systems: list[str]) -> DataFrame:
    """The rows of some systems, with ``place``: where each stands in the list. An unknown one is a ValueError."""
    have = {r[0] for r in run.filter(F.col("system").isin(systems)).select("system").distinct().limit(len(systems)).collect()}
    if lost := [s for s in systems if s not in have]:
        raise ValueError(f"no rows of {lost}")
    return run.filter(F.col("system").isin(systems)).withColumn("place", F.array_position(F.array(*[F.lit(s) for s in systems]), F.col("system")))


def concat(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of several rankings; a document that a query ranks in two of them is a ValueError."""
    rows = first
    for other in others:
        rows = rows.unionByName(other)
    twice = duplicates(rows, [*KEYS, "doc_id"]).head(1)
    if twice:
        raise ValueError(f"ranked more than once: {twice[0].asDict()}")
    return rows


def of_dataset(run: DataFrame, dataset: str) -> DataFrame:
    """The rows that name a data set, else those that name none; neither is a ValueError."""
    for name in (dataset, ""):
        rows = run.filter(F.col("dataset") == name)
        if rows.head(1):
            return rows.withColumn("dataset", F.lit(dataset))
    raise ValueError(f"no rankings for {dataset!r}")


def depth(pools: DataFrame, k: int) -> DataFrame:
    """The first ``k`` candidates of each pool, in its order."""
    place = F.row_number().over(Window.partitionBy(*QUERY).orderBy("pos", "doc_id"))
    return pools.withColumn("place", place).filter(F.col("place") <= k)


def hydrated(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows with their documents' bodies and ``found``; see ``complete`` for the refusal of missing ones."""
    return rows.join(corpus.withColumn("found", F.lit(True)), "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def complete(rows: DataFrame) -> DataFrame:
    """Hydrated rows, once all of them have a body; else ValueError names one."""
    lost = rows.filter(~F.col("found")).head(1)
    if lost:
        raise ValueError(f"no such document: {lost[0]['doc_id']!r}")
    return rows.drop("found")


def ranking_shape(labels: DataFrame) -> DataFrame:
    """One row a query: its labelled documents in order, and their grades."""
    rows = labels.groupBy(*QUERY).agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id", "grade"))).alias("d"))
    return rows.select(*QUERY, F.col("d.doc_id").alias("doc_ids"), F.col("d.grade").alias("grades"))


def overlaid(base: DataFrame, *extensions: DataFrame) -> DataFrame:
    """Abilities with ``source``: the fit's own, and those of later extensions for documents that it lacks.

    ``base`` and each extension have (*QUERY, doc_id, theta, source); an extension of a document that is there already
    is a ValueError.
    """
    rows = base
    for more in extensions:
        rows = rows.unionByName(more)
    twice = duplicates(rows, [*QUERY, "doc_id"]).head(1)
    if twice:
        raise ValueError(f"an ability twice: {twice[0].asDict()}")
    return rows


def prior(thetas: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n, mean, sd): mean and population deviation of abilities; a deviation of zero is null."""
    rows = thetas.groupBy(*keys).agg(F.count("theta").alias("n"), F.avg("theta").alias("mean"), F.stddev_pop("theta").alias("sd"))
    return rows.withColumn("sd", F.nullif("sd", F.lit(0.0)))


def observed(placements: DataFrame, thetas: DataFrame) -> DataFrame:
    """(query_id, used, skipped): valid placements whose document has an ability, and those whose has none."""
    known = thetas.select("query_id", "doc_id").distinct().withColumn("known", F.lit(1))
    rows = placements.filter("valid").join(known, ["query_id", "doc_id"], "left")
    return rows.groupBy("query_id").agg(F.count("known").alias("used"), F.count_if(F.col("known").isNull()).alias("skipped"))


def never_compared(placements: DataFrame) -> DataFrame:
    """(query_id, doc_id) shown only in windows that compare nothing: invalid ones, or of one document; fitted queries only."""
    size = F.count("*").over(Window.partitionBy("record_id"))
    rows = placements.withColumn("backs", F.col("valid") & (size > 1))
    per = rows.groupBy("query_id", "doc_id").agg(F.bool_or("backs").alias("backed"))
    fitted = rows.filter("backs").select("query_id").distinct()
    return per.filter("NOT backed").join(fitted, "query_id", "left_semi").select("query_id", "doc_id")


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, node, component): the smallest node that ``edges(*keys, a, b)`` reach from each node, group by group.

    Every round a node takes the smallest label around it and then its label's label, so that rounds follow the
    logarithm of a component's length; lineage is cut each round.
    """
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    labels = both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component"))
    while True:
        labels = cut(labels)
        near = both.join(labels.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, [*keys, "node"]).select(*keys, "node", F.least("component", "near").alias("c"), F.col("component").alias("old"))
        jump = labels.select(*keys, F.col("node").alias("c"), F.col("component").alias("over"))
        new = cut(step.join(jump, [*keys, "c"], "left").select(*keys, "node", F.least("c", "over").alias("component"), "old"))
        if not new.filter("component <> old").head(1):
            return new.select(*keys, "node", "component")
        labels = new.select(*keys, "node", "component")
