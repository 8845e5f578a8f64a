"""One report of an evaluation: means with intervals, and every two systems against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import compare
from rankloom.operators.lineage import cut

CELL = ["system", "metric", "k"]


def _interval(rows: DataFrame, keys: list[str], value: str, draws: int, seed: int, level: float) -> DataFrame:
    """(*keys, ci_low, ci_high) of the mean of dataset means, queries drawn n of n within datasets."""
    named = rows.select(F.to_json(F.struct(*keys)).alias("system"), "dataset", "query_id", F.col(value).alias("value"))
    found = compare.bootstrap(named, "value", draws, level, seed)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return found.select(F.from_json("system", kinds).alias("c"), F.col("low").alias("ci_low"), F.col("high").alias("ci_high")).select("c.*", "ci_low", "ci_high")


def summary(values: DataFrame, draws: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(system, metric, k, dataset, value, ci_low, ci_high, num_queries, num_datasets) of ``values(system, metric, k, dataset, query_id, value)``.

    A row a data set with the mean of its defined values, and with a null dataset the mean of those means, its
    percentile interval (none without ``draws``), and how many queries and data sets are in it. A data set without a
    defined value stays, with a null mean, and is not in the other row's mean; a system without any has null there.
    """
    rows = values.select(*CELL, "dataset", "query_id", F.col("value").cast("double").alias("value"))
    inner = rows.groupBy(*CELL, "dataset").agg(F.avg("value").alias("value"), F.count("value").alias("num_queries"))
    outer = inner.groupBy(*CELL).agg(F.avg("value").alias("value"), F.sum("num_queries").alias("num_queries"), F.count("value").alias("num_datasets"))
    none = F.lit(None).cast("double")
    if draws:
        ci = _interval(rows, CELL, "value", draws, seed, level)
        outer = outer.join(ci, CELL, "left")
    else:
        outer = outer.withColumns({"ci_low": none, "ci_high": none})
    inner = inner.select("*", none.alias("ci_low"), none.alias("ci_high"), F.col("value").isNotNull().cast("long").alias("num_datasets"))
    order = [*CELL, "dataset", "value", "ci_low", "ci_high", "num_queries", "num_datasets"]
    return inner.select(*order).unionByName(outer.withColumn("dataset", F.lit(None).cast("string")).select(*order))


def comparison(values: DataFrame, baseline: str | None = None, alpha: float = 0.05, draws: int = 10_000, seed: int = 0, flips: DataFrame | None = None) -> DataFrame:
    """(a, b, value_a, value_b, delta, ci_low, ci_high, t, p, significant, num_queries, sign_flips) of every two systems.

    ``values(system, dataset, query_id, value)`` of one metric; pairs are taken in the systems' order by name, or with
    ``baseline`` each other system against it. Values are means of dataset means over the queries that both have; t and
    p are a paired test over all of them, null where there are fewer than two or all differences are alike, and then
    nothing is significant; the interval resamples each data set's differences. ``sign_flips`` counts the queries where
    the values of ``flips`` (another metric, laid out alike) prefer the other system; null without it. Refused: fewer
    than two systems, a baseline that is none of them, and two systems without a query in common.
    """
    # read by five jobs, and few beside the rankings that they come from
    rows = cut(values.filter("value IS NOT NULL").select("system", "dataset", "query_id", F.col("value").cast("double").alias("value")))
    systems = [r.system for r in rows.select("system").distinct().orderBy("system").limit(10_000).collect()]
    if len(systems) < 2 or baseline is not None and baseline not in systems:
        raise ValueError(f"a comparison needs two systems{'' if baseline is None else f' and {baseline!r} among them'}; there are {systems[:10]}")
    a = rows.select("dataset", "query_id", F.col("system").alias("a"), F.col("value").alias("va"))
    b = rows.select("dataset", "query_id", F.col("system").alias("b"), F.col("value").alias("vb"))
    if baseline is not None:
        both = a.filter(F.col("a") == baseline).join(b.filter(F.col("b") != baseline), ["dataset", "query_id"])
        expected = len(systems) - 1
    else:
        both = a.join(b, ["dataset", "query_id"]).filter("a < b")
        expected = len(systems) * (len(systems) - 1) // 2
    both = both.withColumn("delta", F.col("vb") - F.col("va"))
    inner = both.groupBy("a", "b", "dataset").agg(F.avg("va").alias("va"), F.avg("vb").alias("vb"), F.count("*").alias("n"))
    out = inner.groupBy("a", "b").agg(F.avg("va").alias("value_a"), F.avg("vb").alias("value_b"), F.sum("n").alias("num_queries")).withColumn("delta", F.col("value_b") - F.col("value_a"))
    if out.count() < expected:
        raise ValueError("two of the systems share no scored query")
    tests = compare.with_p(compare.paired_t(both)).select("a", "b", "t", "p")
    out = out.join(tests, ["a", "b"]).withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))
    none = F.lit(None).cast("double")
    out = out.join(_interval(both, ["a", "b"], "delta", draws, seed, 1 - alpha), ["a", "b"]) if draws else out.withColumns({"ci_low": none, "ci_high": none})
    if flips is None:
        out = out.withColumn("sign_flips", F.lit(None).cast("long"))
    else:
        other = cut(flips.filter("value IS NOT NULL").select("dataset", "query_id", "system", "value"))
        x, y = other.select("dataset", "query_id", F.col("system").alias("a"), F.col("value").alias("oa")), other.select("dataset", "query_id", F.col("system").alias("b"), F.col("value").alias("ob"))
        turned = both.join(x, ["dataset", "query_id", "a"]).join(y, ["dataset", "query_id", "b"]).filter(F.col("delta") * (F.col("ob") - F.col("oa")) < 0)
        out = out.join(turned.groupBy("a", "b").agg(F.count("*").alias("sign_flips")), ["a", "b"], "left").withColumn("sign_flips", F.coalesce("sign_flips", F.lit(0).cast("long")))
    return out.select("a", "b", "value_a", "value_b", "delta", "ci_low", "ci_high", "t", "p", "significant", "num_queries", "sign_flips")
