"""Judged windows: comparisons, pooling, coverage, deduplication, reliability and abilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import gains


def comparisons(placements: DataFrame) -> DataFrame:
    """(record_id, query_id, winner, loser, weight, soft_label): the pairs of each window of two or more documents.

    The higher score wins, of equal ones the earlier position. A window's pairs weigh 2 / documents; the label is the
    logistic of the gap, kept within 0.01 and 0.99.
    """
    rows = placements.groupBy("record_id", "query_id").agg(F.array_sort(F.collect_list(F.struct("position", "doc_id", "score"))).alias("docs"))
    two = F.flatten(F.transform("docs", lambda x: F.transform(F.filter("docs", lambda y: y["position"] > x["position"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = rows.select("record_id", "query_id", F.size("docs").alias("n"), F.explode(two).alias("p"))
    gap = F.col("p.x.score") - F.col("p.y.score")
    first = gap >= 0
    return pairs.select(
        "record_id", "query_id", F.when(first, F.col("p.x.doc_id")).otherwise(F.col("p.y.doc_id")).alias("winner"),
        F.when(first, F.col("p.y.doc_id")).otherwise(F.col("p.x.doc_id")).alias("loser"), (F.lit(2.0) / F.col("n")).alias("weight"),
        F.least(F.greatest(gains.sigmoid(F.abs(gap)), F.lit(0.01)), F.lit(0.99)).alias("soft_label"),
    )


def summed(pairs: DataFrame) -> DataFrame:
    """(query_id, winner, loser, weight, soft_label, comparisons): comparisons of one pair of documents as one, with its weight and mean label."""
    sums = pairs.groupBy("query_id", "winner", "loser").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("soft_label")).alias("wy"), F.count("*").alias("comparisons"))
    return sums.select("query_id", "winner", "loser", "weight", F.try_divide("wy", "weight").alias("soft_label"), "comparisons")


def count_gain(placements: DataFrame, criteria: list[str]) -> DataFrame:
    """(query_id, doc_id, windows, gain): passed criteria of all valid windows over criteria times windows."""
    passed = sum((F.col(c) for c in criteria[1:]), F.col(criteria[0]))
    return placements.filter("valid").groupBy("query_id", "doc_id").agg(
        F.count("*").alias("windows"), (F.sum(passed) / (F.lit(float(len(criteria))) * F.count("*"))).alias("gain")
    )


def or_pooled(placements: DataFrame, criteria: list[str], doc) -> DataFrame:
    """(record_id, doc_id, criteria...): a document passes what any of its chunks in the window passes."""
    return placements.groupBy("record_id", doc.alias("document")).agg(*[F.max(c).alias(c) for c in criteria])


def max_pooled(run: DataFrame, doc, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, document, score, pos): a document scores as its best chunk and stands where its first one does."""
    return run.groupBy(*keys, doc.alias("document")).agg(F.max("score").alias("score"), F.min("pos").alias("pos"))


def window_coverage(log: DataFrame) -> DataFrame:
    """(query_id, phase, windows, invalid, share)."""
    return log.groupBy("query_id", "phase").agg(
        F.count("*").alias("windows"), F.count_if(~F.col("valid")).alias("invalid"), F.avg((~F.col("valid")).cast("double")).alias("share")
    )


def coverage_flags(coverage: DataFrame, share: float = 0.05) -> DataFrame:
    """Rows with too large a share of invalid windows, or any invalid adaptive one."""
    return coverage.filter((F.col("share") > share) | ((F.col("phase") == "adaptive") & (F.col("invalid") > 0)))


def latest(log: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """One line a key, where no line is a tombstone: valid before invalid, then the later, then the last."""
    order = Window.partitionBy(*keys).orderBy(F.col("valid").desc(), F.col("recorded_at").desc(), *[F.col(t).desc() for t in ties])
    return log.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def judge_overlap(placements: DataFrame) -> DataFrame:
    """(judge_a, judge_b, shared): items that two judges both saw."""
    seen = placements.select("judge", "query_id", "doc_id").distinct()
    a, b = seen.withColumnRenamed("judge", "judge_a"), seen.withColumnRenamed("judge", "judge_b")
    return a.join(b, ["query_id", "doc_id"]).filter("judge_a < judge_b").groupBy("judge_a", "judge_b").agg(F.count("*").alias("shared"))


def binned(rows: DataFrame, p: str, hit: str, edges: list[float]) -> DataFrame:
    """Rows with ``bin``: the inner edges at or below the probability, counted."""
    at = F.lit(0)
    for e in edges:
        at = at + (F.col(p) >= F.lit(e)).cast("int")
    return rows.select("*", at.alias("bin"), F.col(p).alias("p_"), F.col(hit).cast("double").alias("y_"))


def reliability(rows: DataFrame, p: str, hit: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate): ten equal bins of the probability; empty ones are kept with nulls."""
    edges = [i / bins for i in range(1, bins)]
    sums = binned(rows, p, hit, edges).groupBy("bin").agg(F.count("*").alias("n"), F.avg("p_").alias("mean_p"), F.avg("y_").alias("rate"))
    every = sums.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(sums, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(curve: DataFrame) -> DataFrame:
    """Expected calibration error of a reliability curve."""
    gap = F.abs(F.col("mean_p") - F.col("rate")) * F.col("n")
    return curve.agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def patterns(placements: DataFrame, criteria: list[str]) -> DataFrame:
    """(query_id, doc_id, n, s...): windows and passes of each criterion: all that an ability depends on."""
    return placements.filter("valid").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i + 1}") for i, c in enumerate(criteria)])


def eap(rows: DataFrame, gamma: list[float], beta: list[float], mean: float = 0.0, sd: float = 1.0, low: float = -18.0, high: float = 10.0, points: int = 561) -> DataFrame:
    """Patterns with ``theta`` and ``se``: mean and deviation of the ability given the passes, under a normal prior.

    Each batch's distinct patterns are integrated over the grid where they are: nothing is exploded, shuffled or joined.
    """
    s = [f"s{i + 1}" for i in range(len(gamma))]
    grid = np.linspace(low, high, points)
    logit = np.array(gamma)[:, None] * (grid - np.array(beta)[:, None])
    yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    prior = -(((grid - mean) / sd) ** 2) / 2
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([batch.column(columns.index(c)).to_numpy().astype(float) for c in ("n", *s)], axis=1)
            kinds, of = np.unique(table, axis=0, return_inverse=True)
            theta, se = np.empty(len(kinds)), np.empty(len(kinds))
            for a in range(0, len(kinds), 1024):
                n, passed = kinds[a : a + 1024, :1], kinds[a : a + 1024, 1:]
                log = passed @ yes + (n - passed) @ no + prior
                w = np.exp(log - log.max(1, keepdims=True))
                w /= w.sum(1, keepdims=True)
                theta[a : a + 1024] = w @ grid
                se[a : a + 1024] = np.sqrt(np.maximum(w @ (grid * grid) - theta[a : a + 1024] ** 2, 0))
            of = of.reshape(-1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(theta[of]), pa.array(se[of])], names=[*columns, "theta", "se"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, theta double, se double")


def boundary_values(thetas: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbours in order of ability with p (1 - p) / log2(place + 1): how much a comparison of them would tell."""
    order = Window.partitionBy(*keys).orderBy(F.col("theta").desc(), "doc_id")
    rows = thetas.withColumn("place", F.row_number().over(order)).withColumn("below", F.lead("theta").over(order))
    p = gains.sigmoid(F.col("theta") - F.col("below"))
    return rows.filter("below IS NOT NULL").withColumn("value", p * (1 - p) / F.log2(F.col("place") + 1))


def quantile_bins(thetas: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Rows with ``bin``: equal shares of the order by ability, the remainder spread over the bins."""
    order = Window.partitionBy(*keys).orderBy(F.col("theta").desc(), "doc_id")
    n = F.count("*").over(Window.partitionBy(*keys))
    return thetas.withColumn("bin", F.floor((F.row_number().over(order) - 1) * F.lit(bins) / n).cast("long"))


def schedule_sizes(pools: DataFrame, window: int = 10, random: float = 3.5, stratified: float = 1.8, adaptive: int = 7) -> DataFrame:
    """(dataset, query_id, units, random, stratified, adaptive): windows of each kind, rounded half to even."""
    sizes = pools.groupBy("dataset", "query_id").agg(F.count("*").alias("units"))
    shape = lambda x: F.bround(F.lit(x) * F.col("units") / F.lit(float(window))).cast("long")
    return sizes.select("dataset", "query_id", "units", shape(random).alias("random"), shape(stratified).alias("stratified"), F.least(F.lit(adaptive).cast("long"), F.col("units")).alias("adaptive"))


def superseded(log: DataFrame, keys: list[str], within_store: bool = False) -> DataFrame:
    """(*keys, line): the line of each key that stands, from ``log(*keys, pos, record_id, valid, tombstone, recorded_at)``.

    Lines are folded in store order. Valid beats invalid, then the later time, and the new line wins a tie. Where either
    is a tombstone only time decides, or, within one store, the place in it: the rule is cyclic, so no ordering
    of the lines can stand for the fold. A key has few lines; its lines are what one row's array holds.
    """
    line = F.struct("pos", "record_id", "valid", "tombstone", "recorded_at")
    rows = log.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("lines"))

    def stands(old, new):
        marked = F.lit(True) if within_store else new["recorded_at"] >= old["recorded_at"]
        plain = F.when(old["valid"] != new["valid"], new["valid"]).otherwise(new["recorded_at"] >= old["recorded_at"])
        return F.when(F.when(old["tombstone"] | new["tombstone"], marked).otherwise(plain), new).otherwise(old)

    return rows.select(*keys, F.reduce(F.slice("lines", 2, F.size("lines")), F.get("lines", F.lit(0)), stands).alias("line"))


def window_coverage_split(log: DataFrame) -> DataFrame:
    """(query_id, windows, invalid, share, by_phase, by_judge): invalid windows of each query, in all and by kind as ``name=n``.

    Lines marked as tombstones count for nothing.
    """
    rows = log.filter(~F.coalesce(F.col("tombstone"), F.lit(False))) if "tombstone" in log.columns else log
    out = rows.groupBy("query_id").agg(F.count("*").alias("windows"), F.count_if(~F.col("valid")).alias("invalid"))
    for kind in ("phase", "judge"):
        per = rows.filter(~F.col("valid")).groupBy("query_id", kind).agg(F.count("*").alias("n"))
        line = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", kind, F.col("n").cast("string")))), ",")
        out = out.join(per.groupBy("query_id").agg(line.alias(f"by_{kind}")), "query_id", "left").withColumn(f"by_{kind}", F.coalesce(f"by_{kind}", F.lit("")))
    return out.withColumn("share", F.col("invalid") / F.col("windows"))
