"""Which documents are judged together: sizes of a schedule, tiers of like ability, windows that tell most."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import gains
from rankloom.operators.metrics import QUERY


def rubric_sizes(pools: DataFrame, window: int = 10, placements: float = 1000 / 150, random_share: float = 0.5) -> DataFrame:
    """(*QUERY, units, random, stratified, uncovered): windows of a rubric, every unit seen; rounded half to even.

    ``uncovered`` is what the random windows alone cannot show.
    """
    sizes = pools.groupBy(*QUERY).agg(F.count("*").alias("units"))
    w = F.least(F.lit(window), F.col("units"))
    total = F.greatest(F.ceil(F.col("units") / w), F.bround(F.lit(placements) * F.col("units") / w).cast("long"))
    random = F.least(total, F.greatest(F.lit(1).cast("long"), F.bround(F.lit(random_share) * total).cast("long")))
    rows = sizes.withColumn("random", random).withColumn("stratified", total - F.col("random"))
    return rows.withColumn("uncovered", F.greatest(F.lit(0).cast("long"), F.col("units") - F.col("random") * w))


def cost(sizes: DataFrame, rounds: int = 7, per_round: int = 8, seconds: float = 20.0) -> DataFrame:
    """(dataset, queries, calls, seconds) of ``sizes(random, stratified)``: both kinds are judged in two orders."""
    calls = 2 * (F.col("random") + F.col("stratified")) + F.lit(rounds * per_round)
    rows = sizes.groupBy("dataset").agg(F.count("*").alias("queries"), F.sum(calls).alias("calls"))
    return rows.withColumn("seconds", F.col("calls") * F.lit(seconds))


def observed_values(thetas: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """(query_id, doc_id, below, place, value) of neighbours among the ``top``: what one more comparison of them tells.

    p (1 - p) / log2(place + 1) / (1 + n), n the comparisons in ``pairs(query_id, a, b, n)``, a < b.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("theta").desc(), "doc_id")
    rows = thetas.withColumn("place", F.row_number().over(order)).withColumn("below", F.lead("doc_id").over(order)).withColumn("low", F.lead("theta").over(order))
    rows = rows.filter((F.col("place") < top) & F.col("below").isNotNull())
    rows = rows.withColumn("a", F.least("doc_id", "below")).withColumn("b", F.greatest("doc_id", "below")).join(pairs, ["query_id", "a", "b"], "left")
    p = gains.sigmoid(F.col("theta") - F.col("low"))
    value = p * (1 - p) / F.log2(F.col("place") + 1) / (1 + F.coalesce("n", F.lit(0)))
    return rows.select("query_id", "doc_id", "below", "place", value.alias("value"))


def best_windows(values: np.ndarray, window: int, count: int, overlap: float) -> list[int]:
    """Starts of windows over a sorted order by the largest sum of the boundaries inside; covered ones count less after."""
    if window > len(values):
        return [0][:count]
    values, out = values.astype(float).copy(), []
    for _ in range(count):
        sums = np.lib.stride_tricks.sliding_window_view(values, window - 1).sum(1) if window > 1 else np.zeros(len(values) + 1)
        start = int(sums.argmax())
        if sums[start] <= 0:
            break
        out.append(start)
        values[start : start + window - 1] *= overlap
    return out


def least_covered(n: int, window: int, count: int) -> list[int]:
    """Starts of windows over a sorted order, each where the least has been shown so far, of equal ones the first."""
    window, seen, out = min(window, n), np.zeros(n), []
    for _ in range(count):
        start = int(np.lib.stride_tricks.sliding_window_view(seen, window).sum(1).argmin())
        seen[start : start + window] += 1
        out.append(start)
    return out


_WINDOWS = "query_id string, window long, position long, doc_id string"


def _laid_out(frame: pd.DataFrame, starts: list[int], window: int, shuffle: int | None) -> pd.DataFrame:
    rows = []
    for w, start in enumerate(starts):
        docs = frame["doc_id"].to_numpy()[start : start + window]
        if shuffle is not None:
            docs = np.random.default_rng((shuffle, w, *frame["query_id"].iloc[0].encode())).permutation(docs)
        rows += [(frame["query_id"].iloc[0], w, k, d) for k, d in enumerate(docs)]
    return pd.DataFrame(rows, columns=["query_id", "window", "position", "doc_id"])


def adaptive_windows(values: DataFrame, window: int, count: int, overlap: float = 0.3) -> DataFrame:
    """(query_id, window, position, doc_id): for each query the windows of its order that tell most; see ``best_windows``.

    ``values(query_id, doc_id, below, place, value)`` are a query's boundaries; a pool is what one row group holds.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        docs = pd.DataFrame({"query_id": frame["query_id"].iloc[0], "doc_id": [*frame["doc_id"], frame["below"].iloc[-1]]})
        return _laid_out(docs, best_windows(frame["value"].to_numpy(), window, count, overlap), window, None)

    return values.groupBy("query_id").applyInPandas(run, _WINDOWS)


def stratified_groups(thetas: DataFrame, window: int, count: int, seed: int = 42) -> DataFrame:
    """(query_id, window, position, doc_id): groups of neighbours in ability, shown about equally often, in shuffled order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["theta", "doc_id"], ascending=[False, True])
        return _laid_out(frame, least_covered(len(frame), window, count), window, seed)

    return thetas.select("query_id", "doc_id", "theta").groupBy("query_id").applyInPandas(run, _WINDOWS)
