"""Abilities of documents: items by marginal likelihood, documents scored from their verdicts, documents put into a tournament."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import gains
from rankloom.operators.joint import _vector_sum
from rankloom.operators.lineage import cut
from rankloom.operators.pools import components

#: The grid of abilities, the bounds of a discrimination, and when a fit is refused or only ordinal.
GRID = (-18.0, 10.0, 561)
GAMMA_BOUNDS = (0.05, 20.0)
MAX_ITEM_WEIGHT = 0.90
MIN_PASSING_ANY = 0.02
SE_TARGET = 0.5
THETA_BOUND = 20.0
MIN_OPPONENTS = 5
#: Documents whose posteriors a worker holds at a time.
CHUNK = 1024


def _log_likelihood(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the chance of passing and of failing."""
    return -np.logaddexp(0, -logit), -np.logaddexp(0, logit)


def _marginal(slope: np.ndarray, level: np.ndarray):
    """By batch of patterns (count, n, s...): the marginal log likelihood with its slopes and bends in (slope, level) of each item."""
    k = len(slope)
    grid = np.linspace(*GRID)
    prior = -grid * grid / 2
    prior -= np.log(np.exp(prior).sum())
    yes, no = _log_likelihood(slope[:, None] * grid + level[:, None])
    p = np.exp(yes)
    powers = np.stack((grid, np.ones_like(grid)))  # what a logit moves by with its slope and its level
    turned = (p[:, None, :] * powers).reshape(2 * k, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, first, second = 0.0, np.zeros(2 * k), np.zeros((2 * k, 2 * k))
        for batch in batches:
            table = np.stack([c.to_numpy().astype(float) for c in batch.columns], axis=1)
            for a in range(0, len(table), CHUNK):
                count, n, s = table[a : a + CHUNK, 0], table[a : a + CHUNK, 1], table[a : a + CHUNK, 2:]
                log = s @ yes + (n[:, None] - s) @ no + prior
                top = log.max(1)
                w = np.exp(log - top[:, None])
                total = w.sum(1)
                w /= total[:, None]
                value += (count * (np.log(total) + top)).sum()
                moments = w @ powers.T
                mean = (s[:, :, None] * moments[:, None, :]).reshape(len(s), -1) - n[:, None] * (w @ turned.T)
                first += count @ mean
                cw = w * count[:, None]
                tried, squared = n @ cw, (n * n) @ cw
                passed, mixed = s.T @ cw, (s * n[:, None]).T @ cw
                for i in range(k):
                    both = (s * s[:, i : i + 1]).T @ cw  # by item and grid point
                    kernel = both - p[i] * mixed - p * mixed[i] + p[i] * p * squared
                    kernel[i] -= tried * p[i] * (1 - p[i])
                    for x in range(2):
                        second[2 * i + x] += (kernel @ (powers[x] * powers).T).ravel()
                second -= (mean * count[:, None]).T @ mean
        yield pa.RecordBatch.from_arrays([pa.array([[value, *first, *second.ravel()]], pa.list_(pa.float64()))], names=["total"])

    return run


@dataclass(frozen=True)
class RubricFit:
    """Items on the common scale (gamma sums to the criteria, beta to 0), and the prior of abilities there."""

    gamma: list[float]
    beta: list[float]
    mean: float
    sd: float
    log_likelihood: float
    rounds: int
    documents: int
    max_item_weight: float
    passing_any: float
    #: Why the gains are no calibrated chances; empty if they are.
    ordinal: list[str] = field(default_factory=list)


def rubric_2pl(patterns: DataFrame, criteria: int, ability_sd: float = 1.0, rounds: int = 60, tolerance: float = 1e-10) -> RubricFit:
    """Items by marginal maximum likelihood over a fixed grid of abilities, with a normal prior.

    ``patterns(n, s1...)`` has a document's windows and passes by criterion. Documents fold into distinct patterns,
    which stay a table: a round adds up, partition by partition, the likelihood with its slopes and bends in the items
    (2 K + 4 K^2 numbers), and only that sum reaches the driver for Newton's step. A step that lowers the likelihood is
    halved; discriminations stay within GAMMA_BOUNDS. Refused: no documents, and fits in which one criterion takes more
    than MAX_ITEM_WEIGHT of the weight. Any order and partitioning of the rows gives the same items.
    """
    s = [f"s{i + 1}" for i in range(criteria)]
    kinds = cut(patterns.groupBy("n", *s).agg(F.count("*").alias("count")).select("count", "n", *s))
    some = F.greatest(*s) > 0 if criteria > 1 else F.col(s[0]) > 0
    sums = kinds.agg(F.sum("count").alias("docs"), F.sum(F.when(some, F.col("count")).otherwise(0)).alias("some"), F.sum(F.col("count") * F.col("n")).alias("n"), *[F.sum(F.col("count") * F.col(c)).alias(c) for c in s]).first()
    if not sums.docs:
        raise ValueError("no documents to fit items to")
    rate = np.clip(np.array([sums[c] for c in s], float) / sums.n, 1e-3, 1 - 1e-3)
    slope, level = np.ones(criteria), np.log(rate / (1 - rate))
    best, scale, move = None, 1.0, None
    for turn in range(1, rounds + 1):
        total = _vector_sum(kinds.mapInArrow(_marginal(slope, level), "total array<double>"), "total")
        if best is not None and not total[0] >= best[0] - 1e-12 * abs(best[0]):
            scale /= 2
            if scale < 1e-8:
                slope, level = best[1], best[2]
                break
        else:
            best, scale = (total[0], slope, level), 1.0
            g, h = total[1 : 1 + 2 * criteria], -total[1 + 2 * criteria :].reshape(2 * criteria, -1)
            held = np.zeros(2 * criteria, bool)
            held[::2] = ((slope <= GAMMA_BOUNDS[0]) & (g[::2] < 0)) | ((slope >= GAMMA_BOUNDS[1]) & (g[::2] > 0))
            free = ~held
            inner = h[np.ix_(free, free)]
            low = np.linalg.eigvalsh(inner)[0]
            if low <= 1e-10 * np.abs(inner).max():
                inner = inner + (1e-4 * np.abs(inner).max() - min(low, 0)) * np.eye(free.sum())
            move = np.zeros(2 * criteria)
            move[free] = np.linalg.solve(inner, g[free])
            scale = min(1.0, 2 / max(np.abs(move).max(), 1e-300))
            if g[free] @ move[free] <= tolerance * max(1.0, abs(total[0])) and np.abs(move).max() < 1e-7:
                break
        slope = np.clip(best[1] + scale * move[::2], *GAMMA_BOUNDS)
        level = best[2] + scale * move[1::2]
    slope, level = best[1], best[2]
    gamma, beta = slope / ability_sd, -level / slope * ability_sd
    weight = float((gamma / gamma.sum()).max())
    if weight > MAX_ITEM_WEIGHT:
        raise ValueError(f"criterion C{int(gamma.argmax()) + 1} takes {weight:.4f} of the weight: its passes do not identify a discrimination")
    ordinal = []
    if (slope >= GAMMA_BOUNDS[1] * 0.999).all():
        ordinal.append("every discrimination is at its bound")
    if sums.some / sums.docs < MIN_PASSING_ANY:
        ordinal.append(f"only {sums.some / sums.docs:.4f} of the documents pass any criterion")
    unit = float(gamma.sum()) / criteria
    shift = -unit * float(beta.mean())
    return RubricFit((gamma / unit).tolist(), (unit * beta + shift).tolist(), shift, unit * ability_sd, float(best[0]), turn, int(sums.docs), weight, sums.some / sums.docs, ordinal)


def score_documents(
    evidence: DataFrame, gamma: list[float], beta: list[float], mean: float = 0.0, sd: float = 1.0, severity: dict[str, float] | None = None, se_target: float = SE_TARGET,
) -> DataFrame:
    """(query_id, doc_id, n, theta, se, information, degenerate, low_information): documents from their verdicts, items frozen.

    ``evidence(query_id, doc_id, judge, n, s1...)``: windows and passes of a document by judge; rows of one judge add
    up. All judges' verdicts enter one likelihood, each judge's logits lowered by its ``severity``; a judge without one
    is refused if there are severities. theta and se are mean and deviation of the ability under the normal prior (mean,
    sd), whose grid scales with it; information is the verdicts' own at theta, low if below se_target^-2; degenerate is
    ``all_fail`` or ``all_pass`` where nothing bounds the ability but the prior. Documents fold into one row of a list
    by judge, and are integrated where they are: no row of the grid is ever made. No rows give no rows.
    """
    if not sd > 0 or not se_target > 0:
        raise ValueError("the prior's deviation and the target must be above 0")
    k, low, high = len(gamma), *GRID[:2]
    s = [f"s{i + 1}" for i in range(k)]
    if severity:
        known = F.create_map(*[x for j, v in severity.items() for x in (F.lit(j), F.lit(float(v)))])
        shift = F.element_at(known, F.col("judge"))
        shift = F.when(shift.isNull(), F.raise_error(F.concat(F.lit("no severity for judge "), F.coalesce("judge", F.lit("null"))))).otherwise(shift)
    else:
        shift = F.lit(0.0)
    rows = evidence.withColumn("shift", shift).groupBy("query_id", "doc_id", "shift").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", *s)])
    lists = rows.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("shift", F.array("n", *s).alias("sums")))).alias("parts"))
    g, b = np.array(gamma) * sd, (np.array(beta) - mean) / sd  # in units of the prior
    grid = np.linspace(low, high, GRID[2])
    prior = -grid * grid / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                lists = part.column(2)
                d = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                shifts = flat.field("shift").to_numpy(zero_copy_only=False)
                sums = flat.field("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, 1 + k)
                log = np.tile(prior, (part.num_rows, 1))
                levels, of = np.unique(shifts, return_inverse=True)
                for i, level in enumerate(levels):
                    mine = of == i
                    yes, no = _log_likelihood(g[:, None] * (grid - b[:, None]) - level)
                    np.add.at(log, d[mine], sums[mine, 1:] @ yes + (sums[mine, :1] - sums[mine, 1:]) @ no)
                w = np.exp(log - log.max(1, keepdims=True))
                w /= w.sum(1, keepdims=True)
                theta = w @ grid
                se = np.sqrt(np.maximum(w @ (grid * grid) - theta**2, 0))
                p = 1 / (1 + np.exp(-(g * (theta[d][:, None] - b) - shifts[:, None])))
                information, n, passed = np.zeros(len(theta)), np.zeros(len(theta)), np.zeros(len(theta))
                np.add.at(information, d, sums[:, 0] * (g * g * p * (1 - p)).sum(1))
                np.add.at(n, d, sums[:, 0])
                np.add.at(passed, d, sums[:, 1:].sum(1))
                information /= sd**2
                edge = np.where(passed == 0, "all_fail", np.where(passed == n * k, "all_pass", None))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(theta * sd + mean), pa.array(se * sd), pa.array(information), pa.array(edge.tolist(), pa.string()), pa.array(information < se_target**-2)],
                    names=["query_id", "doc_id", "n", "theta", "se", "information", "degenerate", "low_information"],
                )

    return lists.mapInArrow(run, "query_id string, doc_id string, n long, theta double, se double, information double, degenerate string, low_information boolean")


def _settled(l2: Column) -> Column:
    """The ability that ``faced`` (an array of other, w, wy) makes likeliest under a ridge: Newton's steps inside a shrinking bracket."""

    def at(x: Column) -> Column:
        def add(sums: Column, o: Column) -> Column:
            p = gains.sigmoid(x - o["other_theta"])
            return F.struct((sums["slope"] + o["w"] * p - o["wy"]).alias("slope"), (sums["bend"] + o["w"] * p * (1 - p)).alias("bend"))

        return F.aggregate("faced", F.struct((l2 * x).alias("slope"), l2.alias("bend")), add)

    def step(state: Column, _: Column) -> Column:
        x = state["x"]

        def settle(s: Column) -> Column:
            low, high = F.when(s["slope"] > 0, state["low"]).otherwise(x), F.when(s["slope"] > 0, x).otherwise(state["high"])
            newton = x - s["slope"] / s["bend"]
            middle = (low + high) / 2
            return F.struct(low.alias("low"), high.alias("high"), F.when((s["bend"] > 0) & (newton > low) & (newton < high), newton).otherwise(middle).alias("x"))

        return F.get(F.transform(F.array(at(x)), settle), F.lit(0))

    begin = F.struct(F.lit(-THETA_BOUND).alias("low"), F.lit(THETA_BOUND).alias("high"), F.lit(0.0).alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), begin, step, lambda s: s["x"])


def insert(pairs: DataFrame, frozen: DataFrame, existing: DataFrame, l2: float = 1e-4, se_target: float = SE_TARGET, min_opponents: int = MIN_OPPONENTS) -> DataFrame:
    """(query_id, doc_id, theta, se, information, opponents, comparisons, components, failed): new documents against frozen abilities.

    ``pairs`` and ``existing`` are (query_id, winner, loser, weight, soft_label); ``frozen(query_id, doc_id, theta)``
    are the fitted abilities, which nothing here changes. A document without one that meets one with is new; pairs of
    two new documents tell nothing. A row of ``pairs`` may stand for several (``comparisons``), see ``judgements.summed``. Its ability is the likeliest under the fit's own ridge: l2 times the weight of all
    its query's comparisons. ``failed`` names what does not hold: ``connected`` (the fitted documents, linked by
    ``existing``, and the new one are one component: its opponents must stand in every component there was, so the
    stored labels suffice and no graph is walked again), ``opponents`` (``min_opponents`` distinct ones), ``information``
    (ridge included, se_target^-2 or more), ``interior`` (not at the edge of -20 to 20). Opponents of a document are
    summed before they form its list, which is no longer than its query's fitted documents. No new documents, no rows.
    """
    sides = F.array(
        F.struct(F.col("winner").alias("doc_id"), F.col("loser").alias("other"), F.col("soft_label").alias("y")),
        F.struct(F.col("loser").alias("doc_id"), F.col("winner").alias("other"), (1 - F.col("soft_label")).alias("y")),
    )
    known = frozen.select("query_id", "doc_id", F.col("theta").cast("double").alias("other_theta"))
    times = F.col("comparisons") if "comparisons" in pairs.columns else F.lit(1)
    both = pairs.select("query_id", "weight", times.cast("long").alias("times"), F.inline(sides)).join(known.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    met = both.groupBy("query_id", "doc_id", "other").agg(F.sum("weight").cast("double").alias("w"), F.sum(F.col("weight") * F.col("y")).cast("double").alias("wy"), F.sum("times").alias("c"))

    edges = existing.select("query_id", F.col("winner").alias("a"), F.col("loser").alias("b"))
    labels = components(edges, ["query_id"])
    place = known.join(labels.select("query_id", F.col("node").alias("doc_id"), "component"), ["query_id", "doc_id"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    place = cut(place.withColumnRenamed("doc_id", "other"))
    there = place.groupBy("query_id").agg(F.count_distinct("component").alias("there"))
    total = existing.groupBy("query_id").agg(F.sum("weight").cast("double").alias("total"))

    rows = met.join(place, ["query_id", "other"]).groupBy("query_id", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("other", "other_theta", "w", "wy"))).alias("faced"), F.sum("w").alias("own"), F.sum("c").alias("comparisons"), F.count_distinct("component").alias("touched")
    )
    rows = rows.join(there, "query_id").join(total, "query_id", "left")
    rows = rows.withColumn("ridge", F.lit(float(l2)) * (F.col("own") + F.coalesce("total", F.lit(0.0))))
    rows = rows.withColumn("theta", _settled(F.col("ridge")))

    def info(sums: Column, o: Column) -> Column:
        p = gains.sigmoid(F.col("theta") - o["other_theta"])
        return sums + o["w"] * p * (1 - p)

    rows = rows.withColumn("information", F.aggregate("faced", F.col("ridge"), info)).withColumn("opponents", F.size("faced").cast("long"))
    checks = {
        "connected": F.col("touched") == F.col("there"), "opponents": F.col("opponents") >= min_opponents,
        "information": F.col("information") >= se_target**-2, "interior": F.abs("theta") < THETA_BOUND - 1e-3,
    }
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return rows.select(
        "query_id", "doc_id", "theta", (1 / F.sqrt(F.greatest("information", F.lit(1e-12)))).alias("se"), "information", "opponents", "comparisons",
        (F.col("there") - F.col("touched") + 1).alias("components"), failed.alias("failed"),
    )
