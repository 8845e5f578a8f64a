"""Items, judges' severities and queries' scales fitted together over a distributed table of verdicts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import gains
from rankloom.operators.lineage import cut


@dataclass(frozen=True)
class Priors:
    """Spreads and penalties of the fits, in logits."""

    sigma_tau: float = 1.0
    sigma_alpha: float = 2.0
    l2_gamma: float = 1e-4
    l2_beta: float = 1e-4
    ability_sd: float = 1.0
    bt_l2: float = 1e-4


@dataclass(frozen=True)
class TournamentFit:
    """Items and severities, small; ``queries(query_id, tau, alpha)`` stays a table."""

    gamma: list[float]
    beta: list[float]
    severity: dict[str, float]
    queries: DataFrame
    rounds: int
    #: Largest slope left in a query's scale and offset, in units of the summed loss, and the loss itself.
    max_grad: float
    loss: float
    converged: bool
    observations: int


def _vector_sum(rows: DataFrame, column: str) -> np.ndarray:
    """The sum of a column of equally long arrays: added up by place, so that one array is all that reaches the driver."""
    sums = rows.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at")
    return np.array([r.x for r in sums.collect()])


def _evidence(observations: DataFrame, params: DataFrame, gamma, beta, severity: dict[str, float]) -> DataFrame:
    """One row a query: its scale and offset, and a list of (judge, sums): loss, then by criterion five sums of slopes and bends.

    Everything that the joint fit's slopes and bends need of a query's rows is linear in these, as the logit is linear
    in theta. Tasks add up their own rows first, so a query with very many rows is one row a task in the shuffle.
    """
    s = [f"s{k + 1}" for k in range(len(gamma))]
    rows = observations.join(params.select("query_id", "raw", "tau", "alpha"), "query_id")
    shift: Column = F.lit(0.0)
    if severity:
        shift = F.element_at(F.create_map(*[x for j, v in severity.items() for x in (F.lit(j), F.lit(float(v)))]), F.col("judge"))
    ability = F.col("tau") * F.col("theta") + F.col("alpha")
    terms, loss = [], F.lit(0.0)
    for g, b, name in zip(gamma, beta, s):
        x = F.lit(float(g)) * (ability - F.lit(float(b))) - shift
        p = gains.sigmoid(x)
        loss = loss + F.col("n") * (F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))) - F.col(name) * x
        e, w, t = F.col("n") * p - F.col(name), F.col("n") * p * (1 - p), F.col("theta")
        terms += [e, e * t, w, w * t, w * t * t]
    sums = [F.sum(x) for x in (loss, *terms)]
    each = rows.groupBy("query_id", F.coalesce("judge", F.lit("")).alias("judge")).agg(F.first("raw").alias("raw"), F.first("alpha").alias("alpha"), F.array(*sums).alias("sums"))
    return each.groupBy("query_id").agg(F.first("raw").alias("raw"), F.first("alpha").alias("alpha"), F.collect_list(F.struct("judge", "sums")).alias("parts"))


def _steps(gamma: np.ndarray, beta: np.ndarray, judges: list[str], priors: Priors):
    """Per query, its own part eliminated: what its scale and offset would do alone, and for each unit that a shared parameter moves."""
    k, size = len(gamma), 2 * len(gamma) + len(judges)
    number = {j: i for i, j in enumerate(judges)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            parts = batch.column(3)
            count = parts.value_lengths().to_numpy()
            flat = parts.flatten()
            q = np.repeat(np.arange(n), count)
            who = np.array([number.get(j, -1) for j in flat.field("judge").to_pylist()])
            sums = np.array(flat.field("sums").flatten().to_numpy(zero_copy_only=False)).reshape(len(q), 1 + 5 * k)
            raw, alpha = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            tau, c = np.logaddexp(0, raw), 1 / (1 + np.exp(-raw))
            e, et, w, wt, wtt = (sums[:, 1 + i :: 5] for i in range(5))
            a = alpha[q][:, None] - beta
            one, two = tau[q][:, None] * wt + a * w, (tau[q] ** 2)[:, None] * wtt + 2 * tau[q][:, None] * a * wt + a * a * w

            def by_query(x: np.ndarray) -> np.ndarray:
                out = np.zeros((n, *x.shape[1:]))
                np.add.at(out, q, x)
                return out

            # slopes and bends of the shared parameters, query by query: gamma, beta, severity
            slope, bend = np.zeros((n, size)), np.zeros((n, size, size))
            slope[:, :k], slope[:, k : 2 * k] = by_query(tau[q][:, None] * et + a * e), by_query(-gamma * e)
            i = np.arange(k)
            bend[:, i, i], bend[:, k + i, k + i] = by_query(two), by_query(gamma**2 * w)
            bend[:, i, k + i] = bend[:, k + i, i] = by_query(-gamma * one - e)
            cross = np.zeros((n, 2, size))
            cross[:, 0, :k], cross[:, 1, :k] = by_query(gamma * (tau[q][:, None] * wtt + a * wt) + et), by_query(gamma * one + e)
            cross[:, 0, k : 2 * k], cross[:, 1, k : 2 * k] = by_query(-(gamma**2) * wt), by_query(-(gamma**2) * w)
            if judges:
                at = 2 * k + who
                np.add.at(slope, (q, at), -e.sum(1))
                np.add.at(bend, (q, at, at), w.sum(1))
                for m in range(k):
                    for spot, x in ((m, -one[:, m]), (k + m, gamma[m] * w[:, m])):
                        np.add.at(bend, (q, at, np.full(len(q), spot)), x)
                        np.add.at(bend, (q, np.full(len(q), spot), at), x)
                np.add.at(cross, (q, np.zeros_like(q), at), -(gamma * wt).sum(1))
                np.add.at(cross, (q, np.ones_like(q), at), -(gamma * w).sum(1))
            # the query's own scale (through its raw form, which keeps it positive) and offset, with their priors
            g_tau = by_query((gamma * et).sum(1)) + (tau - 1) / priors.sigma_tau**2
            g_alpha = by_query((gamma * e).sum(1)) + alpha / priors.sigma_alpha**2
            tt = by_query((gamma**2 * wtt).sum(1)) + 1 / priors.sigma_tau**2
            ta, aa = by_query((gamma**2 * wt).sum(1)), by_query((gamma**2 * w).sum(1)) + 1 / priors.sigma_alpha**2
            rr, ra = c * c * tt + c * (1 - c) * g_tau, c * ta
            rr = np.where(rr * aa - ra * ra > 1e-10 * c * c * tt * aa, rr, c * c * tt)
            cross[:, 0] *= c[:, None]
            own = np.stack((c * g_tau, g_alpha), axis=1)
            det = rr * aa - ra * ra
            inverse = np.stack((np.stack((aa, -ra), axis=1), np.stack((-ra, rr), axis=1)), axis=1) / det[:, None, None]
            alone, each = np.einsum("qij,qj->qi", inverse, own), np.einsum("qij,qjp->qip", inverse, cross)
            loss = by_query(sums[:, 0]) + (tau - 1) ** 2 / (2 * priors.sigma_tau**2) + alpha**2 / (2 * priors.sigma_alpha**2)
            gone = np.einsum("qip,qir->pr", cross, each)
            total = np.concatenate(([loss.sum(), (own * alone).sum()], slope.sum(0), slope.sum(0) - np.einsum("qip,qi->p", cross, alone), (bend.sum(0) - gone).ravel()))
            none = pa.nulls(n - 1, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(alone.tolist(), pa.list_(pa.float64())),
                    pa.array(each.reshape(n, -1).tolist(), pa.list_(pa.float64())), pa.array(np.maximum(np.abs(own[:, 0]), np.abs(own[:, 1]))),
                    pa.concat_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), none]),
                ],
                names=["query_id", "raw", "alpha", "alone", "each", "slope", "total"],
            )

    return run


def _shared(values: np.ndarray, k: int, weight: np.ndarray):
    """gamma, beta and severities of the free values: gamma sums to the criteria, beta and weighted severities to 0. And how they move."""
    rel = np.exp(values[:k] - values[:k].max())
    gamma = rel * k / rel.sum()
    beta, severity = values[k : 2 * k] - values[k : 2 * k].mean(), values[2 * k :].copy()
    move = np.zeros((len(values), len(values)))
    move[:k, :k] = np.diag(gamma) - np.outer(gamma, gamma) / k
    move[k : 2 * k, k : 2 * k] = np.eye(k) - 1 / k
    if len(severity):
        share = weight / weight.sum()
        severity -= share @ severity
        move[2 * k :, 2 * k :] = np.eye(len(severity)) - share
    return gamma, beta, severity, move


def tournament_2pl(observations: DataFrame, criteria: int, priors: Priors = Priors(), pooled: bool = False, rounds: int = 60, tolerance: float = 1e-9) -> TournamentFit:
    """Items anchored on tournament abilities: logit = gamma_k (tau_q theta + alpha_q - beta_k) - severity_judge.

    ``observations(query_id, doc_id, theta, judge, n, s1...)``: windows and passes of a document by one judge, and its
    tournament ability (null: the row has nothing to attach to and is skipped; no finite number: refused). gamma sums to
    the criteria and beta to 0; with ``pooled`` each of two or more judges has a severity, whose mean over verdicts is
    0; every row must name its judge then, and every two judges must share a document. The penalised loss is that of
    the verdicts' mean, plus l2 / 2 of log gamma and beta squared, plus the priors of tau (1, sigma_tau) and alpha
    (0, sigma_alpha) over the number of verdicts.

    Newton's method on all parameters at once. A round adds up, by Spark, five sums a criterion for each query and
    judge; each query's scale and offset are eliminated where its sums are, and what reaches the driver is one slope and
    one bend matrix of items and judges. Its solution goes back as literals, so queries' parameters never leave their
    table. A step that does not lower the loss is halved. Rows of any order and partitioning give the same optimum.
    No rows, or no row with an ability, is an error.
    """
    s = [f"s{k + 1}" for k in range(criteria)]
    theta = F.col("theta").cast("double")
    sane = F.when(F.isnan(theta) | (F.abs(theta) == float("inf")), F.raise_error(F.lit("an ability is no finite number"))).otherwise(theta)
    rows = observations.filter("theta IS NOT NULL").select("query_id", "doc_id", sane.alias("theta"), F.col("judge").cast("string").alias("judge") if pooled else F.lit(None).cast("string").alias("judge"), "n", *s)
    rows = cut(rows.groupBy("query_id", "doc_id", "theta", "judge").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", *s)]))
    per = {r.judge: r.n for r in rows.groupBy("judge").agg(F.sum("n").alias("n")).collect()}
    if not per:
        raise ValueError("no verdict on a document with an ability")
    judges: list[str] = []
    if pooled:
        if None in per:
            raise ValueError("pooled judges: every row must name its judge")
        judges = sorted(per)
        if len(judges) < 2:
            raise ValueError(f"pooled judges: two or more are needed, got {judges}")
        seen = rows.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_set("judge")).alias("j")).filter(F.size("j") > 1)
        two = F.flatten(F.transform("j", lambda a: F.transform(F.filter("j", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        shared = {(r.a, r.b) for r in seen.select(F.inline(two)).distinct().collect()}
        if lone := [(a, b) for i, a in enumerate(judges) for b in judges[i + 1 :] if (a, b) not in shared]:
            raise ValueError(f"judges share no document: {lone}")
    weight, verdicts = np.array([per[j] for j in judges]), criteria * sum(per.values())
    ridge = verdicts * np.concatenate((np.full(criteria, priors.l2_gamma), np.full(criteria, priors.l2_beta), np.zeros(len(judges))))
    values, size = np.zeros(2 * criteria + len(judges)), 2 * criteria + len(judges)
    start = math.log(math.e - 1)
    params = rows.select("query_id").distinct().withColumns({"raw": F.lit(start), "tau": F.lit(1.0), "alpha": F.lit(0.0)})
    old, kept, move_by, scale, done, best = None, None, None, 1.0, False, (np.inf, np.inf)
    for turn in range(1, rounds + 1):
        gamma, beta, severity, jacobian = _shared(values, criteria, weight)
        run = _steps(gamma, beta, judges, priors)
        found = cut(_evidence(rows, params, gamma, beta, dict(zip(judges, severity.tolist()))).select("query_id", "raw", "alpha", "parts").mapInArrow(
            run, "query_id string, raw double, alpha double, alone array<double>, each array<double>, slope double, total array<double>"
        ))
        total = _vector_sum(found, "total")
        loss = total[0] + (ridge * values**2).sum() / 2
        if old is not None and not loss <= old[0] + 1e-12 * abs(old[0]):
            scale /= 2  # the step was too long: half of it, from where it began
            if scale < 1e-6:
                values, found, done = old[1], kept, True
                break
        else:
            slope, reduced, bend = total[2 : 2 + size], total[2 + size : 2 + 2 * size], total[2 + 2 * size :].reshape(size, size)
            g = jacobian.T @ reduced + ridge * values
            h = jacobian.T @ bend @ jacobian + np.diag(ridge)
            share = gamma / criteria
            inner = jacobian.T @ slope
            h[:criteria, :criteria] += np.diag(inner[:criteria]) - np.outer(share, inner[:criteria]) - np.outer(inner[:criteria], share)
            if judges:
                h[2 * criteria :, 2 * criteria :] += np.outer(weight, weight) / weight.sum()  # the severities' common level is free
            h += 1e-12 * np.trace(h) / size * np.eye(size)
            low = np.linalg.eigvalsh(h)[0]
            if low <= 0:
                h += (1e-6 * np.abs(h).max() - low) * np.eye(size)
            delta = -np.linalg.solve(h, g)
            fall = total[1] - g @ delta  # twice what the step should gain
            old, kept, scale, best = (loss, values), found, min(1.0, 2 / max(np.abs(delta).max(), 1e-300)), (loss, found.agg(F.max("slope")).first()[0])
            move_by = delta
            if fall <= tolerance * max(1.0, abs(loss)):
                done = True
                break
        values = old[1] + scale * move_by
        shift = F.array(*[F.lit(float(x)) for x in _shared(old[1], criteria, weight)[3] @ move_by])

        def moved(at: int) -> Column:
            by = F.aggregate(F.zip_with(F.slice("each", 1 + at * size, size), shift, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            return F.col("alpha" if at else "raw") - F.lit(scale) * (F.get("alone", F.lit(at)) + by)

        raw = moved(0)
        params = kept.select("query_id", raw.alias("raw"), (F.greatest(raw, F.lit(0.0)) + F.log1p(F.exp(-F.abs(raw)))).alias("tau"), moved(1).alias("alpha"))
    else:
        values, found = old[1], kept
    gamma, beta, severity, _ = _shared(values, criteria, weight)
    softplus = F.greatest(F.col("raw"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("raw")))
    queries = found.select("query_id", softplus.alias("tau"), "alpha")
    return TournamentFit(gamma.tolist(), beta.tolist(), dict(zip(judges, severity.tolist())), queries, turn, best[1], best[0], done, int(sum(per.values())))
