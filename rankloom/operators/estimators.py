"""Item-response estimators: pairwise abilities, rubric items, abilities of new documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import gains
from rankloom.operators import abilities


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def bradley_terry_fit(i: np.ndarray, j: np.ndarray, weight: np.ndarray, label: np.ndarray, n: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Abilities and standard errors of ``n`` documents by Newton's method.

    Minimises the weighted cross entropy of the labels, over the total weight, plus l2 / 2 times the squared norm.
    """
    theta, total = np.zeros(n), weight.sum()
    w = weight / total
    for _ in range(100):
        p = _logistic(theta[i] - theta[j])
        g = w * (p - label)
        grad = np.bincount(i, g, n) - np.bincount(j, g, n) + l2 * theta
        h = w * p * (1 - p)
        hess = np.diag(np.bincount(i, h, n) + np.bincount(j, h, n) + l2)
        np.add.at(hess, (i, j), -h)
        np.add.at(hess, (j, i), -h)
        step = np.linalg.solve(hess, grad)
        theta = theta - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-12:
            break
    p = _logistic(theta[i] - theta[j])
    info = weight * p * (1 - p)
    se = 1 / np.sqrt(np.bincount(i, info, n) + np.bincount(j, info, n) + l2 * total)
    return theta - theta.mean(), se


def bradley_terry(comparisons: DataFrame, l2: float = 1e-4) -> DataFrame:
    """(query_id, doc_id, theta, se) from ``comparisons(query_id, winner, loser, weight, soft_label)``.

    Comparisons of one pair are summed first: what a query's fit takes in is one row a pair of its documents.
    """
    summed = comparisons.groupBy("query_id", "winner", "loser").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("soft_label")).alias("wy"))

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["winner", "loser"])
        names, at = np.unique(np.concatenate([f["winner"], f["loser"]]).astype(str), return_inverse=True)
        i, j = at[: len(f)], at[len(f) :]
        w = f["w"].to_numpy()
        theta, se = bradley_terry_fit(i, j, w, f["wy"].to_numpy() / w, len(names), l2)
        return pd.DataFrame({"query_id": f["query_id"].iloc[0], "doc_id": names, "theta": theta, "se": se})

    return summed.groupBy("query_id").applyInPandas(fit, "query_id string, doc_id string, theta double, se double")


def rubric_items(patterns: DataFrame, criteria: int) -> tuple[np.ndarray, np.ndarray]:
    """Discriminations (sum: the criteria) and difficulties (mean 0) by marginal maximum likelihood, see ``abilities.rubric_2pl``."""
    fit = abilities.rubric_2pl(patterns, criteria)
    return np.array(fit.gamma), np.array(fit.beta)


def insert_document(opponents: DataFrame, sd: float = 10.0) -> DataFrame:
    """(query_id, doc_id, theta, information, opponents) of new documents against frozen abilities.

    ``opponents(query_id, doc_id, other_theta, weight, label)``: label is the share of the comparison that the new
    document won. A normal prior of ``sd`` holds the ability; it is found by Newton's steps inside a bracket of -20 to
    20, as an aggregate over the opponents' abilities, whose rows are summed first. ``abilities.insert`` adds the
    predicates that tell whether the opponents identify the document.
    """
    rows = opponents.groupBy("query_id", "doc_id", "other_theta").agg(F.sum("weight").cast("double").alias("w"), F.sum(F.col("weight") * F.col("label")).cast("double").alias("wy"))
    rows = rows.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("other_theta", "w", "wy"))).alias("faced"))
    rows = rows.withColumn("theta", abilities._settled(F.lit(1 / sd**2)))

    def info(total, o):
        p = gains.sigmoid(F.col("theta") - o["other_theta"])
        return total + o["w"] * p * (1 - p)

    return rows.select("query_id", "doc_id", "theta", F.aggregate("faced", F.lit(0.0), info).alias("information"), F.size("faced").cast("long").alias("opponents"))


def rasch_scores(rows: DataFrame, beta: list[float], ridge: float = 0.05, steps: int = 30) -> DataFrame:
    """Rows of ``rows(.., n, s1...)`` with ``theta`` and ``score``: ridge-penalised Rasch ability, and the share of criteria it passes.

    Newton's method written out as an aggregate over steps: it stays inside the JVM.
    """
    s = [f"s{i + 1}" for i in range(len(beta))]
    total = sum((F.col(c) for c in s[1:]), F.col(s[0])).cast("double")
    p = lambda t, b: 1 / (1 + F.exp(-(t - F.lit(b))))

    def step(t, _):
        ps = [p(t, b) for b in beta]
        mass = sum(ps[1:], ps[0])
        bend = sum((x * (1 - x) for x in ps[1:]), ps[0] * (1 - ps[0]))
        k = F.lit(float(len(beta)))
        move = ((total / F.col("n") - mass) / k - ridge * t) / (bend / k + ridge)
        return t + F.least(F.greatest(move, F.lit(-2.0)), F.lit(2.0))

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    rows = rows.withColumn("theta", theta)
    score = sum((p(F.col("theta"), b) for b in beta[1:]), p(F.col("theta"), beta[0])) * (100.0 / len(beta))
    return rows.withColumn("score", score)


def balanced_groups(pools: DataFrame, window: int, windows: int, seed: str = "0") -> DataFrame:
    """(dataset, query_id, window_no, doc_id, place): random windows of each pool that show its documents equally often.

    The pool is dealt out round by round, each round in an order of its own (by a hash of seed, query, document and
    round), and cut into windows. A window that begins in one round and ends in the next takes documents there that it
    does not hold yet; those that it does follow in the rest of that round. So no window shows a document twice, and any
    two documents are shown within one of each other. Places within a window are a hash's too. A pool smaller than the
    window is shown whole. Documents listed twice count once, null ones do not; a query's pool is one row's list.
    """
    sizes = pools.filter("doc_id IS NOT NULL").groupBy("dataset", "query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    rows = sizes.withColumn("n", F.size("docs")).withColumn("w", F.least("n", F.lit(window)))

    def dealt(docs, *key):
        order = F.array_sort(F.transform(docs, lambda d: F.struct(F.xxhash64(F.lit(seed), "dataset", "query_id", d, *key).alias("h"), d.alias("d"))))
        return F.transform(order, lambda x: x["d"])

    def deal(out, turn):
        # each list is bound to a name of its own: inside a lambda over documents it would be worked out once a document
        named = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
        begun = F.size(out) % F.col("w")
        missing = F.when(begun > 0, F.col("w") - begun).otherwise(0)

        def rest(order):
            begin = lambda held: F.slice(F.filter(order, lambda d: ~F.array_contains(held, d)), F.lit(1), missing)
            return named(named(F.slice(out, F.size(out) - begun + 1, begun), begin), lambda first: F.concat(out, first, F.filter(order, lambda d: ~F.array_contains(first, d))))

        return named(dealt(F.col("docs"), turn), rest)

    turns = F.sequence(F.lit(1), F.ceil(F.lit(windows) * F.col("w") / F.col("n")).cast("int"))
    rows = rows.withColumn("out", F.aggregate(turns, F.array().cast("array<string>"), deal))
    rows = rows.select("dataset", "query_id", "w", "out", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("window_no"))
    shown = dealt(F.slice("out", F.col("window_no") * F.col("w") + 1, F.col("w")), F.col("window_no"), F.lit("place"))
    return rows.select("dataset", "query_id", "window_no", F.posexplode(shown).alias("place", "doc_id"))
