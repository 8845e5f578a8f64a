"""Gains of graded labels and of abilities under item parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Logistic function that neither over- nor underflows."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def pass_probabilities(theta: Column, gamma: list[float], beta: list[float]) -> list[Column]:
    """Chance that a document of ability ``theta`` passes each criterion."""
    return [sigmoid(F.lit(g) * (theta - F.lit(b))) for g, b in zip(gamma, beta, strict=True)]


def calibrated_gain(theta: Column, gamma: list[float], beta: list[float]) -> Column:
    """Pass probabilities weighted by discrimination."""
    total = F.lit(0.0)
    for g, p in zip(gamma, pass_probabilities(theta, gamma, beta), strict=True):
        total = total + F.lit(g) * p
    return total / F.lit(float(sum(gamma)))


def qrel_gain(grade: Column, kind: str = "linear") -> Column:
    """``linear``: the grade; ``exponential``: two to the grade, less one."""
    if kind == "linear":
        return grade.cast("double")
    if kind == "exponential":
        return F.pow(F.lit(2.0), grade) - 1
    raise ValueError(f"unknown gain {kind!r}")


def affine(theta: Column, tau: Column, alpha: Column) -> Column:
    """Ability on a query's scale."""
    return theta * tau + alpha


def variant(theta: Column, gamma: list[float], beta: list[float], name: str) -> Column:
    """Other gains of an ability, all between 0 and 1."""
    p = pass_probabilities(theta, gamma, beta)
    mean = lambda xs: sum(xs[1:], xs[0]) / F.lit(float(len(xs)))
    low, high = min(beta), max(beta)
    known = {
        "sigmoid_theta": lambda: sigmoid(theta),
        "sigmoid_mean_beta": lambda: sigmoid(theta - F.lit(sum(beta) / len(beta))),
        "weighted_criterion": lambda: calibrated_gain(theta, gamma, beta),
        "mean_criterion": lambda: mean(p),
        "excess_probability": lambda: mean([F.greatest(x - 0.5, F.lit(0.0)) for x in p]),
        "gated_weighted": lambda: F.when(theta < low, F.lit(0.0)).otherwise(calibrated_gain(theta, gamma, beta)),
        "power2_weighted": lambda: F.pow(calibrated_gain(theta, gamma, beta), 2),
        "linear_theta": lambda: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (theta - low) / F.lit(high - low))) if high > low else F.lit(0.5),
        **{f"criterion_C{i + 1}": (lambda x=x: x) for i, x in enumerate(p)},
    }
    if name not in known:
        raise ValueError(f"unknown gain {name!r}")
    return known[name]()


def information(theta: Column, gamma: list[float], beta: list[float]) -> Column:
    """What one window of all criteria tells about an ability."""
    parts = [F.lit(g * g) * p * (1 - p) for g, p in zip(gamma, pass_probabilities(theta, gamma, beta), strict=True)]
    return sum(parts[1:], parts[0])
