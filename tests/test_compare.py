"""Rank correlation by inversions and the bootstrap against brute force, over groups cut into blocks and leaves."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import compare
from rankloom.plans import analysis


def tau(rows):
    rows = [r for r in rows if None not in r]
    s = nx = ny = 0
    for i, (a, b) in enumerate(rows):
        for c, d in rows[:i]:
            x, y = (a > c) - (a < c), (b > d) - (b < d)
            s, nx, ny = s + x * y, nx + x * x, ny + y * y
    return s / math.sqrt(nx * ny) if nx and ny else None


@pytest.mark.parametrize("block", [10, 40, 50_000])
def test_tau_equals_all_pairs(spark, block):
    r = random.Random(block)
    groups = {
        "ties": [(r.randrange(4), r.randrange(5)) for _ in range(300)], "hot": [(1.0 if r.random() < 0.5 else r.random(), r.random()) for _ in range(300)],
        "near": [(i, i + r.random() * 40) for i in range(250)], "back": [(i, -i) for i in range(120)], "flat": [(1, i) for i in range(50)], "one": [(1, 1)],
        "nulls": [(None, 1), (1, None), (1, 2), (2, 1), (3, 3)], "negative": [(-r.random(), r.gauss(0, 9)) for _ in range(200)], "hoty": [(r.random(), 2.0 if r.random() < 0.5 else r.random() * 4) for _ in range(300)],
    }
    rows = [(g, f"i{i}", None if x is None else float(x), None if y is None else float(y)) for g, items in groups.items() for i, (x, y) in enumerate(items)]
    frame = spark.createDataFrame(rows, "g string, item string, x double, y double").repartition(5)
    got = {t.g: t.tau for t in compare.kendall_tau_b(frame, ["g"], "item", "x", "y", block).collect()}
    want = {g: tau(items) for g, items in groups.items()}
    assert got.keys() == want.keys()
    for g, t in want.items():
        assert got[g] == (None if t is None else pytest.approx(t, abs=1e-12)), g
    assert compare.kendall_tau_b(frame.limit(0), ["g"], "item", "x", "y").count() == 0


def test_tau_of_a_large_group(spark):
    n = 300_000
    frame = spark.range(n).select(F.lit("g").alias("g"), "id", F.col("id").cast("double").alias("x"), ((F.col("id") * 7919) % n).cast("double").alias("y"))
    got = compare.kendall_tau_b(frame, ["g"], "id", "x", "y").first().tau
    y = (np.arange(n) * 7919) % n
    order, d = y.copy(), 0
    width = 1
    while width < n:  # a bottom-up merge that counts what it passes
        for a in range(0, n, 2 * width):
            left, right = order[a : a + width], order[a + width : a + 2 * width]
            d += int((len(left) - np.searchsorted(left, right)).sum())
            order[a : a + 2 * width] = np.sort(order[a : a + 2 * width])
        width = max(width * 2, 1) if width >= 64 else width * 2
    assert got == pytest.approx(1 - 4 * d / (n * (n - 1)), abs=1e-12)


def values(n, seed):
    r = random.Random(seed)
    return [(s, d, f"q{i}", r.random() + (d == "b")) for s in ("one", "two") for d, m in (("a", n), ("b", 7)) for i in range(m)] + [("one", "a", "none", None)]


@pytest.mark.parametrize("leaf", [16, 4096])
def test_draws_are_n_of_n_and_rerun_alike(spark, leaf):
    rows = values(400, 1)
    frame = spark.createDataFrame(rows, "system string, dataset string, query_id string, value double")
    runs = [compare.resampled(f, "value", 50, 3, leaf).collect() for f in (frame.repartition(7), frame.orderBy(F.rand(1)).coalesce(1))]
    for run in runs:
        assert len(run) == 2 * 2 * 50 and all(r.drawn == r.n == (400 if r.dataset == "a" else 7) for r in run)
    sums = [{(r.system, r.dataset, r.draw): r.total for r in run} for run in runs]
    assert sums[0].keys() == sums[1].keys() and all(sums[1][k] == pytest.approx(v, rel=1e-12) for k, v in sums[0].items())
    assert len({round(v, 9) for v in sums[0].values()}) > 150  # draws differ


def test_picks_are_even(spark):
    """Each query's picks follow the binomial of n of n: mean 1, variance 1 - 1/n, leaf by leaf alike."""
    n, draws = 64, 2000
    counts = []
    for q in range(0, n, 9):
        frame = spark.createDataFrame([("s", "d", f"q{i}", float(i == q)) for i in range(n)], "system string, dataset string, query_id string, value double")
        counts.append([r.total for r in compare.resampled(frame, "value", draws, q, 8).collect()])
    for c in counts:
        assert np.mean(c) == pytest.approx(1, abs=0.1) and np.var(c) == pytest.approx(1 - 1 / n, abs=0.15)
        seen = Counter(c)
        assert seen[0.0] / draws == pytest.approx((1 - 1 / n) ** n, abs=0.05)


def test_interval_equals_a_brute_bootstrap(spark):
    rows = [r for r in values(300, 2) if r[3] is not None]
    frame = spark.createDataFrame(rows, "system string, dataset string, query_id string, value double")
    got = {r.system: (r.low, r.high) for r in compare.bootstrap(frame, "value", 2000, seed=5).collect()}
    rng = np.random.default_rng(0)
    for s in got:
        parts = [np.array([v for a, d, _, v in rows if (a, d) == (s, x)]) for x in ("a", "b")]
        means = np.mean([p[rng.integers(0, len(p), (4000, len(p)))].mean(1) for p in parts], axis=0)
        assert got[s] == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=0.02)
    with pytest.raises(ValueError):
        compare.bootstrap(frame, "value", 0)


def test_whole_queries_of_p_values_and_sensitivity(spark):
    folder = "/root/testdata/sf0.001"
    deltas = {}
    for r in analysis._deltas(spark, folder).collect():
        deltas.setdefault((r.dataset, r.a, r.b), []).append(r.delta)

    def p_value(x):
        n, sd = len(x), np.std(x, ddof=1) if len(x) > 1 else 0
        if n < 2 or sd == 0:
            return None
        t, m = abs(np.mean(x)) / (sd / math.sqrt(n)), n - 1
        grid = np.linspace(0, t, 200_001)  # Student's density, integrated
        f = math.gamma((m + 1) / 2) / (math.sqrt(m * math.pi) * math.gamma(m / 2)) * (1 + grid**2 / m) ** (-(m + 1) / 2)
        return 1 - 2 * float(np.trapezoid(f, grid))

    want = {k: p_value(x) for k, x in deltas.items()}
    got = compare.with_p(compare.paired_t(analysis._deltas(spark, folder), ("dataset", "a", "b"))).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.dataset, r.a, r.b]
        assert r.p == (None if w is None else pytest.approx(w, abs=1e-6))
    shares = {r.dataset: (r.share, r.pairs) for r in compare.sensitivity(analysis._deltas(spark, folder)).collect()}
    for d, (share, n) in shares.items():
        ps = [p for (x, *_), p in want.items() if x == d]
        assert n == len(ps) and share == pytest.approx(sum(p is not None and p < 0.05 for p in ps) / n)


@pytest.mark.parametrize("shuffle", ["4", "13"])
def test_ranks_over_ranges(spark, shuffle):
    r = random.Random(4)
    rows = [(g, i, float(r.choice((0, 0, 0, *range(n)))), r.random() if i % 9 else None, int(r.random() < 0.3)) for g, n in (("a", 5), ("b", 400), ("c", 1)) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, i int, x double, y double, hit int")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        got = {(t.g, t.i): t.rank for t in compare.average_ranks(frame, ["g"], "x", "rank").collect()}
        rho = {t.g: (t.n, t.rho) for t in compare.spearman(frame, ["g"], "x", "y").collect()}
        areas = {t.g: t.auc for t in compare.auc(frame, ["g"], "x", "hit").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

    def ranks(v):
        return np.array([(np.array(v) < x).sum() + ((np.array(v) == x).sum() + 1) / 2 for x in v])

    for g in "abc":
        mine = [t for t in rows if t[0] == g]
        want = ranks([t[2] for t in mine])
        assert [got[g, t[1]] for t in mine] == want.tolist()
        both = [t for t in mine if t[3] is not None]
        rx, ry = ranks([t[2] for t in both]), ranks([t[3] for t in both])
        assert rho[g][0] == len(both) and rho[g][1] == (None if rx.std() == 0 else pytest.approx(np.corrcoef(rx, ry)[0, 1]))
        pos, neg = [t[2] for t in mine if t[4]], [t[2] for t in mine if not t[4]]
        assert areas[g] == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
