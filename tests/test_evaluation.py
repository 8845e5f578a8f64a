import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import compare, evaluation

SCHEMA = "system string, metric string, k int, dataset string, query_id string, value double"


def values():
    r = random.Random(9)
    out = []
    for s, lift in (("a", 0.0), ("b", 0.15), ("c", 0.02)):
        for d, n in (("x", 30), ("y", 12)):
            for q in range(n - (s == "c")):
                base = random.Random(f"{d}{q}").random()
                out += [(s, "ndcg", 10, d, f"q{q}", base + lift * r.random()), (s, "recall", 10, d, f"q{q}", r.random() if q else None)]
        out.append((s, "recall", 10, "empty", "q0", None))
    return out + [("d", "recall", 10, "x", "q0", None)]


def means(rows, pick):
    by = {}
    for s, m, k, d, q, v in rows:
        if pick(s, m):
            by.setdefault(d, []).append(v)
    return {d: [v for v in x if v is not None] for d, x in by.items()}


def test_summary(spark):
    rows = values()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r.system, r.metric, r.dataset): r for r in evaluation.summary(frame, 300, 1).collect()}
    for s, m in {(r[0], r[1]) for r in rows}:
        per = means(rows, lambda a, b: (a, b) == (s, m))
        for d, x in per.items():
            r = got.pop((s, m, d))
            assert r.num_queries == len(x) and r.num_datasets == bool(x) and r.value == (pytest.approx(np.mean(x)) if x else None) and r.ci_low is None
        r, defined = got.pop((s, m, None)), [np.mean(x) for x in per.values() if x]
        assert r.num_queries == sum(map(len, per.values())) and r.num_datasets == len(defined)
        if defined:
            assert r.value == pytest.approx(np.mean(defined)) and r.ci_low < r.value < r.ci_high
        else:
            assert r.value is None and r.ci_low is None
    assert not got
    assert evaluation.summary(frame, 0).filter("ci_low IS NOT NULL").count() == 0 and evaluation.summary(frame.limit(0), 10).count() == 0


def test_comparison(spark):
    rows = [r for r in values() if r[0] != "d"]
    frame = spark.createDataFrame(rows, SCHEMA)
    ndcg, recall = frame.filter("metric = 'ndcg'"), frame.filter("metric = 'recall'")
    got = {(r.a, r.b): r for r in evaluation.comparison(ndcg, draws=300, flips=recall).collect()}
    v = {(s, m, d, q): x for s, m, _, d, q, x in rows if x is not None}
    assert sorted(got) == list(itertools.combinations("abc", 2))
    for (a, b), r in got.items():
        both = [(d, v[a, "ndcg", d, q], v[b, "ndcg", d, q], d, q) for s, m, d, q in v if (s, m) == (a, "ndcg") and (b, "ndcg", d, q) in v]
        for i, side in ((1, r.value_a), (2, r.value_b)):
            assert side == pytest.approx(np.mean([np.mean([x[i] for x in both if x[0] == d]) for d in ("x", "y")]))
        diff = np.array([x[2] - x[1] for x in both])
        t = diff.mean() / (diff.std(ddof=1) / len(diff) ** 0.5)
        assert r.t == pytest.approx(t) and r.p == pytest.approx(compare.two_sided_p(t, len(diff) - 1)) and r.significant == (r.p < 0.05)
        assert r.num_queries == len(both) and r.delta == pytest.approx(r.value_b - r.value_a) and r.ci_low < r.delta < r.ci_high
        flips = sum((a, "recall", d, q) in v and (b, "recall", d, q) in v and (y - x) * (v[b, "recall", d, q] - v[a, "recall", d, q]) < 0 for _, x, y, d, q in both)
        assert r.sign_flips == flips
    one = evaluation.comparison(ndcg, "b", draws=0).collect()
    assert sorted((r.a, r.b) for r in one) == [("b", "a"), ("b", "c")] and {(r.sign_flips, r.ci_low) for r in one} == {(None, None)}
    with pytest.raises(ValueError, match="two systems"):
        evaluation.comparison(ndcg.filter("system = 'a'"))
    with pytest.raises(ValueError, match="among them"):
        evaluation.comparison(ndcg, "nobody")
    with pytest.raises(ValueError, match="share no scored query"):
        evaluation.comparison(ndcg.filter((F.col("system") != "a") | (F.col("dataset") == "x")).filter((F.col("system") != "b") | (F.col("dataset") == "y")), draws=0)
