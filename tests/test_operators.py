import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import gains, text, vectors
from rankloom.operators import compare, estimators, judgements, metrics, protocol, ranking, retrieval, validate


def run_of(spark, scores):
    rows = [("s", "d", q, doc, float(v), i) for q, docs in scores.items() for i, (doc, v) in enumerate(docs.items())]
    return spark.createDataFrame(rows, "system string, dataset string, query_id string, doc_id string, score double, pos long").repartition(3)


def labels_of(spark, grades):
    rows = [("d", q, doc, float(g), float(g), i) for q, docs in grades.items() for i, (doc, g) in enumerate(docs.items())]
    return spark.createDataFrame(rows, "dataset string, query_id string, doc_id string, grade double, gain double, pos long").repartition(3)


RUN = {"left": {"ant": 4, "bee": 3, "cat": 3, "dog": 1}, "right": {"ant": 5, "bee": 5, "cat": 2, "dog": 1}}
GRADES = {"left": {"bee": 3, "dog": 1}, "right": {"bee": 2, "cat": 0}}


@pytest.mark.parametrize("k,success,mrr", [(1, 0.5, 0.0), (2, 0.5, 0.5), (3, 1.0, 0.5)])
def test_two_tie_rules_in_one_pass(spark, k, success, mrr):
    """By id, left's first relevant stands third and right's first; as the rows came, both stand second."""
    rows = metrics.classic(run_of(spark, RUN), labels_of(spark, GRADES), k).agg(F.avg("success"), F.avg("mrr")).first()
    assert rows[0] == pytest.approx(success) and rows[1] == pytest.approx(mrr)


def test_tie_rules_differ(spark):
    run, labels = run_of(spark, RUN), labels_of(spark, GRADES)
    value = lambda ties: {r.query_id: r.ndcg for r in metrics.ndcg(run, labels, [1], ties).collect()}
    assert value("doc_id_desc")["right"] == pytest.approx(1.0)
    assert value("input_order")["right"] == pytest.approx(0.0)
    assert value("group_mean")["right"] == pytest.approx(0.5)


def test_unranked_queries_count_zero(spark):
    run = run_of(spark, {"left": RUN["left"]})
    labels = labels_of(spark, GRADES)
    per = metrics.with_unranked(metrics.ndcg(run, labels, [5]), labels, ["s"], "ndcg")
    assert {r.query_id: r.ndcg for r in per.collect()}["right"] == 0.0
    assert metrics.two_level_mean(per, "ndcg").first().queries == 2


def test_protocols(spark):
    run, none = run_of(spark, RUN), spark.createDataFrame([], "dataset string, query_id string, doc_id string")
    pool = spark.createDataFrame([("d", "left", "dog", 0), ("d", "left", "ant", 1), ("d", "right", "right", 0)], "dataset string, query_id string, doc_id string, pos long")
    kept = protocol.restricted(run, pool, none, protocol.PRESETS["nanobeir"])
    assert {(r.query_id, r.doc_id, r.pos) for r in kept.collect()} == {("left", "dog", 0), ("left", "ant", 1)}
    assert protocol.restricted(run, pool, none, protocol.PRESETS["bright"]).count() == 8


def test_fusion_prefers_the_earlier_ranker(spark):
    rows = [("x", "d", "q", "a", 1.0, 0), ("x", "d", "q", "b", 0.5, 1), ("y", "d", "q", "b", 1.0, 0), ("y", "d", "q", "a", 0.5, 1)]
    run = spark.createDataFrame(rows, "system string, dataset string, query_id string, doc_id string, score double, pos long")
    assert [r.doc_id for r in ranking.fused(run, ["x", "y"]).orderBy("rank").collect()] == ["a", "b"]
    assert [r.doc_id for r in ranking.fused(run, ["y", "x"]).orderBy("rank").collect()] == ["b", "a"]


def test_student_t():
    # tabulated two-sided values
    for t, df, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (2.750, 30, 0.01), (1.960, 1e6, 0.05)):
        assert compare.two_sided_p(t, df) == pytest.approx(p, abs=2e-5)
    assert compare.two_sided_p(0.0, 5) == 1.0


def test_paired_t_is_undefined_without_spread(spark):
    rows = spark.createDataFrame([("a", "b", 0.1), ("a", "b", 0.1), ("a", "c", 0.2)], "a string, b string, delta double")
    assert all(r.t is None and r.p is None for r in compare.with_p(compare.paired_t(rows)).collect())


def test_bootstrap_covers_the_mean(spark):
    rows = spark.createDataFrame([("s", "d", str(i), float(i % 10)) for i in range(300)], "system string, dataset string, query_id string, value double")
    one, two = (compare.bootstrap(r, "value", 200).first() for r in (rows, rows.repartition(7)))
    assert one.low < 4.5 < one.high and one.high - one.low < 1.2
    assert (round(one.low, 9), round(one.high, 9)) == (round(two.low, 9), round(two.high, 9))


#: Four documents' comparisons and their abilities at l2 = 1e-3.
SEEN = [("a", "b", 1.0, 0.9), ("a", "c", 0.5, 0.7), ("b", "c", 2.0, 0.6), ("c", "d", 1.0, 0.8), ("b", "d", 1.0, 0.4), ("a", "d", 1.0, 0.95)]
ABILITY = {"a": 1.451788, "b": -0.367212, "c": -0.275314, "d": -0.809262}


def test_bradley_terry_anchor(spark):
    rows = spark.createDataFrame([("q", *x) for x in SEEN], "query_id string, winner string, loser string, weight double, soft_label double")
    got = {r.doc_id: r.theta for r in estimators.bradley_terry(rows, 1e-3).collect()}
    assert got == pytest.approx(ABILITY, abs=1e-4)


def test_rubric_items_are_recovered(spark):
    r = np.random.default_rng(7)
    gamma, beta = np.array([1.4, 0.9, 0.7]), np.array([-1.0, 0.2, 0.8])
    theta = r.normal(size=4000)
    p = 1 / (1 + np.exp(-gamma * (theta[:, None] - beta)))
    s = r.binomial(6, p)
    rows = spark.createDataFrame([(6, *map(int, x)) for x in s], "n int, s1 int, s2 int, s3 int")
    g, b = estimators.rubric_items(rows, 3)
    assert g.sum() == pytest.approx(3) and b.mean() == pytest.approx(0, abs=1e-9)
    assert np.allclose(g, gamma, atol=0.12)


def test_insertion_and_rasch(spark):
    rows = spark.createDataFrame([("q", "n", t, 1.0, 1 / (1 + math.exp(t - 0.7))) for t in np.linspace(-2, 2, 9).tolist()], "query_id string, doc_id string, other_theta double, weight double, label double")
    got = estimators.insert_document(rows).first()
    assert got.theta == pytest.approx(0.7, abs=0.02) and got.opponents == 9
    rows = spark.createDataFrame([(4, 4, 4), (4, 2, 2), (4, 0, 0)], "n int, s1 int, s2 int")
    theta = [r.theta for r in estimators.rasch_scores(rows, [-0.5, 0.5]).collect()]
    assert theta[0] > theta[1] > theta[2] and theta[1] == pytest.approx(0, abs=1e-6) and theta[0] == pytest.approx(-theta[2], abs=1e-6)


def test_balanced_groups_show_all_alike(spark):
    pools = [("d", f"q{n}", f"x{i}", i) for n in (3, 10, 12, 13, 31) for i in range(n)] + [("d", "q3", "x0", 9), ("d", "q3", None, 9)]
    frame = spark.createDataFrame(pools, "dataset string, query_id string, doc_id string, pos long")
    for window, windows in ((4, 6), (10, 7), (1, 5)):
        rows = estimators.balanced_groups(frame, window, windows).collect()
        again = estimators.balanced_groups(frame.repartition(3), window, windows).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
        for n in (3, 10, 12, 13, 31):
            mine = [r for r in rows if r.query_id == f"q{n}"]
            groups = {}
            for r in mine:
                groups.setdefault(r.window_no, []).append(r.doc_id)
            assert sorted(groups) == list(range(windows)) and all(len(g) == len(set(g)) == min(n, window) for g in groups.values())
            shown = [sum(r.doc_id == f"x{i}" for r in mine) for i in range(n)]
            assert max(shown) - min(shown) <= 1
            assert sorted(r.place for r in mine if r.window_no == 0) == list(range(min(n, window)))
    other = estimators.balanced_groups(frame, 4, 6, "1").collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, estimators.balanced_groups(frame, 4, 6).collect()))


def test_comparisons(spark):
    rows = spark.createDataFrame([(1, "q", "a", 1, 2.0), (1, "q", "b", 2, 2.0), (1, "q", "c", 3, 9.0), (2, "q", "z", 1, 1.0)], "record_id long, query_id string, doc_id string, position long, score double")
    got = {(r.winner, r.loser): (round(r.weight, 6), round(r.soft_label, 6)) for r in judgements.comparisons(rows).collect()}
    assert got == {("a", "b"): (0.666667, 0.5), ("c", "a"): (0.666667, 0.99), ("c", "b"): (0.666667, 0.99)}


def test_quantisation_and_cuts(spark):
    row = spark.createDataFrame([([3.0, 4.0, -1.0],)], "v array<float>").select(
        vectors.cut(F.col("v"), 2).alias("c"), vectors.quantise_int8(F.col("v"), -4.0, 4.0).alias("q"), vectors.sign_bits(F.col("v")).alias("b")
    ).first()
    assert row.c == pytest.approx([0.6, 0.8]) and row.q == [95, 127, -32] and row.b == [0b11000000]


def test_text(spark):
    row = spark.sql("SELECT ' T ' AS t, 'body ' AS b, '<a> & b ' AS x, 'Document 007' AS k").select(
        text.title_join(F.col("t"), F.col("b")), text.title_join(F.lit(None).cast("string"), F.col("b")), text.xml_escaped(F.col("x")), text.document_number(F.col("k")), text.document_number(F.lit("doc_x"))
    ).first()
    assert tuple(row) == ("T  body", "body", "&lt;a&gt; &amp; b", 7, None)
    docs = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, None), (3, "one")], "doc_id long, text string")
    assert [(r.chunk_id, r.text) for r in text.chunks(docs, 4, 1).orderBy("doc_id", "start").collect()] == [("1#0", "0 1 2 3"), ("1#1", "3 4 5 6"), ("1#2", "6 7 8 9"), ("3#0", "one")]


def test_gain_is_monotone(spark):
    rows = spark.range(-300, 300).select(gains.calibrated_gain(F.col("id") / 3.0, [1.0, 2.0], [-1.0, 1.0]).alias("g")).collect()
    values = [r.g for r in rows]
    assert values == sorted(values) and 0 <= values[0] < 1e-6 and values[-1] == pytest.approx(1)


def test_guards(spark):
    run = run_of(spark, RUN)
    assert validate.check_rankings(run).count() == 8
    with pytest.raises(ValueError, match="more than once"):
        validate.check_rankings(run.unionByName(run))
    with pytest.raises(ValueError, match="finite"):
        validate.check_rankings(run.withColumn("score", F.lit(float("nan"))))


def test_dense_top_leaves_out_what_has_no_vector(spark):
    bad = [(1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(6, [1.0, 0.0]), (7, [0.0, 2.0]), (8, [1.0, 1.0])]
    frame = spark.createDataFrame(bad + good, "id long, v array<double>").repartition(3)
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.dense_top(frame, frame, 5).collect()}
    assert got == {(a, b): sum(x * y for x, y in zip(u, v)) for a, u in good for b, v in good if a != b}
    many = spark.createDataFrame([(1, []), (2, None), (3, [[], [1.0, 0.0]]), (4, [[0.0, 1.0], None]), (5, [[2.0, 3.0], [3.0, 1.0]])], "id long, v array<array<double>>")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.dense_top(many, many, 5).collect()}
    assert got == {(3, 4): 0, (4, 3): 0, (3, 5): 3, (5, 3): 2 + 3, (4, 5): 3, (5, 4): 3 + 1}
    assert retrieval.dense_top(frame.limit(0), frame, 5).count() == retrieval.dense_top(frame, frame.limit(0), 5).count() == 0


def test_ndcg_mean_keeps_queries_without_a_positive_label(spark):
    run = spark.createDataFrame([("s", "d", "q1", "a", 1.0, 0), ("s", "d", "q2", "a", 1.0, 0)], "system string, dataset string, query_id string, doc_id string, score double, pos long")
    labels = spark.createDataFrame([("d", "q1", "a", 1.0, 1.0, 0), ("d", "q2", "a", 0.0, 0.0, 0)], "dataset string, query_id string, doc_id string, grade double, gain double, pos long")
    assert sorted(r.ndcg for r in metrics.ndcg(run, labels, [10]).collect()) == [0.0, 1.0]


def test_pruned_search_finds_the_same_from_fewer_rows(spark):
    import random

    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(int(r.expovariate(0.12)), 59)] for _ in range(n))
    docs = spark.createDataFrame([(i, text(r.randint(0, 40))) for i in range(600)] + [(700, None), (701, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(i, text(r.randint(1, 25))) for i in range(30)] + [(50, "nothing of it"), (51, None)], "query_id long, text string")
    for k in (1, 3, 10, 700):
        plain = retrieval.bm25_top(docs, queries, k).collect()
        pruned = retrieval.bm25_top(docs, queries, k, prune=True).collect()
        assert sorted(map(tuple, plain)) == sorted(map(tuple, pruned))
    asked = queries.select("query_id", F.explode(F.array_distinct(retrieval.terms(F.col("text")))).alias("term"))
    # weights as if each posting told by its word's rarity
    tf = docs.select("doc_id", F.explode(F.array_distinct(retrieval.terms(F.col("text")))).alias("term"))
    weights = tf.groupBy("term").agg((1 / F.count("*")).alias("w"))
    postings = tf.join(weights, "term")
    every, some = asked.join(postings, "term").count(), retrieval._pruned(asked, postings, 3, 6).count()
    assert some < 0.8 * every
