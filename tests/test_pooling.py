import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import text
from rankloom.operators import metrics, pools, protocol, retrieval, schedule, validate
from rankloom.plans import bindings, pooling
from rankloom.sources import rankings

SF = "/root/testdata/sf0.001"
RUN = "system string, dataset string, query_id string, doc_id string, score double, pos long"


def run_of(spark, rows):
    return spark.createDataFrame(rows, RUN)


@pytest.mark.parametrize("n,window,count", [(9, 4, 5), (30, 10, 7), (5, 5, 3), (12, 2, 20)])
def test_best_windows(n, window, count):
    """Each pick is worth as much as any start could be, by what all earlier picks left of every pair; the earliest of such."""
    values = np.random.default_rng(n).integers(0, 100, n) / 8
    picks = schedule.best_windows(values, window, count, 0.25)
    reach = np.array([[s <= p < s + window - 1 for p in range(n)] for s in range(n - window + 2)], float)  # pairs that a start shows
    for i, pick in enumerate(picks):
        worth = reach @ (values * 0.25 ** reach[picks[:i]].sum(0))
        assert worth[pick] > 0 and worth[pick] == worth.max() and (worth[:pick] < worth[pick]).all()
    assert len(picks) == count or not (reach @ (values * 0.25 ** reach[picks].sum(0)) > 0).any()
    assert schedule.best_windows(values, n + 2, count, 0.25) == [0]


def test_least_covered():
    starts = schedule.least_covered(12, 4, 9)
    assert sorted(starts[:3]) == [0, 4, 8]
    seen = np.zeros(12)
    for s in starts:
        seen[s : s + 4] += 1
    assert seen.max() - seen.min() == 0 and schedule.least_covered(3, 10, 2) == [0, 0]


def test_windows_of_every_query(spark):
    thetas, pairs = pooling._shown(spark, SF)
    values = schedule.observed_values(thetas, pairs, 20)
    by = {}
    for r in values.orderBy("query_id", "place").collect():
        by.setdefault(r.query_id, []).append(r)
    got = {}
    for r in schedule.adaptive_windows(values, 5, 6).collect():
        got.setdefault(r.query_id, {}).setdefault(r.window, {})[r.position] = r.doc_id
    assert set(got) == set(by)
    for q, rows in by.items():
        docs = [*[r.doc_id for r in rows], rows[-1].below]
        starts = schedule.best_windows(np.array([r.value for r in rows]), 5, 6, 0.3)
        assert [[w[k] for k in sorted(w)] for _, w in sorted(got[q].items())] == [docs[s : s + 5] for s in starts]
    groups = schedule.stratified_groups(thetas, 10, 12)
    again = {tuple(r) for r in schedule.stratified_groups(thetas.repartition(5), 10, 12).collect()}
    assert {tuple(r) for r in groups.collect()} == again
    order = {}
    for r in thetas.collect():
        order.setdefault(r.query_id, []).append((-r.theta, r.doc_id))
    for r in groups.groupBy("query_id", "window").agg(F.collect_set("doc_id").alias("d")).collect():
        docs = [d for _, d in sorted(order[r.query_id])]
        at = sorted(docs.index(d) for d in r.d)
        assert at == list(range(at[0], at[0] + min(10, len(docs))))


def test_refusals(spark):
    a, b_ = ("s", "d", "q", "x", 1.0, 0), ("t", "", "q", "x", 1.0, 0)
    run = run_of(spark, [a, b_])
    with pytest.raises(ValueError, match="more than once"):
        pools.concat(run, run_of(spark, [a]))
    with pytest.raises(ValueError, match="no rows of"):
        pools.selected(run, ["s", "nobody"])
    assert [r.system for r in pools.of_dataset(run, "d").collect()] == ["s"]
    assert [(r.system, r.dataset) for r in pools.of_dataset(run, "other").collect()] == [("t", "other")]
    with pytest.raises(ValueError, match="no rankings"):
        pools.of_dataset(run.filter("dataset = 'd'"), "other")
    with pytest.raises(ValueError, match="no such document"):
        pools.complete(pools.hydrated(run, spark.createDataFrame([("y", "t")], "doc_id string, body string")))
    theta = spark.createDataFrame([("d", "q", "x", 0.0, "fit")], "dataset string, query_id string, doc_id string, theta double, source string")
    with pytest.raises(ValueError, match="twice"):
        pools.overlaid(theta, theta)
    with pytest.raises(ValueError, match="no finite"):
        validate.grades(spark.createDataFrame([("1",), ("many",)], "score string"))
    with pytest.raises(ValueError, match="no metric"):
        metrics.by_name(run, bindings.labels(spark, SF), ["beauty"], 10)
    with pytest.raises(ValueError, match="there is a metric"):
        metrics.register("map", None)
    labels = spark.createDataFrame([("d", "other", "x", 1.0, 1.0, 0)], "dataset string, query_id string, doc_id string, grade double, gain double, pos long")
    none = spark.createDataFrame([], "dataset string, query_id string, doc_id string, pos long")
    with pytest.raises(ValueError, match="no query in common"):
        protocol.scored(run, labels, none, none, protocol.Protocol(), 10)


def test_folds(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError, match="different rows"):
        validate.folded(rows, ["k"], ["v"])
    assert {tuple(r) for r in validate.folded(rows, ["k"], ["v"], "last").collect()} == {(1, "a", 2, 0), (2, "c", 1, 1)}
    assert validate.kept_cases(rows, "flag").count() == 4


def test_components_of_long_chains(spark):
    edges = [("q", f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)] + [("r", "b", "a"), ("r", "x", "y")]
    got = {(r.query_id, r.node): r.component for r in pools.components(spark.createDataFrame(edges, "query_id string, a string, b string"), ["query_id"]).collect()}
    assert {got["q", f"n{i:03d}"] for i in range(71)} == {"n000"} and got["r", "b"] == "a" and got["r", "y"] == "x"


def test_rankings_are_written_and_read(spark, tmp_path):
    rows = [("s", "d", "q", "a", 2.5, 0), ("s", "d", "q", "b", 1.0, 1), ("s", "d", "p", "a", -1.0, 0)]
    for kind in ("parquet", "csv", "tsv", "jsonl"):
        path = str(tmp_path / f"run.{kind}")
        rankings.write_rankings(run_of(spark, rows), path)
        assert sorted(tuple(r)[:5] for r in rankings.read_rankings(spark, path).collect()) == sorted(r[:5] for r in rows)
    with pytest.raises(ValueError, match="no writer"):
        rankings.write_rankings(run_of(spark, rows), "x.bin")


def test_predictions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rankings, "MOST", 2)
    rows = [("s", "d", "q", x, 1.0, 0) for x in "abc"] + [("s", "d", "free", "a", 1.0, 0)]
    labels = spark.createDataFrame([("d", "q")], "dataset string, query_id string")
    got = rankings.predictions(run_of(spark, rows), labels)
    assert [(r.query_id, r.scores) for r in got.collect()] == [("q", {"c": 1.0, "b": 1.0})]
    with pytest.raises(ValueError, match="not ranked"):
        rankings.predictions(run_of(spark, rows), labels.union(spark.createDataFrame([("d", "lost")], labels.schema)))
    path = str(tmp_path / "predictions")
    rankings.write_predictions(got, path)
    rankings.write_predictions(got.withColumn("split", F.lit("dev")), path)
    assert {r.split for r in spark.read.json(path).collect()} == {"test", "dev"}


def test_nested_rows_and_records(spark, tmp_path):
    tables = {
        "corpus": spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string"), "queries": spark.createDataFrame([("q", "ask")], "query_id string, text string"),
        "qrels": spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.0)], "query_id string, doc_id string, grade double"),
    }
    rankings.write_rows(tables, str(tmp_path / "rows"))
    back = rankings.read_rows(spark, str(tmp_path / "rows"))
    assert all(sorted(map(tuple, back[k].collect())) == sorted(map(tuple, t.collect())) for k, t in tables.items())
    for kind in ("jsonl", "parquet", "null"):
        rankings.write_records(tables["qrels"], str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "jsonl")).count() == spark.read.parquet(str(tmp_path / "parquet")).count() == 2 and not (tmp_path / "null").exists()


def test_bad_grades_are_refused(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text(json.dumps({"_id": "a", "text": "x"}) + "\n")
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "q", "text": "x"}) + "\n")
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\ta\t1\n")
    assert [tuple(r) for r in rankings.read_beir(spark, str(tmp_path))["qrels"].collect()] == [("q", "a", 1.0)]
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\ta\tgood\n")
    with pytest.raises(ValueError, match="no finite"):
        rankings.read_beir(spark, str(tmp_path))


def test_text_policy(spark):
    rows = spark.createDataFrame([("a b  c d",), ("a",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.policy(F.col("t"), 3, "truncate")).collect()] == ["a b  c", "a", None]
    assert [r[0] for r in rows.select(text.policy(F.col("t"), 3, "keep")).collect()] == ["a b  c d", "a", None]
    with pytest.raises(Exception, match="more than 3 words"):
        rows.select(text.policy(F.col("t"), 3, "fail")).collect()


def test_bm25_in_any_script(spark):
    docs = spark.createDataFrame([(1, "naïve Über wort"), (2, "привет мир"), (3, "the the")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "über the"), (8, "МИР")], "query_id long, text string")
    assert {(r.query_id, r.doc_id) for r in retrieval.bm25_top(docs, queries, 2, stop=("the",)).collect()} == {(7, 1), (8, 2)}
    filled = retrieval.bm25_top(docs, queries, 3, stop=("the",), fill=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in filled] == [(7, 1), (7, 2), (7, 3), (8, 2), (8, 1), (8, 3)]
