import gzip
import json

import pytest
from pyspark.sql import functions as F

from rankloom.operators.judgements import latest
from rankloom.functions import answers
from rankloom.sources import hub, rankings
from rankloom.streaming import log


def test_trec_round_trip(spark, tmp_path):
    rows = [("s", "d", "q", "a", 2.5, 0), ("s", "d", "q", "b", 1.0, 1)]
    run = spark.createDataFrame(rows, "system string, dataset string, query_id string, doc_id string, score double, pos long")
    path = str(tmp_path / "run.trec")
    rankings.write_trec(run, path)
    assert sorted(tuple(r)[:5] for r in rankings.read_rankings(spark, path, "d").collect()) == [r[:5] for r in rows]
    (tmp_path / "bad.trec").write_text("q Q0 a 1 2.0\n")
    with pytest.raises(ValueError, match="six fields"):
        rankings.read_trec(spark, str(tmp_path / "bad.trec"))


def test_json_shapes(spark, tmp_path):
    lines = [
        {"system": "s", "query_id": "1", "scores": {"a": 2, "b": 1}}, {"system": "s", "query_id": "2", "doc_ids": ["x", "y"], "scores": [0.5, 0.25]},
        {"system": "s", "query_id": "3", "doc_ids": ["x", "y", "z"]},
    ]
    (tmp_path / "r.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    got = {(r.query_id, r.doc_id): r.score for r in rankings.read_rankings(spark, str(tmp_path / "r.jsonl"), "d").collect()}
    assert got == {("1", "a"): 2, ("1", "b"): 1, ("2", "x"): 0.5, ("2", "y"): 0.25, ("3", "x"): 3, ("3", "y"): 2, ("3", "z"): 1}


def test_aliases(spark):
    rows = spark.createDataFrame([("m", 7, "x", 1)], "model string, qid int, docno string, sim int")
    assert tuple(rankings.named(rows, "d").drop("pos").first()) == ("m", "d", "7", "x", 1.0)
    with pytest.raises(ValueError, match="no column for score"):
        rankings.named(rows.drop("sim"))


def test_beir(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    with gzip.open(tmp_path / "corpus.jsonl.gz", "wt") as f:
        f.write('{"_id": "1", "title": "t", "text": "x"}\n{"id": "2"}\n')
    with gzip.open(tmp_path / "queries.jsonl.gz", "wt") as f:
        f.write('{"_id": "q", "text": "what"}\n')
    with gzip.open(tmp_path / "qrels/test.tsv.gz", "wt") as f:
        f.write("query-id\tcorpus-id\tscore\nq\t1\t2\n")
    tables = rankings.read_beir(spark, str(tmp_path), suffix=".gz")
    assert sorted(map(tuple, tables["corpus"].collect())) == [("1", "t", "x"), ("2", "", "")] and tuple(tables["qrels"].first()) == ("q", "1", 2.0)
    rankings.write_beir(tables, str(tmp_path / "out"))
    again = rankings.read_beir(spark, str(tmp_path / "out"))
    assert all(sorted(map(tuple, again[k].collect())) == sorted(map(tuple, tables[k].collect())) for k in tables)
    with pytest.raises(ValueError, match="whole"):
        rankings.write_beir(tables | {"qrels": tables["qrels"].withColumn("grade", F.lit(0.5))}, str(tmp_path / "no"))


def test_nested_rows(spark):
    rows = spark.createDataFrame([("q", "what", ["a", "b"], ["A", "B"], {"a": 1.0})], "query_id string, query string, doc_ids array<string>, docs array<string>, qrels map<string,double>")
    tables = rankings.flatten_rows(rows)
    assert sorted(map(tuple, tables["corpus"].collect())) == [("a", "A"), ("b", "B")] and tuple(tables["qrels"].first()) == ("q", "a", 1.0)


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for n in range(4):
        lines = [{"key": k % 7, "record_id": n * 10 + k, "query_id": "q", "phase": "random", "valid": (n + k) % 3 > 0, "recorded_at": f"2024-01-0{1 + (n * k) % 5}T00:00:00Z"} for k in range(10)]
        (folder / f"{n}.json").write_text("".join(json.dumps(x) + "\n" for x in lines) + ('{"key": 1, "rec' if n == 3 else ""))
    stream = log.read_stream(spark, str(folder), files=1)
    log.keep_latest(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "state/generation=3")).collect()
    want = latest(spark.read.schema(log.SCHEMA).json(str(folder)).filter("key IS NOT NULL"), ["key"], ["record_id"])
    assert sorted(map(tuple, got)) == sorted(tuple(r[c] for c in got[0].asDict()) for r in want.collect())

    out = log.windowed_coverage(log.read_stream(spark, str(folder))).writeStream.format("memory").queryName("coverage_").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert spark.table("coverage_").columns == ["start", "phase", "windows", "invalid"]


def test_hub_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([("d", "q", "a", 2.0, 0.5, 1.5), ("d", "q", "b", 0.0, None, None)], "dataset string, query_id string, doc_id string, grade double, gain double, theta double")
    pools = spark.createDataFrame([("d", "q", "b", 1), ("d", "q", "a", 0)], "dataset string, query_id string, doc_id string, pos int")
    tables = {"labels": labels, "pools": pools, "excluded": pools.select("dataset", "query_id", "doc_id").limit(1), "corpus": spark.range(2), "queries": spark.range(1)}
    hub.write(tables, str(tmp_path / "h"))
    again = hub.read(spark, str(tmp_path / "h"), "d")
    assert sorted(map(tuple, again["labels"].collect())) == sorted(map(tuple, labels.collect()))
    assert sorted((r.pos, r.doc_id) for r in again["pools"].collect()) == [(0, "a"), (1, "b")] and again["excluded"].count() == 1
    both = hub.suite({"x": again, "y": again})
    assert {r.dataset for r in both["labels"].select("dataset").distinct().collect()} == {"x", "y"} and both["pools"].count() == 4
    hub.write(tables | {"labels": labels.withColumn("gain", F.lit(None).cast("double"))}, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="without a gain"):
        hub.read(spark, str(tmp_path / "bad"))


@pytest.mark.parametrize("text,slots,category", [
    ('{"doc_1": 2, "Document 2": 1.5}', 2, "ok"), ('<think>{"1": 9}</think> ```json\n{"1": 1, "2": 2}\n``` done', 2, "ok"), ('{"1": 1} trailing {', 1, "ok"),
    ('{"1": 1}', 2, "incomplete"), ('{"1": 1, "3": 1}', 2, "schema"), ('{"1": "x"}', 1, "schema"), ('{"1": NaN}', 1, "schema"), ('{"1": 1, "1": 2}', 1, "duplicate"),
    ('{"1": 1', 1, "json"), ("nothing", 1, "empty"), (None, 1, "empty"), ('{"a\\_b": 1}', 1, "schema"),
])
def test_answers(text, slots, category):
    assert answers.listwise(text, slots)["category"] == category
