"""JSON rankings in every shape, and corpora read strictly."""

import json

import pytest

from rankloom.sources import rankings


def file(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_json_rankings_in_every_shape(spark, tmp_path):
    rows = [
        {"query_id": "q1", "system": "s", "dataset": "d", "scores": {"a": 2.5, "b": 1}}, {"id": "q2", "system": "s", "doc_ids": ["x", "y"], "scores": [0.5, 0.25]},
        {"query_id": "q3", "system": "s", "ranking": ["u", "v", "w"]}, {"query_id": "q4", "system": "s", "doc_id": "z", "score": 7}, "", {"query_id": 5, "system": "s", "doc_ids": []},
    ]
    got = {tuple(r) for r in rankings.read_json(spark, file(tmp_path / "r.jsonl", rows), "other").collect()}
    assert got == {
        ("s", "d", "q1", "a", 2.5, 0), ("s", "d", "q1", "b", 1.0, 1), ("s", "other", "q2", "x", 0.5, 0), ("s", "other", "q2", "y", 0.25, 1),
        ("s", "other", "q3", "u", 3.0, 0), ("s", "other", "q3", "v", 2.0, 1), ("s", "other", "q3", "w", 1.0, 2), ("s", "other", "q4", "z", 7.0, 0),
    }
    assert rankings.read_json(spark, file(tmp_path / "none.jsonl", [])).count() == 0


@pytest.mark.parametrize("row,why", [
    ({"system": "s", "scores": {"a": 1}}, "without a query_id"), ({"query_id": "q", "doc_id": "a"}, "without its score"), ({"query_id": "q", "doc_ids": ["a", "b"], "scores": [1]}, "differ in length"),
    ({"query_id": "q"}, "without scores or documents"), ({"query_id": "q", "scores": [1]}, "without scores or documents"), ('{"query_id": "q", ', "not a JSON object"), ("text", "not a JSON object"),
])
def test_json_rankings_refused(spark, tmp_path, row, why):
    with pytest.raises(Exception, match=why):
        rankings.read_json(spark, file(tmp_path / "r.jsonl", [{"query_id": "q0", "doc_ids": ["a"]}, row])).collect()


def test_one_object_of_all_queries(spark, tmp_path):
    path = tmp_path / "run.json"
    path.write_text(json.dumps({"q1": {"a": 1.5, "b": 2}, "q2": ["x", "y"], "q3": []}, indent=1))
    got = {tuple(r) for r in rankings.read_json_map(spark, str(path), "s", "d").collect()}
    assert got == {("s", "d", "q1", "a", 1.5, 0), ("s", "d", "q1", "b", 2.0, 1), ("s", "d", "q2", "x", 2.0, 0), ("s", "d", "q2", "y", 1.0, 1)}
    path.write_text('{"q": 3}')
    with pytest.raises(Exception, match="neither scores nor documents for query: q"):
        rankings.read_json_map(spark, str(path), "s").collect()


def corpus(path, corpus=(), queries=(), qrels=()):
    file(path / "corpus.jsonl", [{"doc_id": "a", "text": "A"}, {"doc_id": "b", "text": ""}, *corpus])
    file(path / "queries.jsonl", [{"query_id": "q", "query": "Q", "instruction": "find"}, {"query_id": "p", "query": "P"}, *queries])
    file(path / "qrels.jsonl", [{"query_id": "q", "qrels": {"a": 2, "b": 0.5}}, *qrels])
    return str(path)


def read(spark, folder):
    return {k: sorted(map(tuple, v.collect()), key=str) for k, v in rankings.read_corpus(spark, folder).items()}


def test_corpus_folder(spark, tmp_path):
    got = read(spark, corpus(tmp_path / "c"))
    assert got == {"corpus": [("a", "A"), ("b", "")], "queries": [("p", "P", None), ("q", "Q", "find")], "qrels": [("q", "a", 2.0), ("q", "b", 0.5)]}


@pytest.mark.parametrize("change,why", [
    ({"corpus": [{"doc_id": "c", "text": "C", "title": "T"}]}, "unknown keys: title"), ({"corpus": [{"doc_id": "c"}]}, "nothing for: text"), ({"corpus": [{"text": "C"}]}, "nothing for: doc_id"),
    ({"corpus": [{"doc_id": "c", "text": None}]}, "nothing for: text"), ({"corpus": ['{"doc_id": "c", "te']}, "not a record"), ({"corpus": ["[1]"]}, "not a record"), ({"corpus": [{"doc_id": "a", "text": "again"}]}, "more than once"),
    ({"queries": [{"query_id": "r", "text": "R"}]}, "unknown keys: text"), ({"queries": [{"query_id": "q", "query": "again"}]}, "more than once"), ({"qrels": [{"query_id": "p", "qrels": {"a": "high"}}]}, "no finite number"),
])
def test_corpus_rows_refused(spark, tmp_path, change, why):
    with pytest.raises(Exception, match=why):
        read(spark, corpus(tmp_path / "c", **change))
