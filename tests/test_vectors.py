"""Stores read equal to their arrays, by ranges; and refused where the record and the arrays differ."""

import json

import numpy as np
import pytest

from rankloom.operators import retrieval
from rankloom.sources import vectors


def stores(path, ragged, dtype="float32"):
    r = np.random.default_rng(1)
    if ragged:
        corpus = [r.normal(size=(n, 6)).astype(dtype) for n in [3, 0, 1, 40, *r.integers(0, 9, 200)]]
        queries = [r.normal(size=(2, 6)).astype(dtype) for _ in range(3)]
    else:
        corpus, queries = r.normal(size=(204, 6)).astype(dtype), r.normal(size=(3, 6)).astype(dtype)
    vectors.write_store(str(path), [f"d{i}" for i in range(204)], corpus, [f"q{i}" for i in range(3)], queries, ragged)
    return corpus, queries


@pytest.mark.parametrize("ragged", [True, False])
@pytest.mark.parametrize("dtype", ["float32", "float64", "float16"])
@pytest.mark.parametrize("partition", [100, 700, 1 << 20])
def test_store_equals_its_arrays(spark, tmp_path, ragged, dtype, partition, monkeypatch):
    corpus, queries = stores(tmp_path, ragged, dtype)
    monkeypatch.setattr(vectors, "BATCH", 300)
    for side, items in (("corpus", corpus), ("queries", queries)):
        frame = vectors.read_store(spark, str(tmp_path), side, partition)
        got = {r.id: r.vector for r in frame.collect()}
        assert len(got) == len(items)
        for i, x in enumerate(items):
            assert got[f"{side[0].replace('c', 'd')}{i}"] == x.astype("float64" if dtype == "float64" else "float32").tolist()


def test_partitions_read_only_their_bytes(tmp_path, monkeypatch):
    stores(tmp_path, True)
    source = vectors.VectorSource({"path": str(tmp_path), "side": "corpus", "ragged": "true", "partition": "2000"})
    reader = source.reader(None)
    parts = reader.partitions()
    assert len(parts) > 5 and [p.first for p in parts[1:]] == [p.last for p in parts[:-1]] and parts[-1].last == 204
    read, plain = [], vectors.npy_rows
    monkeypatch.setattr(vectors, "npy_rows", lambda a, x, y: read.append((a.path.rsplit("/", 1)[1], x, y)) or plain(a, x, y))
    offsets = np.load(tmp_path / "corpus_offsets.npy")
    for p in parts:
        read.clear()
        rows = sum(b.num_rows for b in reader.read(p))
        assert rows == p.last - p.first and read[0] == ("corpus_offsets.npy", p.first, p.last + 1)
        spans = [(x, y) for _, x, y in read[1:]]
        assert spans[0][0] == offsets[p.first] and spans[-1][1] == offsets[p.last] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_store_feeds_search(spark, tmp_path):
    corpus, queries = stores(tmp_path, False)
    number = "cast(substring(id, 2) as long) as id"
    docs, asked = (vectors.read_store(spark, str(tmp_path), s).selectExpr(number, "vector") for s in ("corpus", "queries"))
    got = retrieval.dense_top(docs.filter("id >= 3"), asked, 1).collect()
    for r in got:
        scores = corpus[3:].astype(float) @ queries[r.query_id].astype(float)
        assert r.doc_id == 3 + int(scores.argmax()) and r.score == pytest.approx(scores.max(), abs=1e-6)
    assert len(got) == 3


def test_refusals(spark, tmp_path):
    stores(tmp_path / "a", True)
    path = tmp_path / "a"
    record = json.loads((path / "store.json").read_text())
    for change in ({"full_width": 5}, {"dtype": "float64"}, {"count": 203}, {"doc_ids": record["doc_ids"][1:]}, {"layout": "single"}):
        (path / "store.json").write_text(json.dumps(record | change))
        with pytest.raises(ValueError, match="the record says"):
            vectors.read_store(spark, str(path))
    (path / "store.json").write_text(json.dumps(record | {"layout": "other"}))
    with pytest.raises(ValueError, match="no record"):
        vectors.read_store(spark, str(path))
    (path / "store.json").write_text(json.dumps(record))
    offsets = np.load(path / "corpus_offsets.npy")
    bad = offsets.copy()
    bad[5], bad[6] = bad[6] + 3, bad[5]
    np.save(path / "corpus_offsets.npy", bad)
    with pytest.raises(Exception, match="offsets that fall"):
        vectors.read_store(spark, str(path)).collect()
    np.save(path / "corpus_offsets.npy", offsets[:-1])
    with pytest.raises(ValueError, match="offsets from 0"):
        vectors.read_store(spark, str(path))
    np.save(path / "corpus_offsets.npy", offsets)
    data = (path / "corpus.npy").read_bytes()
    (path / "corpus.npy").write_bytes(data[:-1])
    with pytest.raises(ValueError, match="cut short"):
        vectors.read_store(spark, str(path))
    (path / "corpus.npy").write_bytes(b"text" * 9)
    with pytest.raises(ValueError, match="no .npy"):
        vectors.read_store(spark, str(path))
    np.save(path / "corpus.npy", np.asfortranarray(np.ones((3, 6))))
    with pytest.raises(ValueError, match="C order"):
        vectors.read_store(spark, str(path))
