"""The store's stream against its batch fold, for every way of cutting the lines into batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.streaming import store

T = datetime(2024, 1, 1)


def lines(seed, n=160, keys=13):
    r = random.Random(seed)
    return [
        (r.choice(("rubric", "tournament")), i + 1, f"r{r.randrange(keys)}", r.random() < 0.6, r.random() < 0.2, T + timedelta(hours=r.randrange(40)), "q", "random", "j", None, "a")
        for i in range(n)
    ]


def fold(rows):
    """The rule as stated: valid beats invalid, then the later time, the new line of equal ones; next to a tombstone the later line."""
    out = {}
    for row in rows:
        key, old = (row[0], row[2]), out.get((row[0], row[2]))
        if old is None or old[4] or row[4] or (row[3] if row[3] != old[3] else row[5] >= old[5]):
            out[key] = row
    return out


def write(spark, rows, folder):
    store.append(spark.createDataFrame(rows, store.SCHEMA).coalesce(1), folder)


@pytest.mark.parametrize("seed,sizes", [(1, [160]), (2, [1, 50, 9, 100]), (3, [40, 40, 40, 40])])
def test_stream_state_equals_the_fold_after_every_batch(spark, tmp_path, seed, sizes):
    folder, changes, checkpoint = (str(tmp_path / x) for x in ("store", "changes", "checkpoint"))
    rows, upto = lines(seed), 0
    for size in sizes:
        write(spark, rows[upto : upto + size], folder)
        upto += size
        store.stand(store.read_stream(spark, folder, 1), changes, checkpoint).awaitTermination(120)  # started anew each time
        want = {k: (v[1], v[3], v[4], v[5]) for k, v in fold(rows[:upto]).items()}
        got = {(r.stage, r.record_id): (r.pos, r.valid, r.tombstone, r.recorded_at) for r in store.standing(spark, checkpoint).collect()}
        assert got == want
    batch = {(r.stage, r.record_id): r.pos for r in store.records(spark, folder).collect()}
    assert batch == {k: v[1] for k, v in fold(rows).items()}
    changed = spark.read.parquet(changes).groupBy("batch").count().orderBy("batch").collect()
    touched, upto = [], 0
    for size in sizes:
        touched.append(len({(x[0], x[2]) for x in rows[upto : upto + size]}))
        upto += size
    assert [c["count"] for c in changed] == touched  # only a batch's own records


def test_torn_lines_are_asked_again(spark, tmp_path):
    folder = tmp_path / "store"
    write(spark, lines(4, 20), str(folder))
    (folder / "part-torn.json").write_text('{"stage":"rubric","pos":99,"record_id":"r1","valid":true,"recorded_at":"2024-01-01T00:00:00.000Z"}\n{"stage":"rubric","pos":100,"rec')
    assert {r.pos for r in store.read(spark, str(folder)).collect()} == {*range(1, 21), 99}


def test_retired_records_are_asked_again(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = lines(5)
    write(spark, rows, folder)
    stand = fold(rows)
    alive = {k for k, v in stand.items() if not v[4]}
    assert {(r.stage, r.record_id) for r in store.live(store.records(spark, folder)).collect()} == alive
    which = spark.createDataFrame([("rubric", f"r{i}") for i in range(6)] + [("rubric", "r0"), ("rubric", "none")], "stage string, record_id string")
    dead = {k for k in alive if k[0] == "rubric" and k[1] in {f"r{i}" for i in range(6)}}
    assert store.retire(spark, folder, which, "new prompt", T) == len(dead) > 0
    assert {(r.stage, r.record_id) for r in store.live(store.records(spark, folder)).collect()} == alive - dead
    places = [r.pos for r in store.read(spark, folder).filter("reason = 'new prompt'").collect()]
    assert sorted(places) == list(range(161, 161 + len(dead)))
    assert store.retire(spark, folder, which, "again", T) == 0
    again = next(iter(dead))
    write(spark, [(*again[:1], 900, again[1], False, False, T - timedelta(days=9), "q", "random", "j", None, "late clock")], folder)
    assert again in {(r.stage, r.record_id) for r in store.live(store.records(spark, folder)).collect()}


def test_lines_out_of_order_and_unsound_lines_are_refused(spark, tmp_path):
    folder, changes, checkpoint = (str(tmp_path / x) for x in ("store", "changes", "checkpoint"))
    row = ("rubric", 5, "r", True, False, T, "q", "p", "j", None, "a")
    write(spark, [row], folder)
    store.stand(store.read_stream(spark, folder, 1), changes, checkpoint).awaitTermination(120)
    write(spark, [(row[0], 4, *row[2:])], folder)
    with pytest.raises(Exception, match="has been folded"):
        store.stand(store.read_stream(spark, folder, 1), changes, checkpoint).awaitTermination(120)
    with pytest.raises(Exception, match="a line lacks"):
        write(spark, [(row[0], None, *row[2:])], folder)
    assert store.live(store.records(spark, folder).filter(F.lit(False))).count() == 0


def test_reparse_reads_stored_answers_again(spark, tmp_path):
    from rankloom.functions import answers

    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    good = '{"doc_1": {"criteria": {"C1": 1, "C2": 0}}}'
    rows = [("rubric", i, f"r{i}", False, i == 3, T, "q", "random", "j", "old parser", a) for i, a in enumerate([good, "no", '{"doc_1": {"criteria": {"C1": 1}}}', good, None], 1)]
    write(spark, rows, source)
    parse = lambda d: d.withColumn("category", answers.rubric_verdicts(F.col("answer"), F.lit(1), 2)["category"])
    assert store.reparse(spark, source, target, parse, "v2") == 4
    got = {r.record_id: (r.valid, r.reason, r.pos, r.answer) for r in store.records(spark, target).collect()}
    assert got == {"r1@v2": (True, None, 1, good), "r2@v2": (False, "empty", 2, "no"), "r4@v2": (True, None, 4, good), "r5@v2": (False, "empty", 5, None)}
    for bad, why in (((source, source), "into itself"), ((source, target), "already holds"), ((target, str(tmp_path / "c")), "already")):
        with pytest.raises(ValueError, match=why):
            store.reparse(spark, *bad, parse, "v2")
