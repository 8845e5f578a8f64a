"""The judgement store: lines appended in immutable parts, the standing line of each record kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rankloom.operators.judgements import superseded

#: A line: its place in the store, its record, and what the rule of standing looks at.
LINE = "pos long, record_id string, valid boolean, tombstone boolean, recorded_at timestamp"
SCHEMA = f"stage string, {LINE}, query_id string, phase string, judge string, reason string, answer string"
KEYS = ["stage", "record_id"]
STATE = "pos long, valid boolean, tombstone boolean, recorded_at timestamp"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append(lines: DataFrame, folder: str) -> None:
    """Appends ``lines(SCHEMA)``: each part file appears whole when its job commits, and none is written again.

    Places must follow those already in the store: the caller deals them out, as from one clock or counter. Lines
    without a stage, record, place or time are refused.
    """
    needed = [c for c in ("stage", "pos", "record_id", "valid", "recorded_at")]
    sound = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in needed]) == 1, F.raise_error(F.lit(f"a line lacks one of {', '.join(needed)}"))).otherwise(F.col("stage"))
    rows = lines.select(*[c.split()[0] for c in SCHEMA.split(", ")]).withColumn("stage", sound).withColumn("tombstone", F.coalesce("tombstone", F.lit(False)))
    rows.write.mode("append").json(folder)


def _whole(rows: DataFrame) -> DataFrame:
    """Lines but for torn ones: a line that a writer did not finish has no place or no time, and its window is asked again."""
    return rows.filter("stage IS NOT NULL AND pos IS NOT NULL AND record_id IS NOT NULL AND valid IS NOT NULL AND recorded_at IS NOT NULL").withColumn("tombstone", F.coalesce("tombstone", F.lit(False)))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All whole lines of the store."""
    return _whole(spark.read.schema(SCHEMA).json(folder))


def read_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """The same as a stream, ``files`` part files a batch at most."""
    return _whole(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(folder))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The standing line of each record, tombstones included, with all its columns: by one pass over the lines."""
    lines = read(spark, folder)
    stands = superseded(lines, KEYS, within_store=True).select(*KEYS, F.col("line.pos").alias("pos"))
    return lines.join(stands, [*KEYS, "pos"], "left_semi").dropDuplicates([*KEYS, "pos"])


def live(standing: DataFrame) -> DataFrame:
    """The records that count: their standing line is no tombstone."""
    return standing.filter("NOT tombstone")


def retire(spark: SparkSession, folder: str, which: DataFrame, reason: str, at) -> int:
    """Appends a tombstone for each live record of ``which(stage, record_id)``; returns how many.

    A tombstone keeps the line's query, phase and judge, and follows all lines that there are. ``at`` is its time.
    """
    standing = live(records(spark, folder)).join(which.select(*KEYS).distinct(), KEYS, "left_semi")
    last = read(spark, folder).agg(F.max("pos")).first()[0] or 0
    # places by record, in parts: each part's share follows the shares before it
    rows = standing.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).withColumn("part", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id() % F.lit(1 << 33))
    sizes = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    if not total:
        return 0
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part"))
    dead = rows.withColumns({
        "pos": (F.lit(last + 1) + shift + F.col("at_")).cast("long"), "valid": F.lit(False), "tombstone": F.lit(True), "reason": F.lit(reason),
        "answer": F.lit(None).cast("string"), "recorded_at": F.lit(at).cast("timestamp"),
    })
    append(dead, folder)
    return total


class _Standing(StatefulProcessor):
    """One state a record: the line that stands. A batch's lines are folded into it in the store's order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.line = handle.getValueState("line", STATE)
        self.seen = handle.getValueState("seen", "pos long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("pos")
        seen = self.seen.get()[0] if self.seen.exists() else None
        old = self.line.get() if self.line.exists() else None
        for pos, valid, dead, at in zip(new["pos"].tolist(), new["valid"].tolist(), new["tombstone"].tolist(), new["recorded_at"].dt.to_pydatetime()):
            if seen is not None and pos <= seen:
                if old is not None and pos == seen:
                    continue  # the same line again
                raise ValueError(f"record {key}: line {pos} comes after line {seen} has been folded")
            seen = pos
            if old is None or dead or old[2] or (valid if valid != old[1] else at >= old[3]):
                old = (pos, bool(valid), bool(dead), at)
        self.line.update(tuple(old))
        self.seen.update((seen,))
        yield pd.DataFrame({"stage": [key[0]], "record_id": [key[1]], "pos": [old[0]], "valid": [old[1]], "tombstone": [old[2]], "recorded_at": [old[3]]})

    def close(self) -> None:
        pass


def stand(stream: DataFrame, changes: str, checkpoint: str) -> StreamingQuery:
    """Folds the stream of lines into one state a record; the standing lines that a batch changes are appended to ``changes``.

    A batch touches the state of its own records alone, however many there are, and the state is part of the checkpoint:
    a query started again goes on from it. Of equal places the first line counts; a line whose place lies before one
    already folded is refused, as the rule of tombstones depends on the order. ``standing`` reads the state itself.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = stream.select("stage", "record_id", "pos", "valid", "tombstone", "recorded_at").groupBy(*KEYS).transformWithStateInPandas(
        _Standing(), f"stage string, record_id string, {STATE}", "Update", "None"
    )

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")  # a batch run again replaces its own part

    return rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(stage, record_id, pos, valid, tombstone, recorded_at): the state as the last finished batch left it."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "line").load()
    return rows.select("key.stage", "key.record_id", *[f"value.{c.split()[0]}" for c in STATE.split(", ")])


def reparse(spark: SparkSession, source: str, target: str, read_answer, version: str) -> int:
    """Reads every standing line's answer again into a new store; returns how many lines it holds.

    ``read_answer`` takes the lines and adds ``category``: ``ok`` makes a line valid, anything else not, and is its
    reason then. Records keep their window, judge and times, and get ids of their own: the old id with ``version``, so
    that two parsers' records never meet. Tombstones stay behind. A target that holds lines, or is the source, is
    refused, as is a version that the source's ids end in already.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a store cannot be read into itself")
    kept = live(records(spark, source))
    try:
        there = not read(spark, target).isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = False
    if there:
        raise ValueError(f"{target} already holds a store")
    mark = f"@{version}"
    if not kept.filter(F.col("record_id").endswith(mark)).isEmpty():
        raise ValueError(f"{source} was read by version {version} already")
    good = F.col("category") == "ok"
    lines = read_answer(kept).withColumns({"valid": F.coalesce(good, F.lit(False)), "reason": F.when(~good, F.col("category"))})
    lines = lines.withColumn("record_id", F.concat(F.regexp_replace("record_id", r"@[^@]*$", ""), F.lit(mark)))
    append(lines, target)
    return read(spark, target).count()
