"""Retrieval: exact dense and late-interaction search in blocks, and BM25 over an inverted index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from rankloom.operators.lineage import cut, spread

#: So many terms of all queries at most are sent to every task; more are met by a shuffle.
BROADCAST_TERMS = 1 << 18
#: Documents and queries that one block holds.
DOCS, QUERIES = 2048, 256
#: Scores that a task holds before it leaves out those that others of it beat.
HELD = 1 << 19


def _usable(items: DataFrame) -> DataFrame:
    """(id, vector) of items that have a vector: null and empty ones, and those with a null or non-finite component, are none.

    An item of several vectors keeps those that are usable, and is left out if none is.
    """
    key, name = items.columns
    kind = items.schema[name].dataType.elementType

    def whole(v):
        return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))

    if isinstance(kind, ArrayType):
        return items.select(key, F.filter(name, whole).alias(name)).filter(F.size(name) > 0).filter(F.col(key).isNotNull())
    return items.filter(whole(F.col(name)) & F.col(key).isNotNull())


def _packed(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """(ids, matrix, starts) rows of up to ``size`` items; an item is one vector or an array of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                items = [np.atleast_2d(np.array(v, np.float64)) for v in part.column(1).to_pylist()]
                starts = np.concatenate(([0], np.cumsum([len(v) for v in items]))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_numpy().tobytes()]), pa.array([np.concatenate(items).tobytes()]), pa.array([starts.tobytes()])],
                    names=[f"{prefix}_ids", f"{prefix}_matrix", f"{prefix}_starts"],
                )

    return rows.mapInArrow(run, f"{prefix}_ids binary, {prefix}_matrix binary, {prefix}_starts binary")


def dense_top(docs: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` largest inner products of each query, in double precision.

    ``docs(id, vector)`` and ``queries(id, vector)``; a vector may be an array of vectors, and then a document scores
    the sum over the query's of the largest product with one of the document's. A document is not its own result.
    Scores are rounded before they are ranked; ties go to the smaller id. Blocks of documents meet blocks of queries;
    each pair of blocks hands on only its best ``k`` a query. Items without a usable vector (null, empty, or with a
    component that is null or not finite) or without an id find nothing and are not found, as are vectors of an item of
    several; no documents or no queries give no rows. Vectors of different sizes are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                # views of the batch: no block is copied
                view = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
                d, q = (view(f"{p}_ids", np.int64) for p in "dq")
                ds, qs = (view(f"{p}_starts", np.int64) for p in "dq")
                dm, qm = (view(f"{p}_matrix", np.float64).reshape(s[-1], -1) for p, s in (("d", ds), ("q", qs)))
                score = qm @ dm.T
                if len(dm) > len(d) or len(qm) > len(q):
                    score = np.add.reduceat(np.maximum.reduceat(score, ds[:-1], axis=1), qs[:-1], axis=0)
                score = np.round(score, digits)
                score[(q[:, None] == d[None, :]) | np.isnan(score)] = -np.inf
                # what reaches a query's k-th score here, ties included; only that is sorted
                least = np.partition(score, len(d) - k, axis=1)[:, len(d) - k, None] if len(d) > k else -np.inf
                row, at = np.nonzero((score >= least) & (score > -np.inf))
                order = np.lexsort((d[at], -score[row, at], row))
                row, at = row[order], at[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, at = row[place < k], at[place < k]
                top = score[row, at]
                keep = np.isfinite(top)
                yield pa.RecordBatch.from_arrays([pa.array(q[row][keep]), pa.array(d[at][keep]), pa.array(top[keep])], names=["query_id", "doc_id", "score"])

    # a stated set of queries against all documents, block by block
    dealt = lambda items: spread(_usable(items), items.columns[0])
    blocks = cut(_packed(dealt(docs), DOCS, "d")).crossJoin(cut(_packed(dealt(queries), QUERIES, "q")))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    rows = blocks.mapInArrow(run, "query_id long, doc_id long, score double")
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def terms(text, stop: tuple[str, ...] = ()):
    """Lower-cased runs of two or more letters and digits of any script, and underscores, without the stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The rows of ``scores(query_id, doc_id, score)`` that can be among a query's first ``k``: the best ``k`` of each part of the rows."""
    order = [("query_id", "ascending"), ("score", "descending"), ("doc_id", "ascending")]

    def first(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        of = rows.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
        start = np.flatnonzero(np.diff(of, prepend=-1))
        return rows.filter(pa.array(np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of)))) < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < HELD:
                continue
            rows = first(pa.Table.from_batches(held))
            held, n = rows.to_batches(), rows.num_rows
            if n > HELD // 2:
                yield from held
                held, n = [], 0
        if n:
            yield from first(pa.Table.from_batches(held)).to_batches()

    kinds = ", ".join(f"{c} {scores.schema[c].dataType.simpleString()}" for c in scores.columns)
    return scores.mapInArrow(run, kinds)


def _pruned(asked: DataFrame, postings: DataFrame, k: int, digits: int, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, doc_id, w) of all terms of the documents that can be among a query's first ``k``; exact for those.

    A query's threshold is the k-th score of some documents, a lower bound of its k-th score of all: of the 4 k that do best
    by its terms' ``k`` best postings alone. Its terms, the least telling first, are optional as long as their largest weights together stay below that:
    a document with no other term cannot get there. Candidates come from the other terms' postings, and the optional
    terms are looked up by document, so that the long postings of common words are never joined with every query.
    """
    held = asked.withColumnRenamed("query_id", "query")
    best = Window.partitionBy("term").orderBy(F.col("w").desc(), "doc_id")
    champions = postings.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    sums = champions.join(small(held), "term").groupBy("query", "doc_id").agg(F.sum("w").alias("low"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("low").desc(), "doc_id"))
    likely = sums.withColumn("n", place).filter(F.col("n") <= 4 * k).select("query", "doc_id")
    whole = likely.join(small(held), "query").join(postings, ["term", "doc_id"]).groupBy("query", "doc_id").agg(F.sum("w").alias("low"))
    floor = whole.withColumn("n", place).filter(F.col("n") == k).select("query", "low")
    largest = champions.filter("n = 1").select("term", F.col("w").alias("most"))
    # scores are rounded before they are ranked: what could round up to the threshold stays
    upto = F.sum("most").over(Window.partitionBy("query").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    terms_ = held.join(largest, "term").join(floor, "query", "left").withColumn("optional", F.coalesce(upto * (1 + 1e-9) + 2 * 10.0**-digits < F.col("low"), F.lit(False)))
    terms_ = cut(terms_.select("query", "term", "optional"))
    first = postings.join(small(terms_.filter("NOT optional")), "term").select("query", "doc_id", "w")
    candidates = first.select("query", "doc_id").distinct()
    later = candidates.join(small(terms_.filter("optional").select("query", "term")), "query").join(postings, ["term", "doc_id"]).select("query", "doc_id", "w")
    return first.unionByName(later).withColumnRenamed("query", "query_id")


def bm25_top(
    docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, digits: int = 6, stop: tuple[str, ...] = (), fill: bool = False, prune: bool = False
) -> DataFrame:
    """(query_id, doc_id, score, rank) of ``queries(query_id, text)`` over ``docs(doc_id, text)``.

    The inverted index holds only terms that a query has: where those are few they are sent to all tasks, which leave
    the other words out before anything is shuffled. Texts are read and split once, for lengths and index together. A term counts once in a query. Documents without any of the
    query's terms score 0; with ``fill`` they follow by doc_id where a query has fewer than ``k`` others. With ``prune``
    the postings of a query's common terms are only looked up for documents that can still be among its first ``k``, see
    ``_pruned``: the same results from fewer rows where queries are long and documents many.
    """
    asked = cut(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text"), stop))).alias("term")))
    few = asked.count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda rows: rows
    wanted = small(asked.select("term").distinct())
    sums = Observation()
    # dealt by document, a document's words are counted and its scores added up where they are
    split = spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", terms(F.col("text"), stop).alias("ts")).select("doc_id", "ts", F.size("ts").alias("n"))
    split = split.observe(sums, F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words"))
    tf = split.select("doc_id", "n", F.explode("ts").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc_id", "n").agg(F.count("*").alias("tf"))
    tf = cut(tf)
    count, mean = sums.get["docs"], (sums.get["words"] or 0) / max(sums.get["docs"], 1)
    df = small(tf.groupBy("term").agg(F.count("*").alias("df")))
    idf = F.log(1 + (F.lit(float(count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(mean)))
    postings = tf.join(df, "term").select("term", "doc_id", (idf * weight).alias("w"))
    met = _pruned(asked, cut(postings), k, digits, small) if prune else postings.join(small(asked), "term")
    scores = met.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), digits).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    top = _best(scores, k).withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
    if not fill:
        return top
    # of the first 2 k documents at least k are none of a query's fewer than k hits
    first = [r[0] for r in docs.select("doc_id").orderBy("doc_id").limit(2 * k).collect()]
    hits = top.groupBy("query_id").agg(F.count("*").alias("hits"))
    short = queries.select("query_id").distinct().join(hits, "query_id", "left").filter(F.coalesce("hits", F.lit(0)) < k)
    zero = short.select("query_id", F.explode(F.array(*[F.lit(x) for x in first])).alias("doc_id")).join(top.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = top.drop("rank").unionByName(zero.withColumn("score", F.lit(0.0)))
    return both.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)
