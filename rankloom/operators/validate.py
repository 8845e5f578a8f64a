"""Loud checks of rankings and labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import KEYS

QUERY = ["dataset", "query_id"]


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n) of keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def check_rankings(run: DataFrame) -> DataFrame:
    """The run, once it is known to have finite scores and one row a document; else ValueError names an example."""
    bad = run.filter(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).head(1)
    if bad:
        raise ValueError(f"score is not finite: {bad[0].asDict()}")
    twice = duplicates(run, [*KEYS, "doc_id"]).head(1)
    if twice:
        raise ValueError(f"ranked more than once: {twice[0].asDict()}")
    return run


def same_queries(left: DataFrame, right: DataFrame) -> DataFrame:
    """(dataset, query_id, side) of queries that only one of the two has."""
    a, b = left.select(*QUERY).distinct(), right.select(*QUERY).distinct()
    return a.join(b, QUERY, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, QUERY, "left_anti").withColumn("side", F.lit("right")))


def _first(named: int):
    """(code, n, ids) of a partition's cases: the sum of each code and its first ids, so that no code is gathered or sorted."""

    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        ids: dict[str, list[str]] = {}
        for batch in batches:
            for code in pc.unique(batch.column("code")).to_pylist():
                mine = batch.filter(pc.equal(batch.column("code"), code))
                sums[code] = sums.get(code, 0) + pc.sum(mine.column("n")).as_py()
                some = pc.unique(mine.column("id"))
                ids[code] = sorted({*ids.get(code, ()), *some.take(pc.bottom_k_unstable(some, named)).to_pylist()})[:named]
        kinds = (pa.string(), pa.int64(), pa.list_(pa.string()))
        columns = [pa.array(x, k) for x, k in zip((list(sums), list(sums.values()), list(ids.values())), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["code", "n", "ids"])

    return cases


def report(run: DataFrame, labels: DataFrame, pools: DataFrame, excluded: DataFrame, named: int = 5) -> DataFrame:
    """(code, n, examples) of everything that a data set's tables contradict each other in; codes without cases stay.

    Every document of a query says once, by flags, in which tables it stands, and every query likewise: the codes are
    conditions on those flags, and all are counted in one pass, with the first ``named`` by name as examples. Rows are
    dealt by query, over all shuffle partitions, before any are aggregated: few tasks that make many rows do not hold them all.
    """
    doc = [*QUERY, "doc_id"]
    flag = lambda rows, name: rows.select(*doc, *[(F.lit(True) if n == name else F.lit(None).cast("boolean")).alias(n) for n in ("ranked", "labelled", "positive", "pooled", "excluded")])
    positive = labels.select(*doc, F.lit(None).cast("boolean").alias("ranked"), F.lit(True).alias("labelled"), (F.col("grade") > 0).alias("positive"), F.lit(None).cast("boolean").alias("pooled"), F.lit(None).cast("boolean").alias("excluded"))
    rows = flag(run, "ranked").unionByName(positive).unionByName(flag(pools, "pooled")).unionByName(flag(excluded, "excluded"))
    flags = ("ranked", "labelled", "positive", "pooled", "excluded")
    docs = rows.repartition(int(run.sparkSession.conf.get("spark.sql.shuffle.partitions")), *QUERY).groupBy(*doc).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags], F.count_if((F.col("labelled") & F.col("positive"))).alias("positives"), F.count("pooled").alias("pools"))
    name = F.concat_ws("/", *doc)
    cases = {
        "EXCLUDED_RELEVANT": ("positives", F.col("positive") & F.col("excluded")), "UNJUDGED_CANDIDATES": ("pools", F.col("pooled") & ~F.col("labelled")),
        "OUTSIDE_POOL": (None, F.col("ranked") & ~F.col("pooled")), "EXCLUDED_RANKED": (None, F.col("ranked") & F.col("excluded")),
    }
    queries = docs.groupBy(*QUERY).agg(*[F.bool_or(c).alias(c) for c in ("ranked", "labelled", "pooled")])
    of_query = {"QUERIES_WITHOUT_POOL": F.col("labelled") & ~F.col("pooled"), "UNKNOWN_QUERIES": F.col("ranked") & ~F.col("labelled")}
    found = docs.select(name.alias("id"), F.explode(F.filter(F.array(*[F.when(ok, F.struct(F.lit(code).alias("code"), (F.col(n) if n else F.lit(1)).cast("long").alias("n"))) for code, (n, ok) in cases.items()]), lambda x: x.isNotNull())).alias("c"))
    found = found.unionByName(queries.select(F.concat_ws("/", *QUERY).alias("id"), F.explode(F.filter(F.array(*[F.when(ok, F.struct(F.lit(code).alias("code"), F.lit(1).cast("long").alias("n"))) for code, ok in of_query.items()]), lambda x: x.isNotNull())).alias("c")))
    some = found.select("id", "c.code", "c.n").mapInArrow(_first(named), "code string, n long, ids array<string>")
    sums = some.groupBy("code").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, named).alias("examples"))
    every = run.sparkSession.createDataFrame([(c,) for c in (*cases, *of_query)], "code string")
    return every.join(F.broadcast(sums), "code", "left").select("code", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def folded(rows: DataFrame, keys: list[str], order: list[str], conflict: str = "error") -> DataFrame:
    """One row a key, with ``copies``: rows that equal it in all columns, and ``lost``: others of its key.

    Equal rows fold. Different rows of one key are a ValueError, or with ``conflict`` "last" the last by ``order`` stays.
    """
    rest = [c for c in rows.columns if c not in keys]
    per = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    value = F.struct(*order, *[c for c in rest if c not in order], "copies")
    out = per.groupBy(*keys).agg(F.max(value).alias("v"), F.sum("copies").alias("all"))
    out = out.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest], F.col("v.copies").alias("copies"), (F.col("all") - F.col("v.copies")).alias("lost"))
    if conflict == "error":
        bad = out.filter("lost > 0").head(1)
        if bad:
            raise ValueError(f"different rows of one key: {({k: bad[0][k] for k in keys})}")
    return out


def unknown_ids(labels: DataFrame, pools: DataFrame) -> DataFrame:
    """(dataset, query_id, doc_id, side) of pairs that only one of labels and pools names."""
    doc = [*QUERY, "doc_id"]
    a = labels.select(*doc).join(pools.select(*doc), doc, "left_anti").withColumn("side", F.lit("labels"))
    return a.unionByName(pools.select(*doc).join(labels.select(*doc), doc, "left_anti").withColumn("side", F.lit("pools")))


def criteria_gaps(verdicts: DataFrame, criteria: list[str]) -> DataFrame:
    """(record_id, doc_id, missing, unknown) of ``verdicts(record_id, doc_id, criteria map)`` that answer other criteria."""
    want = F.array(*[F.lit(c) for c in criteria])
    have = F.coalesce(F.map_keys("criteria"), F.array().cast("array<string>"))
    rows = verdicts.select("record_id", "doc_id", F.array_except(want, have).alias("missing"), F.array_sort(F.array_except(have, want)).alias("unknown"))
    return rows.filter((F.size("missing") > 0) | (F.size("unknown") > 0))


def kept_cases(cases: DataFrame, flag: str) -> DataFrame:
    """Cases whose exclusion flag is not set; a null flag keeps, and so does a missing column."""
    return cases.filter(~F.coalesce(F.col(flag), F.lit(False))) if flag in cases.columns else cases


def grades(rows: DataFrame, column: str = "score") -> DataFrame:
    """Rows with a finite ``grade``; anything else in the column is a ValueError."""
    out = rows.withColumn("grade", F.col(column).try_cast("double"))
    bad = out.filter(F.col("grade").isNull() | F.isnan("grade") | (F.abs("grade") == float("inf"))).head(1)
    if bad:
        raise ValueError(f"grade is no finite number: {bad[0].asDict()}")
    return out
