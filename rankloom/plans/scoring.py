"""Queries over rankings and labels, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import gains
from rankloom.operators import metrics, protocol, ranking
from rankloom.plans import bindings as b

SYSTEMS = ["click", "error", "purchase", "signup", "view"]
DATASETS = ["ds0", "ds1", "ds2"]
CUTS = [1, 3, 5, 10, 20]


def _r(name: str):
    return F.round(name, 6).alias(name)


def _ndcg(spark, d, ties="group_mean", tied=True):
    return metrics.ndcg(b.run(spark, d, tied), b.labels(spark, d), [10], ties)


def ndcg10_by_system(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: nDCG@10 of each system, unranked queries 0, mean of the datasets' means."""
    labels = b.labels(spark, d)
    per = metrics.with_unranked(_ndcg(spark, d), labels, SYSTEMS, "ndcg")
    return metrics.two_level_mean(per, "ndcg").select("system", _r("ndcg"), "queries", "datasets")


def ndcg10_group_mean(spark, d):
    return _ndcg(spark, d).select(*ranking.KEYS, _r("ndcg"))


def ndcg10_doc_id_desc(spark, d):
    return _ndcg(spark, d, "doc_id_desc").select(*ranking.KEYS, _r("ndcg"))


def ndcg10_input_order(spark, d):
    return _ndcg(spark, d, "input_order").select(*ranking.KEYS, _r("ndcg"))


def ndcg_all_cutoffs(spark, d):
    return metrics.ndcg(b.run(spark, d, True), b.labels(spark, d), CUTS).select(*ranking.KEYS, "k", _r("ndcg"))


def dcg_idcg_parts(spark, d):
    return _ndcg(spark, d).select(*ranking.KEYS, _r("dcg"), _r("idcg"))


def exponential_gain_ndcg(spark, d):
    labels = b.labels(spark, d).withColumn("gain", gains.qrel_gain(F.col("grade"), "exponential"))
    return metrics.ndcg(b.run(spark, d, True), labels, [10]).select(*ranking.KEYS, _r("ndcg"))


def calibrated_ndcg(spark, d):
    labels = b.labels(spark, d).withColumn("gain", gains.calibrated_gain(F.col("theta"), b.GAMMA, b.BETA))
    return metrics.ndcg(b.run(spark, d, True), labels, [10]).select(*ranking.KEYS, _r("ndcg"))


def calibrated_gain(spark, d):
    probabilities = gains.pass_probabilities(F.col("theta"), b.GAMMA, b.BETA)
    cells = [F.round(p, 6).alias(f"p{i + 1}") for i, p in enumerate(probabilities)]
    return b.labels(spark, d).select("dataset", "query_id", "doc_id", F.round(gains.calibrated_gain(F.col("theta"), b.GAMMA, b.BETA), 6).alias("gain"), *cells)


def _classic(spark, d, value):
    return metrics.classic(b.run(spark, d, True), b.labels(spark, d), 10).select(*ranking.KEYS, _r(value))


def map10(spark, d):
    return _classic(spark, d, "map")


def recall10(spark, d):
    return _classic(spark, d, "recall")


def precision10(spark, d):
    return _classic(spark, d, "precision")


def success10(spark, d):
    return _classic(spark, d, "success")


def mrr10(spark, d):
    return _classic(spark, d, "mrr")


def recall_cap10(spark, d):
    return _classic(spark, d, "recall_cap")


def hole10(spark, d):
    return metrics.holes(b.run(spark, d, True), b.labels(spark, d).filter("pos % 4 <> 1"), 10).select(*ranking.KEYS, _r("hole"))


def paired_accuracy(spark, d):
    return metrics.paired_accuracy(b.run(spark, d), b.labels(spark, d), b.pair_groups(spark, d)).select("system", "dataset", _r("accuracy"), "pairs")


def coverage90(spark, d):
    answers = b.run(spark, d).withColumn("p", F.col("score") / 100)
    return metrics.coverage(answers, 0.9).select("system", "dataset", _r("coverage"))


def _protocol(spark, d, name: str):
    return protocol.scored(b.run(spark, d, True), b.labels(spark, d), b.pools(spark, d), b.excluded(spark, d), protocol.PRESETS[name], 10)


def protocol_pool_ndcg(spark, d):
    return _protocol(spark, d, "nanobeir")


def protocol_excluded_ndcg(spark, d):
    return _protocol(spark, d, "bright")


def two_level_mean(spark, d):
    return metrics.two_level_mean(_ndcg(spark, d), "ndcg").select("system", _r("ndcg"), "queries", "datasets")


def leaderboard_pivot(spark, d):
    rows = metrics.leaderboard(_ndcg(spark, d), DATASETS, "ndcg")
    return rows.select("system", *[_r(c) for c in [*DATASETS, "mean"]])


def rrf_fusion(spark, d):
    return ranking.fused(b.run(spark, d), SYSTEMS, depth=10).select("dataset", "query_id", "doc_id", _r("score"), F.col("rank").cast("long").alias("rank"))


def top_depth(spark, d):
    return ranking.top(b.run(spark, d, True), 5).select(*ranking.KEYS, "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def order_scores(spark, d):
    """Ranked lists of documents become scores n, n - 1, ... 1."""
    lists = b.run(spark, d).groupBy(*ranking.KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    return ranking.scores_from_order(lists).select(*ranking.KEYS, "doc_id", "score", "pos")


QUERIES = {f.__name__: f for f in (
    ndcg10_by_system, ndcg10_group_mean, ndcg10_doc_id_desc, ndcg10_input_order, ndcg_all_cutoffs, dcg_idcg_parts, exponential_gain_ndcg,
    calibrated_ndcg, calibrated_gain, map10, recall10, precision10, success10, mrr10, recall_cap10, hole10, paired_accuracy, coverage90,
    protocol_pool_ndcg, protocol_excluded_ndcg, two_level_mean, leaderboard_pivot, rrf_fusion, top_depth, order_scores,
)}

_SYSTEM = "system, dataset, query_id"


def _ndcg_sql(select: str, names: str = "run_tied grid qrels", ties: str = "group_mean", gain: str = "gain", ks: str = "10", run: str = "run", qrels: str = "qrels", tail: str = "") -> str:
    order = "score DESC, pos" if ties == "input_order" else "score DESC, doc_id DESC"
    credit = f"avg(g) OVER (PARTITION BY {_SYSTEM}, score)" if ties == "group_mean" else "g"
    return b.sql(names, f""", q AS (SELECT *, {gain} AS g0 FROM {qrels}),
l AS (SELECT r.*, coalesce(q.g0, 0) AS g FROM {run} r LEFT JOIN q USING (dataset, query_id, doc_id)),
c AS (SELECT *, {credit} AS credit, row_number() OVER (PARTITION BY {_SYSTEM} ORDER BY {order}) AS rk FROM l),
ks AS (SELECT unnest([{ks}]) AS k),
dc AS (SELECT {_SYSTEM}, k, coalesce(sum(credit / log2(rk + 1)) FILTER (rk <= k), 0) AS dcg FROM c, ks GROUP BY ALL),
i AS (SELECT dataset, query_id, k, coalesce(sum(g0 / log2(rk + 1)) FILTER (rk <= k), 0) AS idcg, count(*) FILTER (grade > 0) AS positives
  FROM (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY g0 DESC) AS rk FROM q), ks GROUP BY ALL),
n AS (SELECT {_SYSTEM}, k, dcg, idcg, positives, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg FROM dc JOIN i USING (dataset, query_id, k))
{tail}SELECT {select} FROM """.replace(")\n,", "),\n"))


_N = f"{_SYSTEM}, round(ndcg, 6) AS ndcg"
_ROUNDED = f"{_SYSTEM}, CASE WHEN positives > 0 THEN round_even(ndcg, 5) END AS ndcg"


def _gain_sql(theta: str = "theta") -> str:
    return "(" + " + ".join(f"{g} / (1 + exp(-{g}::DOUBLE * ({theta} - ({v}::DOUBLE))))" for g, v in zip(b.GAMMA, b.BETA)) + f") / {sum(b.GAMMA)}::DOUBLE"


def _classic_sql(value: str) -> str:
    return b.sql("run_tied grid qrels", f""", l AS (SELECT r.*, coalesce(grade > 0, false)::INT AS rel FROM run r LEFT JOIN qrels USING (dataset, query_id, doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY {_SYSTEM} ORDER BY score DESC, doc_id DESC) AS rk, row_number() OVER (PARTITION BY {_SYSTEM} ORDER BY score DESC, pos) AS rp FROM l),
h AS (SELECT *, sum(rel) OVER (PARTITION BY {_SYSTEM} ORDER BY rk) AS hits FROM k),
p AS (SELECT dataset, query_id, count(*) FILTER (grade > 0) AS positives FROM qrels GROUP BY ALL),
s AS (SELECT {_SYSTEM}, positives, coalesce(sum(hits / rk) FILTER (rk <= 10 AND rel = 1), 0) AS pr, coalesce(sum(rel) FILTER (rk <= 10), 0) AS found,
  min(rp) FILTER (rp <= 10 AND rel = 1) AS fp, coalesce(sum(rel) FILTER (rp <= 10), 0) AS ff FROM h JOIN p USING (dataset, query_id) GROUP BY ALL)
SELECT {_SYSTEM}, round({value}, 6) AS {{}} FROM s""")


_VALUES = {
    "map": "(pr / nullif(positives, 0))::DOUBLE", "recall": "(found / nullif(positives, 0))::DOUBLE", "precision": "(found / 10)::DOUBLE",
    "success": "(found > 0)::INT::DOUBLE", "mrr": "coalesce(1.0::DOUBLE / fp, 0)::DOUBLE", "recall_cap": "(ff / nullif(least(positives, 10), 0))::DOUBLE",
}

ORACLE_SQL = {
    "ndcg10_by_system": _ndcg_sql("system, round(avg(v), 6) AS ndcg, sum(n)::BIGINT AS queries, count(*) AS datasets") + f"""(
  SELECT system, dataset, avg(coalesce(ndcg, 0)) AS v, count(*) AS n FROM (SELECT DISTINCT dataset, query_id FROM qrels) CROSS JOIN (SELECT unnest({SYSTEMS}) AS system) LEFT JOIN n USING ({_SYSTEM}) GROUP BY ALL) GROUP BY ALL""",
    "ndcg10_group_mean": _ndcg_sql(_N) + "n",
    "ndcg10_doc_id_desc": _ndcg_sql(_N, ties="doc_id_desc") + "n",
    "ndcg10_input_order": _ndcg_sql(_N, ties="input_order") + "n",
    "ndcg_all_cutoffs": _ndcg_sql(f"{_SYSTEM}, k, round(ndcg, 6) AS ndcg", ks="1, 3, 5, 10, 20") + "n",
    "dcg_idcg_parts": _ndcg_sql(f"{_SYSTEM}, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg") + "n",
    "exponential_gain_ndcg": _ndcg_sql(_N, gain="pow(2, grade) - 1") + "n",
    "calibrated_ndcg": _ndcg_sql(_N, gain=_gain_sql()) + "n",
    "calibrated_gain": b.sql("grid qrels", f"SELECT dataset, query_id, doc_id, round({_gain_sql()}, 6) AS gain, " + ", ".join(f"round(1 / (1 + exp(-{g}::DOUBLE * (theta - ({v}::DOUBLE)))), 6) AS p{i + 1}" for i, (g, v) in enumerate(zip(b.GAMMA, b.BETA))) + " FROM qrels"),
    **{f"{k}10": _classic_sql(v).format(k) for k, v in _VALUES.items()},
    "hole10": b.sql("run_tied grid qrels", f""", s AS (SELECT DISTINCT doc_id, 1 AS seen FROM qrels WHERE pos % 4 <> 1),
c AS (SELECT *, row_number() OVER (PARTITION BY {_SYSTEM} ORDER BY score DESC, doc_id DESC) AS rk FROM run)
SELECT {_SYSTEM}, round(count(*) FILTER (seen IS NULL) / 10.0::DOUBLE, 6) AS hole FROM c LEFT JOIN s USING (doc_id) WHERE rk <= 10 GROUP BY ALL"""),
    "paired_accuracy": b.sql("run grid qrels pair_groups", """, f AS (SELECT dataset, query_id, arg_min(doc_id, pos) AS own FROM qrels WHERE grade > 0 GROUP BY ALL),
g AS (SELECT *, count(*) OVER (PARTITION BY dataset, group_id) AS n FROM pair_groups JOIN f USING (dataset, query_id)),
p AS (SELECT a.dataset, a.group_id, a.query_id, a.own, o.own AS other FROM g a JOIN g o ON a.dataset = o.dataset AND a.group_id = o.group_id AND a.query_id <> o.query_id WHERE a.n = 2),
s AS (SELECT DISTINCT system, dataset FROM run),
v AS (SELECT s.system, p.dataset, group_id, bool_and(coalesce(x.score, '-infinity'::DOUBLE) > coalesce(y.score, '-infinity'::DOUBLE)) AS ok
  FROM p JOIN s USING (dataset) LEFT JOIN run x ON x.system = s.system AND x.dataset = p.dataset AND x.query_id = p.query_id AND x.doc_id = own
  LEFT JOIN run y ON y.system = s.system AND y.dataset = p.dataset AND y.query_id = p.query_id AND y.doc_id = other GROUP BY ALL)
SELECT system, dataset, round(avg(ok::INT), 6) AS accuracy, count(*) AS pairs FROM v GROUP BY ALL"""),
    "coverage90": b.sql("run", "SELECT system, dataset, round(avg((score / 100 >= 0.9::DOUBLE)::INT), 6) AS coverage FROM run GROUP BY ALL"),
    "protocol_pool_ndcg": _ndcg_sql(_ROUNDED, "run_tied grid qrels pools excluded", run="(SELECT run.* FROM run JOIN pools USING (dataset, query_id, doc_id) ANTI JOIN excluded USING (dataset, query_id, doc_id))", qrels="(SELECT * FROM qrels ANTI JOIN excluded USING (dataset, query_id, doc_id))") + "n",
    "protocol_excluded_ndcg": _ndcg_sql(_ROUNDED, "run_tied grid qrels pools excluded", run="(SELECT run.* EXCLUDE (pos), coalesce(pools.pos, run.pos + 1000000000) AS pos FROM run LEFT JOIN pools USING (dataset, query_id, doc_id) ANTI JOIN excluded USING (dataset, query_id, doc_id))", qrels="(SELECT * FROM qrels ANTI JOIN excluded USING (dataset, query_id, doc_id))") + "n",
    "two_level_mean": _ndcg_sql("system, round(avg(v), 6) AS ndcg, sum(c)::BIGINT AS queries, count(*) AS datasets") + "(SELECT system, dataset, avg(ndcg) AS v, count(*) AS c FROM n GROUP BY ALL) GROUP BY ALL",
    "leaderboard_pivot": _ndcg_sql("system, " + ", ".join(f"round(max(v) FILTER (dataset = '{x}'), 6) AS {x}" for x in DATASETS) + ", round(avg(v), 6) AS mean") + "(SELECT system, dataset, avg(ndcg) AS v FROM n GROUP BY ALL) GROUP BY ALL",
    "rrf_fusion": b.sql("run", f""", k AS (SELECT *, row_number() OVER (PARTITION BY {_SYSTEM} ORDER BY score DESC, doc_id) AS rk, list_position({SYSTEMS}, system) AS o FROM run),
s AS (SELECT dataset, query_id, doc_id, sum(1.0::DOUBLE / (60 + rk)) AS score, min(o * 1000000 + rk) AS f FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY round(score, 12) DESC, f) AS rank FROM s)
SELECT dataset, query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""),
    "top_depth": b.sql("run_tied", f"SELECT {_SYSTEM}, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {_SYSTEM} ORDER BY score DESC, doc_id) AS rank FROM run) WHERE rank <= 5"),
    "order_scores": b.sql("run", f"SELECT {_SYSTEM}, doc_id, (count(*) OVER w - (row_number() OVER (w ORDER BY pos) - 1))::DOUBLE AS score, row_number() OVER (w ORDER BY pos) - 1 AS pos FROM run WINDOW w AS (PARTITION BY {_SYSTEM})"),
}
