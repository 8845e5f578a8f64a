"""Queries over reports, the judgement log and answers, and the same in SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import answers
from rankloom.operators import judgements, metrics, ranking, reports
from rankloom.plans import bindings as b
from rankloom.plans.analysis import CRITERIA
from rankloom.plans.scoring import _SYSTEM, _ndcg_sql


def _r(name: str):
    return F.round(name, 6).alias(name)


def explain_top(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.explained(b.run(spark, d), b.labels(spark, d), 5)
    return rows.select(*ranking.KEYS, F.col("rank").cast("long").alias("rank"), "doc_id", "grade", _r("contribution"))


def _records(spark, d):
    values = metrics.ndcg(b.run(spark, d, True), b.labels(spark, d), [10]).groupBy("system", "dataset").agg(F.round(F.avg("ndcg"), 6).alias("value"))
    return reports.records(values, "ndcg", 10)


def result_records(spark, d):
    return reports.flat_records(_records(spark, d))


def pool_summary(spark, d):
    return reports.pool_summary(b.pools(spark, d)).select("dataset", "queries", "smallest", _r("mean"), "largest")


def label_histogram(spark, d):
    return b.labels(spark, d).groupBy("dataset", "grade").agg(F.count("*").alias("n"))


def opponents(spark, d):
    return reports.opponents(b.labels(spark, d), 7).select("dataset", "query_id", "bin", "doc_id", _r("value"))


def _marked(spark, d):
    return b.log(spark, d).withColumn("tombstone", F.col("record_id") % 13 == 0).withColumn("pos", F.col("record_id"))


def supersede_fold(spark, d):
    return judgements.superseded(_marked(spark, d), ["key"]).select("key", "line.record_id", "line.valid", "line.tombstone")


def supersede_in_store(spark, d):
    return judgements.superseded(_marked(spark, d), ["key"], True).select("key", "line.record_id", "line.valid", "line.tombstone")


def answer_decode(spark, d):
    """Windows' placements written as a judge would answer, every eleventh cut off, and read again."""
    rows = b.placements(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("position", "score"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.concat(F.lit('"doc_'), x["position"].cast("string"), F.lit('": '), x["score"].cast("string"))), ", ")
    answer = F.concat(F.lit("<think>{maybe}</think>\n```json\n{"), body, F.when(F.col("record_id") % 11 == 0, F.lit("")).otherwise(F.lit("}\n```")))
    read = rows.select("record_id", answers.listwise_scores(answer, F.size("p")).alias("a")).select("record_id", "a.category", "a.scores")
    return read.select("record_id", "category", F.explode_outer("scores").alias("position", "score")).select("record_id", "category", F.col("position").cast("long").alias("position"), "score")


def rubric_decode(spark, d):
    """Windows' verdicts written as a judge would answer, some cut off and some without a criterion, and read again."""
    rows = b.placements(spark, d).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("position", *CRITERIA))).alias("p"))
    short = (F.col("record_id") % 13 == 0) & (F.col("record_id") % 11 != 0)

    def verdicts(x):
        each = [F.concat(F.lit(f'"C{i + 1}": '), x[c].cast("string")) for i, c in enumerate(CRITERIA)]
        return F.when(short, F.concat_ws(", ", *each[:-1])).otherwise(F.concat_ws(", ", *each))

    body = F.array_join(F.transform("p", lambda x: F.concat(F.lit('"doc_'), x["position"].cast("string"), F.lit('": {"criteria": {'), verdicts(x), F.lit("}}"))), ", ")
    answer = F.concat(F.lit("{"), body, F.when(F.col("record_id") % 11 == 0, F.lit("")).otherwise(F.lit("}")))
    read = rows.select("record_id", answers.rubric_verdicts(answer, F.size("p"), len(CRITERIA)).alias("a")).select("record_id", "a.category", "a.verdicts")
    rows = read.select("record_id", "category", F.explode_outer("verdicts").alias("position", "v"))
    return rows.select("record_id", "category", F.col("position").cast("long").alias("position"), F.array_join("v", "").alias("verdicts"))


QUERIES = {f.__name__: f for f in (rubric_decode, explain_top, result_records, pool_summary, label_histogram, opponents, supersede_fold, supersede_in_store, answer_decode)}

_FOLD = """, m AS (SELECT key, record_id, valid, record_id % 13 = 0 AS tombstone, recorded_at FROM log),
f AS (SELECT key, list_reduce(list({{'record_id': record_id, 'valid': valid, 'tombstone': tombstone, 'at': recorded_at}} ORDER BY record_id),
  lambda a, b: CASE WHEN CASE WHEN a.tombstone OR b.tombstone THEN {rule} WHEN a.valid <> b.valid THEN b.valid ELSE b.at >= a.at END THEN b ELSE a END) AS x FROM m GROUP BY key)
SELECT key, x.record_id AS record_id, x.valid AS valid, x.tombstone AS tombstone FROM f"""

ORACLE_SQL = {
    "explain_top": _ndcg_sql(f"{_SYSTEM}, rk AS rank, doc_id, grade, round(coalesce(credit / log2(rk + 1) / nullif(idcg, 0), 0), 6) AS contribution", "run grid qrels", ks="5")
    + "(SELECT c.*, idcg FROM c JOIN i USING (dataset, query_id) WHERE rk <= 5) LEFT JOIN qrels USING (dataset, query_id, doc_id)",
    "result_records": _ndcg_sql("sha256(system || chr(10) || string_agg(line, chr(10) ORDER BY dataset) OVER (PARTITION BY system ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS record_id, system, dataset, 'ndcg' AS metric, 10 AS k, value")
    + "(SELECT *, dataset || '|ndcg|10|' || printf('%.6f', value) AS line FROM (SELECT system, dataset, round(avg(ndcg), 6) AS value FROM n GROUP BY ALL))",
    "pool_summary": b.sql("grid pools", "SELECT dataset, count(*) AS queries, min(n) AS smallest, round(avg(n), 6) AS mean, max(n) AS largest FROM (SELECT dataset, query_id, count(*) AS n FROM pools GROUP BY ALL) GROUP BY ALL"),
    "label_histogram": b.sql("grid qrels", "SELECT dataset, grade, count(*) AS n FROM qrels GROUP BY ALL"),
    "opponents": b.sql("grid qrels", """, o AS (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY theta DESC, doc_id) AS place, count(*) OVER w AS n, avg(theta) OVER w AS m FROM qrels WINDOW w AS (PARTITION BY dataset, query_id)),
v AS (SELECT *, (place - 1) * 7 // n AS bin, round(1 / (1 + exp(m - theta)) * (1 - 1 / (1 + exp(m - theta))) / log2(place + 1), 9) AS v FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, query_id, bin ORDER BY v DESC, place) AS k FROM v)
SELECT dataset, query_id, bin, doc_id, round(v, 6) AS value FROM r WHERE k = 1"""),
    "supersede_fold": b.sql("placements log", _FOLD.format(rule="b.at >= a.at")),
    "supersede_in_store": b.sql("placements log", _FOLD.format(rule="true")),
    "rubric_decode": b.sql("placements", """SELECT record_id, 'ok' AS category, position, concat(c1, c2, c3, c4, c5) AS verdicts FROM placements WHERE record_id % 11 <> 0 AND record_id % 13 <> 0
UNION ALL SELECT DISTINCT record_id, CASE WHEN record_id % 11 = 0 THEN 'json' ELSE 'schema' END, NULL, NULL FROM placements WHERE record_id % 11 = 0 OR record_id % 13 = 0"""),
    "answer_decode": b.sql("placements", """SELECT record_id, 'ok' AS category, position, score FROM placements WHERE record_id % 11 <> 0
UNION ALL SELECT DISTINCT record_id, 'json', NULL, NULL FROM placements WHERE record_id % 11 = 0"""),
}
