"""Queries over pools, schedules, protocols and checks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import gains, text, vectors
from rankloom.operators import budget, evaluation, judgements, metrics, pools, protocol, ranking, schedule, validate
from rankloom.plans import bindings as b
from rankloom.plans.scoring import _SYSTEM, _VALUES, _classic_sql, _gain_sql, _ndcg_sql

CRITERIA = [f"c{i}" for i in range(1, 6)]


def _r(name: str):
    return F.round(name, 6).alias(name)


def pool_depth(spark: SparkSession, d: str) -> DataFrame:
    return pools.depth(b.pools(spark, d), 20).select("dataset", "query_id", "doc_id", F.col("place").cast("long").alias("place"))


def selected_systems(spark, d):
    return pools.selected(b.run(spark, d), ["view", "click"]).groupBy("system", "place").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))


def rankings_concat(spark, d):
    run = b.run(spark, d)
    return pools.concat(run.filter("dataset = 'ds0'"), run.filter("dataset <> 'ds0'")).groupBy("system", "dataset").agg(F.count("*").alias("n"))


def observation_order(spark, d):
    """Judgements in the order that a fit reads them; those without a number last."""
    seq = F.when(F.col("record_id") % 5 != 0, F.col("record_id") % 97)
    order = Window.partitionBy("query_id").orderBy("judge", seq.asc_nulls_last(), "record_id")
    return b.log(spark, d).select("query_id", "record_id", F.row_number().over(order).cast("long").alias("place"))


def _thetas(spark, d):
    rows = b.labels(spark, d)
    base = rows.filter("pos % 9 <> 0").select("dataset", "query_id", "doc_id", "theta", F.lit("fit").alias("source"))
    more = rows.filter("pos % 9 = 0").select("dataset", "query_id", "doc_id", "theta", F.lit("scored").alias("source"))
    return base, more


def overlay_thetas(spark, d):
    return pools.overlaid(*_thetas(spark, d)).groupBy("dataset", "source").agg(F.count("*").alias("n"), F.round(F.sum("theta"), 4).alias("total"))


def population_prior(spark, d):
    return pools.prior(b.labels(spark, d), ["dataset"]).select("dataset", "n", _r("mean"), _r("sd"))


def gain_variants(spark, d):
    names = ["sigmoid_theta", "sigmoid_mean_beta", "mean_criterion", "excess_probability", "gated_weighted", "power2_weighted", "linear_theta", "criterion_C3"]
    return b.labels(spark, d).select("dataset", "query_id", "doc_id", *[F.round(gains.variant(F.col("theta"), b.GAMMA, b.BETA, n), 6).alias(n) for n in names])


def window_information(spark, d):
    """What a document's windows tell of its ability, and whether that is too little."""
    info = F.col("pos") % 7 * gains.information(F.col("theta"), b.GAMMA, b.BETA)
    return b.labels(spark, d).select("dataset", "query_id", "doc_id", F.round(info, 6).alias("information"), (F.round(info, 6) < 4.0).alias("low_information"))


def quantize_uint8(spark, d):
    return b.table(spark, d, "embeddings").select("vec_id", F.array_join(vectors.quantise_uint8(F.col("embedding"), -0.4, 0.4), ",").alias("codes"))


def text_policy(spark, d):
    rows = b.table(spark, d, "documents").withColumn("cut", text.policy(F.col("text"), 40, "truncate"))
    return rows.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.token_estimate(F.col("cut")).alias("kept_tokens"), F.md5("cut").alias("cut_md5"))


#: The tokenizer that budgets count with, and the frame that a judge's request puts around a document.
TOKENIZER, FRAME = "/opt/tokenizers/byte_bpe_50k.json", budget.Template("<doc>\n", "\n</doc>", escape=True)


def token_cut(spark, d):
    """Every document as a request of 512 tokens can hold it."""
    return budget.fit(b.table(spark, d, "documents"), TOKENIZER, 512, template=FRAME)


def token_chunks(spark, d):
    """Documents over the budget in parts of 400 tokens that share 50."""
    return budget.fit(b.table(spark, d, "documents"), TOKENIZER, 512, "chunk", FRAME, size=400, overlap=50)


def budget_census(spark, d):
    """What the budget takes from the corpus."""
    return budget.census(token_cut(spark, d))


def usage_totals(spark, d):
    rows = b.table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("requests"), F.sum(text.token_estimate(F.col("text"))).alias("tokens"))
    return rows


def window_coverage_split(spark, d):
    return judgements.window_coverage_split(b.log(spark, d)).select("query_id", "windows", "invalid", _r("share"), "by_phase", "by_judge")


def comparison_components(spark, d):
    """Which documents the first two places of all windows connect."""
    rows = b.placements(spark, d).filter("position <= 2 AND valid")
    edges = rows.groupBy("query_id", "record_id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    return pools.components(edges.select("query_id", "a", "b").distinct(), ["query_id"]).select("query_id", F.col("node").alias("doc_id"), "component")


def rubric_sizes(spark, d):
    return schedule.rubric_sizes(b.pools(spark, d)).select("dataset", "query_id", "units", "random", "stratified", "uncovered")


def cost_estimate(spark, d):
    return schedule.cost(judgements.schedule_sizes(b.pools(spark, d))).select("dataset", "queries", "calls", "seconds")


def _shown(spark, d):
    rows = b.placements(spark, d).filter("valid")
    thetas = rows.groupBy("query_id", "doc_id").agg(F.round(F.avg("score"), 6).alias("theta"))
    x, y = rows.select("record_id", "query_id", F.col("doc_id").alias("a")), rows.select("record_id", F.col("doc_id").alias("b"))
    return thetas, x.join(y, "record_id").filter("a < b").groupBy("query_id", "a", "b").agg(F.count("*").alias("n"))


def boundary_observed(spark, d):
    return schedule.observed_values(*_shown(spark, d), 20).select("query_id", "doc_id", "below", F.col("place").cast("long").alias("place"), _r("value"))


def adaptive_windows(spark, d):
    return schedule.adaptive_windows(schedule.observed_values(*_shown(spark, d), 20), 5, 6)


def stratified_groups(spark, d):
    return schedule.stratified_groups(_shown(spark, d)[0], 10, 12)


def ndcg_evaluated(spark, d):
    """nDCG's mean over the queries both labelled and ranked; one without a positive label counts 0."""
    rows = metrics.ndcg(b.run(spark, d, True), b.labels(spark, d), [10])
    return rows.groupBy("system", "dataset").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count("*").alias("queries"))


def _scored(spark, d):
    p = protocol.Protocol(qrel_gain="exponential", restrict_to_candidates=True, drop_identical_ids=True, round_digits=5)
    return protocol.scored(b.run(spark, d, True), b.labels(spark, d), b.pools(spark, d), b.excluded(spark, d), p, 10)


def protocol_scored(spark, d):
    return _scored(spark, d).select(*ranking.KEYS, _r("ndcg"))


def protocol_report(spark, d):
    return protocol.report(_scored(spark, d), "ndcg").select("system", "dataset", _r("ndcg"), "num_queries")


def metric_table(spark, d):
    """Every metric by its name, one row a query and metric."""
    rows = metrics.by_name(b.run(spark, d, True), b.labels(spark, d), ["map", "mrr", "recall", "success"], 10)
    return rows.groupBy("system", "metric").agg(F.round(F.avg("value"), 6).alias("value"), F.count("value").alias("queries"))


def _named(spark, d):
    run, labels = b.run(spark, d, True), b.labels(spark, d)
    gain = metrics.ndcg(run, labels, [10]).select(*ranking.KEYS, F.lit("ndcg").alias("metric"), F.col("ndcg").alias("value"))
    return gain.unionByName(metrics.by_name(run, labels, ["map", "recall"], 10).select(*ranking.KEYS, "metric", "value")).withColumn("k", F.lit(10))


def evaluation_summary(spark, d):
    """Means of three metrics by data set and over all, with intervals."""
    return evaluation.summary(_named(spark, d), 400)


def comparison_table(spark, d):
    """Every two systems by nDCG, with the queries where recall prefers the other."""
    rows = _named(spark, d)
    return evaluation.comparison(rows.filter("metric = 'ndcg'"), draws=400, flips=rows.filter("metric = 'recall'"))


def folded_lines(spark, d):
    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return validate.folded(rows, ["l_orderkey", "l_linenumber"], ["l_partkey"], "last").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "copies", "lost")


def unknown_ids(spark, d):
    rows = validate.unknown_ids(b.labels(spark, d), b.pools(spark, d))
    return rows.groupBy("dataset", "side").agg(F.count("*").alias("n"))


def criteria_gaps(spark, d):
    """Verdicts keyed by criterion; every 31st record lacks one, every 37th has another."""
    names = F.array(*[F.lit(c) for c in CRITERIA])
    keys = F.when(F.col("record_id") % 31 == 0, F.slice(names, 1, 4)).when(F.col("record_id") % 37 == 0, F.array_append(names, F.lit("c9"))).otherwise(names)
    rows = b.placements(spark, d).filter("valid").select("record_id", "doc_id", F.map_from_arrays(keys, F.transform(keys, lambda k: F.lit(1))).alias("criteria"))
    return validate.criteria_gaps(rows, CRITERIA).select("record_id", "doc_id", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))


def kept_cases(spark, d):
    rows = b.log(spark, d).withColumn("excluded", F.when(F.col("record_id") % 3 != 0, F.col("record_id") % 3 == 1))
    return validate.kept_cases(rows, "excluded").groupBy("judge").agg(F.count("*").alias("n"))


def hydrated_top(spark, d):
    """The first documents of each ranking with their texts, and whether there is one."""
    corpus = b.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("text").alias("body"))
    rows = pools.hydrated(ranking.top(b.run(spark, d), 3), corpus)
    return rows.select(*ranking.KEYS, "doc_id", "found", F.md5(F.coalesce("body", F.lit(""))).alias("body_md5"))


def ranking_shape(spark, d):
    rows = pools.ranking_shape(b.labels(spark, d))
    return rows.select("dataset", "query_id", F.array_join("doc_ids", ",").alias("doc_ids"), F.array_join(F.transform("grades", lambda g: g.cast("int").cast("string")), ",").alias("grades"))


def observed_abilities(spark, d):
    thetas = _shown(spark, d)[0].filter("substring(doc_id, 2) % 7 <> 0")
    return pools.observed(b.placements(spark, d), thetas)


def never_compared(spark, d):
    return pools.never_compared(b.placements(spark, d))


def judgement_ids(spark, d):
    """Content keys of judgements and of their families, and the composite key of data set and query."""
    line = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.lpad(F.col("position").cast("string"), 3, "0"), "doc_id"))), ",")
    rows = b.placements(spark, d).groupBy("record_id", "query_id", "judge", "phase").agg(line.alias("docs"))
    return rows.select(
        "record_id", F.left(F.sha2(F.concat_ws("\n", "judge", "phase", "query_id", "docs"), 256), F.lit(32)).alias("key"),
        F.left(F.sha2(F.concat_ws("\n", "judge", "phase"), 256), F.lit(16)).alias("family"), F.concat_ws("||", "judge", "query_id").alias("namespace"),
    )


def predictions(spark, d):
    from rankloom.sources import rankings

    labels = b.labels(spark, d).filter("grade > 0")
    rows = rankings.predictions(b.run(spark, d).filter("system = 'view'").join(labels.select("dataset", "query_id").distinct(), ["dataset", "query_id"], "left_semi"), labels.join(b.run(spark, d).filter("system = 'view'").select("dataset", "query_id").distinct(), ["dataset", "query_id"], "left_semi"))
    return rows.select("dataset", "split", "query_id", F.size("scores").cast("long").alias("n"), F.round(F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


QUERIES = {f.__name__: f for f in (
    pool_depth, selected_systems, rankings_concat, observation_order, overlay_thetas, population_prior, gain_variants, window_information, quantize_uint8,
    text_policy, token_cut, token_chunks, budget_census, usage_totals, window_coverage_split, comparison_components, rubric_sizes, cost_estimate, boundary_observed, adaptive_windows, stratified_groups,
    ndcg_evaluated, protocol_scored, protocol_report, metric_table, evaluation_summary, comparison_table, folded_lines, unknown_ids, criteria_gaps, kept_cases, hydrated_top, ranking_shape,
    observed_abilities, never_compared, judgement_ids, predictions,
)}

_P = [f"(1 / (1 + exp(-{g}::DOUBLE * (theta - ({v}::DOUBLE)))))" for g, v in zip(b.GAMMA, b.BETA)]
_LOW, _HIGH = f"({min(b.BETA)}::DOUBLE)", f"({max(b.BETA)}::DOUBLE)"
_PROTOCOL = _ndcg_sql("@", "run_tied grid qrels pools excluded", gain="pow(2, grade) - 1",
    run="(SELECT run.* FROM run JOIN pools USING (dataset, query_id, doc_id) ANTI JOIN excluded USING (dataset, query_id, doc_id) WHERE doc_id <> query_id)",
    qrels="(SELECT * FROM qrels ANTI JOIN excluded USING (dataset, query_id, doc_id) WHERE doc_id <> query_id)").rsplit("SELECT @ FROM", 1)[0].rstrip() + f""",
s AS (SELECT {_SYSTEM}, CASE WHEN idcg > 0 THEN round_even(ndcg, 5) END AS ndcg FROM n)
"""
_THETAS = ", v AS (SELECT * FROM placements WHERE valid), t AS (SELECT query_id, doc_id, round(avg(score), 6) AS theta FROM v GROUP BY ALL)"
_SIZES = "z AS (SELECT dataset, query_id, count(*) AS units, least(10, count(*)) AS w FROM pools GROUP BY ALL)"

ORACLE_SQL = {
    "pool_depth": b.sql("grid pools", "SELECT * FROM (SELECT dataset, query_id, doc_id, row_number() OVER (PARTITION BY dataset, query_id ORDER BY pos, doc_id) AS place FROM pools) WHERE place <= 20"),
    "selected_systems": b.sql("run", "SELECT system, CASE system WHEN 'view' THEN 1 ELSE 2 END::BIGINT AS place, count(*) AS n, round(sum(score), 4) AS score FROM run WHERE system IN ('view', 'click') GROUP BY ALL"),
    "rankings_concat": b.sql("run", "SELECT system, dataset, count(*) AS n FROM run GROUP BY ALL"),
    "observation_order": b.sql("placements log", "SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY judge, CASE WHEN record_id % 5 <> 0 THEN record_id % 97 END NULLS LAST, record_id) AS place FROM log"),
    "overlay_thetas": b.sql("grid qrels", "SELECT dataset, CASE WHEN pos % 9 <> 0 THEN 'fit' ELSE 'scored' END AS source, count(*) AS n, round(sum(theta), 4) AS total FROM qrels GROUP BY ALL"),
    "population_prior": b.sql("grid qrels", "SELECT dataset, count(*) AS n, round(avg(theta), 6) AS mean, round(nullif(stddev_pop(theta), 0), 6) AS sd FROM qrels GROUP BY ALL"),
    "gain_variants": b.sql("grid qrels", f"""SELECT dataset, query_id, doc_id, round(1 / (1 + exp(-theta)), 6) AS sigmoid_theta, round(1 / (1 + exp({sum(b.BETA) / 5}::DOUBLE - theta)), 6) AS sigmoid_mean_beta,
  round(({' + '.join(_P)}) / 5, 6) AS mean_criterion, round(({' + '.join(f'greatest({p} - 0.5, 0)' for p in _P)}) / 5, 6) AS excess_probability,
  CASE WHEN theta < {_LOW} THEN 0 ELSE round({_gain_sql()}, 6) END AS gated_weighted, round(pow({_gain_sql()}, 2), 6) AS power2_weighted,
  round(greatest(0, least(1, (theta - {_LOW}) / ({_HIGH} - {_LOW}))), 6) AS linear_theta, round({_P[2]}, 6) AS "criterion_C3" FROM qrels"""),
    "window_information": b.sql("grid qrels", ", i AS (SELECT *, round(pos % 7 * (" + " + ".join(f"{g * g}::DOUBLE * {p} * (1 - {p})" for g, p in zip(b.GAMMA, _P)) + "), 6) AS information FROM qrels) SELECT dataset, query_id, doc_id, information, information < 4.0::DOUBLE AS low_information FROM i"),
    "quantize_uint8": "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: trunc(least(greatest((x::DOUBLE + 0.4::DOUBLE) * (255.0::DOUBLE / 0.8::DOUBLE) - 128, -128), 127))::INT + 128), ',') AS codes FROM embeddings",
    "text_policy": r"""WITH w AS (SELECT doc_id, text, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS n FROM documents),
c AS (SELECT *, CASE WHEN n > 40 THEN regexp_extract(text, '^\s*(?:\S+\s+){0,39}\S*') ELSE text END AS cut FROM w)
SELECT doc_id, ((length(coalesce(text, '')) + 1) // 2)::BIGINT AS tokens, ((length(coalesce(cut, '')) + 1) // 2)::BIGINT AS kept_tokens, md5(cut) AS cut_md5 FROM c""",
    "usage_totals": "SELECT role, count(*) AS requests, sum((length(coalesce(text, '')) + 1) // 2)::BIGINT AS tokens FROM conversations GROUP BY ALL",
    "window_coverage_split": b.sql("placements log", """, x AS (SELECT query_id, string_agg(phase || '=' || n, ',' ORDER BY phase) AS by_phase FROM (SELECT query_id, phase, count(*) AS n FROM log WHERE NOT valid GROUP BY ALL) GROUP BY ALL),
y AS (SELECT query_id, string_agg(judge || '=' || n, ',' ORDER BY judge) AS by_judge FROM (SELECT query_id, judge, count(*) AS n FROM log WHERE NOT valid GROUP BY ALL) GROUP BY ALL)
SELECT query_id, count(*) AS windows, count(*) FILTER (NOT valid) AS invalid, round(avg((NOT valid)::INT), 6) AS share, coalesce(any_value(by_phase), '') AS by_phase, coalesce(any_value(by_judge), '') AS by_judge
FROM log LEFT JOIN x USING (query_id) LEFT JOIN y USING (query_id) GROUP BY query_id"""),
    "comparison_components": "WITH RECURSIVE " + b.sql("placements", """, e0 AS (SELECT query_id, record_id, min(doc_id) AS a, max(doc_id) AS b FROM placements WHERE position <= 2 AND valid GROUP BY ALL HAVING min(doc_id) < max(doc_id)),
e AS (SELECT DISTINCT query_id, a, b FROM e0 UNION SELECT DISTINCT query_id, b, a FROM e0),
r AS (SELECT DISTINCT query_id, a AS doc_id, a AS reached FROM e UNION SELECT r.query_id, r.doc_id, e.b FROM r JOIN e ON r.query_id = e.query_id AND r.reached = e.a)
SELECT query_id, doc_id, min(reached) AS component FROM r GROUP BY ALL""").removeprefix("WITH "),
    "rubric_sizes": b.sql("grid pools", f""", {_SIZES},
t AS (SELECT *, greatest(ceil(units / w)::BIGINT, round_even({1000 / 150}::DOUBLE * units / w, 0)::BIGINT) AS total FROM z),
k AS (SELECT *, least(total, greatest(1, round_even(0.5::DOUBLE * total, 0)::BIGINT)) AS random FROM t)
SELECT dataset, query_id, units, random, total - random AS stratified, greatest(0, units - random * w) AS uncovered FROM k"""),
    "cost_estimate": b.sql("grid pools", f""", {_SIZES}, c AS (SELECT dataset, 2 * (round_even(3.5::DOUBLE * units / 10, 0) + round_even(1.8::DOUBLE * units / 10, 0))::BIGINT + 56 AS calls FROM z)
SELECT dataset, count(*) AS queries, sum(calls)::BIGINT AS calls, sum(calls) * 20.0::DOUBLE AS seconds FROM c GROUP BY ALL"""),
    "boundary_observed": b.sql("placements", _THETAS + """, p AS (SELECT x.query_id, x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM v x JOIN v y ON x.record_id = y.record_id AND x.doc_id < y.doc_id GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS place, lead(doc_id) OVER w AS below, lead(theta) OVER w AS low FROM t WINDOW w AS (PARTITION BY query_id ORDER BY theta DESC, doc_id))
SELECT o.query_id, doc_id, below, place, round(1 / (1 + exp(low - theta)) * (1 - 1 / (1 + exp(low - theta))) / log2(place + 1) / (1 + coalesce(n, 0)), 6) AS value
FROM o LEFT JOIN p ON o.query_id = p.query_id AND a = least(doc_id, below) AND b = greatest(doc_id, below) WHERE place < 20 AND below IS NOT NULL"""),
    "ndcg_evaluated": _ndcg_sql("system, dataset, round(avg(ndcg), 6) AS ndcg, count(*) AS queries") + "n GROUP BY ALL",
    "protocol_scored": _PROTOCOL + f"SELECT {_SYSTEM}, round(ndcg, 6) AS ndcg FROM s",
    "protocol_report": _PROTOCOL + """, per AS (SELECT system, dataset, avg(ndcg) AS v, count(ndcg) AS n FROM s GROUP BY ALL)
SELECT system, dataset, round(v, 6) AS ndcg, n AS num_queries FROM per UNION ALL SELECT system, NULL, round(avg(v), 6), sum(n)::BIGINT FROM per GROUP BY system""",
    "metric_table": _classic_sql("0").replace("round(0, 6) AS {}", "@").rsplit("SELECT", 1)[0] + f""", v AS (
  SELECT {_SYSTEM}, unnest([{{'metric': 'map', 'value': {_VALUES['map']}}}, {{'metric': 'mrr', 'value': {_VALUES['mrr']}}}, {{'metric': 'recall', 'value': {_VALUES['recall']}}}, {{'metric': 'success', 'value': {_VALUES['success']}}}]) AS m FROM s)
SELECT system, m.metric AS metric, round(avg(m.value), 6) AS value, count(m.value) AS queries FROM v GROUP BY ALL""",
    "folded_lines": """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, count(*) AS copies FROM lineitem GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_quantity DESC) AS k, sum(copies) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, copies, (n - copies)::BIGINT AS lost FROM o WHERE k = 1""",
    "unknown_ids": b.sql("grid qrels pools", """SELECT dataset, 'labels' AS side, count(*) AS n FROM qrels ANTI JOIN pools USING (dataset, query_id, doc_id) GROUP BY ALL
UNION ALL SELECT dataset, 'pools', count(*) FROM pools ANTI JOIN qrels USING (dataset, query_id, doc_id) GROUP BY ALL"""),
    "criteria_gaps": b.sql("placements", "SELECT record_id, doc_id, CASE WHEN record_id % 31 = 0 THEN 'c5' ELSE '' END AS missing, CASE WHEN record_id % 31 = 0 THEN '' ELSE 'c9' END AS unknown FROM placements WHERE valid AND (record_id % 31 = 0 OR record_id % 37 = 0)"),
    "kept_cases": b.sql("placements log", "SELECT judge, count(*) AS n FROM log WHERE record_id % 3 <> 1 GROUP BY ALL"),
    "hydrated_top": b.sql("run", f"""SELECT {_SYSTEM}, r.doc_id, d.doc_id IS NOT NULL AS found, md5(coalesce(text, '')) AS body_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY {_SYSTEM} ORDER BY score DESC, doc_id) AS rk FROM run) r LEFT JOIN documents d ON r.doc_id = 'd' || d.doc_id WHERE rk <= 3"""),
    "ranking_shape": b.sql("grid qrels", "SELECT dataset, query_id, string_agg(doc_id, ',' ORDER BY pos) AS doc_ids, string_agg(grade::INT::VARCHAR, ',' ORDER BY pos) AS grades FROM qrels GROUP BY ALL"),
    "observed_abilities": b.sql("placements", _THETAS + "SELECT query_id, count(*) FILTER (substr(doc_id, 2)::INT % 7 <> 0) AS used, count(*) FILTER (substr(doc_id, 2)::INT % 7 = 0) AS skipped FROM v GROUP BY ALL"),
    "never_compared": b.sql("placements", """, w AS (SELECT *, valid AND count(*) OVER (PARTITION BY record_id) > 1 AS backs FROM placements)
SELECT query_id, doc_id FROM w GROUP BY ALL HAVING NOT bool_or(backs) AND query_id IN (SELECT query_id FROM w WHERE backs)"""),
    "judgement_ids": b.sql("placements", r""", g AS (SELECT record_id, query_id, judge, phase, string_agg(lpad(position::VARCHAR, 3, '0') || '=' || doc_id, ',' ORDER BY position) AS docs FROM placements GROUP BY ALL)
SELECT record_id, left(sha256(judge || chr(10) || phase || chr(10) || query_id || chr(10) || docs), 32) AS key, left(sha256(judge || chr(10) || phase), 16) AS family, judge || '||' || query_id AS namespace FROM g"""),
    "predictions": b.sql("run grid qrels", "SELECT dataset, 'test' AS split, query_id, count(*) AS n, round(sum(score), 4) AS total FROM run WHERE system = 'view' AND EXISTS (SELECT 1 FROM qrels q WHERE q.dataset = run.dataset AND q.query_id = run.query_id AND grade > 0) GROUP BY ALL"),
}
