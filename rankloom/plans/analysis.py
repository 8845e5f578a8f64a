"""Queries that compare systems, retrieve, read judgements and check tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import text, vectors
from rankloom.operators import compare, judgements, metrics, ranking, retrieval, validate
from rankloom.plans import bindings as b
from rankloom.plans.scoring import _SYSTEM, _ndcg_sql

CRITERIA = ["c1", "c2", "c3", "c4", "c5"]


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _ndcg(spark, d):
    return metrics.ndcg(b.run(spark, d, True), b.labels(spark, d), [10]).select(*ranking.KEYS, F.round("ndcg", 9).alias("value"))


def _deltas(spark, d):
    return compare.pairs(_ndcg(spark, d))


def pair_ttest(spark: SparkSession, d: str) -> DataFrame:
    rows = compare.paired_t(_deltas(spark, d))
    return rows.select("a", "b", "n", _r("delta"), _r("t", 4))


def pair_p_values(spark, d):
    return compare.with_p(compare.paired_t(_deltas(spark, d), ("dataset", "a", "b")))


def sensitivity_share(spark, d):
    return compare.sensitivity(_deltas(spark, d))


def bootstrap_ci(spark, d):
    return compare.bootstrap(_ndcg(spark, d), "value", 200)


def sign_flips(spark, d):
    recall = metrics.classic(b.run(spark, d, True), b.labels(spark, d), 10).select(*ranking.KEYS, F.round("recall", 9).alias("value"))
    rows = compare.sign_flips(_deltas(spark, d), compare.pairs(recall.filter("value IS NOT NULL")))
    return rows.select("dataset", "query_id", "a", "b", _r("delta"), _r("other"), _r("gap"))


def kendall_tau_b(spark, d):
    rows = b.run(spark, d, True).join(b.labels(spark, d), ["dataset", "query_id", "doc_id"])
    # one labelled document makes no pair, and such a ranking is no row; a pair without values is one with a null tau
    several = rows.groupBy(*ranking.KEYS).agg(F.count("*").alias("n")).filter("n > 1").select(*ranking.KEYS)
    tau = compare.kendall_tau_b(rows, list(ranking.KEYS), "doc_id", "score", "grade")
    return several.join(tau, list(ranking.KEYS), "left").select(*ranking.KEYS, _r("tau"))


def spearman_rank(spark, d):
    rows = b.run(spark, d, True).join(b.labels(spark, d), ["dataset", "query_id", "doc_id"])
    return compare.spearman(rows, ["system", "dataset"], "score", "theta").select("system", "dataset", "n", _r("rho"))


def mann_whitney_auc(spark, d):
    rows = b.run(spark, d, True).join(b.labels(spark, d), ["dataset", "query_id", "doc_id"]).withColumn("y", (F.col("grade") > 0).cast("int"))
    return compare.auc(rows, ["system", "dataset"], "score", "y").select("system", "dataset", _r("auc"))


def clustered_rate(spark, d):
    rows = b.placements(spark, d).withColumn("hit", F.col("c3"))
    return compare.clustered_rate(rows, ["phase"], "query_id", "hit").select("phase", "n", "clusters", _r("rate"), _r("low"), _r("high"))


def majority_vote(spark, d):
    """Documents that at least two of three phases pass on most of their windows."""
    per = b.placements(spark, d).filter("valid").groupBy("query_id", "doc_id", "phase").agg((F.avg("c3") > 0.5).alias("pass"))
    return per.groupBy("query_id", "doc_id").agg(F.count_if("pass").alias("votes"), (F.count_if("pass") >= 2).alias("majority"))


def _vectors(spark, d):
    return b.table(spark, d, "embeddings").select("vec_id", "embedding")


def _searched(rows, k=10):
    return retrieval.dense_top(rows, rows.filter("vec_id % 100 = 0"), k).select("query_id", "doc_id", "score", "rank")


def dense_topk(spark, d):
    return _searched(_vectors(spark, d))


def l2_normalise_topk(spark, d):
    return _searched(_vectors(spark, d).select("vec_id", vectors.normalised(F.col("embedding")).alias("v")))


def mrl_sweep(spark, d):
    out = None
    for k in (8, 16, 32):
        rows = _searched(_vectors(spark, d).select("vec_id", vectors.cut(F.col("embedding"), k).alias("v")), 5).withColumn("dims", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def maxsim_topk(spark, d):
    """Four vectors in turn are one item; every item whose number 100 divides asks all."""
    items = _vectors(spark, d).withColumn("item", F.floor(F.col("vec_id") / 4).cast("long"))
    rows = items.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("v"))
    return retrieval.dense_top(rows, rows.filter("item % 100 = 0"), 10).select("query_id", "doc_id", "score", "rank")


def quantize_int8(spark, d):
    q = vectors.quantise_int8(F.col("embedding"), -0.4, 0.4)
    return _vectors(spark, d).select("vec_id", F.array_join(q, ",").alias("codes"))


def quantize_binary(spark, d):
    return _vectors(spark, d).select("vec_id", F.array_join(vectors.sign_bits(F.col("embedding")), ",").alias("bits"))


def bm25_topk(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "text")
    return retrieval.bm25_top(docs, b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


def bm25_pruned(spark, d):
    """The same search with the common terms' postings looked up for candidates alone."""
    docs = b.table(spark, d, "documents").select("doc_id", "text")
    return retrieval.bm25_top(docs, b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10, prune=True)


def chunk_overlap(spark, d):
    rows = text.chunks(b.table(spark, d, "documents"), 64, 16)
    return rows.select("doc_id", "chunk_id", "start", "n_words", F.md5("text").alias("text_md5"))


def window_render(spark, d):
    rows = b.table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("docs"))
    return rows.select("conv_id", F.md5(text.window_text(F.col("docs"))).alias("window_md5"))


def max_pool_chunks(spark, d):
    doc = F.concat(F.lit("p"), (F.substring("doc_id", 2, 9).cast("int") % 20).cast("string"))
    return judgements.max_pooled(b.run(spark, d), doc, ranking.KEYS)


def rubric_or_pool(spark, d):
    doc = F.concat(F.lit("p"), (F.substring("doc_id", 2, 9).cast("int") % 10).cast("string"))
    return judgements.or_pooled(b.placements(spark, d), CRITERIA, doc)


def count_gain(spark, d):
    return judgements.count_gain(b.placements(spark, d), CRITERIA).select("query_id", "doc_id", "windows", _r("gain"))


def window_comparisons(spark, d):
    rows = judgements.comparisons(b.placements(spark, d).filter("valid"))
    return rows.select("record_id", "query_id", "winner", "loser", _r("weight"), _r("soft_label"))


def window_coverage(spark, d):
    return judgements.window_coverage(b.log(spark, d)).select("query_id", "phase", "windows", "invalid", _r("share"))


def coverage_flags(spark, d):
    return judgements.coverage_flags(judgements.window_coverage(b.log(spark, d))).select("query_id", "phase", "windows", "invalid", _r("share"))


def latest_judgement(spark, d):
    return judgements.latest(b.log(spark, d), ["key"], ["record_id"]).select("key", "record_id", "valid", "phase")


def judge_overlap(spark, d):
    return judgements.judge_overlap(b.placements(spark, d))


def _verdicts(spark, d):
    """Every valid placement's chance and outcome at the middle criterion."""
    return b.placements(spark, d).filter("valid").withColumn("p", F.round(F.lit(1.0) / (1 + F.exp(4.5 - F.col("score"))), 6))


def reliability_bins(spark, d):
    return judgements.reliability(_verdicts(spark, d), "p", "c3").select("bin", "n", _r("mean_p"), _r("rate"))


def reliability_grouping_sets(spark, d):
    rows = _verdicts(spark, d).withColumn("e", F.pow(F.col("p") - F.col("c3"), 2))
    sets = [[], [F.col("judge")], [F.col("phase")], [F.col("judge"), F.col("phase")]]
    return rows.groupingSets(sets, "judge", "phase").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("brier"))


def eap_scores(spark, d):
    rows = judgements.eap(judgements.patterns(b.placements(spark, d), CRITERIA), b.GAMMA, b.BETA)
    return rows.select("query_id", "doc_id", "n", _r("theta"), _r("se", 5))


def boundary_values(spark, d):
    rows = judgements.boundary_values(b.labels(spark, d), ["dataset", "query_id"])
    return rows.select("dataset", "query_id", "doc_id", F.col("place").cast("long").alias("place"), _r("value"))


def opponent_bins(spark, d):
    return judgements.quantile_bins(b.labels(spark, d), ["dataset", "query_id"], 7).select("dataset", "query_id", "doc_id", "bin")


def schedule_sizes(spark, d):
    return judgements.schedule_sizes(b.pools(spark, d))


def validation_report(spark, d):
    rows = validate.report(b.run(spark, d), b.labels(spark, d), b.pools(spark, d), b.excluded(spark, d))
    return rows.select("code", "n", F.array_join("examples", ",").alias("examples"))


def unknown_queries(spark, d):
    return validate.same_queries(b.run(spark, d), b.labels(spark, d).filter("grade > 0"))


def duplicate_pairs(spark, d):
    return validate.duplicates(b.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def score_delta(spark, d):
    """What of the difference of two systems comes from selecting documents, and what from ordering them."""
    run, labels = b.run(spark, d), b.labels(spark, d)
    two = run.filter("system IN ('view', 'purchase')")
    a, c = two.filter("system = 'view'"), two.filter("system = 'purchase'")
    place = ranking.top(a, 1_000_000).select("dataset", "query_id", "doc_id", F.col("rank").alias("place"))
    # purchase's documents, those that view ranks first and in its order
    mixed = c.join(place, ["dataset", "query_id", "doc_id"], "left").withColumn("score", F.coalesce(-F.col("place").cast("double"), F.col("score") - 1e6))
    rows = two.unionByName(mixed.drop("place").withColumn("system", F.lit("mixed")))
    per = metrics.ndcg(rows, labels, [10], "doc_id_desc").groupBy("dataset", "query_id").pivot("system", ["view", "purchase", "mixed"]).agg(F.first("ndcg"))
    per = per.filter("view IS NOT NULL AND purchase IS NOT NULL")
    return per.select("dataset", "query_id", F.round(F.col("mixed") - F.col("view"), 6).alias("selection"), F.round(F.col("purchase") - F.col("mixed"), 6).alias("ordering"))


QUERIES = {f.__name__: f for f in (
    pair_ttest, pair_p_values, sensitivity_share, bootstrap_ci, sign_flips, kendall_tau_b, spearman_rank, mann_whitney_auc, clustered_rate, majority_vote,
    dense_topk, l2_normalise_topk, mrl_sweep, maxsim_topk, quantize_int8, quantize_binary, bm25_topk, bm25_pruned, chunk_overlap, window_render, max_pool_chunks,
    rubric_or_pool, count_gain, window_comparisons, window_coverage, coverage_flags, latest_judgement, judge_overlap, reliability_bins,
    reliability_grouping_sets, eap_scores, boundary_values, opponent_bins, schedule_sizes, validation_report, unknown_queries, duplicate_pairs, score_delta,
)}

_PAIRS = f""", v AS (SELECT {_SYSTEM}, round(ndcg, 9) AS x FROM n),
p AS (SELECT l.dataset, l.query_id, l.system AS a, r.system AS b, r.x - l.x AS delta FROM v l JOIN v r ON l.dataset = r.dataset AND l.query_id = r.query_id AND l.system < r.system)
"""


def _after_ndcg(select: str, more: str = "") -> str:
    """The nDCG query's tables, then ``more`` of them, then ``select``."""
    head = _ndcg_sql("@").rsplit("SELECT @ FROM", 1)[0].rstrip()
    return f"{head}{_PAIRS}{more}{select}"


_BOTH = ", j AS (SELECT r.*, grade, theta FROM run r JOIN qrels USING (dataset, query_id, doc_id))\n"


def _top_sql(v: str, source: str = "embeddings", k: int = 10, extra: str = "") -> str:
    return f"""SELECT query_id, doc_id, score, rank{extra} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.vec_id AS query_id, x.vec_id AS doc_id, round(list_inner_product(q.v, x.v), 6) AS score
  FROM (SELECT vec_id, {v} AS v FROM {source} WHERE vec_id % 100 = 0) q, (SELECT vec_id, {v} AS v FROM {source}) x WHERE q.vec_id <> x.vec_id)) WHERE rank <= {k}"""


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"


_EAP = " + ".join(
    f"(s{i + 1} * -(greatest(-{x}, 0) + ln(1 + exp(-abs({x})))) - (n - s{i + 1}) * (greatest({x}, 0) + ln(1 + exp(-abs({x})))))"
    for i, x in enumerate(f"({g}::DOUBLE * (t - ({v}::DOUBLE)))" for g, v in zip(b.GAMMA, b.BETA))
)

ORACLE_SQL = {
    "pair_ttest": _after_ndcg("SELECT a, b, count(*) AS n, round(avg(delta), 6) AS delta, round(CASE WHEN count(*) > 1 AND max(delta) > min(delta) THEN avg(delta) / (stddev_samp(delta) / sqrt(count(*))) END, 4) AS t FROM p GROUP BY ALL"),
    "sign_flips": _after_ndcg(
        "SELECT dataset, query_id, a, b, round(delta, 6) AS delta, round(o.other, 6) AS other, round(abs(delta - o.other), 6) AS gap FROM p JOIN o USING (dataset, query_id, a, b) WHERE delta * o.other < 0",
        f""", rr AS (SELECT {_SYSTEM}, round(sum((coalesce(grade, 0) > 0)::INT) FILTER (rk <= 10) / nullif(max(pos_n), 0)::DOUBLE, 9) AS x FROM (
  SELECT r.*, q.grade, row_number() OVER (PARTITION BY {_SYSTEM} ORDER BY score DESC, doc_id DESC) AS rk, pn.pos_n FROM run r LEFT JOIN qrels q USING (dataset, query_id, doc_id)
  JOIN (SELECT dataset, query_id, count(*) FILTER (grade > 0) AS pos_n FROM qrels GROUP BY ALL) pn USING (dataset, query_id)) GROUP BY ALL HAVING max(pos_n) > 0),
o AS (SELECT l.dataset, l.query_id, l.system AS a, r.system AS b, r.x - l.x AS other FROM rr l JOIN rr r ON l.dataset = r.dataset AND l.query_id = r.query_id AND l.system < r.system)
"""),
    "kendall_tau_b": b.sql("run_tied grid qrels", _BOTH + f"""SELECT x.system, x.dataset, x.query_id,
  round((sum(sign(x.score - y.score) * sign(x.grade - y.grade)) / nullif(sqrt(sum(abs(sign(x.score - y.score))) * sum(abs(sign(x.grade - y.grade)))), 0))::DOUBLE, 6) AS tau
FROM j x JOIN j y ON x.system = y.system AND x.dataset = y.dataset AND x.query_id = y.query_id AND x.doc_id < y.doc_id GROUP BY ALL"""),
    "spearman_rank": b.sql("run_tied grid qrels", _BOTH + """, k AS (SELECT *, rank() OVER (PARTITION BY system, dataset ORDER BY score) + (count(*) OVER (PARTITION BY system, dataset, score) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY system, dataset ORDER BY theta) + (count(*) OVER (PARTITION BY system, dataset, theta) - 1) / 2 AS ry FROM j)
SELECT system, dataset, count(*) AS n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS rho FROM k GROUP BY ALL"""),
    "mann_whitney_auc": b.sql("run_tied grid qrels", _BOTH + """, k AS (SELECT *, (grade > 0)::INT AS y, rank() OVER (PARTITION BY system, dataset ORDER BY score) + (count(*) OVER (PARTITION BY system, dataset, score) - 1) / 2 AS r FROM j)
SELECT system, dataset, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 6)::DOUBLE AS auc FROM k GROUP BY ALL"""),
    "clustered_rate": b.sql("placements", """, i AS (SELECT phase, query_id, sum(c3) AS s, count(*) AS m FROM placements GROUP BY ALL),
t AS (SELECT phase, sum(m)::BIGINT AS n, count(*) AS clusters, (sum(s) / sum(m))::DOUBLE AS rate FROM i GROUP BY ALL)
SELECT phase, n, clusters, round(rate, 6) AS rate, round(rate - 1.96 * sqrt(sum(pow(s - rate * m, 2))) / n, 6) AS low, round(rate + 1.96 * sqrt(sum(pow(s - rate * m, 2))) / n, 6) AS high FROM i JOIN t USING (phase) GROUP BY phase, n, clusters, rate"""),
    "majority_vote": b.sql("placements", """SELECT query_id, doc_id, count(*) FILTER (p) AS votes, count(*) FILTER (p) >= 2 AS majority FROM (
  SELECT query_id, doc_id, phase, avg(c3) > 0.5 AS p FROM placements WHERE valid GROUP BY ALL) GROUP BY ALL"""),
    "dense_topk": _top_sql("embedding::DOUBLE[]"),
    "l2_normalise_topk": _top_sql(_unit("embedding::DOUBLE[]")),
    "mrl_sweep": " UNION ALL ".join(f"SELECT *, {k} AS dims FROM ({_top_sql(_unit(f'embedding[1:{k}]::DOUBLE[]'), k=5)})" for k in (8, 16, 32)),
    "maxsim_topk": """WITH t AS (SELECT vec_id // 4 AS item, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.item AS query_id, x.item AS doc_id, q.vec_id, max(list_inner_product(q.v, x.v)) AS m FROM t q, t x WHERE q.item % 100 = 0 AND q.item <> x.item GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM s GROUP BY ALL)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""",
    "quantize_int8": "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: trunc(least(greatest((x::DOUBLE + 0.4::DOUBLE) * (255.0::DOUBLE / 0.8::DOUBLE) - 128, -128), 127))::INT), ',') AS codes FROM embeddings",
    "quantize_binary": "SELECT vec_id, array_to_string(list_transform(range(0, len(embedding), 8), lambda i: list_sum(list_transform(range(8), lambda j: CASE WHEN embedding[i + j + 1] > 0 THEN (1 << (7 - j))::INT ELSE 0 END))::INT), ',') AS bits FROM embeddings",
    "bm25_topk": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS ts FROM documents),
a AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark),
g AS (SELECT count(*) AS docs, avg(len(ts)) AS mean FROM d),
tf AS (SELECT term, doc_id, n, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
p AS (SELECT term, doc_id, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean)) AS w FROM tf JOIN df USING (term), g),
s AS (SELECT query_id, doc_id, round(sum(w), 6)::DOUBLE AS score FROM a JOIN p USING (term) GROUP BY ALL)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "chunk_overlap": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(greatest(ceil((len(w) - 16) / 48)::INT, 1))) AS c FROM w WHERE len(w) > 0)
SELECT doc_id, doc_id || '#' || c AS chunk_id, (c * 48)::BIGINT AS start, len(w[c * 48 + 1 : c * 48 + 64])::BIGINT AS n_words, md5(array_to_string(w[c * 48 + 1 : c * 48 + 64], ' ')) AS text_md5 FROM c""",
    "window_render": r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS i FROM conversations)
SELECT conv_id, md5(string_agg('<doc id="doc_' || i || '">' || chr(10) || replace(replace(replace(trim(text, ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '</doc>', chr(10) ORDER BY i)) AS window_md5 FROM t GROUP BY ALL""",
    "max_pool_chunks": b.sql("run", f"SELECT {_SYSTEM}, 'p' || (substr(doc_id, 2)::INT % 20) AS document, max(score) AS score, min(pos) AS pos FROM run GROUP BY ALL"),
    "rubric_or_pool": b.sql("placements", "SELECT record_id, 'p' || (substr(doc_id, 2)::INT % 10) AS document, max(c1) AS c1, max(c2) AS c2, max(c3) AS c3, max(c4) AS c4, max(c5) AS c5 FROM placements GROUP BY ALL"),
    "count_gain": b.sql("placements", "SELECT query_id, doc_id, count(*) AS windows, round(sum(c1 + c2 + c3 + c4 + c5) / (5.0::DOUBLE * count(*)), 6) AS gain FROM placements WHERE valid GROUP BY ALL"),
    "window_comparisons": b.sql("placements", """, w AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n FROM placements WHERE valid)
SELECT x.record_id, x.query_id, CASE WHEN x.score >= y.score THEN x.doc_id ELSE y.doc_id END AS winner, CASE WHEN x.score >= y.score THEN y.doc_id ELSE x.doc_id END AS loser,
  round(2.0::DOUBLE / x.n, 6) AS weight, round(least(greatest(1 / (1 + exp(-abs(x.score - y.score))), 0.01), 0.99), 6)::DOUBLE AS soft_label
FROM w x JOIN w y ON x.record_id = y.record_id AND x.position < y.position"""),
    "window_coverage": b.sql("placements log", "SELECT query_id, phase, count(*) AS windows, count(*) FILTER (NOT valid) AS invalid, round(avg((NOT valid)::INT), 6) AS share FROM log GROUP BY ALL"),
    "coverage_flags": b.sql("placements log", "SELECT query_id, phase, count(*) AS windows, count(*) FILTER (NOT valid) AS invalid, round(avg((NOT valid)::INT), 6) AS share FROM log GROUP BY ALL HAVING avg((NOT valid)::INT) > 0.05 OR (phase = 'adaptive' AND count(*) FILTER (NOT valid) > 0)"),
    "latest_judgement": b.sql("placements log", "SELECT key, record_id, valid, phase FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY valid DESC, recorded_at DESC, record_id DESC) AS n FROM log) WHERE n = 1"),
    "judge_overlap": b.sql("placements", ", s AS (SELECT DISTINCT judge, query_id, doc_id FROM placements) SELECT x.judge AS judge_a, y.judge AS judge_b, count(*) AS shared FROM s x JOIN s y ON x.query_id = y.query_id AND x.doc_id = y.doc_id AND x.judge < y.judge GROUP BY ALL"),
    "reliability_bins": b.sql("placements", """, v AS (SELECT round(1 / (1 + exp(4.5::DOUBLE - score)), 6) AS p, c3 FROM placements WHERE valid),
e AS (SELECT *, (SELECT count(*) FROM (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS x) WHERE x <= p)::INT AS bin FROM v)
SELECT b.bin, count(p) AS n, round(avg(p), 6) AS mean_p, round(avg(c3), 6) AS rate FROM (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN e ON e.bin = b.bin GROUP BY ALL"""),
    "reliability_grouping_sets": b.sql("placements", """, v AS (SELECT judge, phase, pow(round(1 / (1 + exp(4.5::DOUBLE - score)), 6) - c3, 2) AS e FROM placements WHERE valid)
SELECT judge, phase, count(*) AS n, round(avg(e), 6) AS brier FROM v GROUP BY GROUPING SETS ((), (judge), (phase), (judge, phase))"""),
    "eap_scores": b.sql("placements", f""", r AS (SELECT query_id, doc_id, count(*) AS n, sum(c1) AS s1, sum(c2) AS s2, sum(c3) AS s3, sum(c4) AS s4, sum(c5) AS s5 FROM placements WHERE valid GROUP BY ALL),
k AS (SELECT DISTINCT n, s1, s2, s3, s4, s5 FROM r), g AS (SELECT -18 + i * (28.0::DOUBLE / 560) AS t FROM (SELECT unnest(range(561)) AS i)),
l AS (SELECT n, s1, s2, s3, s4, s5, t, -t * t / 2 + {_EAP} AS lg FROM k, g),
m AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY n, s1, s2, s3, s4, s5)) AS w FROM l),
f AS (SELECT n, s1, s2, s3, s4, s5, sum(w * t) / sum(w) AS theta, sum(w * t * t) / sum(w) AS tt FROM m GROUP BY ALL)
SELECT query_id, doc_id, n, round(theta, 6) AS theta, round(sqrt(greatest(tt - theta * theta, 0)), 5) AS se FROM r JOIN f USING (n, s1, s2, s3, s4, s5)"""),
    "boundary_values": b.sql("grid qrels", """, o AS (SELECT *, row_number() OVER w AS place, lead(theta) OVER w AS below FROM qrels WINDOW w AS (PARTITION BY dataset, query_id ORDER BY theta DESC, doc_id))
SELECT dataset, query_id, doc_id, place, round(1 / (1 + exp(below - theta)) * (1 - 1 / (1 + exp(below - theta))) / log2(place + 1), 6) AS value FROM o WHERE below IS NOT NULL"""),
    "opponent_bins": b.sql("grid qrels", "SELECT dataset, query_id, doc_id, ((row_number() OVER (PARTITION BY dataset, query_id ORDER BY theta DESC, doc_id) - 1) * 7 // count(*) OVER (PARTITION BY dataset, query_id))::BIGINT AS bin FROM qrels"),
    "schedule_sizes": b.sql("grid pools", "SELECT dataset, query_id, count(*) AS units, round_even(3.5::DOUBLE * count(*) / 10, 0)::BIGINT AS random, round_even(1.8::DOUBLE * count(*) / 10, 0)::BIGINT AS stratified, least(7, count(*))::BIGINT AS adaptive FROM pools GROUP BY ALL"),
    "validation_report": b.sql("run grid qrels pools excluded", """, k AS (SELECT DISTINCT dataset, query_id, doc_id FROM run),
a AS (
  SELECT 'EXCLUDED_RELEVANT' AS code, dataset || '/' || query_id || '/' || doc_id AS id FROM qrels SEMI JOIN excluded USING (dataset, query_id, doc_id) WHERE grade > 0
  UNION ALL SELECT 'UNJUDGED_CANDIDATES', dataset || '/' || query_id || '/' || doc_id FROM pools ANTI JOIN qrels USING (dataset, query_id, doc_id)
  UNION ALL SELECT 'QUERIES_WITHOUT_POOL', dataset || '/' || query_id FROM (SELECT DISTINCT dataset, query_id FROM qrels) ANTI JOIN pools USING (dataset, query_id)
  UNION ALL SELECT 'UNKNOWN_QUERIES', dataset || '/' || query_id FROM (SELECT DISTINCT dataset, query_id FROM k) ANTI JOIN qrels USING (dataset, query_id)
  UNION ALL SELECT 'OUTSIDE_POOL', dataset || '/' || query_id || '/' || doc_id FROM k ANTI JOIN pools USING (dataset, query_id, doc_id)
  UNION ALL SELECT 'EXCLUDED_RANKED', dataset || '/' || query_id || '/' || doc_id FROM k SEMI JOIN excluded USING (dataset, query_id, doc_id)),
c AS (SELECT unnest(['EXCLUDED_RELEVANT', 'UNJUDGED_CANDIDATES', 'QUERIES_WITHOUT_POOL', 'UNKNOWN_QUERIES', 'OUTSIDE_POOL', 'EXCLUDED_RANKED']) AS code)
SELECT c.code, count(id) AS n, coalesce(array_to_string(list_sort(list_distinct(list(id) FILTER (id IS NOT NULL)))[1:5], ','), '') AS examples FROM c LEFT JOIN a USING (code) GROUP BY ALL"""),
    "unknown_queries": b.sql("run grid qrels", """, l AS (SELECT DISTINCT dataset, query_id FROM run), r AS (SELECT DISTINCT dataset, query_id FROM qrels WHERE grade > 0)
SELECT dataset, query_id, 'left' AS side FROM l ANTI JOIN r USING (dataset, query_id) UNION ALL SELECT dataset, query_id, 'right' FROM r ANTI JOIN l USING (dataset, query_id)"""),
    "score_delta": _ndcg_sql("dataset, query_id, round(m - v, 6) AS selection, round(p - m, 6) AS ordering", "run grid qrels", ties="doc_id_desc", run="""(
  SELECT * FROM run WHERE system IN ('view', 'purchase') UNION ALL
  SELECT 'mixed', c.dataset, c.query_id, c.doc_id, coalesce(-p.place::DOUBLE, c.score - 1e6::DOUBLE), c.pos FROM (SELECT * FROM run WHERE system = 'purchase') c
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY dataset, query_id ORDER BY score DESC, doc_id) AS place FROM run WHERE system = 'view') p USING (dataset, query_id, doc_id))""")
    + "(SELECT dataset, query_id, max(ndcg) FILTER (system = 'view') AS v, max(ndcg) FILTER (system = 'purchase') AS p, max(ndcg) FILTER (system = 'mixed') AS m FROM n GROUP BY ALL) WHERE v IS NOT NULL AND p IS NOT NULL",
    "duplicate_pairs": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
}
ORACLE_SQL["bm25_pruned"] = ORACLE_SQL["bm25_topk"]
