"""Queries of the estimators, which SQL cannot express; tests hold them against their optimum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import abilities, calibrate, estimators, judgements
from rankloom.operators.lineage import cut
from rankloom.plans import bindings as b
from rankloom.plans.analysis import CRITERIA


def _patterns(spark, d):
    return judgements.patterns(b.placements(spark, d), CRITERIA)


def bradley_terry_fit(spark: SparkSession, d: str) -> DataFrame:
    return estimators.bradley_terry(judgements.comparisons(b.placements(spark, d).filter("valid")))


def rubric_2pl_fit(spark, d):
    """Every document's expected ability under items fitted to all of them."""
    rows = _patterns(spark, d)
    gamma, beta = estimators.rubric_items(rows, len(CRITERIA))
    return judgements.eap(rows, gamma.tolist(), beta.tolist()).select("query_id", "doc_id", "theta", "se")


def rasch_ability(spark, d):
    return estimators.rasch_scores(_patterns(spark, d), b.BETA).select("query_id", "doc_id", F.round("theta", 6).alias("theta"), F.round("score", 6).alias("score"))


def insert_document(spark, d):
    """Each query's last document by name, placed against the others' fitted abilities."""
    pairs = cut(judgements.summed(judgements.comparisons(b.placements(spark, d).filter("valid"))))
    thetas = cut(estimators.bradley_terry(pairs))
    new = thetas.groupBy("query_id").agg(F.max("doc_id").alias("doc_id"))
    won = pairs.join(new.withColumnRenamed("doc_id", "winner"), ["query_id", "winner"]).select("query_id", F.col("winner").alias("doc_id"), F.col("loser").alias("other"), "weight", F.col("soft_label").alias("label"))
    lost = pairs.join(new.withColumnRenamed("doc_id", "loser"), ["query_id", "loser"]).select("query_id", F.col("loser").alias("doc_id"), F.col("winner").alias("other"), "weight", (1 - F.col("soft_label")).alias("label"))
    other = thetas.select("query_id", F.col("doc_id").alias("other"), F.col("theta").alias("other_theta"))
    return estimators.insert_document(won.unionByName(lost).join(other, ["query_id", "other"]))


def balanced_groups(spark, d):
    return estimators.balanced_groups(b.pools(spark, d), 10, 5)


def _calibration(spark, d):
    rows = b.placements(spark, d)
    return calibrate.calibrate(rows, rows, CRITERIA, pooled=True)


def calibrated_thetas(spark, d):
    """Abilities of all documents under items, severities and scales fitted together, anchored on the tournament."""
    return _calibration(spark, d).thetas


def rubric_calibration(spark, d):
    """The calibration of each judge's verdicts alone, without the tournament."""
    rows = cut(b.placements(spark, d).select("record_id", "query_id", "doc_id", "judge", "valid", "phase", *CRITERIA))
    parts = [calibrate.calibrate(rows.filter(F.col("judge") == j), None, CRITERIA).thetas.withColumn("judge", F.lit(j)) for j in ("j0", "j1")]
    return parts[0].unionByName(parts[1])


def tournament_projection(spark, d):
    """Abilities of documents shown in two chunks each: the better chunk's."""
    rows = b.placements(spark, d).withColumn("doc_id", F.concat_ws("#", "doc_id", (F.col("record_id") % 2).cast("string")))
    return calibrate.projection(rows, chunk_of=F.substring_index("doc_id", "#", 1))


#: A frozen pooled calibration for documents that it lacks (those of odd number).
SEVERITY, PRIOR = {"j0": 0.3, "j1": -0.2}, (0.2, 1.5)


def scored_missing(spark, d):
    """Documents that a frozen pooled calibration lacks, each from all judges' verdicts."""
    rows = calibrate.evidence(b.placements(spark, d).filter("cast(substring(doc_id, 2) as int) % 2 = 1"), CRITERIA, True)
    out = abilities.score_documents(rows, b.GAMMA, b.BETA, *PRIOR, SEVERITY)
    return out.select("query_id", "doc_id", "n", *[F.round(c, 6).alias(c) for c in ("theta", "se", "information")], "degenerate", "low_information")


def inserted_documents(spark, d):
    """Every query's documents numbered 35 and more put into the tournament of the others, with the predicates that fail."""
    pairs = cut(judgements.summed(judgements.comparisons(b.placements(spark, d).filter("valid"))))
    number = lambda c: F.substring(c, 2, 9).cast("int")
    old = pairs.filter((number("winner") < 35) & (number("loser") < 35))
    return abilities.insert(pairs, cut(estimators.bradley_terry(old)), old)


QUERIES = {
    f.__name__: f
    for f in (
        bradley_terry_fit, rubric_2pl_fit, rasch_ability, insert_document, balanced_groups, calibrated_thetas, rubric_calibration, tournament_projection,
        scored_missing, inserted_documents,
    )
}

_SEVERITY = "CASE judge WHEN 'j0' THEN 0.3::DOUBLE ELSE -0.2::DOUBLE END"


def _logit(i: int, theta: str) -> str:
    return f"({b.GAMMA[i]}::DOUBLE * ({theta} - ({b.BETA[i]}::DOUBLE)) - sev)"


_LOG = " + ".join(
    f"(-s{i + 1} * (greatest(-{x}, 0) + ln(1 + exp(-abs({x})))) - (n - s{i + 1}) * (greatest({x}, 0) + ln(1 + exp(-abs({x})))))" for i, x in enumerate(_logit(i, "(0.2 + 1.5::DOUBLE * u)") for i in range(5))
)
_INFO = " + ".join(f"{b.GAMMA[i]}::DOUBLE ** 2 / (1 + exp(-{_logit(i, 'theta')})) / (1 + exp({_logit(i, 'theta')}))" for i in range(5))

ORACLE_SQL = {
    "scored_missing": b.sql("placements", f""", r AS (
  SELECT query_id, doc_id, {_SEVERITY} AS sev, count(*) AS n, sum(c1) AS s1, sum(c2) AS s2, sum(c3) AS s3, sum(c4) AS s4, sum(c5) AS s5
  FROM placements WHERE valid AND substr(doc_id, 2)::INT % 2 = 1 GROUP BY ALL),
g AS (SELECT -18 + i * (28.0::DOUBLE / 560) AS u FROM (SELECT unnest(range(561)) AS i)),
l AS (SELECT query_id, doc_id, u, sum({_LOG}) - u * u / 2 AS lg FROM r, g GROUP BY query_id, doc_id, u),
m AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY query_id, doc_id)) AS w FROM l),
f AS (SELECT query_id, doc_id, 0.2 + 1.5::DOUBLE * sum(w * u) / sum(w) AS theta, 1.5::DOUBLE * sqrt(sum(w * u * u) / sum(w) - (sum(w * u) / sum(w)) ** 2) AS se FROM m GROUP BY ALL),
i AS (SELECT query_id, doc_id, any_value(theta) AS theta, any_value(se) AS se, sum(n)::BIGINT AS n, sum(n * ({_INFO})) AS information, sum(s1 + s2 + s3 + s4 + s5) AS passed FROM r JOIN f USING (query_id, doc_id) GROUP BY ALL)
SELECT query_id, doc_id, n, round(theta, 6) AS theta, round(se, 6) AS se, round(information, 6) AS information,
  CASE WHEN passed = 0 THEN 'all_fail' WHEN passed = 5 * n THEN 'all_pass' END AS degenerate, information < 4 AS low_information FROM i"""),
}
