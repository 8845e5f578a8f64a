"""Calibrations: fitted to judged windows, extended by documents they lack, checked against the windows they came from."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import gains
from rankloom.operators import abilities, estimators, joint, judgements
from rankloom.operators.joint import Priors
from rankloom.operators.lineage import cut

#: Largest gain by which the refit of a calibration's own windows may differ from it.
MAX_GAIN_SHIFT = 0.01
#: Documents named in a refusal.
NAMED = 5


@dataclass(frozen=True)
class Calibration:
    """``thetas(query_id, doc_id, theta, se, source)`` and ``queries(query_id, tau, alpha)`` are tables; all else is small."""

    mode: str
    criteria: list[str]
    gamma: list[float]
    beta: list[float]
    severity: dict[str, float]
    thetas: DataFrame
    queries: DataFrame | None
    priors: Priors
    #: Mean and deviation of the ability prior of a rubric-only fit.
    prior: tuple[float, float] | None
    identity: str
    #: (code, rows it is about).
    warnings: list[tuple[str, int]] = field(default_factory=list)
    diagnostics: dict = field(default_factory=dict)

    def scoring_prior(self) -> tuple[float, float]:
        """The prior of a document scored against it: the fit's own, or mean and deviation of the fitted abilities."""
        if self.prior:
            return self.prior
        row = self.thetas.filter("source = 'fit'").agg(F.avg("theta").alias("m"), F.stddev_pop("theta").alias("s")).first()
        if not row.s:
            raise ValueError("fewer than two abilities: no prior to score documents by")
        return row.m, row.s

    def extended(self, records: DataFrame) -> Calibration:
        """With ``records(query_id, doc_id, theta, se, source, calibration)`` added; of another calibration, or known documents: refused."""
        same = F.col("calibration") == self.identity
        rows = records.withColumn("theta", F.when(same, F.col("theta")).otherwise(F.raise_error(F.lit("an extension of another calibration"))))
        known = self.thetas.select("query_id", "doc_id", F.lit(True).alias("known"))
        rows = rows.join(known, ["query_id", "doc_id"], "left")
        rows = rows.withColumn("theta", F.when(F.col("known").isNull(), F.col("theta")).otherwise(F.raise_error(F.concat(F.lit("already in the calibration: "), "doc_id"))))
        return replace(self, thetas=self.thetas.unionByName(rows.select("query_id", "doc_id", "theta", "se", "source")))


def projection(placements: DataFrame, l2: float = 1e-4, chunk_of: Column | None = None) -> DataFrame:
    """(query_id, doc_id, theta, se) of the documents that valid tournament windows compare.

    Abilities are fitted to the shown units; a unit that no valid window compares with another has none. With
    ``chunk_of`` (the document of a shown unit) a document's ability is its best chunk's, with that chunk's error.
    """
    fits = estimators.bradley_terry(judgements.comparisons(placements.filter("valid")), l2)
    if chunk_of is None:
        return fits
    best = fits.groupBy("query_id", chunk_of.alias("document")).agg(F.max(F.struct("theta", (-F.col("se")).alias("less"))).alias("best"))
    return best.select("query_id", F.col("document").alias("doc_id"), "best.theta", (-F.col("best.less")).alias("se"))


def evidence(placements: DataFrame, criteria: list[str], by_judge: bool) -> DataFrame:
    """(query_id, doc_id, judge, n, s1...): windows and passes of valid rubric windows; one judge, null, unless ``by_judge``."""
    judge = F.col("judge").cast("string") if by_judge else F.lit(None).cast("string")
    return placements.filter("valid").groupBy("query_id", "doc_id", judge.alias("judge")).agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(f"s{i + 1}") for i, c in enumerate(criteria)])


def _digest(*tables: DataFrame) -> str:
    """Of the sets of judged windows, in any order; repeated rows cancel out, so each window counts once."""
    out = []
    for t in tables:
        row = t.select("record_id").distinct().agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(record_id))").alias("x"), F.expr("bit_xor(xxhash64(record_id, 1L))").alias("y")).first()
        out.append(f"{row.n}.{(row.x or 0) & (1 << 64) - 1:016x}{(row.y or 0) & (1 << 64) - 1:016x}")
    return "-".join(out)


def _names(rows: DataFrame) -> str:
    return ", ".join(f"{r.query_id}/{r.doc_id}" for r in rows.orderBy("query_id", "doc_id").limit(NAMED).collect())


def calibrate(
    rubric: DataFrame, tournament: DataFrame | None, criteria: list[str], mode: str = "auto", pooled: bool = False, priors: Priors = Priors(), strict: bool = False,
) -> Calibration:
    """A calibration from placements of rubric windows, anchored on those of tournament windows if there are any.

    ``rubric(record_id, query_id, doc_id, judge, valid, phase, <criteria>)`` and ``tournament(record_id, query_id,
    doc_id, position, score, valid, phase)``, one row a placement, each window once. ``auto`` takes the tournament if
    every rubric query has one and the rubric alone if none has; anything between is refused, as are several judges
    unless ``pooled`` (which needs the tournament). Queries with more than 5 % invalid windows or an invalid adaptive
    one, documents without a valid comparison, and rubric documents without an ability are counted in ``warnings``;
    with ``strict`` the first two are refused. The abilities of the tournament stand on the fit's scale, tau theta +
    alpha; a rubric-only fit gives posterior means. Null abilities and empty stages are stated in the operators used.
    """
    if mode not in ("auto", "tournament", "rubric_only"):
        raise ValueError(f"unknown mode {mode!r}")
    whole, own, theirs = rubric, ["record_id", "query_id", "doc_id", "judge", "valid", "phase", *criteria], ["record_id", "query_id", "doc_id", "position", "score", "valid", "phase"]
    # one table in both roles is worked out once
    rubric = cut(whole.select(*dict.fromkeys(own + theirs)) if tournament is whole else whole.select(*own))
    asked = rubric.filter("valid").select("query_id").distinct()
    if asked.isEmpty():
        raise ValueError("no valid rubric window to calibrate")
    judges = [r.judge for r in rubric.filter("valid").select("judge").distinct().orderBy("judge").limit(1000).collect()]
    if not pooled and len(judges) > 1:
        raise ValueError(f"several rubric judges ({judges[:NAMED]}): pool them or calibrate each alone")
    if tournament is None:
        has = none = 0
    else:
        tournament = rubric.select(*theirs) if tournament is whole else cut(tournament.select(*theirs))
        row = asked.join(tournament.select("query_id", F.lit(1).alias("t")).distinct(), "query_id", "left").agg(F.count("t").alias("has"), F.count_if(F.col("t").isNull()).alias("none")).first()
        has, none = row["has"], row["none"]
    if mode == "tournament" and not has:
        raise ValueError("no rubric query has tournament windows")
    if mode == "auto" and has and none:
        raise ValueError(f"{has} rubric queries have tournament windows and {none} have none: name the mode")
    mode = "tournament" if mode == "tournament" or mode == "auto" and has else "rubric_only"
    if pooled and mode != "tournament":
        raise ValueError("pooled judges need the tournament: the rubric alone has no severities")

    warnings: list[tuple[str, int]] = []

    def warn(code: str, rows: DataFrame, refuse: bool) -> None:
        n = rows.count()
        if n and refuse and strict:
            raise ValueError(f"refused by strict: {code} for {n} rows")
        if n:
            warnings.append((code, n))

    stages = [rubric] + ([tournament] if mode == "tournament" else [])
    for stage in stages:
        heads = stage.select("record_id", "query_id", "phase", "valid").distinct()
        warn("INVALID_WINDOWS", judgements.coverage_flags(judgements.window_coverage(heads)).select("query_id").distinct(), True)
    seen = cut(evidence(rubric, criteria, pooled))
    if mode == "rubric_only":
        fit = abilities.rubric_2pl(seen.drop("judge"), len(criteria), priors.ability_sd)
        scored = abilities.score_documents(seen, fit.gamma, fit.beta, fit.mean, fit.sd)
        thetas = cut(scored.select("query_id", "doc_id", "theta", "se", F.lit("fit").alias("source")))
        notes = {"rounds": fit.rounds, "documents": fit.documents, "log_likelihood": fit.log_likelihood, "max_item_weight": fit.max_item_weight, "ordinal": fit.ordinal}
        return Calibration(mode, criteria, fit.gamma, fit.beta, {}, thetas, None, priors, (fit.mean, fit.sd), _digest(rubric), warnings, notes)

    bt = cut(projection(tournament, priors.bt_l2))
    warn("NO_VALID_TOURNAMENT_EVIDENCE", tournament.select("query_id", "doc_id").distinct().join(bt, ["query_id", "doc_id"], "left_anti"), True)
    warn("UNCALIBRATED_DOCUMENTS", seen.select("query_id", "doc_id").distinct().join(bt, ["query_id", "doc_id"], "left_anti"), False)
    rows = seen.join(bt.select("query_id", "doc_id", "theta"), ["query_id", "doc_id"], "left")
    fit = joint.tournament_2pl(rows, len(criteria), priors, pooled)
    thetas = bt.join(fit.queries, "query_id").select("query_id", "doc_id", gains.affine(F.col("theta"), F.col("tau"), F.col("alpha")).alias("theta"), (F.col("se") * F.col("tau")).alias("se"), F.lit("fit").alias("source"))
    notes = {"rounds": fit.rounds, "observations": fit.observations, "loss": fit.loss, "max_grad": fit.max_grad, "converged": fit.converged}
    return Calibration(mode, criteria, fit.gamma, fit.beta, fit.severity, cut(thetas), fit.queries, priors, None, _digest(rubric, tournament), warnings, notes)


def score_missing(calibration: Calibration, rubric: DataFrame, se_target: float = abilities.SE_TARGET) -> DataFrame:
    """(query_id, doc_id, n, theta, se, information, degenerate, low_information, source, calibration) of rubric documents it lacks.

    Documents it holds are left out. One document, one ability: all its judges' verdicts count, each with the judge's
    severity in a pooled calibration (a judge without one is refused). The prior is ``scoring_prior``. No rows: none.
    """
    known = calibration.thetas.select("query_id", "doc_id")
    rows = evidence(rubric, calibration.criteria, True).join(known, ["query_id", "doc_id"], "left_anti")
    scored = abilities.score_documents(rows, calibration.gamma, calibration.beta, *calibration.scoring_prior(), calibration.severity, se_target)
    return scored.withColumns({"source": F.lit("scored"), "calibration": F.lit(calibration.identity)})


@dataclass(frozen=True)
class Anchor:
    """How far the refit of a calibration's own windows is from it."""

    documents: int
    theta_shift: float
    gain_shift: float


def insert_missing(
    calibration: Calibration, tournament: DataFrame, max_gain_shift: float = MAX_GAIN_SHIFT, se_target: float = abilities.SE_TARGET, min_opponents: int = abilities.MIN_OPPONENTS,
) -> tuple[DataFrame, Anchor]:
    """New documents of a tournament calibration from ``tournament`` windows, every fitted ability frozen; and the anchor check.

    The windows hold those that the calibration was fitted on, which are the ones of fitted documents only, and those
    that pair new documents with fitted ones. Refused: a rubric-only calibration, queries it lacks, no new document,
    fitted documents that the refit of the old windows does not reach, a refit whose gains differ by more than
    ``max_gain_shift`` (or that compares nothing), and documents for which a predicate of ``abilities.insert`` fails.
    Only queries with new documents are refitted. theta and se come on the calibration's scale, information likewise.
    """
    if calibration.mode != "tournament":
        raise ValueError("a rubric-only calibration: score documents instead")
    windows = tournament.filter("valid").select("record_id", "query_id", "doc_id", "position", "score")
    fitted = calibration.thetas.filter("source = 'fit'").select("query_id", "doc_id", "theta", F.lit(True).alias("fitted"))
    known = calibration.thetas.select("query_id", "doc_id", F.lit(True).alias("known")).distinct()
    rows = cut(windows.join(fitted, ["query_id", "doc_id"], "left").join(known, ["query_id", "doc_id"], "left"))
    queries = cut(rows.filter("known IS NULL").select("query_id").distinct())
    if queries.isEmpty():
        raise ValueError("no new document in the windows")
    lost = queries.join(calibration.queries, "query_id", "left_anti").orderBy("query_id").limit(NAMED).collect()
    if lost:
        raise ValueError(f"no calibrated tournament for queries {[r.query_id for r in lost]}: score their documents instead")
    rows = rows.join(queries, "query_id", "left_semi")
    old = rows.groupBy("record_id", "query_id").agg(F.every(F.col("fitted").isNotNull()).alias("old")).filter("old")
    refit = cut(estimators.bradley_terry(judgements.comparisons(rows.join(old, ["record_id", "query_id"], "left_semi")), calibration.priors.bt_l2))
    scale = calibration.queries.select("query_id", "tau", "alpha")
    own = fitted.drop("fitted").join(queries, "query_id", "left_semi").join(scale, "query_id")
    after = own.join(refit.select("query_id", "doc_id", F.col("theta").alias("again")), ["query_id", "doc_id"], "left")
    missing = after.filter("again IS NULL")
    again = gains.affine(F.col("again"), F.col("tau"), F.col("alpha"))
    gain = lambda t: gains.calibrated_gain(t, calibration.gamma, calibration.beta)
    row = after.agg(F.count("again").alias("n"), F.count_if(F.col("again").isNull()).alias("lost"), F.max(F.abs(again - F.col("theta"))).alias("theta"), F.max(F.abs(gain(again) - gain(F.col("theta")))).alias("gain")).first()
    if row.lost:
        raise ValueError(f"the refit of the fitted windows has no ability for {_names(missing)}: pass all windows of the fit")
    if not row.n or row["gain"] > max_gain_shift:
        raise ValueError(f"the fitted windows no longer give the calibration: gains move by {row['gain']}, abilities by {row['theta']}, over {row.n} documents")
    frozen = own.select("query_id", "doc_id", ((F.col("theta") - F.col("alpha")) / F.col("tau")).alias("theta"))
    pairs = cut(judgements.comparisons(rows))
    side = frozen.select("query_id", F.col("doc_id").alias("winner"))
    among = pairs.join(side, ["query_id", "winner"], "left_semi").join(side.withColumnRenamed("winner", "loser"), ["query_id", "loser"], "left_semi")
    new = rows.filter("known IS NULL").select("query_id", "doc_id").distinct()
    fresh = pairs.join(new.withColumnRenamed("doc_id", "winner"), ["query_id", "winner"], "left_semi").unionByName(
        pairs.join(new.withColumnRenamed("doc_id", "loser"), ["query_id", "loser"], "left_semi").join(side, ["query_id", "winner"], "left_semi")
    )
    put = cut(abilities.insert(fresh, frozen, among, calibration.priors.bt_l2, se_target, min_opponents))
    alone = new.join(put, ["query_id", "doc_id"], "left_anti")
    if not alone.isEmpty():
        raise ValueError(f"no window pairs {_names(alone)} with a fitted document")
    bad = put.filter(F.size("failed") > 0)
    if named := bad.orderBy("query_id", "doc_id").limit(NAMED).collect():
        raise ValueError("not identifiable: " + "; ".join(f"{r.query_id}/{r.doc_id} ({', '.join(r.failed)}; would be {r.theta:.4f} with error {r.se:.4f})" for r in named))
    out = put.join(scale, "query_id").select(
        "query_id", "doc_id", gains.affine(F.col("theta"), F.col("tau"), F.col("alpha")).alias("theta"), (F.col("se") * F.col("tau")).alias("se"), (F.col("information") / F.col("tau") ** 2).alias("information"),
        "opponents", "comparisons", F.lit("inserted").alias("source"), F.lit(calibration.identity).alias("calibration"),
    )
    return out, Anchor(row.n, row["theta"], row["gain"])


def settings(calibration: Calibration) -> dict:
    """All of a calibration but its tables, as plain values."""
    return {k: getattr(calibration, k) for k in ("mode", "criteria", "gamma", "beta", "severity", "prior", "identity", "warnings", "diagnostics")} | {"priors": asdict(calibration.priors)}
