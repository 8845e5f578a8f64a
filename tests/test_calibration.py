"""Fits against one-machine optima written from the definitions, documents against integrals, gates and stored versions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import abilities, calibrate, estimators, joint, judgements
from rankloom.sources import calibrations

CRITERIA = ["c1", "c2", "c3"]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def descend(loss, x, rounds=400):
    """A plain quasi-Newton minimum with slopes by differences: slow, small and independent of the operators."""
    def slope(at):
        e = np.eye(len(at)) * 1e-5
        return np.array([(loss(at + d) - loss(at - d)) / 2e-5 for d in e])

    h, g, f = np.eye(len(x)), slope(x), loss(x)
    for _ in range(rounds):
        step, t = -h @ g, 1.0
        while loss(x + t * step) > f + 1e-4 * t * (g @ step) and t > 1e-10:
            t /= 2
        s = t * step
        y = slope(x + s) - g
        x, g, f = x + s, g + y, loss(x + s)
        if np.abs(g).max() < 1e-7 or s @ y <= 0:
            break
        r = 1 / (s @ y)
        left = np.eye(len(x)) - r * np.outer(s, y)
        h = left @ h @ left.T + r * np.outer(s, s)
    return f


def verdicts(r, queries=4, docs=12, judges=2, unknown=True):
    gamma, beta, severity = np.array([1.3, 1.0, 0.7]), np.array([-1.0, 0.0, 1.0]), np.array([0.4, -0.4, 0.0])[:judges]
    rows = []
    for q in range(queries):
        tau, alpha = r.uniform(0.6, 1.6), r.normal()
        for d in range(docs):
            theta = r.normal() * 1.4
            for j in range(judges):
                n = int(r.integers(1, 5))
                rows.append((f"q{q}", f"d{d}", float(theta), f"j{j}", n, *(int(x) for x in r.binomial(n, sigmoid(gamma * (tau * theta + alpha - beta) - severity[j])))))
    return rows + ([("q0", "none", None, "j0", 1, 1, 1, 1), ("q9", "none", None, "j1", 1, 0, 0, 0)] if unknown else [])


VERDICTS = "query_id string, doc_id string, theta double, judge string, n long, s1 long, s2 long, s3 long"


def joint_loss(rows, pooled, p=joint.Priors(), k=3):
    rows = [r for r in rows if r[2] is not None]
    qs, js = sorted({r[0] for r in rows}), sorted({r[3] for r in rows}) if pooled else []
    q, theta, n, s = np.array([qs.index(r[0]) for r in rows]), np.array([r[2] for r in rows]), np.array([r[4] for r in rows], float), np.array([r[5:] for r in rows], float)
    j = np.array([js.index(r[3]) for r in rows]) if pooled else None
    weight = np.bincount(j, n) if pooled else None

    def loss(x):
        raw_g, raw_b, raw_t, alpha, sev = np.split(x, np.cumsum([k, k, len(qs), len(qs)]))
        gamma, beta, tau = np.exp(raw_g) * k / np.exp(raw_g).sum(), raw_b - raw_b.mean(), np.logaddexp(0, raw_t)
        logit = gamma * ((tau[q] * theta + alpha[q])[:, None] - beta)
        if pooled:
            logit = logit - (sev - weight @ sev / weight.sum())[j][:, None]
        total = (n[:, None] * np.logaddexp(0, logit) - s * logit).sum()
        total += n.sum() * k * (p.l2_gamma * raw_g @ raw_g + p.l2_beta * raw_b @ raw_b) / 2
        return total + ((tau - 1) ** 2).sum() / (2 * p.sigma_tau**2) + (alpha**2).sum() / (2 * p.sigma_alpha**2)

    start = np.concatenate([np.zeros(2 * k), np.full(len(qs), math.log(math.e - 1)), np.zeros(len(qs) + len(js))])
    return loss, start


@pytest.mark.parametrize("pooled", [True, False])
def test_joint_fit_is_the_optimum(spark, pooled):
    rows = verdicts(np.random.default_rng(1))
    frame = spark.createDataFrame(rows, VERDICTS)
    fits = [joint.tournament_2pl(f, 3, pooled=pooled) for f in (frame.repartition(5), frame.orderBy(F.rand(3)).coalesce(1))[: 1 + pooled]]
    loss, start = joint_loss(rows, pooled)
    best = descend(loss, start)
    for fit in fits:
        assert fit.converged and fit.max_grad < 1e-3
        queries = {r.query_id: r for r in fit.queries.collect()}
        assert sorted(queries) == ["q0", "q1", "q2", "q3"]
        tau, alpha = (np.array([queries[q][c] for q in sorted(queries)]) for c in ("tau", "alpha"))
        assert abs(fit.loss - best) < 1e-6 * best
        assert sum(fit.gamma) == pytest.approx(3) and sum(fit.beta) == pytest.approx(0, abs=1e-9)
        own = loss(np.concatenate([np.log(fit.gamma), fit.beta, np.log(np.expm1(tau)), alpha, list(fit.severity.values())]))
        assert abs(own - fit.loss) < 1e-3 * best  # raw values differ by the free levels, whose penalty is small
    if pooled:
        assert fits[0].gamma == pytest.approx(fits[1].gamma, abs=1e-7) and fits[0].loss == pytest.approx(fits[1].loss, rel=1e-11)
        weight = {j: sum(r[4] for r in rows if r[3] == j and r[2] is not None) for j in ("j0", "j1")}
        assert sum(weight[j] * v for j, v in fits[0].severity.items()) == pytest.approx(0, abs=1e-6)


def test_joint_fit_recovers_what_was_planted(spark):
    fit = joint.tournament_2pl(spark.createDataFrame(verdicts(np.random.default_rng(2), 30, 30, 3), VERDICTS), 3, pooled=True)
    assert fit.gamma == pytest.approx([1.3, 1.0, 0.7], abs=0.1) and fit.beta == pytest.approx([-1, 0, 1], abs=0.12)
    assert list(fit.severity.values()) == pytest.approx([0.4, -0.4, 0.0], abs=0.1)


def test_joint_fit_refusals(spark):
    rows = verdicts(np.random.default_rng(3))
    frame = lambda rs: spark.createDataFrame(rs, VERDICTS)
    with pytest.raises(ValueError, match="no verdict"):
        joint.tournament_2pl(frame([]), 3)
    with pytest.raises(ValueError, match="name its judge"):
        joint.tournament_2pl(frame([(*rows[0][:3], None, *rows[0][4:]), *rows[1:]]), 3, pooled=True)
    with pytest.raises(ValueError, match="two or more"):
        joint.tournament_2pl(frame([r for r in rows if r[3] == "j0"]), 3, pooled=True)
    with pytest.raises(ValueError, match="share no document"):
        joint.tournament_2pl(frame([r for r in rows if (r[3] == "j0") == (r[1] < "d3")]), 3, pooled=True)
    with pytest.raises(Exception, match="no finite number"):
        joint.tournament_2pl(frame([(*rows[0][:2], float("nan"), *rows[0][3:]), *rows[1:]]), 3)


def marginal(table, gamma, beta, sd=1.0):
    grid = np.linspace(-18, 10, 561)
    prior = np.exp(-(grid**2) / 2)
    logit = np.array(gamma)[:, None] * (grid * sd - np.array(beta)[:, None])
    n, s = table[:, :1], table[:, 1:]
    log = -s @ np.logaddexp(0, -logit) - (n - s) @ np.logaddexp(0, logit)
    return np.log((np.exp(log) * prior / prior.sum()).sum(1)).sum()


def patterns(r, docs=400):
    theta = r.normal(size=docs)
    n = r.integers(1, 6, docs)
    s = r.binomial(n[:, None], sigmoid(np.array([1.5, 1.0, 0.6]) * (theta[:, None] - np.array([-0.5, 0.3, 1.0]))))
    return np.column_stack([n, s]).astype(float)


def test_rubric_fit_is_the_marginal_optimum(spark):
    table = patterns(np.random.default_rng(4))
    frame = spark.createDataFrame([tuple(int(x) for x in row) for row in table], "n long, s1 long, s2 long, s3 long")
    fits = [abilities.rubric_2pl(f, 3) for f in (frame.repartition(6), frame.coalesce(1))]
    best = descend(lambda x: -marginal(table, np.exp(x[:3]), x[3:]), np.concatenate([np.zeros(3), np.zeros(3)]))
    for fit in fits:
        assert abs(fit.log_likelihood + best) < 1e-6 * best
        # the reported items are the same model on another scale
        sd, mean = fit.sd, fit.mean
        assert marginal(table, np.array(fit.gamma) * sd, (np.array(fit.beta) - mean) / sd) == pytest.approx(-best, rel=1e-7)
    assert fits[0].gamma == pytest.approx(fits[1].gamma, abs=1e-8) and fits[0].beta == pytest.approx(fits[1].beta, abs=1e-8)
    other = abilities.rubric_2pl(frame, 3, ability_sd=2.0)
    assert other.gamma == pytest.approx(fits[0].gamma, abs=1e-6)


def test_rubric_fit_refusals_and_flags(spark):
    with pytest.raises(ValueError, match="no documents"):
        abilities.rubric_2pl(spark.createDataFrame([], "n long, s1 long, s2 long"), 2)
    rows = [(1, 0, 0)] * 2000 + [(1, 1, 0)] * 5 + [(1, 0, 1)] * 5 + [(1, 1, 1)] * 5
    assert "only" in " ".join(abilities.rubric_2pl(spark.createDataFrame(rows, "n long, s1 long, s2 long"), 2).ordinal)


def test_documents_are_scored_by_their_integral(spark):
    gamma, beta, mean, sd, severity = [1.2, 0.8], [-0.5, 1.5], 0.4, 6.0, {"a": 0.7, "b": -0.7}
    rows = [("q", "x", "a", 3, 2, 1), ("q", "x", "b", 2, 2, 0), ("q", "x", "b", 1, 0, 0), ("q", "fail", "a", 2, 0, 0), ("q", "pass", "b", 4, 4, 4), ("r", "x", "a", 90, 40, 20)]
    frame = spark.createDataFrame(rows, "query_id string, doc_id string, judge string, n long, s1 long, s2 long")
    got = {(r.query_id, r.doc_id): r for r in abilities.score_documents(frame, gamma, beta, mean, sd, severity).collect()}
    for key, r in got.items():
        t = np.linspace(-18, 10, 561) * sd + mean
        log = -(((t - mean) / sd) ** 2) / 2
        info = 0
        for q, d, j, n, *s in rows:
            if (q, d) == key:
                for k in range(2):
                    x = gamma[k] * (t - beta[k]) - severity[j]
                    log = log - s[k] * np.logaddexp(0, -x) - (n - s[k]) * np.logaddexp(0, x)
                    p = sigmoid(gamma[k] * (r.theta - beta[k]) - severity[j])
                    info += n * gamma[k] ** 2 * p * (1 - p)
        w = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
        assert r.theta == pytest.approx(w @ t) and r.se == pytest.approx(math.sqrt(w @ t**2 - (w @ t) ** 2)) and r.information == pytest.approx(info)
        assert r.low_information == (info < 4)
    assert [got["q", d].degenerate for d in ("x", "fail", "pass")] == [None, "all_fail", "all_pass"] and got["q", "x"].n == 6
    with pytest.raises(Exception, match="no severity for judge c"):
        abilities.score_documents(frame.unionByName(frame.withColumn("judge", F.lit("c"))), gamma, beta, severity=severity).collect()
    assert abilities.score_documents(frame.limit(0), gamma, beta).count() == 0


PAIRS = "query_id string, winner string, loser string, weight double, soft_label double"


def insertion(spark, **kwargs):
    r = np.random.default_rng(5)
    names = [f"d{i}" for i in range(8)]
    theta = dict(zip(names, r.normal(size=8)))
    old = [("q", names[i], names[i + 1], 1.0, 0.6) for i in range(5)] + [("q", "d6", "d7", 2.0, 0.7)]
    new = [("q", "n", d, 3.0, 0.7) for d in names[:3]] + [("q", d, "n", 2.0, 0.6) for d in names[3:]] + [("q", "n", "d0", 1.0, 0.9), ("q", "n", "m", 5.0, 0.9)]
    new += [("q", "m", "d0", 1.0, 0.7)] + [("q", "w", d, 1.0, 1.0) for d in names]
    frame = lambda x, s=PAIRS: spark.createDataFrame(x, s)
    frozen = frame([("q", d, float(t)) for d, t in theta.items()], "query_id string, doc_id string, theta double")
    got = {x.doc_id: x for x in abilities.insert(frame(new), frozen, frame(old), **kwargs).collect()}
    return theta, old, new, got


def test_insertion_is_the_conditional_optimum_and_names_what_fails(spark):
    theta, old, new, got = insertion(spark, l2=1e-3, se_target=0.75)
    assert sorted(got) == ["m", "n", "w"]
    for doc, r in got.items():
        own = [(theta[b], w, y) if a == doc else (theta[a], w, 1 - y) for _, a, b, w, y in new if doc in (a, b) and (b if a == doc else a) in theta]
        ridge = 1e-3 * (sum(x[3] for x in old) + sum(w for _, w, _ in own))
        grid = np.linspace(-20, 20, 4_000_01)
        loss = ridge * grid**2 / 2 + sum(w * (np.logaddexp(0, grid - t) - y * (grid - t)) for t, w, y in own)
        assert r.theta == pytest.approx(grid[loss.argmin()], abs=2e-4)
        info = ridge + sum(w * sigmoid(r.theta - t) * sigmoid(t - r.theta) for t, w, _ in own)
        assert r.information == pytest.approx(info) and r.se == pytest.approx(info**-0.5) and r.comparisons == len(own)
    assert got["n"].failed == [] and got["n"].opponents == 8 and got["n"].components == 1
    assert got["m"].failed == ["connected", "opponents", "information"] and got["m"].components == 2
    *_, flat = insertion(spark, l2=0.0)
    assert "interior" in flat["w"].failed


def world(spark, seed=6, queries=3, docs=9, windows=30):
    """Placements of windows with hidden abilities, by two judges."""
    r = np.random.default_rng(seed)
    rows, record = [], 0
    for q in range(queries):
        theta = r.normal(size=docs) * 1.5
        for w in range(windows):
            record += 1
            shown = r.choice(docs, 4, replace=False)
            for place, d in enumerate(shown):
                passed = r.random(3) < sigmoid(np.array([1.3, 1.0, 0.7]) * (theta[d] - np.array([-1, 0, 1])))
                rows.append((record, f"q{q}", f"d{d}", f"j{w % 2}", w not in (5, 6), "random", place, float(theta[d] + r.normal() * 0.5), *(int(x) for x in passed)))
    return spark.createDataFrame(rows, "record_id long, query_id string, doc_id string, judge string, valid boolean, phase string, position int, score double, c1 int, c2 int, c3 int")


@pytest.fixture(scope="module")
def judged(spark):
    return world(spark).cache()


@pytest.fixture(scope="module")
def fitted(judged):
    """Fitted to windows that lack d8."""
    holding = judged.filter("doc_id = 'd8'").select("record_id").distinct()
    windows = judged.join(holding, "record_id", "left_anti")
    return calibrate.calibrate(windows, windows, CRITERIA, pooled=True), windows


def test_calibrate_stands_on_its_parts(fitted):
    cal, windows = fitted
    assert cal.mode == "tournament" and sorted(cal.severity) == ["j0", "j1"] and dict(cal.warnings).keys() == {"INVALID_WINDOWS"}
    bt = {(r.query_id, r.doc_id): r for r in estimators.bradley_terry(judgements.comparisons(windows.filter("valid"))).collect()}
    scale = {r.query_id: r for r in cal.queries.collect()}
    got = {(r.query_id, r.doc_id): r for r in cal.thetas.collect()}
    assert got.keys() == bt.keys() and len(got) == 24
    for key, r in got.items():
        s = scale[key[0]]
        assert r.theta == pytest.approx(s.tau * bt[key].theta + s.alpha) and r.se == pytest.approx(s.tau * bt[key].se) and r.source == "fit"


def test_calibrate_modes_and_refusals(spark, judged):
    one = judged.filter("judge = 'j0'")
    alone = calibrate.calibrate(one, None, CRITERIA)
    assert alone.mode == "rubric_only" and alone.queries is None and alone.prior
    again = calibrate.calibrate(one.repartition(7), one.limit(0), CRITERIA)
    assert again.identity == alone.identity and again.gamma == pytest.approx(alone.gamma, abs=1e-7)
    with pytest.raises(ValueError, match="pool them"):
        calibrate.calibrate(judged, None, CRITERIA)
    with pytest.raises(ValueError, match="need the tournament"):
        calibrate.calibrate(judged, None, CRITERIA, pooled=True)
    with pytest.raises(ValueError, match="name the mode"):
        calibrate.calibrate(one, one.filter("query_id = 'q0'"), CRITERIA)
    with pytest.raises(ValueError, match="no valid rubric"):
        calibrate.calibrate(one.filter("NOT valid"), None, CRITERIA)
    with pytest.raises(ValueError, match="strict: INVALID_WINDOWS"):
        calibrate.calibrate(one, None, CRITERIA, strict=True)
    with pytest.raises(ValueError, match="no rubric query has"):
        calibrate.calibrate(one, None, CRITERIA, mode="tournament")
    shown = judged.withColumn("valid", F.col("valid") & (F.col("doc_id") != "d0"))
    cal = calibrate.calibrate(judged, shown.filter("doc_id <> 'd1'"), CRITERIA, pooled=True)
    assert {"NO_VALID_TOURNAMENT_EVIDENCE", "UNCALIBRATED_DOCUMENTS"} <= dict(cal.warnings).keys() and dict(cal.warnings)["UNCALIBRATED_DOCUMENTS"] == 6


def test_scoring_its_own_evidence_gives_the_fit_back(judged):
    one = judged.filter("judge = 'j0'")
    cal = calibrate.calibrate(one, None, CRITERIA)
    own = {(r.query_id, r.doc_id): r.theta for r in cal.thetas.collect()}
    less = calibrate.replace(cal, thetas=cal.thetas.filter("doc_id <> 'd3'"))
    new = calibrate.score_missing(less, one)
    assert {(r.query_id, r.doc_id) for r in new.collect()} == {(f"q{q}", "d3") for q in range(3)}
    for r in new.collect():
        assert r.theta == pytest.approx(own[r.query_id, r.doc_id])
    assert less.extended(new).thetas.count() == len(own)
    with pytest.raises(Exception, match="already in the calibration"):
        cal.extended(new).thetas.collect()
    with pytest.raises(Exception, match="another calibration"):
        less.extended(new.withColumn("calibration", F.lit("x"))).thetas.collect()


def test_insertion_into_a_calibration(fitted, judged):
    cal, windows = fitted
    rows, anchor = calibrate.insert_missing(cal, judged, se_target=2.0, min_opponents=3)
    assert anchor.documents == 24 and anchor.gain_shift < 1e-6
    assert {(r.query_id, r.doc_id, r.source) for r in rows.collect()} == {(f"q{q}", "d8", "inserted") for q in range(3)}
    assert cal.extended(rows).thetas.count() == 27
    scale = {r.query_id: r for r in cal.queries.collect()}
    for r in rows.collect():
        assert r.information == pytest.approx(r.se**-2)
    assert scale.keys() == {"q0", "q1", "q2"}
    with pytest.raises(ValueError, match="no new document"):
        calibrate.insert_missing(cal, windows)
    with pytest.raises(ValueError, match="not identifiable.*opponents"):
        calibrate.insert_missing(cal, judged, se_target=2.0, min_opponents=9)
    with pytest.raises(ValueError, match="has no ability for q0/d1"):
        calibrate.insert_missing(cal, judged.join(windows.filter("query_id = 'q0' AND doc_id = 'd1'").select("record_id").distinct(), "record_id", "left_anti"))
    drifted = judged.withColumn("score", F.when(F.col("doc_id") == "d2", -F.col("score")).otherwise(F.col("score")))
    with pytest.raises(ValueError, match="no longer give the calibration"):
        calibrate.insert_missing(cal, drifted, se_target=2.0, min_opponents=3)
    with pytest.raises(ValueError, match="rubric-only"):
        calibrate.insert_missing(calibrate.replace(cal, mode="rubric_only"), judged)


def test_projection_takes_the_best_chunk(spark, judged):
    chunks = judged.withColumn("doc_id", F.concat_ws("#", "doc_id", (F.col("record_id") % 2).cast("string")))
    got = {(r.query_id, r.doc_id): (r.theta, r.se) for r in calibrate.projection(chunks, chunk_of=F.substring_index("doc_id", "#", 1)).collect()}
    want = {}
    for r in estimators.bradley_terry(judgements.comparisons(chunks.filter("valid"))).collect():
        key = (r.query_id, r.doc_id.split("#")[0])
        want[key] = max(want.get(key, (-9e9, 0)), (r.theta, r.se))
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_versions_are_whole_or_absent(spark, fitted, judged, tmp_path, monkeypatch):
    cal, _ = fitted
    folder = str(tmp_path / "cal")
    with pytest.raises(FileNotFoundError):
        calibrations.load(spark, folder)
    assert calibrations.save(cal, folder) == 1
    first = calibrations.load(spark, folder)
    assert calibrate.settings(first) == calibrate.settings(cal)
    assert sorted(map(tuple, first.thetas.collect())) == sorted(map(tuple, cal.thetas.collect())) and first.queries.count() == 3
    rows, _ = calibrate.insert_missing(first, judged, se_target=2.0, min_opponents=3)
    more = first.extended(rows)

    def die(table):
        raise KeyboardInterrupt

    monkeypatch.setattr(calibrations, "_print", die)
    with pytest.raises(KeyboardInterrupt):  # its tables are written, its line is not
        calibrations.save(more, folder)
    monkeypatch.undo()
    assert calibrations.load(spark, folder).thetas.count() == 24
    assert calibrations.save(more, folder) == 2
    assert calibrations.load(spark, folder).thetas.count() == 27 and calibrations.load(spark, folder, 1).thetas.count() == 24
    with pytest.raises(FileNotFoundError, match="version 7"):
        calibrations.load(spark, folder, 7)
    with pytest.raises(ValueError):
        calibrations.save(calibrate.replace(cal, gamma=[math.nan, 1.0, 1.0]), folder)
    name = json.loads(json.dumps(calibrations._current(spark, folder).name))
    more.thetas.limit(3).write.mode("overwrite").parquet(f"{folder}/versions/{name}/thetas")
    with pytest.raises(ValueError, match="not what was written"):
        calibrations.load(spark, folder)
