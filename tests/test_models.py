"""Fitted models against independent optimisers, grids and recursions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagwise.models import calibration as C
from lagwise.models import logistic as L
from lagwise.models import newton as N
from lagwise.models import score_model as D
from lagwise.models import splines as S
from lagwise.operators import metrics as M
from lagwise.plans import experiment as X


def sample(n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    z = np.column_stack([0.8 * x[:, 0], np.zeros(n), -0.5 * x[:, 1]])
    p = N.softmax(z)
    result = [rng.choice(list("HDA"), p=row) for row in p]
    return pd.DataFrame({"league": rng.choice(["a", "b"], n), "season": rng.integers(2000, 2004, n), "u": x[:, 0], "v": x[:, 1], "w": rng.uniform(0.5, 2, n),
                         "result_3way": result, "prob_H": p[:, 0], "prob_D": p[:, 1], "prob_A": p[:, 2]})


def test_newton_and_spark_ml_agree(spark):
    df = spark.createDataFrame(sample())
    fit = L.fit_logistic(df, ["u", "v"])
    moments = N.group_moments(df, ["u", "v"], "season", "league")
    problems = N.prepare_problems([N.Problem("p", ("u", "v"), (2000, 2001, 2002, 2003))], moments, "season", "league", False)
    theta = N.fit_multinomials(df, problems)["p"]
    matrix = fit.model.coefficientMatrix.toArray()
    np.testing.assert_allclose(theta[:, 1:], matrix, atol=2e-4)
    np.testing.assert_allclose(theta[:, 0] - theta[:, 0].mean(), fit.model.interceptVector.toArray(), atol=2e-4)


def test_newton_reaches_a_stationary_point_with_weights(spark):
    frame = sample()
    df = spark.createDataFrame(frame)
    moments = N.group_moments(df, ["u", "v"], "season", "league")
    p = N.prepare_problems([N.Problem("p", ("u", "v"), (2000, 2001))], moments, "season", "league", True)[0]
    theta = N.fit_multinomials(df, [p])["p"]
    rows = frame[frame.season.isin((2000, 2001))]
    w = rows.league.map(p.group_weights).to_numpy()
    np.testing.assert_allclose(pd.Series(w).groupby(rows.league.to_numpy()).sum(), len(rows) / 2)
    x = np.column_stack([np.ones(len(rows)), (rows[["u", "v"]] - p.means) / p.scales])
    y = np.eye(3)[rows.result_3way.map(N.CLASS_CODES)]
    gradient = ((w[:, None] * (N.softmax(x @ theta.T) - y)).T @ x)
    gradient[:, 1:] += theta[:, 1:]
    np.testing.assert_allclose(gradient, 0, atol=1e-6)


def test_temperature_minimises_the_loss(spark):
    frame = sample()
    got = C.fit_temperatures(spark.createDataFrame(frame), ["league"], weight="w").toPandas().set_index("league")["temperature"]
    grid = np.exp(np.linspace(np.log(0.25), np.log(4), 4001))
    for league, part in frame.groupby("league"):
        logs = np.log(part[["prob_H", "prob_D", "prob_A"]].to_numpy())
        y = part.result_3way.map(N.CLASS_CODES).to_numpy()
        loss = [-(part.w * np.log(N.softmax(logs / t)[np.arange(len(y)), y])).sum() for t in grid]
        assert got[league] == pytest.approx(grid[int(np.argmin(loss))], rel=2e-3)


def test_vector_scaling_is_stationary(spark):
    frame = sample()
    p = C.fit_vector_scaling(spark.createDataFrame(frame), regularization=1.0)
    logs, y = np.log(frame[["prob_H", "prob_D", "prob_A"]].to_numpy()), frame.result_3way.map(N.CLASS_CODES).to_numpy()

    def objective(t):
        q = N.softmax(logs * t[:3] + np.array([t[3], t[4], 0]))
        return -np.log(q[np.arange(len(y)), y]).mean() + ((t[:3] - 1) ** 2).sum() / len(y) + (t[3:] ** 2).sum() / len(y)

    best = np.array([p["slope_H"], p["slope_D"], p["slope_A"], p["bias_H"], p["bias_D"]])
    for i in range(5):
        for step in (-1e-3, 1e-3):
            assert objective(best + step * np.eye(5)[i]) >= objective(best) - 1e-12


def test_calibration_slopes_are_stationary(spark):
    frame = sample()
    got = C.calibration_slopes(spark.createDataFrame(frame.assign(model="m")), ["model"]).toPandas()
    for r in got.itertuples():
        p = frame[f"prob_{r.outcome}"]
        x = np.log(p / (1 - p))
        e = 1 / (1 + np.exp(-(r.calibration_intercept + r.calibration_slope * x))) - (frame.result_3way == r.outcome)
        assert abs(e.sum()) < 1e-6 and abs((e * x).sum()) < 1e-4


def score_data(seed=7, n=900):
    rng = np.random.default_rng(seed)
    home = rng.integers(0, 6, n)
    away = (home + rng.integers(1, 6, n)) % 6
    strength = np.linspace(-0.4, 0.4, 6)
    x = rng.normal(size=n)
    return pd.DataFrame({
        "league": rng.choice([1, 2], n), "season": rng.integers(2001, 2004, n), "match_id": np.arange(n), "home_team": home, "away_team": away, "x": x,
        "kickoff": pd.Timestamp("2001-01-01") + pd.to_timedelta(rng.integers(0, 900, n), unit="D"),
        "home_score": rng.poisson(np.exp(0.3 + strength[home] - strength[away] + 0.1 * x)), "away_score": rng.poisson(np.exp(0.1 + strength[away] - strength[home] - 0.1 * x))})


@pytest.mark.parametrize("features", [(), ("x",)])
def test_score_model_is_a_local_optimum(spark, features):
    frame = score_data()
    fit = D.fit_score_models(spark.createDataFrame(frame), [D.ScoreProblem(f"l{g}", g, (2001, 2002), features) for g in (1, 2)])["l1"]
    rows = frame[(frame.league == 1) & frame.season.isin((2001, 2002))]
    age = (rows.kickoff.max() - rows.kickoff).dt.days.to_numpy()
    w = np.exp(-np.log(2) * age / 365)
    w /= w.mean()
    z = (rows.x - rows.x.mean()) / rows.x.std(ddof=0) if features else 0.0
    index = {t: i for i, t in enumerate(fit.teams)}
    h, a = rows.home_team.map(index).to_numpy(), rows.away_team.map(index).to_numpy()
    yh, ya = rows.home_score.to_numpy(), rows.away_score.to_numpy()

    def loss(v):
        att, dfn = v[3:9], v[9:15]
        shift = v[15] * z if features else 0.0
        lh, la = np.exp(v[0] + v[1] + att[h] + dfn[a] + shift), np.exp(v[0] + att[a] + dfn[h] - shift)
        tau = np.select([(yh == 0) & (ya == 0), (yh == 0) & (ya == 1), (yh == 1) & (ya == 0), (yh == 1) & (ya == 1)],
                        [1 - lh * la * v[2], 1 + lh * v[2], 1 + la * v[2], np.full(len(lh), 1 - v[2])], 1.0)
        return -(w * (yh * np.log(lh) - lh + ya * np.log(la) - la + np.log(tau))).sum() + (v[15] ** 2 if features else 0)

    best = np.concatenate([[fit.intercept, fit.home_advantage, fit.rho], fit.attack, fit.defence, fit.player])
    assert abs(fit.attack.sum()) < 1e-9 and abs(fit.defence.sum()) < 1e-9
    base = loss(best)
    for i in range(len(best)):
        if i == 2 and abs(abs(fit.rho) - D.RHO_BOUND) < 1e-9:
            continue
        for step in (-1e-3, 1e-3):
            assert loss(best + step * np.eye(len(best))[i]) > base - 1e-7


def test_score_model_scales_by_all_fixtures(spark):
    """Fixtures that are equal in all that counts are merged, and each still counts in the scale of a feature."""
    frame = score_data().assign(x=lambda t: t.x.round())
    frame = pd.concat([frame, *[frame[frame.x > 0]] * 3])
    fit = D.fit_score_models(spark.createDataFrame(frame), [D.ScoreProblem("l1", 1, (2001, 2002), ("x",))])["l1"]
    rows = frame[(frame.league == 1) & frame.season.isin((2001, 2002))]
    assert fit.means[0] == pytest.approx(rows.x.mean()) and fit.scales[0] == pytest.approx(rows.x.std(ddof=0))


def test_score_model_passes_over_kinds_of_fixtures(spark, monkeypatch):
    """Days only set weights: passes read a row for each kind of fixture, however many days it was played on."""
    frame = score_data(n=400)
    frame = pd.concat([frame.assign(kickoff=frame.kickoff + pd.Timedelta(days=d)) for d in range(5)])
    read = []
    monkeypatch.setattr(D, "minimise", lambda rows, *a, **k: read.append(rows.count()) or N.minimise(rows, *a, **k))
    D.fit_score_models(spark.createDataFrame(frame), [D.ScoreProblem("l1", 1, (2001, 2002))])
    kinds = frame[["league", "season", "home_team", "away_team", "home_score", "away_score"]].drop_duplicates()
    assert read == [len(kinds)]


def test_score_model_needs_every_day(spark):
    frame = score_data(n=300)
    df = spark.createDataFrame(frame).withColumn("kickoff", F.when(F.col("match_id") > 5, F.col("kickoff")))
    with pytest.raises(ValueError, match="domain"):
        D.fit_score_models(df, [D.ScoreProblem("l1", 1, (2001, 2002, 2003))])


def test_score_predictions_sum_to_one_and_ignore_unseen_teams(spark):
    frame = score_data()
    df = spark.createDataFrame(frame)
    fits = D.fit_score_models(df.filter("home_team < 5 AND away_team < 5"), [D.ScoreProblem("l1", 1, (2001, 2002))])
    got = D.predict_scores(df, fits, {"l1": 2003}).toPandas()
    assert len(got) == len(frame[(frame.league == 1) & (frame.season == 2003)])
    np.testing.assert_allclose(got[["prob_H", "prob_D", "prob_A"]].sum(axis=1), 1, atol=1e-12)
    new = got[(got.home_team == 5)].iloc[0]
    expected = np.exp(fits["l1"].intercept + fits["l1"].home_advantage + fits["l1"].defence[fits["l1"].teams.index(new.away_team)])
    assert new.home_rate == pytest.approx(expected)


def test_splines_are_a_partition_of_unity_with_linear_tails(spark):
    spline = S.Spline("x", (0.0, 1.0, 2.5, 4.0))
    frame = pd.DataFrame({"x": np.linspace(-2, 6, 81)})
    poly = spline.pieces()
    np.testing.assert_allclose(poly[:, :, 0].sum(axis=1), 1, atol=1e-12)
    got = spark.createDataFrame(frame).select("x", *spline.columns()).toPandas()
    values = got[[f"x_s{i}" for i in range(spline.size)]].to_numpy()
    low = values[frame.x <= 0]
    np.testing.assert_allclose(np.diff(low, n=2, axis=0), 0, atol=1e-9)
    inside = (frame.x >= 0) & (frame.x <= 4)
    assert (values[inside] >= -1e-12).all() and (values[inside].sum(axis=1) <= 1 + 1e-12).all()


def test_rho_maximises_the_correction(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"lh": rng.uniform(0.6, 2, 500), "la": rng.uniform(0.5, 1.6, 500)})
    frame["h"], frame["a"] = rng.poisson(frame.lh), rng.poisson(frame.la)
    rho = S.fit_rho(spark.createDataFrame(frame), "lh", "la", "h", "a")

    def total(r):
        t = np.select([(frame.h == 0) & (frame.a == 0), (frame.h == 0) & (frame.a == 1), (frame.h == 1) & (frame.a == 0), (frame.h == 1) & (frame.a == 1)],
                      [1 - frame.lh * frame.la * r, 1 + frame.lh * r, 1 + frame.la * r, 1 - r], 1.0)
        return np.log(t).sum()

    assert total(rho) >= max(total(r) for r in np.linspace(-0.2, 0.2, 401)) - 1e-6


def test_poisson_gam_follows_its_penalised_score_equations(spark):
    rng = np.random.default_rng(4)
    n = 300
    frame = pd.DataFrame({"match_id": np.repeat(np.arange(n // 2), 2), "team_side": ["home", "away"] * (n // 2), "is_home": [1.0, 0.0] * (n // 2), "x": rng.normal(size=n)})
    frame["goals"] = rng.poisson(np.exp(0.2 + 0.3 * frame.x)).astype(float)
    df = spark.createDataFrame(frame)
    gam = S.fit_poisson_gam(df, ["x"], ["is_home"], "match_id", alpha=1.0)
    wide, names = S.spline_features(df, gam.splines, gam.linear)
    data = wide.toPandas()
    z = np.column_stack([(data[c] - gam.standardizer.means[c]) / gam.standardizer.scales[c] for c in names])
    mu = np.exp(gam.intercept + z @ np.array(gam.coefficients))
    gradient = z.T @ (mu - data.goals) / n + np.array(gam.coefficients)
    np.testing.assert_allclose(gradient, 0, atol=1e-4)
    assert gam.predict(df, "match_id").filter(F.abs(F.col("prob_H") + F.col("prob_D") + F.col("prob_A") - 1) > 1e-9).isEmpty()


def test_stacked_sums_equal_those_of_each_problem(spark):
    """Problems that share a design matrix get the loss, gradient and curvature that each has on its own rows."""
    frame = sample()
    df = spark.createDataFrame(frame)
    moments = N.group_moments(df, ["u", "v"], "season", "league")
    problems = [N.Problem(f"{t}|{g}|{len(c)}", c, tuple(range(2000, t)), g) for t in (2002, 2003) for g in (None, "a", "b") for c in (("u", "v"), ("v",))]
    problems = N.prepare_problems(problems, moments, "season", "league", True)
    rng = np.random.default_rng(4)
    thetas = {p.key: rng.normal(0, 0.5, 3 * (len(p.columns) + 1)) for p in problems}
    stacks = [N._Stack(c, [p for p in problems if p.columns == c]) for c in (("u", "v"), ("v",))]
    found = {k: rest for k, *rest in N._multinomial_partials(frame, thetas, stacks, "season", "league", "result_3way")}
    assert found.keys() == thetas.keys()
    for p in problems:
        rows = frame[frame.season.isin(p.seasons) & ((p.group is None) | (frame.league == p.group))]
        w = rows.league.map(p.group_weights).fillna(1.0).to_numpy()
        x = np.column_stack([np.ones(len(rows)), (rows[list(p.columns)] - p.means) / p.scales])
        y = np.eye(3)[rows.result_3way.map(N.CLASS_CODES)]
        prob = N.softmax(x @ thetas[p.key].reshape(3, -1).T)
        loss, gradient, hessian = found[p.key]
        np.testing.assert_allclose(loss, -(w * np.log((prob * y).sum(1))).sum(), rtol=1e-10)
        np.testing.assert_allclose(gradient, ((w[:, None] * (prob - y)).T @ x).ravel(), atol=1e-8)
        curve = np.einsum("n,na,nab->nab", w, prob, np.eye(3) - prob[:, None, :])
        np.testing.assert_allclose(hessian, np.einsum("nab,ni,nj->aibj", curve, x, x).reshape(hessian.shape), atol=1e-8)


def test_result_tables_read_the_predictions_twice(spark):
    """Once for repeated keys and once for the sums, however many tables and groupings are made of them."""
    frame = sample().drop(columns=["u", "v", "w"]).reset_index(names="match_id")
    both = pd.concat([frame.assign(model=m, training_scope=s) for m in ("closing_market", "other") for s in ("pooled", "own")])
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.createDataFrame(both)
    tables = X.result_tables(df.mapInPandas(count, df.schema), 2)
    keys = ["training_scope", "league", "season", "model"]
    got = {tuple(r[k] for k in keys): r for r in tables["fold_group_metrics"].collect()}
    assert len(tables["equal_group_metrics"].collect()) == 4 and read.value == 2 * len(both)
    for r in M.score_groups(df, keys).collect():
        at = got[tuple(r[k] for k in keys)]
        assert at.matches == r.matches
        np.testing.assert_allclose([at.log_loss, at.brier_score, at.rps, at.accuracy], [r.log_loss, r.brier_score, r.rps, r.accuracy], rtol=1e-12)


def test_temperature_steps_read_stored_key_names(spark, monkeypatch):
    """A Newton step joins the stored rows as they are, so that nothing is formed per row and step but the sums."""
    df = spark.createDataFrame(sample()).cache()
    met, join = [], type(df).join

    def noted(self, other, *args, **kwargs):
        met.append((self.columns, self._jdf.queryExecution().optimizedPlan().getClass().getSimpleName()))
        return join(self, other, *args, **kwargs)

    monkeypatch.setattr(type(df), "join", noted)
    assert len(C.fit_temperatures(df, ["league", "season"]).collect()) == 8
    steps = [kind for columns, kind in met if "_w" in columns]
    assert steps and set(steps) == {"InMemoryRelation"}


def test_vector_scaling_sends_numbers_and_has_exact_derivatives(spark, monkeypatch):
    """Rows of the fit hold no text; gradient and curvature agree with differences of the loss."""
    seen, minimise = [], C.minimise

    def noted(rows, start, partials, **options):
        seen.append((dict(rows.dtypes), rows.toPandas(), partials))
        return minimise(rows, start, partials, **options)

    monkeypatch.setattr(C, "minimise", noted)
    C.fit_vector_scaling(spark.createDataFrame(sample()))
    types, batch, partials = seen[0]
    assert "string" not in types.values()
    at = lambda t: next(iter(partials(batch, {"fit": t})))
    theta, step = np.array([0.9, 1.2, 0.7, 0.1, -0.2]), 1e-5
    _, _, gradient, hessian = at(theta)
    for i, e in enumerate(np.eye(5) * step):
        high, low = at(theta + e), at(theta - e)
        assert abs((high[1] - low[1]) / (2 * step) - gradient[i]) < 1e-7
        np.testing.assert_allclose((high[2] - low[2]) / (2 * step), hessian[i], atol=1e-7)
