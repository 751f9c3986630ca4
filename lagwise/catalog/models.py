"""Models, calibration and experiments over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.catalog.registry import query, r6, rounded, with_ctes
from lagwise.catalog.scoring import BASE, predictions
from lagwise.functions import scalars as S
from lagwise.functions.scores import PROBS
from lagwise.models import boosting as G
from lagwise.models import calibration as C
from lagwise.models import logistic as L
from lagwise.models import score_model as D
from lagwise.models import splines as P
from lagwise.operators import history as H
from lagwise.operators import joins as J
from lagwise.operators import recurrence as R
from lagwise.operators.metrics import class_frequencies, equal_group_weights, score_groups
from lagwise.plans import experiment as X
from lagwise.plans.tables import FORECASTS, MATCHES, forecasts, matches, read
from lagwise.session import cut_lineage

MARKET = ("market_home_probability", "market_draw_probability", "market_away_probability")
FORM = ("diff_scored_5", "diff_conceded_5", "diff_scored_1", "diff_rest_days")
GROUPS = {"attack": ["diff_scored_5", "diff_scored_1"], "defence": ["diff_conceded_5"], "schedule": ["diff_rest_days"]}


def design(spark, sf, stored: bool = True):
    """Fixtures with market probabilities, log ratios, team form before the kickoff, and its differences."""
    m = matches(spark, sf)
    rows = R.team_rows(m)
    features = [H.prev_mean("scored", 5, "scored_5"), H.prev_mean("conceded", 5, "conceded_5"), H.prev_mean("scored", 1, "scored_1"), H.days_since_previous("kickoff", "rest_days")]
    form = H.with_history(rows, ["league", "team"], ["kickoff", "match_id", "team_side"], features)
    names = [f.name for f in features]
    wide = J.pivot_sides(form, ["match_id"], "team_side", names)
    d = m.withColumn("d", S.devig("home_odds", "draw_odds", "away_odds")).withColumn("result_3way", S.result_3way("home_score", "away_score"))
    d = d.select("league", "match_id", "season", "kickoff", "home_team", "away_team", "home_score", "away_score", "result_3way",
                 *[F.col(f"d.{s}").alias(n) for s, n in zip(("home", "draw", "away"), MARKET)])
    d = L.market_features(d, *MARKET).join(wide, "match_id")
    d = d.select("*", *S.home_away_diff(names))
    return cut_lineage(d) if stored else d


@query("standardizer", """
SELECT round(avg(l_quantity), 6) AS mean_quantity, round(stddev_pop(l_quantity), 6) AS scale_quantity, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean_price,
 round(sqrt(sum(l_quantity * (l_extendedprice - (SELECT sum(l_extendedprice * l_quantity) / sum(l_quantity) FROM lineitem))**2) / sum(l_quantity)), 4) AS scale_price FROM lineitem""")
def _standardizer(spark, sf):
    lines = read(spark, sf, "lineitem")
    a, b = L.fit_standardizer(lines, ["l_quantity"]), L.fit_standardizer(lines, ["l_extendedprice"], "l_quantity")
    return spark.range(1).select(
        r6(F.lit(a.means["l_quantity"]), "mean_quantity"), r6(F.lit(a.scales["l_quantity"]), "scale_quantity"),
        F.round(F.lit(b.means["l_extendedprice"]), 4).alias("mean_price"), F.round(F.lit(b.scales["l_extendedprice"]), 4).alias("scale_price"))


@query("closing_market", with_ctes(MATCHES, FORECASTS, body="""
SELECT match_id, round(prob_H, 6) AS "prob_H", round(prob_D, 6) AS "prob_D", round(prob_A, 6) AS "prob_A" FROM forecasts WHERE model = 'closing_market'"""))
def _market(spark, sf):
    return rounded(L.closing_market(design(spark, sf, False), *MARKET).select("match_id", *PROBS))


def _fit_predict(spark, sf, kind):
    d = design(spark, sf)
    train = d.filter("season < 2001")
    fit = L.fit_logistic(equal_group_weights(train, "league", "w"), L.model_columns(kind, FORM), weight="w")
    return d, fit


@query("multinomial_logistic")
def _logistic(spark, sf):
    d, fit = _fit_predict(spark, sf, "market_plus_player_form")
    return rounded(fit.transform(d.filter("season = 2001")).select("match_id", *PROBS))


@query("recalibrated_market")
def _recalibrated(spark, sf):
    d, fit = _fit_predict(spark, sf, "recalibrated_market")
    return rounded(fit.transform(d.filter("season = 2001")).select("match_id", *PROBS))


@query("player_form_model")
def _player_form(spark, sf):
    d, fit = _fit_predict(spark, sf, "player_form")
    return rounded(fit.transform(d.filter("season = 2001")).select("match_id", *PROBS))


@query("coefficient_table")
def _coefficients(spark, sf):
    _, fit = _fit_predict(spark, sf, "market_plus_player_form")
    return rounded(L.coefficient_table(fit, "market_plus_player_form", 2001, spark))


EXPANDED = tuple(f"{side}_{c.removeprefix('diff_')}" for side in ("home", "away") for c in FORM)


@query("boosted_trees")
def _boosted(spark, sf):
    d = design(spark, sf)
    fit = G.fit_boosted(d.filter("season < 2001"), FORM)
    return rounded(fit.transform(d.filter("season = 2001")).select("match_id", *PROBS))


@query("boosted_trees_expanded")
def _boosted_expanded(spark, sf):
    d = design(spark, sf)
    fit = G.fit_boosted(d.filter("season < 2001"), EXPANDED)
    return rounded(fit.transform(d.filter("season = 2001")).select("match_id", *PROBS))


@query("boosted_importances")
def _boosted_importances(spark, sf):
    d = design(spark, sf)
    return rounded(G.fit_boosted(d.filter("season < 2001"), FORM).importances(spark, "boosted_trees"))


#: Six nested sets of the form features, to be taken as differences or as home and away columns.
TUNING_SETS = {
    "scored": ["scored_5"], "goals": ["scored_5", "conceded_5"], "goals_recent": ["scored_5", "conceded_5", "scored_1"],
    "goals_rest": ["scored_5", "conceded_5", "rest_days"], "rest": ["rest_days", "scored_1"], "all": ["scored_5", "conceded_5", "scored_1", "rest_days"],
}


def _tuned_with(spark, sf, represent):
    """The search at its defaults: 50 trials over the six sets, five finalists, three repeats, up to 2,000 rounds."""
    d = design(spark, sf)
    sets = {name: [c for f in features for c in represent(f)] for name, features in TUNING_SETS.items()}
    return d, G.fit_tuned_boosting(d.filter("season < 2001"), sets)


@query("tuned_boosting")
def _tuned(spark, sf):
    d, tuned = _tuned_with(spark, sf, lambda f: [f"diff_{f}"])
    return rounded(tuned.transform(d.filter("season = 2001")).select("match_id", *PROBS))


@query("tuned_boosting_expanded")
def _tuned_expanded(spark, sf):
    d, tuned = _tuned_with(spark, sf, lambda f: [f"home_{f}", f"away_{f}"])
    return rounded(tuned.transform(d.filter("season = 2001")).select("match_id", *PROBS))


def _score_fits(d):
    leagues = [r[0] for r in d.select("league").distinct().orderBy("league").collect()]
    seasons = tuple(range(1995, 2001))
    return D.fit_score_models(d, [D.ScoreProblem(f"dc|{g}", g, seasons) for g in leagues]), {f"dc|{g}": 2001 for g in leagues}


@query("score_model_parameters")
def _score_parameters(spark, sf):
    fits, _ = _score_fits(design(spark, sf))
    return D.export_parameters(spark, fits, "dixon_coles").withColumn("standardized_coefficient", F.round("standardized_coefficient", 4))


@query("score_model_predictions")
def _score_predictions(spark, sf):
    d = design(spark, sf)
    fits, tests = _score_fits(d)
    p = D.predict_scores(d, fits, tests)
    return p.select("match_id", *[F.round(c, 4).alias(c) for c in ("home_rate", "away_rate", "rho", "effective_rho", "minimum_correction", *PROBS)], "rho_adjusted")


_GRID = """
p AS (SELECT match_id, home_odds / 2 AS lh, away_odds / 2 AS la, (CAST(league AS DOUBLE) - 2) / 20 AS rho FROM matches),
g AS (SELECT match_id, lh, la, rho, i, j, exp(i * ln(lh) - lh - lgamma(i + 1)) * exp(j * ln(la) - la - lgamma(j + 1)) *
  CASE WHEN i = 0 AND j = 0 THEN 1 - lh * la * rho WHEN i = 0 AND j = 1 THEN 1 + lh * rho WHEN i = 1 AND j = 0 THEN 1 + la * rho WHEN i = 1 AND j = 1 THEN 1 - rho ELSE 1 END AS c
  FROM p CROSS JOIN (SELECT unnest(range(11)) AS i) CROSS JOIN (SELECT unnest(range(11)) AS j))"""


@query("score_grid_probs", with_ctes(MATCHES, _GRID.strip(), body="""
SELECT match_id, round(sum(CASE WHEN i > j THEN c ELSE 0 END) / sum(c), 6) AS "prob_H", round(sum(CASE WHEN i = j THEN c ELSE 0 END) / sum(c), 6) AS "prob_D", round(sum(CASE WHEN i < j THEN c ELSE 0 END) / sum(c), 6) AS "prob_A" FROM g GROUP BY 1"""))
def _grid(spark, sf):
    p = matches(spark, sf).select("match_id", (F.col("home_odds") / 2).alias("lh"), (F.col("away_odds") / 2).alias("la"), ((F.col("league").cast("double") - 2) / 20).alias("rho"))
    return rounded(D.score_grid_probs(p, "lh", "la", "rho").select("match_id", *PROBS))


@query("expected_rates", with_ctes(MATCHES, body="""
, t AS (SELECT league, home_team AS team, ln(avg(home_score) + 0.5) AS attack, ln(avg(away_score) + 0.5) AS defence FROM matches GROUP BY 1, 2 HAVING avg(home_score) > 1.5),
r AS (SELECT m.match_id, least(greatest(exp(0.1 + coalesce(h.attack, 0) + coalesce(a.defence, 0)), 0.02), 6) AS lh, least(greatest(exp(-0.1 + coalesce(a.attack, 0) + coalesce(h.defence, 0)), 0.02), 6) AS la
 FROM matches m LEFT JOIN t h ON m.league = h.league AND m.home_team = h.team LEFT JOIN t a ON m.league = a.league AND m.away_team = a.team)
SELECT match_id, round(lh, 6) AS home_rate, round(la, 6) AS away_rate, round(least(greatest(0.19::DOUBLE, greatest((1e-8 - 1) / lh, (1e-8 - 1) / la)), least((1 - 1e-8) / (lh * la), 1 - 1e-8)), 6) AS effective_rho FROM r"""))
def _expected(spark, sf):
    """Rates from a team table, an unseen team having no effect, and the correction kept positive."""
    m = matches(spark, sf)
    t = m.groupBy("league", F.col("home_team").alias("team")).agg(
        F.avg("home_score").alias("mean"), F.log(F.avg("home_score") + 0.5).alias("attack"), F.log(F.avg("away_score") + 0.5).alias("defence")).filter("mean > 1.5")
    both = J.lookup_both_sides(m, t, ["league"], "team", "home_team", "away_team", ["attack", "defence"], 0.0)
    home = D.clip_rate(F.exp(0.1 + F.col("home_attack") + F.col("away_defence")))
    away = D.clip_rate(F.exp(-0.1 + F.col("away_attack") + F.col("home_defence")))
    rated = both.select("match_id", home.alias("home_rate"), away.alias("away_rate"))
    return rounded(rated.withColumn("effective_rho", D.stabilize_rho(F.col("home_rate"), F.col("away_rate"), F.lit(0.19))))


def _cox_de_boor() -> str:
    """The basis of home_odds by the recursion over knots t0..t9, one common table expression per degree."""
    text = ["""k AS (SELECT unnest(quantile_cont(home_odds, [0, 1/3.0, 2/3.0, 1])) AS v FROM matches)""",
            """q AS (SELECT list_sort(list(v)) AS l FROM k)""",
            "t AS (SELECT " + ", ".join(
                [f"l[1] - {3 - i} * (l[2] - l[1]) AS t{i}" for i in range(3)] + [f"l[{i + 1}] AS t{i + 3}" for i in range(4)] + [f"l[4] + {i + 1} * (l[4] - l[3]) AS t{i + 7}" for i in range(3)]) + " FROM q)",
            "b0 AS (SELECT match_id, home_odds AS x, t.*, " + ", ".join(
                f"CAST(home_odds >= t{i} AND (home_odds < t{i + 1} {'OR home_odds = t6' if i == 5 else ''}) AND {'true' if 3 <= i <= 5 else 'false'} AS DOUBLE) AS f0_{i}" for i in range(9)) + " FROM matches CROSS JOIN t)"]
    for d in range(1, 4):
        text.append(f"b{d} AS (SELECT *, " + ", ".join(
            f"(x - t{i}) / (t{i + d} - t{i}) * f{d - 1}_{i} + (t{i + d + 1} - x) / (t{i + d + 1} - t{i + 1}) * f{d - 1}_{i + 1} AS f{d}_{i}" for i in range(9 - d)) + f" FROM b{d - 1})")
    return ",\n".join(text)


@query("spline_basis", with_ctes(MATCHES, _cox_de_boor(), body="SELECT match_id, " + ", ".join(f"round(f3_{i}, 9) AS home_odds_s{i}" for i in range(5)) + " FROM b3"))
def _splines(spark, sf):
    m = matches(spark, sf).select("match_id", "home_odds")
    wide, names = P.spline_features(m, P.fit_splines(m, ["home_odds"]), [])
    return wide.select("match_id", *[F.round(n, 9).alias(n) for n in names])


@query("match_projection", with_ctes(MATCHES, body="""
SELECT match_id, home_score - away_score AS score_difference, home_score + away_score AS score_total, round((home_odds + away_odds) / 2, 6) AS odds_mean FROM matches"""))
def _projection(spark, sf):
    forms = (("score_difference", "difference", "score"), ("score_total", "total", "score"), ("odds_mean", "mean", "odds"))
    return rounded(matches(spark, sf).select("match_id", *P.match_projection(forms)))


@query("attacking_rows", with_ctes(MATCHES, body="""
SELECT match_id, 'home' AS team_side, CAST(1 AS DOUBLE) AS is_home, CAST(home_score AS DOUBLE) AS goals, round(home_odds, 6) AS own_odds, round(away_odds, 6) AS opponent_odds, round(home_odds - away_odds, 6) AS odds_advantage FROM matches UNION ALL
SELECT match_id, 'away', 0, away_score, round(away_odds, 6), round(home_odds, 6), round(away_odds - home_odds, 6) FROM matches"""))
def _attacking(spark, sf):
    rows = P.attacking_rows(matches(spark, sf), ["match_id"], {"own_odds": "odds"}, {"opponent_odds": "odds"}, {"odds_advantage": "odds"})
    return rounded(rows)


@query("poisson_gam")
def _poisson_gam(spark, sf):
    d = design(spark, sf)
    rows = P.attacking_rows(d, ["match_id", "season"], {"own_scored": "scored_5"}, {"opponent_conceded": "conceded_5"}, {"rest_advantage": "rest_days"})
    gam = P.fit_poisson_gam(rows.filter("season < 2001"), ["own_scored", "opponent_conceded"], ["is_home", "rest_advantage"], "match_id")
    return gam.predict(rows.filter("season = 2001"), "match_id").select("match_id", *[F.round(c, 4).alias(c) for c in ("home_rate", "away_rate", *PROBS)])


@query("multinomial_gam")
def _multinomial_gam(spark, sf):
    d = design(spark, sf)
    gam = P.fit_multinomial_gam(d.filter("season < 2001"), ["diff_scored_5", "diff_conceded_5"], ["diff_rest_days"])
    return gam.transform(d.filter("season = 2001")).select("match_id", *[F.round(c, 5).alias(c) for c in PROBS])


@query("apply_temperature", with_ctes(*BASE, body="""
, e AS (SELECT match_id, model, exp(ln(prob_H) / 1.7) AS h, exp(ln(prob_D) / 1.7) AS d, exp(ln(prob_A) / 1.7) AS a FROM forecasts)
SELECT match_id, model, round(h / (h + d + a), 6) AS "prob_H", round(d / (h + d + a), 6) AS "prob_D", round(a / (h + d + a), 6) AS "prob_A" FROM e"""))
def _apply(spark, sf):
    return rounded(C.apply_temperature(forecasts(spark, sf), 1.7).select("match_id", "model", *PROBS))


@query("fit_temperature")
def _temperature(spark, sf):
    return rounded(C.fit_temperatures(predictions(spark, sf), ["model", "league"]))


@query("vector_scaling")
def _vector(spark, sf):
    f = predictions(spark, sf).filter("model = 'closing_market'").select("match_id", "result_3way", *PROBS)
    return rounded(C.apply_vector_scaling(f, C.fit_vector_scaling(f)).select("match_id", *PROBS))


@query("calibration_slopes")
def _slopes(spark, sf):
    return rounded(C.calibration_slopes(predictions(spark, sf), ["model"]))


@query("chronological_temperature")
def _chronological(spark, sf):
    _, fitted = C.chronological_temperature_scale(predictions(spark, sf))
    return rounded(fitted)


@query("walk_forward")
def _walk(spark, sf):
    """Two predictors through the plug-in protocol, scored per fold."""
    d = design(spark, sf)

    def frequency(train, weight):
        table = F.broadcast(class_frequencies(train, weight=weight))
        return lambda test: test.join(table)

    def recalibrated(train, weight):
        return L.fit_logistic(train, L.MARKET_FEATURES, weight=weight, max_iter=100, tol=1e-8).transform

    p = X.walk_forward(d, [X.Predictor("frequency", frequency), X.Predictor("recalibrated_market", recalibrated)])
    return rounded(score_groups(p, ["model", "season"]))


_MODELS = {"recalibrated_market": list(L.MARKET_FEATURES), "market_plus_player_form": [*L.MARKET_FEATURES, *FORM], "player_form": list(FORM)}


def _all_predictions(spark, sf):
    d = design(spark, sf)
    logistic, _ = X.logistic_walk_forward(d, _MODELS)
    parts = [logistic, X.market_predictions(d, MARKET, (X.POOLED, X.BY_GROUP)), X.frequency_predictions(d)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut_lineage(out)


@query("multi_league_results")
def _multi(spark, sf):
    """Pooled and per-league scopes on all folds: equal-league scores against the market."""
    return rounded(X.result_tables(_all_predictions(spark, sf), 5)["equal_group_metrics"])


@query("multi_league_folds")
def _multi_folds(spark, sf):
    tables = X.result_tables(_all_predictions(spark, sf), 5)
    return rounded(tables["fold_equal_group_metrics"])


_TRAIN_AUDIT = """
, se AS (SELECT season, row_number() OVER (ORDER BY min(kickoff)) AS p FROM matches GROUP BY season),
tr AS (SELECT t.season AS test_season, m.league, count(*) AS n FROM se t JOIN se r ON r.p < t.p AND t.p > 2 JOIN matches m ON m.season = r.season GROUP BY 1, 2)
SELECT test_season, league, n AS train_matches, round(sum(n) OVER (PARTITION BY test_season) / CAST(5 AS DOUBLE), 4) AS total_training_weight,
 round(sum(n) OVER (PARTITION BY test_season) / CAST(5 AS DOUBLE) / n, 6) AS mean_match_weight FROM tr"""


@query("training_weight_audit", with_ctes(MATCHES, body=_TRAIN_AUDIT))
def _weights(spark, sf):
    _, audit = X.training_audit(matches(spark, sf))
    return audit.select("test_season", "league", "train_matches", F.round("total_training_weight", 4).alias("total_training_weight"), r6("mean_match_weight"))


@query("holdout_samples", with_ctes(MATCHES, body="""
SELECT CASE WHEN season = 2001 THEN 'final' ELSE 'training' END AS sample, league, season, count(*) AS matches FROM matches GROUP BY 1, 2, 3"""))
def _holdout_samples(spark, sf):
    return X.holdout_samples(matches(spark, sf), 2001)[2]


@query("holdout_run")
def _holdout(spark, sf):
    return rounded(score_groups(X.holdout_run(design(spark, sf), 2001, _MODELS, MARKET), ["training_scope", "model"]))


@query("group_search")
def _search(spark, sf):
    """All seven combinations of three feature groups on all folds."""
    d = design(spark, sf)
    table = X.evaluate_candidates(d, {n: f for n, (_, f) in X.group_subsets(GROUPS).items()}, X.fold_seasons(d), L.MARKET_FEATURES)
    return rounded(spark.createDataFrame(table))


@query("floating_refine")
def _floating(spark, sf):
    d = design(spark, sf)
    store = X.CandidateStore(d, X.fold_seasons(d), L.MARKET_FEATURES)
    _, changes = X.refine_by_changes(store, ["diff_rest_days"], FORM, min_gain=0.0)
    return rounded(spark.createDataFrame(changes.drop(columns="features")))


@query("removal_diagnostics")
def _removal(spark, sf):
    d = design(spark, sf)
    store = X.CandidateStore(d, X.fold_seasons(d), L.MARKET_FEATURES)
    return rounded(spark.createDataFrame(X.removal_diagnostics(store, FORM, GROUPS)))


@query("score_model_selection")
def _selection(spark, sf):
    d = design(spark, sf)
    table, chosen = X.score_model_selection(d, {"attack": GROUPS["attack"], "defence": GROUPS["defence"]}, X.fold_seasons(d))
    out = spark.createDataFrame(table.assign(selected=table["feature_set"] == chosen))
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("robustness_suite")
def _robustness(spark, sf):
    return rounded(X.robustness_suite(design(spark, sf), GROUPS, L.MARKET_FEATURES, ["diff_scored_5", "diff_scored_1", "diff_conceded_5"]))
