"""Scores, calibration tables, comparisons and the block bootstrap over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.catalog.registry import query, r6, rounded, with_ctes
from lagwise.functions import scalars as S
from lagwise.functions.scores import METRICS, row_scores
from lagwise.operators import bootstrap as B
from lagwise.operators import joins as J
from lagwise.operators import metrics as M
from lagwise.plans import folds as E
from lagwise.plans.tables import FORECASTS, MATCHES, forecasts, matches, read

_SCORED = """
sc AS (SELECT *, CAST(kickoff AS DATE) AS match_date, CAST(result_3way = 'H' AS INT) AS oh, CAST(result_3way = 'D' AS INT) AS od, CAST(result_3way = 'A' AS INT) AS oa,
  -ln(CASE result_3way WHEN 'H' THEN prob_H WHEN 'D' THEN prob_D ELSE prob_A END) AS ll,
  (prob_H - CAST(result_3way = 'H' AS INT))**2 + (prob_D - CAST(result_3way = 'D' AS INT))**2 + (prob_A - CAST(result_3way = 'A' AS INT))**2 AS br,
  ((prob_H - CAST(result_3way = 'H' AS INT))**2 + (prob_H + prob_D - CAST(result_3way <> 'A' AS INT))**2) / 2 AS rp,
  CAST(result_3way = CASE WHEN prob_H >= prob_D AND prob_H >= prob_A THEN 'H' WHEN prob_D >= prob_A THEN 'D' ELSE 'A' END AS INT) AS ok FROM forecasts)"""
BASE = (MATCHES, FORECASTS, _SCORED.strip())
_AVG = "count(*) AS matches, round(avg(ll), 6) AS log_loss, round(avg(br), 6) AS brier_score, round(avg(rp), 6) AS rps, round(avg(ok), 6) AS accuracy"


def predictions(spark, sf):
    return forecasts(spark, sf).withColumn("match_date", F.to_date("kickoff"))


@query("score_groups", with_ctes(*BASE, body=f"SELECT model, season, league, {_AVG} FROM sc GROUP BY 1, 2, 3"))
def _scores(spark, sf):
    return rounded(M.score_groups(predictions(spark, sf), ["model", "season", "league"]))


@query("row_scores", with_ctes(*BASE, body="SELECT match_id, model, round(ll, 9) AS log_loss, round(br, 9) AS brier_score, round(rp, 9) AS rps FROM sc"))
def _rows(spark, sf):
    scored = predictions(spark, sf).select("match_id", "model", *row_scores())
    return scored.select("match_id", "model", *[F.round(m, 9).alias(m) for m in METRICS])


@query("equal_group_metrics", with_ctes(*BASE, body="""
, l AS (SELECT model, league, count(*) AS n, avg(ll) AS ll, avg(br) AS br, avg(rp) AS rp, avg(ok) AS ok FROM sc GROUP BY 1, 2)
SELECT model, count(*) AS groups, CAST(sum(n) AS BIGINT) AS matches, round(avg(ll), 6) AS log_loss, round(avg(br), 6) AS brier_score, round(avg(rp), 6) AS rps, round(avg(ok), 6) AS accuracy FROM l GROUP BY 1"""))
def _equal(spark, sf):
    return rounded(M.equal_group_metrics(M.score_groups(predictions(spark, sf), ["model", "league"]), ["model"], "league", 5))


@query("equal_group_weights", with_ctes(MATCHES, body="""
SELECT match_id, round(count(*) OVER () / CAST(5 AS DOUBLE) / count(*) OVER (PARTITION BY league), 6) AS weight FROM matches"""))
def _weights(spark, sf):
    return rounded(M.equal_group_weights(matches(spark, sf), "league").select("match_id", "weight"))


@query("weight_audit", with_ctes(MATCHES, body="""
, w AS (SELECT league, count(*) OVER () / CAST(5 AS DOUBLE) / count(*) OVER (PARTITION BY league) AS weight FROM matches)
SELECT league, count(*) AS train_matches, round(sum(weight), 4) AS total_training_weight, round(avg(weight), 6) AS mean_match_weight FROM w GROUP BY 1"""))
def _audit(spark, sf):
    a = M.weight_audit(M.equal_group_weights(matches(spark, sf), "league"), "league")
    return a.select("league", "train_matches", F.round("total_training_weight", 4).alias("total_training_weight"), r6("mean_match_weight"))


_RESULT = "CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END"


@query("class_frequencies", with_ctes(MATCHES, body=f"""
, r AS (SELECT league, home_odds, {_RESULT} AS res FROM matches)
SELECT league, round(sum(CASE WHEN res = 'H' THEN home_odds ELSE 0 END) / sum(home_odds), 6) AS "prob_H", round(sum(CASE WHEN res = 'D' THEN home_odds ELSE 0 END) / sum(home_odds), 6) AS "prob_D",
 round(sum(CASE WHEN res = 'A' THEN home_odds ELSE 0 END) / sum(home_odds), 6) AS "prob_A" FROM r GROUP BY league
UNION ALL SELECT -1, round(avg(CAST(res = 'H' AS INT)), 6), round(avg(CAST(res = 'D' AS INT)), 6), round(avg(CAST(res = 'A' AS INT)), 6) FROM r"""))
def _frequencies(spark, sf):
    m = matches(spark, sf).withColumn("result_3way", S.result_3way("home_score", "away_score"))
    per = M.class_frequencies(m, ["league"], weight="home_odds", require_all=True)
    return rounded(per.unionByName(M.class_frequencies(m).withColumn("league", F.lit(-1))))


_FOLDS = """
se AS (SELECT season, row_number() OVER (ORDER BY min(kickoff)) AS p FROM matches GROUP BY season),
folds AS (SELECT t.season AS test_season, r.season AS train_season FROM se t JOIN se r ON r.p < t.p WHERE t.p > 2)"""


@query("expanding_folds", with_ctes(MATCHES, _FOLDS.strip(), body="SELECT test_season, train_season FROM folds"))
def _folds(spark, sf):
    return E.expanding_folds(matches(spark, sf))


@query("fold_counts", with_ctes(MATCHES, _FOLDS.strip(), body="""
SELECT f.test_season, m.league, count(*) FILTER (WHERE role = 'train') AS train_matches, count(*) FILTER (WHERE role = 'test') AS test_matches
FROM (SELECT test_season, train_season AS season, 'train' AS role FROM folds UNION SELECT test_season, test_season, 'test' FROM folds) f JOIN matches m ON m.season = f.season GROUP BY 1, 2"""))
def _fold_counts(spark, sf):
    m = matches(spark, sf)
    return M.fold_counts(m, E.expanding_folds(m), "season", "league")


@query("fold_checks", with_ctes(MATCHES, _FOLDS.strip(), body=f"""
, fr AS (SELECT f.test_season, f.role, m.season, m.league, m.kickoff, {_RESULT} AS res
 FROM (SELECT test_season, train_season AS season, 'train' AS role FROM folds UNION SELECT test_season, test_season, 'test' FROM folds) f JOIN matches m ON m.season = f.season)
SELECT test_season, count(*) FILTER (WHERE role = 'train') AS train_rows, count(*) FILTER (WHERE role = 'test') AS test_rows, count(DISTINCT league) FILTER (WHERE role = 'train') AS train_groups,
 count(DISTINCT league) FILTER (WHERE role = 'test') AS test_groups, count(DISTINCT res) FILTER (WHERE role = 'train') AS train_classes, count(DISTINCT season) FILTER (WHERE role = 'train') AS train_seasons,
 max(kickoff) FILTER (WHERE role = 'train') < min(kickoff) FILTER (WHERE role = 'test') AS train_before_test FROM fr GROUP BY 1"""))
def _fold_checks(spark, sf):
    m = matches(spark, sf).withColumn("result_3way", S.result_3way("home_score", "away_score"))
    folds = E.expanding_folds(m)
    E.validate_folds(m, folds, groups=5)
    return E.fold_checks(m, folds)


_REL = """
lo AS (SELECT model, match_id, unnest(['H', 'D', 'A']) AS outcome, unnest([prob_H, prob_D, prob_A]) AS p, unnest([oh, od, oa]) AS o FROM sc),
bi AS (SELECT *, CAST(greatest(ceil((row_number() OVER (PARTITION BY model, outcome ORDER BY p, match_id) - 1) * 10 / (count(*) OVER (PARTITION BY model, outcome) - 1)), 1) - 1 AS BIGINT) AS bin FROM lo),
rb AS (SELECT model, outcome, bin, count(*) AS matches, avg(p) AS ap, sum(o) / count(*) AS f, count(*) AS n FROM bi GROUP BY 1, 2, 3)"""


@query("reliability_table", with_ctes(*BASE, _REL.strip(), body="""
SELECT model, outcome, bin, matches, round(ap, 6) AS average_prediction, round(f, 6) AS actual_frequency,
 round(greatest(0, (f + 3.8416 / (2 * n) - 1.96 * sqrt(f * (1 - f) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS wilson_lower,
 round(least(1, (f + 3.8416 / (2 * n) + 1.96 * sqrt(f * (1 - f) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS wilson_upper, round(abs(f - ap), 6) AS absolute_gap FROM rb"""))
def _reliability(spark, sf):
    return rounded(M.reliability_table(predictions(spark, sf).select("model", "match_id", "result_3way", "prob_H", "prob_D", "prob_A"), ["model"], ["match_id"]))


@query("calibration_errors", with_ctes(*BASE, _REL.strip(), body="""
, e AS (SELECT model, outcome, sum(abs(f - ap) * n) / sum(n) AS ece, max(abs(f - ap)) AS gap FROM rb GROUP BY 1, 2)
SELECT model, round(max(ece) FILTER (WHERE outcome = 'H'), 6) AS "ece_H", round(max(ece) FILTER (WHERE outcome = 'D'), 6) AS "ece_D", round(max(ece) FILTER (WHERE outcome = 'A'), 6) AS "ece_A",
 round(avg(ece), 6) AS ece, round(max(gap), 6) AS mce FROM e GROUP BY 1"""))
def _errors(spark, sf):
    rel = M.reliability_table(predictions(spark, sf).select("model", "match_id", "result_3way", "prob_H", "prob_D", "prob_A"), ["model"], ["match_id"])
    return rounded(M.calibration_errors(rel, ["model"]))


@query("confidence_table", with_ctes(*BASE, body="""
, c AS (SELECT model, match_id, greatest(prob_H, prob_D, prob_A) AS c, ok FROM sc),
b AS (SELECT *, CAST(greatest(ceil((row_number() OVER (PARTITION BY model ORDER BY c, match_id) - 1) * 10 / (count(*) OVER (PARTITION BY model) - 1)), 1) - 1 AS BIGINT) AS bin FROM c)
SELECT model, bin, count(*) AS matches, round(avg(c), 6) AS average_confidence, round(avg(ok), 6) AS accuracy FROM b GROUP BY 1, 2"""))
def _confidence(spark, sf):
    return rounded(M.confidence_table(predictions(spark, sf), ["model"], ["match_id"]))


@query("seasonal_stability", with_ctes(*BASE, body="""
SELECT model, round(avg(l), 6) AS mean_season, round(max(l), 6) AS worst_season, round(stddev_samp(l), 6) AS season_std FROM (SELECT model, season, avg(ll) AS l FROM sc GROUP BY 1, 2) GROUP BY 1"""))
def _stability(spark, sf):
    return rounded(M.seasonal_stability(M.score_groups(predictions(spark, sf), ["model", "season"]), ["model"]))


@query("attach_benchmark", with_ctes(*BASE, body="""
, s AS (SELECT season, model, count(*) AS matches, avg(ll) AS ll FROM sc GROUP BY 1, 2)
SELECT a.season, a.model, a.matches, round(a.ll, 6) AS log_loss, round(b.ll, 6) AS benchmark, round(a.ll - b.ll, 6) AS vs_benchmark, round((a.ll - b.ll) / b.ll, 6) AS relative_to_benchmark,
 CASE WHEN a.model = 'closing_market' THEN 'baseline' WHEN a.ll < b.ll THEN 'outperforms_market' WHEN (a.ll - b.ll) / b.ll <= CAST(0.01 AS DOUBLE) THEN 'within_1_percent'
  WHEN (a.ll - b.ll) / b.ll <= CAST(0.02 AS DOUBLE) THEN 'within_2_percent' ELSE 'worse_by_more_than_2_percent' END AS market_comparison
FROM s a JOIN s b ON a.season = b.season AND b.model = 'closing_market'"""))
def _attach(spark, sf):
    s = M.score_groups(predictions(spark, sf), ["season", "model"]).select("season", "model", "matches", "log_loss")
    a = J.attach_benchmark(s, ["season"], "model", "closing_market", "log_loss")
    return rounded(a.withColumn("market_comparison", S.benchmark_label("model", "relative_to_benchmark", "closing_market")))


_PAIR = """
wk AS (SELECT *, CAST(match_date + CAST((8 - isodow(match_date)) % 7 AS INT) AS DATE) AS e FROM sc),
pa AS (SELECT a.match_id, a.league, a.season, concat(CAST(a.e - 6 AS VARCHAR), '/', CAST(a.e AS VARCHAR)) AS match_week, a.ll AS bl, a.br AS bb, a.rp AS brp, b.ll AS el, b.br AS eb, b.rp AS erp,
  a.ll - b.ll AS il, a.br - b.br AS ib, a.rp - b.rp AS irp FROM wk a JOIN wk b ON a.match_id = b.match_id WHERE a.model = 'closing_market' AND b.model = 'softened_market')"""


def paired(spark, sf):
    return B.paired_losses(predictions(spark, sf), "closing_market", "softened_market")


@query("paired_losses", with_ctes(*BASE, _PAIR.strip(), body="""
SELECT match_id, match_week, round(bl, 6) AS baseline_log_loss, round(el, 6) AS enhanced_log_loss, round(il, 6) AS improvement_log_loss, round(ib, 6) AS improvement_brier_score, round(irp, 6) AS improvement_rps FROM pa"""))
def _paired(spark, sf):
    return rounded(paired(spark, sf).select("match_id", "match_week", "baseline_log_loss", "enhanced_log_loss", *[f"improvement_{m}" for m in METRICS]))


_LONG = """
lg AS (SELECT league, season, match_week, unnest(['log_loss', 'brier_score', 'rps']) AS metric, unnest([bl, bb, brp]) AS b, unnest([il, ib, irp]) AS i FROM pa)"""


@query("observed_improvement", with_ctes(*BASE, _PAIR.strip(), _LONG.strip(), body="""
, l AS (SELECT league, metric, avg(b) AS b, avg(i) AS i FROM lg GROUP BY 1, 2)
SELECT 'equal_league' AS weighting, metric, (SELECT count(*) FROM pa) AS matches, count(*) AS leagues, round(avg(b), 6) AS baseline, round(avg(i), 6) AS improvement, round(100 * avg(i) / avg(b), 5) AS relative_pct FROM l GROUP BY 2
UNION ALL SELECT 'match_weighted', metric, count(*), count(DISTINCT league), round(avg(b), 6), round(avg(i), 6), round(100 * avg(i) / avg(b), 5) FROM lg GROUP BY 2"""))
def _observed(spark, sf):
    o = B.observed_improvement(paired(spark, sf))
    return o.select("weighting", "metric", "matches", "leagues", r6("baseline"), r6("improvement"), F.round("relative_pct", 5).alias("relative_pct"))


REPS = 10_000


def _boot(seed: str) -> str:
    return f"""
wb AS (SELECT league, season, match_week, count(*) AS n, sum(bl) AS bl, sum(bb) AS bb, sum(brp) AS brp, sum(il) AS il, sum(ib) AS ib, sum(irp) AS irp FROM pa GROUP BY 1, 2, 3),
sl AS (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY match_week) - 1 AS slot, count(*) OVER (PARTITION BY league, season) AS blocks FROM wb),
dr AS (SELECT rep, s.league, s.season, ('0x' || substr(md5(concat_ws('|', CAST({seed} AS VARCHAR), CAST(rep AS VARCHAR), CAST(s.league AS VARCHAR), CAST(s.season AS VARCHAR), CAST(s.slot AS VARCHAR))), 1, 8))::BIGINT % s.blocks AS pick
  FROM sl s CROSS JOIN (SELECT unnest(range({REPS})) AS rep)),
rs AS (SELECT rep, d.league, sum(n) AS n, sum(bl) AS bl, sum(bb) AS bb, sum(brp) AS brp, sum(il) AS il, sum(ib) AS ib, sum(irp) AS irp FROM dr d JOIN sl v ON v.league = d.league AND v.season = d.season AND v.slot = d.pick GROUP BY 1, 2),
rl AS (SELECT rep, league, n, unnest(['log_loss', 'brier_score', 'rps']) AS metric, unnest([bl, bb, brp]) AS b, unnest([il, ib, irp]) AS i FROM rs),
sa AS (SELECT rep, 'equal_league' AS weighting, metric, avg(i / n) AS ai, 100 * avg(i / n) / avg(b / n) AS ri FROM rl GROUP BY 1, 3 UNION ALL
  SELECT rep, 'match_weighted', metric, sum(i) / sum(n), 100 * sum(i) / sum(b) FROM rl GROUP BY 1, 3)"""


@query("resample_weeks", with_ctes(*BASE, _PAIR.strip(), _boot("42").strip(), body="""
SELECT rep AS repetition, weighting, metric, round(ai, 6) AS absolute_improvement, round(ri, 5) AS relative_improvement_pct FROM sa"""))
def _resample(spark, sf):
    s = B.resample_weeks(paired(spark, sf), REPS, 42)
    return s.select(F.col("repetition").cast("bigint").alias("repetition"), "weighting", "metric", r6("absolute_improvement"), F.round("relative_improvement_pct", 5).alias("relative_improvement_pct"))


_ENDS = """round(quantile_cont(ai, 0.025), 6) AS lower_absolute, round(quantile_cont(ai, 0.975), 6) AS upper_absolute, round(quantile_cont(ri, 0.025), 5) AS lower_relative_pct,
 round(quantile_cont(ri, 0.975), 5) AS upper_relative_pct, round(100 * avg(CAST(ai > 0 AS INT)), 6) AS samples_favouring_enhanced_pct, quantile_cont(ai, 0.025) > 0 OR quantile_cont(ai, 0.975) < 0 AS interval_excludes_zero"""


def _ends(df, *keys):
    five = ("lower_relative_pct", "upper_relative_pct")
    return df.select(*keys, r6("lower_absolute"), r6("upper_absolute"), *[F.round(c, 5).alias(c) for c in five], r6("samples_favouring_enhanced_pct"), "interval_excludes_zero")


@query("bootstrap_intervals", with_ctes(*BASE, _PAIR.strip(), _boot("42").strip(), body=f"SELECT weighting, metric, {_ENDS} FROM sa GROUP BY 1, 2"))
def _intervals(spark, sf):
    return _ends(B.intervals(B.resample_weeks(paired(spark, sf), REPS, 42)), "weighting", "metric")


@query("league_intervals", with_ctes(*BASE, _PAIR.strip(), _boot("42 + s.league").strip(), body=f"""
, ls AS (SELECT rep, league, metric, i / n AS ai, 100 * i / b AS ri FROM rl) SELECT league, metric, {_ENDS} FROM ls GROUP BY 1, 2"""))
def _league_intervals(spark, sf):
    return _ends(B.intervals(B.resample_weeks_by_league(paired(spark, sf), REPS, 42), ["league", "metric"]), "league", "metric")


@query("calibration_decision", with_ctes(*BASE, _PAIR.strip(), body="""
, l AS (SELECT league, avg(il) AS il, avg(ib) AS ib FROM pa GROUP BY 1), f AS (SELECT season, avg(il) AS il FROM (SELECT season, league, avg(il) AS il FROM pa GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT avg(il) AS a, avg(ib) AS b, count(*) FILTER (WHERE il > 0) AS n, count(*) // 2 + 1 AS q, (SELECT min(il) FROM f) AS w FROM l)
SELECT round(a, 6) AS equal_league_log_loss_improvement, round(b, 6) AS equal_league_brier_improvement, n AS leagues_improved, q AS leagues_required, round(w, 6) AS worst_fold_log_loss_improvement,
 a > 0 AS equal_league_log_loss_improved, b >= 0 AS equal_league_brier_not_worse, w >= CAST(-0.001 AS DOUBLE) AS no_fold_log_loss_deterioration_over_limit, n >= q AS log_loss_improved_in_league_majority,
 a > 0 AND b >= 0 AND w >= CAST(-0.001 AS DOUBLE) AND n >= q AS retain_calibration FROM o"""))
def _decision(spark, sf):
    return rounded(B.calibration_decision(paired(spark, sf)))


@query("calibration_effect", with_ctes(*BASE, _PAIR.strip(), body="""
, x AS (SELECT season, league, unnest(['log_loss', 'brier_score', 'rps']) AS metric, unnest([bl, bb, brp]) AS b, unnest([el, eb, erp]) AS e FROM pa),
g AS (SELECT season, league, metric, avg(b) AS b, avg(e) AS e FROM x GROUP BY 1, 2, 3)
SELECT season, metric, round(avg(b), 6) AS uncalibrated_score, round(avg(e), 6) AS calibrated_score, round(avg(b - e), 6) AS calibration_improvement FROM g GROUP BY 1, 2"""))
def _effect(spark, sf):
    return rounded(M.calibration_effect_table(paired(spark, sf), "season", "league"))


@query("primary_comparison", with_ctes(*BASE, body="""
, lg AS (SELECT model, league, unnest(['log_loss', 'brier_score', 'rps']) AS metric, unnest([ll, br, rp]) AS v FROM sc),
le AS (SELECT model, league, metric, avg(v) AS v FROM lg GROUP BY 1, 2, 3),
al AS (SELECT 'equal_league' AS aggregation, -1 AS league, model, metric, avg(v) AS v FROM le GROUP BY 3, 4 UNION ALL SELECT 'match_weighted', -1, model, metric, avg(v) FROM lg GROUP BY 3, 4
 UNION ALL SELECT 'individual_league', league, model, metric, v FROM le)
SELECT a.aggregation, a.league, a.metric, round(a.v, 6) AS baseline_score, round(b.v, 6) AS player_score, round(a.v - b.v, 6) AS improvement, round(100 * (a.v - b.v) / a.v, 5) AS relative_improvement_pct
FROM al a JOIN al b ON a.aggregation = b.aggregation AND a.league = b.league AND a.metric = b.metric WHERE a.model = 'closing_market' AND b.model = 'softened_market'"""))
def _primary(spark, sf):
    p = predictions(spark, sf)
    by = M.score_groups(p, ["league", "model"])
    c = M.primary_comparison(M.score_groups(p, ["model"]), by, M.equal_group_metrics(by, ["model"], "league", 5), "league", "model", "closing_market", "softened_market")
    return c.fillna(-1, ["league"]).select("aggregation", "league", "metric", r6("baseline_score"), r6("player_score"), r6("improvement"), F.round("relative_improvement_pct", 5).alias("relative_improvement_pct"))


@query("season_points", with_ctes(MATCHES, body=f"""
, p AS (SELECT league, season, home_team AS team, CASE {_RESULT} WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS pts FROM matches UNION ALL
 SELECT league, season, away_team, CASE {_RESULT} WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END FROM matches)
SELECT league, season, team, round(avg(pts), 6) AS points_per_match FROM p GROUP BY 1, 2, 3"""))
def _points(spark, sf):
    m = matches(spark, sf).withColumn("result_3way", S.result_3way("home_score", "away_score"))
    return rounded(M.season_points(m, ["league", "season"], "home_team", "away_team"))


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS correlation FROM lineitem" if a != b else f"SELECT '{a}', '{a}', CAST(1.0 AS DOUBLE)" for a in _NUMERIC for b in reversed(_NUMERIC)))
def _correlation(spark, sf):
    return rounded(M.correlation_matrix(read(spark, sf, "lineitem"), _NUMERIC))


@query("linear_fits", " UNION ALL ".join(
    f"SELECT 'l_quantity' AS x, '{y}' AS y, round(regr_slope({y}, l_quantity), 6) AS slope, round(regr_intercept({y}, l_quantity), 4) AS intercept FROM lineitem" for y in _NUMERIC[1:]))
def _fits(spark, sf):
    f = M.linear_fits(read(spark, sf, "lineitem"), [("l_quantity", y) for y in _NUMERIC[1:]])
    return f.select("x", "y", r6("slope"), F.round("intercept", 4).alias("intercept"))


@query("axis_limits", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.01), 6) AS lower, round(quantile_cont({c}, 0.99), 6) AS upper FROM lineitem" for c in _NUMERIC))
def _limits(spark, sf):
    return rounded(M.axis_limits(read(spark, sf, "lineitem"), _NUMERIC))


@query("comparison_audit", with_ctes(*BASE, body="""
, w AS (SELECT *, CAST(match_date + CAST((8 - isodow(match_date)) % 7 AS INT) AS DATE) AS e FROM sc)
SELECT model, count(*) AS matches, count(DISTINCT league) AS leagues, count(DISTINCT concat_ws('|', league, season, e)) AS league_season_weeks FROM w GROUP BY 1"""))
def _comparison(spark, sf):
    return M.comparison_audit(predictions(spark, sf).withColumn("match_week", S.match_week("kickoff")), ["model"])


_PARTS = "SELECT p_brand, concat_ws('|', CASE WHEN p_size % 2 = 0 THEN 'even' END, CASE WHEN p_size > 25 THEN 'large' END, 'any') AS groups, p_retailprice AS loss, p_size FROM part"


def _parts(spark, sf):
    groups = F.concat_ws("|", F.when(F.col("p_size") % 2 == 0, "even"), F.when(F.col("p_size") > 25, "large"), F.lit("any"))
    return read(spark, sf, "part").select("p_brand", groups.alias("groups"), F.col("p_retailprice").alias("loss"), "p_size")


@query("search_summary", f"""
WITH p AS ({_PARTS}), b AS (SELECT p_brand, min(loss) AS best FROM p GROUP BY 1), g AS (SELECT unnest(['even', 'large']) AS feature_group)
SELECT p.p_brand, feature_group, round(avg(loss) FILTER (WHERE list_contains(string_split(groups, '|'), feature_group)), 6) AS mean_loss_with, round(avg(loss) FILTER (WHERE NOT list_contains(string_split(groups, '|'), feature_group)), 6) AS mean_loss_without,
 round(min(loss - best) FILTER (WHERE list_contains(string_split(groups, '|'), feature_group)), 6) AS best_gap_with FROM p JOIN b ON p.p_brand = b.p_brand CROSS JOIN g GROUP BY 1, 2""")
def _search(spark, sf):
    return rounded(M.search_summary(_parts(spark, sf), "p_brand", "groups", "loss", ["even", "large"]))


@query("gap_by_count", f"""
WITH p AS ({_PARTS}), c AS (SELECT p_brand, p_size, min(loss) AS l FROM p GROUP BY 1, 2) SELECT p_brand, p_size, round(l - min(l) OVER (PARTITION BY p_brand), 6) AS best_gap FROM c""")
def _gap(spark, sf):
    return rounded(M.gap_by_count(_parts(spark, sf), "p_brand", "p_size", "loss"))


@query("feature_list_checks", """
SELECT p_brand AS model, count(*) AS features, count(*) - count(DISTINCT p_type) AS repeated, count(*) FILTER (WHERE p_type NOT IN (SELECT min(p_type) FROM part UNION ALL SELECT max(p_type) FROM part)) AS unknown FROM part GROUP BY 1""")
def _feature_list(spark, sf):
    part = read(spark, sf, "part")
    ends = part.agg(F.min("p_type"), F.max("p_type")).first()
    return E.feature_list_checks(part, list(ends), "p_brand", "p_type").withColumnRenamed("p_brand", "model")


def _hex(start: int) -> str:
    """Fifteen hexadecimal digits as a number."""
    return f"CAST(('0x' || substr(d, {start}, 15))::BIGINT AS HUGEINT)"


@query("table_fingerprint", f"""
WITH d AS (SELECT sha256(concat_ws(',', o_orderkey, o_custkey, o_orderstatus)) AS d FROM orders),
b AS (SELECT ('0x' || substr(d, 61, 4))::BIGINT % 256 AS bucket, count(*) AS n, sum({_hex(1)}) AS s0, sum({_hex(16)}) AS s1, sum({_hex(31)}) AS s2, sum({_hex(46)}) AS s3 FROM d GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(concat_ws(',', lpad(CAST(bucket AS VARCHAR), 5, '0'), n, s0, s1, s2, s3), chr(10) ORDER BY concat_ws(',', lpad(CAST(bucket AS VARCHAR), 5, '0'), n, s0, s1, s2, s3))) AS fingerprint FROM b""")
def _fingerprint(spark, sf):
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")])
    return E.table_fingerprint(read(spark, sf, "orders"), line)


@query("ordered_fingerprint", """
WITH l AS (SELECT row_number() OVER (ORDER BY o_custkey, concat_ws(',', o_orderkey, o_custkey, o_orderstatus)) - 1 AS r0, concat_ws(',', o_orderkey, o_custkey, o_orderstatus) AS line FROM orders),
a AS (SELECT r0 // 4096 AS r1, sha256(string_agg(line, chr(10) ORDER BY r0)) AS d1, count(*) AS n1 FROM l GROUP BY 1),
b AS (SELECT r1 // 4096 AS r2, sha256(string_agg(d1, chr(10) ORDER BY r1)) AS d2, sum(n1) AS n2 FROM a GROUP BY 1)
SELECT CAST(coalesce(sum(n2), 0) AS BIGINT) AS rows, sha256(coalesce(string_agg(d2, chr(10) ORDER BY r2), '')) AS fingerprint FROM b""")
def _ordered_fingerprint(spark, sf):
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")])
    return E.ordered_fingerprint(read(spark, sf, "orders"), line, [F.col("o_custkey")])


@query("late_block_cutoff", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT day, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM d)
SELECT strftime(day, '%Y-%m-%d') AS cutoff FROM r WHERE r = greatest(CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT), 1)""")
def _cutoff(spark, sf):
    return E.late_block_cutoff(read(spark, sf, "orders"), "o_orderdate").select(F.col("cutoff").cast("string").alias("cutoff"))
