"""Joins, reconciliation and coverage reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.catalog.registry import query, r6, rounded, with_ctes
from lagwise.functions import scalars as S
from lagwise.operators import audit as A
from lagwise.operators import joins as J
from lagwise.plans.tables import MATCHES, PLAYERS, PROVIDER, matches, players, provider, read

SIDE = 2

KEYED = """keyed AS (SELECT *, concat_ws('|', CAST(season AS VARCHAR), strftime(kickoff, '%Y-%m-%d'), CAST(match_id AS VARCHAR)) AS join_key FROM matches)"""


def keyed(spark, sf):
    return matches(spark, sf).withColumn("join_key", F.concat_ws(
        "|", F.col("season").cast("string"), F.date_format("kickoff", "yyyy-MM-dd"), F.col("match_id").cast("string")))


VALIDATION = """summary AS (SELECT match_id, count(*) AS player_rows, count(player_id) AS players_with_id, count(DISTINCT player_id) AS unique_player_ids,
  count(*) FILTER (WHERE played) AS played_players, count(*) FILTER (WHERE started) AS starters,
  count(*) FILTER (WHERE started AND player_id IS NOT NULL) AS starters_with_id,
  count(*) FILTER (WHERE started AND minutes IS NOT NULL) AS starters_with_minutes FROM players GROUP BY match_id),
sides AS (SELECT p.match_id, count(*) FILTER (WHERE started AND team_id = home_team) AS home_starters,
  count(*) FILTER (WHERE started AND team_id = away_team) AS away_starters, bool_and(team_id IN (home_team, away_team)) AS ids_valid
  FROM players p JOIN matches m ON p.match_id = m.match_id GROUP BY p.match_id),
validation AS (SELECT k.match_id, k.league, k.season, k.kickoff, k.home_score, k.away_score,
  CASE WHEN full_time_home IS NULL THEN NULL WHEN full_time_home > full_time_away THEN 'H' WHEN full_time_home < full_time_away THEN 'A' ELSE 'D' END AS result_3way,
  o.home_odds, o.draw_odds, o.away_odds, true AS completed_match, full_time_home IS NOT NULL AS football_data_match,
  coalesce(odds_is_closing AND o.home_odds > 1 AND o.draw_odds > 1 AND o.away_odds > 1, false) AS closing_odds_available,
  coalesce(home_score = full_time_home AND away_score = full_time_away, false) AS score_matches_football_data,
  coalesce(player_rows, 0) > 0 AS player_data_available, coalesce(home_starters, 0) AS home_starters, coalesce(away_starters, 0) AS away_starters,
  coalesce(home_starters = 2 AND away_starters = 2, false) AS twenty_two_starters,
  coalesce(starters > 0 AND starters_with_id = starters, false) AS starter_identity_complete,
  coalesce(starters > 0 AND starters_with_minutes = starters, false) AS starter_minutes_complete,
  coalesce(ids_valid, false) AS player_team_ids_valid
  FROM keyed k LEFT JOIN provider o ON k.join_key = o.join_key LEFT JOIN summary s ON k.match_id = s.match_id LEFT JOIN sides d ON k.match_id = d.match_id),
report AS (SELECT *, completed_match AND football_data_match AND closing_odds_available AND score_matches_football_data AND player_data_available
  AND twenty_two_starters AND starter_identity_complete AND starter_minutes_complete AND player_team_ids_valid AS model_ready,
  CASE WHEN NOT football_data_match THEN 'not_top_division_match' WHEN NOT completed_match THEN 'match_not_completed'
   WHEN NOT score_matches_football_data THEN 'score_disagreement' WHEN NOT closing_odds_available THEN 'missing_closing_odds'
   WHEN NOT player_data_available THEN 'no_player_data' WHEN NOT twenty_two_starters THEN 'invalid_starter_count'
   WHEN NOT starter_identity_complete THEN 'missing_starter_identity' WHEN NOT starter_minutes_complete THEN 'missing_starter_minutes'
   WHEN NOT player_team_ids_valid THEN 'invalid_player_team_assignment' END AS exclusion_reason FROM validation)"""

REPORT = (MATCHES, PLAYERS, PROVIDER, KEYED, VALIDATION)


def report(spark, sf):
    """The validation report with reasons; an order's line-up is complete with two starters per side."""
    m = keyed(spark, sf).select("match_id", "league", "season", "kickoff", "join_key", "home_team", "away_team", "home_score", "away_score",
                                F.lit("finished").alias("status"))
    v = A.match_validation(m, provider(spark, sf), players(spark, sf), SIDE)
    v = v.withColumn("model_ready", S.meets_all(S.MATCH_CHECKS)).withColumn("result_3way", S.result_3way("full_time_home", "full_time_away"))
    return v.withColumn("exclusion_reason", S.exclusion_reason(S.EXCLUSION_PRIORITY))


@query("checked_join", with_ctes(MATCHES, PLAYERS, PROVIDER, KEYED, body="""
SELECT match_id, CAST(full_time_home AS DOUBLE) AS full_time_home, CAST(full_time_away AS DOUBLE) AS full_time_away, coalesce(odds_is_closing, false) AS odds_is_closing FROM keyed k LEFT JOIN provider o ON k.join_key = o.join_key"""))
def _checked_join(spark, sf):
    odds = provider(spark, sf).select("join_key", "full_time_home", "full_time_away", "odds_is_closing")
    return J.checked_join(keyed(spark, sf), odds, ["join_key"], "left", "one_to_one").select(
        "match_id", F.col("full_time_home").cast("double"), F.col("full_time_away").cast("double"), F.coalesce("odds_is_closing", F.lit(False)).alias("odds_is_closing"))


@query("match_validation", with_ctes(*REPORT, body="""
SELECT match_id, season, result_3way, completed_match, football_data_match, closing_odds_available, score_matches_football_data, player_data_available,
 home_starters, away_starters, twenty_two_starters, starter_identity_complete, starter_minutes_complete, player_team_ids_valid, model_ready, exclusion_reason FROM report"""))
def _validation(spark, sf):
    return report(spark, sf).select(
        "match_id", "season", "result_3way", "completed_match", "football_data_match", "closing_odds_available", "score_matches_football_data",
        "player_data_available", "home_starters", "away_starters", "twenty_two_starters", "starter_identity_complete", "starter_minutes_complete",
        "player_team_ids_valid", "model_ready", "exclusion_reason")


@query("attach_summary", """
SELECT o_orderkey, coalesce(n, 0) AS lines, coalesce(q, 0) AS quantity FROM orders LEFT JOIN
 (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def _attach(spark, sf):
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))
    return J.attach_summary(read(spark, sf, "orders").select("o_orderkey"), lines, ["o_orderkey"])


@query("lookup_both_sides", with_ctes(MATCHES, PLAYERS, body="""
, t AS (SELECT match_id, team_id, count(*) FILTER (WHERE started) AS starters FROM players GROUP BY 1, 2)
SELECT m.match_id, coalesce(h.starters, 0) AS home_starters, coalesce(a.starters, 0) AS away_starters FROM matches m
LEFT JOIN t h ON m.match_id = h.match_id AND m.home_team = h.team_id LEFT JOIN t a ON m.match_id = a.match_id AND m.away_team = a.team_id"""))
def _lookup(spark, sf):
    t = players(spark, sf).groupBy("match_id", "team_id").agg(A.count_true(F.col("started")).alias("starters"))
    return J.lookup_both_sides(matches(spark, sf), t, ["match_id"], "team_id", "home_team", "away_team", ["starters"], 0).select(
        "match_id", "home_starters", "away_starters")


@query("attach_default", """
SELECT o_orderkey, coalesce(c_acctbal, 1500.0) AS strength FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def _default(spark, sf):
    rated = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("strength"))
    return J.attach_default(read(spark, sf, "orders"), rated, ["o_custkey"], {"strength": 1500.0}).select("o_orderkey", "strength")


@query("merge_complete", """
SELECT o_custkey, n, round(total, 4) AS total, high FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) USING (o_custkey) JOIN (SELECT o_custkey, max(o_orderkey) AS high FROM orders GROUP BY 1) USING (o_custkey)""")
def _merge(spark, sf):
    by = read(spark, sf, "orders").groupBy("o_custkey")
    parts = by.agg(F.sum("o_totalprice").alias("total")), by.agg(F.max("o_orderkey").alias("high"))
    m = J.merge_complete(by.agg(F.count(F.lit(1)).alias("n")), parts, ["o_custkey"])
    return m.select("o_custkey", "n", F.round("total", 4).alias("total"), "high")


@query("pivot_sides", with_ctes(MATCHES, PLAYERS, body="""
SELECT m.match_id, h.rows AS home_rows, h.shots AS home_shots, a.rows AS away_rows, a.shots AS away_shots FROM (SELECT DISTINCT match_id FROM s) m
LEFT JOIN s h ON m.match_id = h.match_id AND h.side = 'home' LEFT JOIN s a ON m.match_id = a.match_id AND a.side = 'away'""").replace(
    "\nSELECT m.match_id", """, s AS (SELECT p.match_id, CASE WHEN team_id = home_team THEN 'home' ELSE 'away' END AS side, CAST(count(*) AS DOUBLE) AS rows, round(sum(shots), 4) AS shots
 FROM players p JOIN matches m ON p.match_id = m.match_id WHERE team_id IN (home_team, away_team) GROUP BY 1, 2)
SELECT m.match_id"""))
def _pivot_sides(spark, sf):
    m = matches(spark, sf).select("match_id", "home_team", "away_team")
    long = players(spark, sf).join(m, "match_id").filter("team_id IN (home_team, away_team)").groupBy(
        "match_id", S.team_side("team_id", "home_team", "away_team").alias("side")).agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.round(F.sum("shots"), 4).alias("shots"))
    return J.pivot_sides(long, ["match_id"], "side", ["rows", "shots"])


@query("starters_of_targets", with_ctes(*REPORT, body="""
SELECT match_id, player_id, team_id, minutes, shots, count(*) AS rows FROM players WHERE started AND match_id IN (SELECT match_id FROM report WHERE model_ready) GROUP BY ALL"""))
def _targets(spark, sf):
    ready = report(spark, sf).filter("model_ready").select("match_id")
    s = players(spark, sf).filter("started").join(ready, "match_id", "left_semi")
    return s.groupBy("match_id", "player_id", "team_id", "minutes", "shots").agg(F.count(F.lit(1)).alias("rows"))


@query("key_origins", with_ctes(MATCHES, PROVIDER, KEYED, body="""
SELECT coalesce(a.join_key, b.join_key) AS join_key, CASE WHEN a.join_key IS NULL THEN 'right_only' WHEN b.join_key IS NULL THEN 'left_only' ELSE 'both' END AS origin
FROM (SELECT join_key FROM keyed WHERE league < 4) a FULL JOIN (SELECT join_key FROM provider) b ON a.join_key = b.join_key"""))
def _origins(spark, sf):
    return J.key_origins(keyed(spark, sf).filter("league < 4"), provider(spark, sf), ["join_key"])


@query("membership_difference", with_ctes(MATCHES, PROVIDER, KEYED, body="""
SELECT join_key, 'missing' AS difference FROM keyed WHERE league < 4 AND join_key NOT IN (SELECT join_key FROM provider) UNION ALL
SELECT join_key, 'unexpected' FROM provider WHERE join_key NOT IN (SELECT join_key FROM keyed WHERE league < 4)"""))
def _membership(spark, sf):
    return J.membership_difference(keyed(spark, sf).filter("league < 4"), provider(spark, sf), ["join_key"])


@query("unordered_pairs", """
WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT a.l_orderkey, a.l_suppkey AS first, b.l_suppkey AS second FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey""")
def _pairs(spark, sf):
    lineup = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return J.unordered_pairs(lineup, ["l_orderkey"], "l_suppkey")


@query("team_season_lookup", with_ctes(MATCHES, body="""
, t AS (SELECT league, season, team, avg(goals) AS rate FROM (SELECT league, season, home_team AS team, home_score AS goals FROM matches
  UNION ALL SELECT league, season, away_team, away_score FROM matches) GROUP BY 1, 2, 3)
SELECT match_id, round(h.rate, 6) AS home_rate, round(a.rate, 6) AS away_rate FROM matches m JOIN t h ON m.league = h.league AND m.season = h.season AND m.home_team = h.team
JOIN t a ON m.league = a.league AND m.season = a.season AND m.away_team = a.team"""))
def _team_season(spark, sf):
    m = matches(spark, sf)
    rows = m.select("league", "season", F.inline(F.array(
        F.struct(F.col("home_team").alias("team"), F.col("home_score").alias("goals")), F.struct(F.col("away_team").alias("team"), F.col("away_score").alias("goals")))))
    t = rows.groupBy("league", "season", "team").agg(F.avg("goals").alias("rate"))
    both = J.lookup_both_sides(m, t, ["league", "season"], "team", "home_team", "away_team", ["rate"], how="inner")
    return both.select("match_id", r6("home_rate"), r6("away_rate"))


@query("player_summary", with_ctes(*REPORT, body="SELECT * FROM summary"))
def _summary(spark, sf):
    return A.player_summary(players(spark, sf))


@query("side_checks", with_ctes(*REPORT, body="""
SELECT match_id, home_starters, away_starters, home_starters = 2 AND away_starters = 2 AS twenty_two_starters, starters > 0 AND starters_with_id = starters AS starter_identity_complete,
 starters > 0 AND starters_with_minutes = starters AS starter_minutes_complete, ids_valid AS player_team_ids_valid FROM sides JOIN summary USING (match_id)"""))
def _sides(spark, sf):
    return A.side_checks(matches(spark, sf), players(spark, sf), SIDE)


@query("set_subset_check", with_ctes(MATCHES, PLAYERS, body="""
SELECT p.match_id, bool_and(team_id IN (home_team, away_team)) AS valid FROM players p JOIN matches m ON p.match_id = m.match_id GROUP BY 1"""))
def _subset(spark, sf):
    p = players(spark, sf).join(matches(spark, sf).select("match_id", "home_team", "away_team"), "match_id")
    return A.set_subset_check(p, ["match_id"], "team_id", ["home_team", "away_team"])


@query("duplicate_rows", """
SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, l_extendedprice FROM lineitem JOIN
 (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) > 1) USING (l_orderkey, l_suppkey)""")
def _duplicates(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    return A.duplicate_rows(lines, ["l_orderkey", "l_suppkey"])


_LIMITS = {"player_match_coverage": 0.9, "lineup_coverage": 0.05, "starter_identity_coverage": 0.9, "starter_minutes_coverage": 0.95}


@query("season_coverage", with_ctes(*REPORT, body="""
, per AS (SELECT season, count(*) AS matches, count(*) FILTER (WHERE football_data_match) AS linked_matches, count(*) FILTER (WHERE NOT football_data_match) AS unmatched_matches,
 count(*) FILTER (WHERE football_data_match AND player_data_available) AS with_player_data, count(*) FILTER (WHERE football_data_match AND twenty_two_starters) AS with_full_lineups,
 count(*) FILTER (WHERE football_data_match AND player_team_ids_valid) AS with_valid_team_ids, count(*) FILTER (WHERE football_data_match AND closing_odds_available) AS with_closing_odds,
 count(*) FILTER (WHERE football_data_match AND score_matches_football_data) AS score_agreements, count(*) FILTER (WHERE football_data_match AND model_ready) AS model_ready_matches FROM report GROUP BY season),
st AS (SELECT season, count(*) AS starter_rows, count(player_id) AS starters_with_id, count(minutes) AS starters_with_minutes FROM players
 WHERE started AND match_id IN (SELECT match_id FROM report WHERE football_data_match) GROUP BY season),
du AS (SELECT season, count(*) AS duplicate_rows FROM (SELECT season, count(*) OVER (PARTITION BY match_id, player_id) AS c FROM players WHERE player_id IS NOT NULL) WHERE c > 1 GROUP BY season)
SELECT season, matches, linked_matches, unmatched_matches, with_player_data, with_full_lineups, with_valid_team_ids, with_closing_odds, score_agreements, model_ready_matches,
 starter_rows, starters_with_id, starters_with_minutes, coalesce(duplicate_rows, 0) AS duplicate_rows,
 round(with_player_data / linked_matches, 6) AS player_match_coverage, round(with_full_lineups / linked_matches, 6) AS lineup_coverage,
 round(starters_with_id / starter_rows, 6) AS starter_identity_coverage, round(starters_with_minutes / starter_rows, 6) AS starter_minutes_coverage,
 round(model_ready_matches / linked_matches, 6) AS model_ready_coverage, with_player_data / linked_matches >= 0.9 AS player_match_coverage_pass,
 with_full_lineups / linked_matches >= 0.05 AS lineup_coverage_pass, starters_with_id / starter_rows >= 0.9 AS starter_identity_coverage_pass,
 starters_with_minutes / starter_rows >= 0.95 AS starter_minutes_coverage_pass
FROM per JOIN st USING (season) LEFT JOIN du USING (season)"""))
def _season_coverage(spark, sf):
    p = players(spark, sf)
    return rounded(A.season_coverage(report(spark, sf), p, A.duplicate_rows(p, ["match_id", "player_id"]), _LIMITS))


@query("field_coverage", with_ctes(MATCHES, PLAYERS, body="""
, f AS (SELECT season, unnest([CASE WHEN played THEN 'played_players' END, CASE WHEN started THEN 'starters' END]) AS cohort, unnest(['m', 'm']) AS x, minutes, npxg, shots FROM players),
u AS (SELECT season, cohort, unnest(['minutes', 'npxg', 'shots']) AS field, unnest([minutes, npxg, shots]) AS v FROM f WHERE cohort IS NOT NULL)
SELECT season, cohort, field, count(*) AS rows, count(v) AS populated_rows, count(*) FILTER (WHERE v <> 0) AS nonzero_rows, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
 round(count(v) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE v <> 0) / count(*), 6) AS nonzero_rate FROM u GROUP BY 1, 2, 3"""))
def _fields(spark, sf):
    cohorts = {"played_players": F.col("played"), "starters": F.col("started")}
    return rounded(A.field_coverage(players(spark, sf), "season", cohorts, ["minutes", "npxg", "shots"]))


@query("two_level_usability", with_ctes(MATCHES, PLAYERS, body="""
SELECT season, round(avg(CAST(ok AS INT)), 6) AS usable_match_coverage FROM (SELECT season, match_id, bool_and(u) AND count(*) = 2 AS ok FROM
 (SELECT season, match_id, team_id, count(npxg) / count(*) >= 0.9 AS u FROM players GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"""))
def _usability(spark, sf):
    return rounded(A.two_level_usability(players(spark, sf), "season", "match_id", "team_id", "npxg"))


@query("coverage_collapse", with_ctes(MATCHES, PLAYERS, body="""
, c AS (SELECT season, count(minutes) FILTER (WHERE league_minutes) / count(*) AS coverage FROM (SELECT p.*, minutes > (season - 1994) * 3 AS league_minutes FROM players p) GROUP BY season)
SELECT season, round(coverage, 6) AS coverage, round(lag(coverage) OVER (ORDER BY season) - coverage, 6) AS coverage_drop, coverage < 0.9 AS low_coverage,
 coalesce(lag(coverage) OVER (ORDER BY season) - coverage > CAST(0.05 AS DOUBLE), false) AS collapsed FROM c"""))
def _collapse(spark, sf):
    kept = F.when(F.col("minutes") > (F.col("season") - 1994) * 3, F.col("minutes"))
    c = players(spark, sf).groupBy("season").agg((F.count(kept) / F.count(F.lit(1))).alias("coverage"))
    return rounded(A.coverage_collapse(c, "season", "coverage", 0.9, 0.05))


@query("grouped_coverage", with_ctes(*REPORT, body="""
SELECT league, season, count(*) FILTER (WHERE football_data_match) AS target_matches, count(*) FILTER (WHERE football_data_match AND model_ready) AS model_ready_matches,
 count(*) FILTER (WHERE football_data_match AND NOT model_ready) AS excluded_matches,
 round(count(*) FILTER (WHERE football_data_match AND model_ready) / count(*) FILTER (WHERE football_data_match), 6) AS retention_rate,
 round(count(*) FILTER (WHERE result_3way = 'H') / count(result_3way), 6) AS target_home_rate, round(count(*) FILTER (WHERE result_3way = 'D') / count(result_3way), 6) AS target_draw_rate,
 round(count(*) FILTER (WHERE result_3way = 'A') / count(result_3way), 6) AS target_away_rate,
 round(count(*) FILTER (WHERE model_ready AND result_3way = 'H') / nullif(count(*) FILTER (WHERE model_ready), 0), 6) AS included_home_rate,
 round(count(*) FILTER (WHERE model_ready AND result_3way = 'D') / nullif(count(*) FILTER (WHERE model_ready), 0), 6) AS included_draw_rate,
 round(count(*) FILTER (WHERE model_ready AND result_3way = 'A') / nullif(count(*) FILTER (WHERE model_ready), 0), 6) AS included_away_rate FROM report GROUP BY 1, 2"""))
def _grouped(spark, sf):
    return rounded(A.grouped_coverage(report(spark, sf), ["league", "season"]))


@query("exclusion_counts", with_ctes(*REPORT, body="""
SELECT league, season, exclusion_reason, count(*) AS matches FROM report WHERE football_data_match AND NOT model_ready GROUP BY 1, 2, 3"""))
def _exclusions(spark, sf):
    return A.exclusion_counts(report(spark, sf), ["league", "season"])


@query("market_by_sample", with_ctes(*REPORT, body="""
, m AS (SELECT league, season, CASE WHEN model_ready THEN 'included' ELSE 'excluded' END AS sample, result_3way AS r,
 1/home_odds / (1/home_odds + 1/draw_odds + 1/away_odds) AS h, 1/draw_odds / (1/home_odds + 1/draw_odds + 1/away_odds) AS d, 1/away_odds / (1/home_odds + 1/draw_odds + 1/away_odds) AS a
 FROM report WHERE football_data_match AND score_matches_football_data AND closing_odds_available)
SELECT league, season, sample, count(*) AS matches, round(avg(-ln(CASE r WHEN 'H' THEN h WHEN 'D' THEN d ELSE a END)), 6) AS closing_market_log_loss,
 round(avg((h - CAST(r = 'H' AS INT))**2 + (d - CAST(r = 'D' AS INT))**2 + (a - CAST(r = 'A' AS INT))**2), 6) AS closing_market_brier, round(avg(greatest(h, d, a)), 6) AS average_market_confidence,
 round(avg(CAST(r = 'H' AS INT)), 6) AS outcome_home_rate, round(avg(CAST(r = 'D' AS INT)), 6) AS outcome_draw_rate, round(avg(CAST(r = 'A' AS INT)), 6) AS outcome_away_rate FROM m GROUP BY 1, 2, 3"""))
def _market(spark, sf):
    comparable = report(spark, sf).filter("football_data_match AND score_matches_football_data AND closing_odds_available")
    market = comparable.withColumn("m", S.devig("home_odds", "draw_odds", "away_odds", strict=False)).filter("m IS NOT NULL")
    split = market.select("league", "season", "result_3way", F.when(F.col("model_ready"), "included").otherwise("excluded").alias("sample"),
                          F.col("m.home").alias("ph"), F.col("m.draw").alias("pd"), F.col("m.away").alias("pa"))
    return rounded(A.market_by_sample(split, ["league", "season", "sample"], ("ph", "pd", "pa")))


_STEPS = ("football_data_match", "score_matches_football_data", "closing_odds_available", "player_data_available", "twenty_two_starters", "model_ready")


@query("sample_funnel", with_ctes(*REPORT, body=" UNION ALL ".join(
    f"""SELECT {k + 1} AS step, '{s}' AS "check", count(*) AS matches, round(count(*) / (SELECT count(*) FROM report WHERE football_data_match), 6) AS share_of_first FROM report WHERE {' AND '.join(_STEPS[:k + 1])}"""
    for k, s in enumerate(_STEPS))))
def _funnel(spark, sf):
    return rounded(A.funnel(report(spark, sf), _STEPS))


@query("pivot_rates", with_ctes(*REPORT, body="SELECT league, " + ", ".join(
    f"""round(avg(CAST(closing_odds_available AS INT)) FILTER (WHERE season = {y}), 6) AS "{y}" """ for y in range(1995, 2002)) + " FROM report GROUP BY league"))
def _pivot(spark, sf):
    return rounded(A.pivot_rates(report(spark, sf), "league", "season", range(1995, 2002), "closing_odds_available"))


@query("provider_audit", with_ctes(*REPORT, body="""
, c AS (SELECT k.league, k.season, count(*) AS fixtures, avg(CAST(o.join_key IS NOT NULL AS INT)) AS join_rate, avg(CAST(v.twenty_two_starters AS INT)) AS twenty_two_starters,
  avg(CAST(v.starter_identity_complete AS INT)) AS starter_identity_complete FROM keyed k JOIN validation v ON k.match_id = v.match_id LEFT JOIN provider o ON k.join_key = o.join_key GROUP BY 1, 2),
r AS (SELECT league, season, count(*) AS reference_fixtures FROM keyed WHERE join_key IN (SELECT join_key FROM provider) GROUP BY 1, 2)
SELECT league, season, fixtures, round(join_rate, 6) AS join_rate, round(twenty_two_starters, 6) AS twenty_two_starters, round(starter_identity_complete, 6) AS starter_identity_complete, reference_fixtures,
 round(fixtures / reference_fixtures, 6) AS fixture_coverage, join_rate >= CAST(0.98 AS DOUBLE) AS join_rate_pass, fixtures / reference_fixtures >= 0.95 AS fixture_coverage_pass,
 starter_identity_complete >= CAST(0.5 AS DOUBLE) AS starter_identity_complete_pass,
 join_rate >= CAST(0.98 AS DOUBLE) AND fixtures / reference_fixtures >= 0.95 AND starter_identity_complete >= CAST(0.5 AS DOUBLE) AS provisional_pass FROM c LEFT JOIN r USING (league, season)"""))
def _provider_audit(spark, sf):
    rows = report(spark, sf)
    reference = provider(spark, sf).select("join_key").join(keyed(spark, sf).select("join_key", "league", "season"), "join_key")
    return rounded(A.provider_audit(rows, reference, ["league", "season"], ["join_key"], ["twenty_two_starters", "starter_identity_complete"],
                                    {"join_rate": 0.98, "fixture_coverage": 0.95, "starter_identity_complete": 0.5}))
