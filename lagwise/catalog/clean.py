"""Projections, predicates and scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.catalog.registry import query, r6, with_ctes
from lagwise.functions import scalars as S
from lagwise.operators.checks import check_dataset, match_rules, violation_counts
from lagwise.plans.tables import MATCHES, PLAYERS, matches, players, read


@query("parse_bool", """
SELECT o_orderkey, coalesce(lower(o_orderstatus) IN ('true', '1', 'yes'), false) AS status_flag,
       coalesce(lower(CAST(o_orderkey % 3 AS VARCHAR)) IN ('true', '1', 'yes'), false) AS digit_flag FROM orders""")
def _parse_bool(spark, sf):
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", S.parse_bool("o_orderstatus").alias("status_flag"),
                    S.parse_bool((F.col("o_orderkey") % 3).cast("string")).alias("digit_flag"))


@query("to_number", """
SELECT o_orderkey, try_cast(trim(split_part(o_orderpriority, '-', 1)) AS DOUBLE) AS leading,
       try_cast(trim(split_part(o_orderpriority, '-', 2)) AS DOUBLE) AS trailing FROM orders""")
def _to_number(spark, sf):
    part = lambda n: F.split_part("o_orderpriority", F.lit("-"), F.lit(n))
    return read(spark, sf, "orders").select(
        "o_orderkey", S.to_number(part(1), "raise").alias("leading"), S.to_number(part(2)).alias("trailing"))


@query("iso_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _iso_date(spark, sf):
    return read(spark, sf, "events").select("event_id", S.iso_date("ts").alias("day"))


@query("parse_day", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def _parse_day(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "dd/MM/yy"))
    return read(spark, sf, "orders").select("o_orderkey", S.parse_day(text).cast("string").alias("day"))


@query("normalize_name", r"""
SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')),
       '\b(fc|cf|sc|afc|fk|sk)\b', '', 'g'), '[^a-z0-9]', '', 'g') AS name FROM documents""")
def _normalize_name(spark, sf):
    return read(spark, sf, "documents").select("doc_id", S.normalize_name("text").alias("name"))


@query("match_key", """
SELECT c_custkey, concat_ws('|', CAST(c_nationkey AS VARCHAR), c_mktsegment,
       CASE regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') WHEN 'china' THEN 'prc'
            ELSE regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') END,
       regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g')) AS join_key
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _match_key(spark, sf):
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", S.match_key("c_nationkey", "c_mktsegment", "n_name", "c_name", {"china": "prc"}).alias("join_key"))


@query("result_3way", with_ctes(MATCHES, PLAYERS, body="""
SELECT match_id, CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS result_3way,
       CASE WHEN home_score = 3 THEN NULL WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS partial_result
FROM matches"""))
def _result(spark, sf):
    m = matches(spark, sf)
    partial = F.when(F.col("home_score") != 3, F.col("home_score"))
    return m.select("match_id", S.result_3way("home_score", "away_score").alias("result_3way"),
                    S.result_3way(partial, "away_score").alias("partial_result"))


@query("devig_strict", with_ctes(MATCHES, body="""
SELECT match_id, round(1/home_odds + 1/draw_odds + 1/away_odds, 6) AS overround,
       round(1/home_odds / (1/home_odds + 1/draw_odds + 1/away_odds), 6) AS p_home,
       round(1/draw_odds / (1/home_odds + 1/draw_odds + 1/away_odds), 6) AS p_draw,
       round(1/away_odds / (1/home_odds + 1/draw_odds + 1/away_odds), 6) AS p_away FROM matches"""))
def _devig(spark, sf):
    d = S.devig("home_odds", "draw_odds", "away_odds")
    return matches(spark, sf).select("match_id", r6(d["overround"], "overround"), r6(d["home"], "p_home"),
                                     r6(d["draw"], "p_draw"), r6(d["away"], "p_away"))


@query("devig_lenient", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       round(1/l_quantity / (1/l_quantity + 1/(l_discount*100) + 1/(l_tax*100)), 6) AS p_first
FROM lineitem WHERE l_quantity > 1 AND l_discount*100 > 1 AND l_tax*100 > 1""")
def _devig_lenient(spark, sf):
    lines = read(spark, sf, "lineitem").withColumn("d", F.col("l_discount") * 100).withColumn("t", F.col("l_tax") * 100)
    return lines.withColumn("market", S.devig("l_quantity", "d", "t", strict=False)).filter("market IS NOT NULL").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", r6("market.home", "p_first"))


@query("log_odds_vs_draw", with_ctes(MATCHES, body="""
SELECT match_id, round(ln((1/home_odds)/(1/draw_odds)), 6) AS log_home, round(ln((1/away_odds)/(1/draw_odds)), 6) AS log_away FROM matches"""))
def _log_odds(spark, sf):
    one = F.lit(1.0)
    home, away = S.log_odds_vs_draw(one / F.col("home_odds"), one / F.col("draw_odds"), one / F.col("away_odds"))
    return matches(spark, sf).select("match_id", r6(home, "log_home"), r6(away, "log_away"))


_LEAGUES = ("scotland", "belgium", "netherlands", "turkey", "portugal")


@query("competition_phase", """
WITH f AS (SELECT o_orderkey, ['scotland', 'belgium', 'netherlands', 'turkey', 'portugal'][1 + n_regionkey] AS league,
  ['2020-21', '2021-22', '2022-23', '2023-24', '2024-25', '2025-26', '2025-26'][year(o_orderdate) - 1994] AS season,
  week(o_orderdate) AS matchday, CASE WHEN o_orderpriority = '1-URGENT' THEN ' Championship Round' END AS stage
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT o_orderkey, CASE
  WHEN stage IS NOT NULL THEN CASE WHEN league = 'scotland' THEN 'post_split' ELSE 'playoffs' END
  WHEN league = 'scotland' THEN CASE WHEN matchday <= 33 THEN 'regular_season' ELSE 'post_split' END
  WHEN league = 'belgium' THEN CASE WHEN matchday <= CASE WHEN season < '2023-24' THEN 34 ELSE 30 END THEN 'regular_season' ELSE 'playoffs' END
  WHEN league = 'turkey' THEN 'regular_season'
  WHEN matchday <= 34 THEN 'regular_season' ELSE 'playoffs' END AS phase FROM f""")
def _phase(spark, sf):
    seasons = ("2020-21", "2021-22", "2022-23", "2023-24", "2024-25", "2025-26", "2025-26")
    names = F.array(*[F.lit(v) for v in _LEAGUES])
    years = F.array(*[F.lit(v) for v in seasons])
    m = matches(spark, sf).join(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), F.col("match_id") == F.col("o_orderkey"))
    stage = F.when(F.col("o_orderpriority") == "1-URGENT", " Championship Round")
    return m.select("o_orderkey", S.competition_phase(
        names[F.col("league")], years[F.col("season") - 1995], F.weekofyear("kickoff"), stage).alias("phase"))


_CHECKED = """checked AS (SELECT match_id, season, home_score > 0 AS completed_match, away_score < 2 AS football_data_match,
  CASE WHEN home_score = 3 THEN NULL ELSE home_odds > 2 END AS closing_odds_available FROM matches)"""


def _checked(spark, sf):
    return matches(spark, sf).select(
        "match_id", "season", (F.col("home_score") > 0).alias("completed_match"), (F.col("away_score") < 2).alias("football_data_match"),
        F.when(F.col("home_score") != 3, F.col("home_odds") > 2).alias("closing_odds_available"))


_THREE = ("completed_match", "football_data_match", "closing_odds_available")


@query("meets_all", with_ctes(MATCHES, _CHECKED, body="""
SELECT match_id, completed_match AND football_data_match AND coalesce(closing_odds_available, false) AS model_ready FROM checked"""))
def _meets_all(spark, sf):
    return _checked(spark, sf).select("match_id", S.meets_all(_THREE).alias("model_ready"))


@query("exclusion_reason", with_ctes(MATCHES, _CHECKED, body="""
SELECT match_id, CASE WHEN NOT football_data_match THEN 'not_top_division_match' WHEN NOT completed_match THEN 'match_not_completed'
  WHEN NOT coalesce(closing_odds_available, false) THEN 'missing_closing_odds' END AS exclusion_reason,
  concat_ws('|', CASE WHEN NOT completed_match THEN 'completed_match' END, CASE WHEN NOT football_data_match THEN 'football_data_match' END,
    CASE WHEN NOT coalesce(closing_odds_available, false) THEN 'closing_odds_available' END) AS failed_match_checks FROM checked"""))
def _exclusion(spark, sf):
    priority = {c: S.EXCLUSION_PRIORITY[c] for c in ("football_data_match", "completed_match", "closing_odds_available")}
    return _checked(spark, sf).select(
        "match_id", S.exclusion_reason(priority).alias("exclusion_reason"), S.failed_checks(_THREE).alias("failed_match_checks"))


@query("consistency_error", with_ctes(MATCHES, _CHECKED, body="""
, v AS (SELECT match_id, completed_match AND football_data_match AND coalesce(closing_odds_available, false) AS holds,
  CASE WHEN match_id % 11 = 0 THEN match_id % 2 = 0 ELSE completed_match AND football_data_match AND coalesce(closing_odds_available, false) END AS model_ready,
  CASE WHEN match_id % 7 = 0 THEN NULL WHEN match_id % 5 = 0 THEN 'other' WHEN NOT (completed_match AND football_data_match AND coalesce(closing_odds_available, false)) THEN 'match_not_completed' END AS exclusion_reason FROM checked)
SELECT match_id, CASE WHEN model_ready AND NOT holds THEN 'ready_with_failed_check' WHEN model_ready <> holds THEN 'verdict_disagrees'
  WHEN NOT model_ready AND exclusion_reason IS NULL THEN 'excluded_without_reason' WHEN model_ready AND exclusion_reason IS NOT NULL THEN 'ready_with_reason'
  WHEN exclusion_reason = 'other' THEN 'undeclared_reason' END AS error FROM v"""))
def _consistency(spark, sf):
    """Verdicts and reasons supplied with the rows, some of them wrong, against the checks."""
    holds, key = S.meets_all(_THREE), F.col("match_id")
    supplied = _checked(spark, sf).select(
        "*", F.when(key % 11 == 0, key % 2 == 0).otherwise(holds).alias("model_ready"),
        F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, "other").when(~holds, "match_not_completed").alias("exclusion_reason"))
    return supplied.select("match_id", S.consistency_error(_THREE, list(S.EXCLUSION_PRIORITY.values())).alias("error"))


@query("season_labels", """
SELECT DISTINCT year(o_orderdate) AS start_year, concat(year(o_orderdate), '-', lpad(CAST((year(o_orderdate)+1) % 100 AS VARCHAR), 2, '0')) AS label,
 concat(lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0'), lpad(CAST((year(o_orderdate)+1) % 100 AS VARCHAR), 2, '0')) AS code FROM orders""")
def _labels(spark, sf):
    years = read(spark, sf, "orders").select(F.year("o_orderdate").cast("bigint").alias("start_year")).distinct()
    return years.select("start_year", S.season_label("start_year").alias("label"), S.season_code("start_year").alias("code"))


@query("qualify_ids", with_ctes(MATCHES, body="""
SELECT concat_ws(':', CAST(league AS VARCHAR), CAST(match_id AS VARCHAR)) AS match_id, CAST(match_id AS VARCHAR) AS source_match_id FROM matches"""))
def _qualify(spark, sf):
    return matches(spark, sf).select(S.qualify_id("league", "match_id").alias("match_id"), F.col("match_id").cast("string").alias("source_match_id"))


@query("home_away_diff", with_ctes(MATCHES, body="""
SELECT match_id, home_score - away_score AS diff_score, round(home_odds - away_odds, 6) AS diff_odds FROM matches"""))
def _diff(spark, sf):
    d = matches(spark, sf).select("match_id", *S.home_away_diff(["score", "odds"]))
    return d.select("match_id", "diff_score", r6("diff_odds"))


@query("group_indicators", with_ctes(MATCHES, body="""
SELECT match_id, CAST(league = 1 AS DOUBLE) AS effect_1, CAST(league = 2 AS DOUBLE) AS effect_2,
       CAST(league = 3 AS DOUBLE) AS effect_3, CAST(league = 4 AS DOUBLE) AS effect_4 FROM matches"""))
def _indicators(spark, sf):
    regions = [r[0] for r in read(spark, sf, "region").select("r_regionkey").collect()]
    return matches(spark, sf).select("match_id", *S.group_indicators("league", regions, "effect_"))


@query("benchmark_label", with_ctes(MATCHES, body="""
SELECT match_id, CASE WHEN home_team = 0 THEN 'baseline' WHEN home_odds/away_odds - 1 < 0 THEN 'outperforms_market'
  WHEN home_odds/away_odds - 1 <= CAST(0.01 AS DOUBLE) THEN 'within_1_percent' WHEN home_odds/away_odds - 1 <= CAST(0.02 AS DOUBLE) THEN 'within_2_percent'
  ELSE 'worse_by_more_than_2_percent' END AS label FROM matches"""))
def _benchmark(spark, sf):
    relative = F.col("home_odds") / F.col("away_odds") - F.lit(1.0)
    return matches(spark, sf).select("match_id", S.benchmark_label(F.col("home_team").cast("string"), relative, "0").alias("label"))


@query("predicted_class", with_ctes(MATCHES, body="""
SELECT match_id, CASE WHEN 1/home_odds >= 1/draw_odds AND 1/home_odds >= 1/away_odds THEN 'H' WHEN 1/draw_odds >= 1/away_odds THEN 'D' ELSE 'A' END AS predicted_result FROM matches"""))
def _predicted(spark, sf):
    inv = [F.lit(1.0) / F.col(c) for c in ("home_odds", "draw_odds", "away_odds")]
    return matches(spark, sf).select("match_id", S.predicted_class(*inv).alias("predicted_result"))


@query("team_side", with_ctes(MATCHES, PLAYERS, body="""
SELECT p.match_id, p.team_id, CASE WHEN p.team_id = m.home_team THEN 'home' ELSE 'away' END AS team_side, count(*) AS player_rows
FROM players p JOIN matches m ON p.match_id = m.match_id WHERE p.team_id IN (m.home_team, m.away_team) GROUP BY 1, 2, 3"""))
def _side(spark, sf):
    p = players(spark, sf).select("match_id", "team_id")
    m = matches(spark, sf).select("match_id", "home_team", "away_team")
    known = p.join(m, "match_id").filter("team_id IN (home_team, away_team)")
    return known.groupBy("match_id", "team_id", S.team_side("team_id", "home_team", "away_team").alias("team_side")).agg(
        F.count(F.lit(1)).alias("player_rows"))


@query("check_dataset", with_ctes(MATCHES, body="""
SELECT count(*) AS rows, count(*) FILTER (WHERE NOT (home_score >= 0 AND home_score = floor(home_score))) AS home_score_is_count,
 count(*) FILTER (WHERE NOT (away_score >= 0 AND away_score = floor(away_score))) AS away_score_is_count, 0::BIGINT AS result_known, 0::BIGINT AS probabilities_positive,
 count(*) FILTER (WHERE abs(1/home_odds/(1/home_odds+1/draw_odds+1/away_odds) + 1/draw_odds/(1/home_odds+1/draw_odds+1/away_odds)
   + 1/away_odds/(1/home_odds+1/draw_odds+1/away_odds) - 1) > CAST(1e-10 AS DOUBLE)) AS probabilities_sum_to_one,
 count(*) FILTER (WHERE home_team = away_team) AS sides_differ, count(*) FILTER (WHERE home_odds <= 2) AS price_above_two FROM matches"""))
def _checks(spark, sf):
    d = S.devig("home_odds", "draw_odds", "away_odds")
    m = matches(spark, sf).withColumn("d", d).withColumn("r", S.result_3way("home_score", "away_score"))
    rules = match_rules("d.home", "d.draw", "d.away", ["home_score", "away_score"], "r")
    rules["sides_differ"] = F.col("home_team") != F.col("away_team")
    check_dataset(m, rules, ["match_id"])
    return violation_counts(m, {**rules, "price_above_two": F.col("home_odds") > 2})


@query("match_week", with_ctes(MATCHES, body="""
SELECT match_id, concat(CAST(e - 6 AS VARCHAR), '/', CAST(e AS VARCHAR)) AS match_week FROM (
 SELECT match_id, CAST(kickoff AS DATE) + CAST((8 - isodow(kickoff)) % 7 AS INT) AS e FROM matches)"""))
def _week(spark, sf):
    return matches(spark, sf).select("match_id", S.match_week("kickoff").alias("match_week"))
