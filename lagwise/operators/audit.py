"""Reconciliation of two providers and the coverage reports that explain every exclusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.scores import brier, log_loss
from lagwise.operators.joins import attach_summary, checked_join

RESULTS = ("H", "D", "A")


def count_true(condition: Column) -> Column:
    """Number of rows where the condition holds, null counting as false."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def safe_rate(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """Ratio with a fixed value for an empty denominator."""
    value = F.when(denominator != 0, numerator / denominator)
    return value if empty is None else F.coalesce(value, F.lit(empty))


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose non-null key occurs more than once (counted before the join, so a hot key is cheap)."""
    identified = df.dropna(subset=list(keys))
    repeated = identified.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return identified.join(repeated, list(keys), "left_semi")


def player_summary(players: DataFrame, match: str = "match_id", player: str = "player_id") -> DataFrame:
    """Per match: rows, ids, distinct ids, played, starters, starters with id and with minutes."""
    started = F.col("started")
    return players.groupBy(match).agg(
        F.count(F.lit(1)).alias("player_rows"), F.count(player).alias("players_with_id"),
        F.countDistinct(player).alias("unique_player_ids"), count_true(F.col("played")).alias("played_players"),
        count_true(started).alias("starters"), count_true(started & F.col(player).isNotNull()).alias("starters_with_id"),
        count_true(started & F.col("minutes").isNotNull()).alias("starters_with_minutes"),
    )


def side_checks(matches: DataFrame, players: DataFrame, side_size: int = 11, match: str = "match_id") -> DataFrame:
    """Per match the starters of each side and the four line-up checks."""
    m = matches.select(match, "home_team", "away_team")
    joined = players.select(match, "team_id", "player_id", "started", "minutes").join(m, match)
    team = F.col("team_id")
    ours = team.isin(F.col("home_team"), F.col("away_team"))
    per = joined.groupBy(match).agg(
        count_true(F.col("started") & (team == F.col("home_team"))).alias("home_starters"),
        count_true(F.col("started") & (team == F.col("away_team"))).alias("away_starters"),
        count_true(F.col("started")).alias("_starters"),
        count_true(F.col("started") & F.col("player_id").isNotNull()).alias("_ids"),
        count_true(F.col("started") & F.col("minutes").isNotNull()).alias("_minutes"),
        F.coalesce(F.min(ours), F.lit(False)).alias("player_team_ids_valid"),
    )
    some = F.col("_starters") > 0
    return per.select(
        match, "home_starters", "away_starters",
        ((F.col("home_starters") == side_size) & (F.col("away_starters") == side_size)).alias("twenty_two_starters"),
        (some & (F.col("_ids") == F.col("_starters"))).alias("starter_identity_complete"),
        (some & (F.col("_minutes") == F.col("_starters"))).alias("starter_minutes_complete"),
        "player_team_ids_valid",
    )


def set_subset_check(df: DataFrame, keys: Sequence[str], value: str, allowed: Sequence[str]) -> DataFrame:
    """Per key whether the observed values are a non-empty subset of the allowed columns."""
    inside = F.min(F.col(value).isin(*[F.col(a) for a in allowed]))
    return df.groupBy(*keys).agg(F.coalesce(inside, F.lit(False)).alias("valid"))


def match_validation(matches: DataFrame, odds: DataFrame, players: DataFrame, side_size: int = 11) -> DataFrame:
    """One row per fixture with the nine inclusion checks and ``model_ready``.

    ``matches`` and ``odds`` share ``join_key``; the odds side is joined one to one.
    """
    report = checked_join(matches, odds, ["join_key"], "left", "one_to_one")
    linked = F.col("full_time_home").isNotNull()
    prices = [F.col(c) > 1.0 for c in ("home_odds", "draw_odds", "away_odds")]
    agreed = (F.col("home_score") == F.col("full_time_home")) & (F.col("away_score") == F.col("full_time_away"))
    no = F.lit(False)
    report = report.withColumns({
        "completed_match": F.coalesce(F.lower("status") == "finished", no),
        "football_data_match": linked,
        "closing_odds_available": F.coalesce(F.col("odds_is_closing") & prices[0] & prices[1] & prices[2], no),
        "score_matches_football_data": linked & F.coalesce(agreed, no),
    })
    report = attach_summary(report, player_summary(players), ["match_id"])
    report = report.join(side_checks(matches, players, side_size), "match_id", "left").fillna(0, ["home_starters", "away_starters"])
    flags = ("twenty_two_starters", "starter_identity_complete", "starter_minutes_complete", "player_team_ids_valid")
    report = report.withColumns({f: F.coalesce(F.col(f), no) for f in flags})
    return report.withColumn("player_data_available", F.col("player_rows") > 0)


def season_coverage(report: DataFrame, players: DataFrame, duplicates: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Counts, rates and threshold flags per season."""
    linked = F.col("football_data_match")
    per = report.groupBy("season").agg(
        F.count(F.lit(1)).alias("matches"), count_true(linked).alias("linked_matches"), count_true(~linked).alias("unmatched_matches"),
        *[count_true(linked & F.col(c)).alias(n) for n, c in (
            ("with_player_data", "player_data_available"), ("with_full_lineups", "twenty_two_starters"),
            ("with_valid_team_ids", "player_team_ids_valid"), ("with_closing_odds", "closing_odds_available"),
            ("score_agreements", "score_matches_football_data"), ("model_ready_matches", "model_ready"))],
    )
    eligible = players.join(report.filter(linked).select("match_id"), "match_id", "left_semi").filter("started")
    starters = eligible.groupBy("season").agg(
        F.count(F.lit(1)).alias("starter_rows"), F.count("player_id").alias("starters_with_id"), F.count("minutes").alias("starters_with_minutes"))
    repeats = duplicates.groupBy("season").agg(F.count(F.lit(1)).alias("duplicate_rows"))
    wide = attach_summary(attach_summary(per, starters, ["season"]), repeats, ["season"])
    rates = {
        "player_match_coverage": safe_rate(F.col("with_player_data"), F.col("linked_matches")),
        "lineup_coverage": safe_rate(F.col("with_full_lineups"), F.col("linked_matches")),
        "starter_identity_coverage": safe_rate(F.col("starters_with_id"), F.col("starter_rows")),
        "starter_minutes_coverage": safe_rate(F.col("starters_with_minutes"), F.col("starter_rows")),
        "model_ready_coverage": safe_rate(F.col("model_ready_matches"), F.col("linked_matches")),
    }
    wide = wide.withColumns(rates)
    return wide.withColumns({f"{name}_pass": F.col(name) >= limit for name, limit in thresholds.items()})


def field_coverage(df: DataFrame, group: str, cohorts: Mapping[str, Column], fields: Sequence[str]) -> DataFrame:
    """Per (group, cohort, field): rows, populated, nonzero, their rates, mean and sample deviation.

    One aggregation per (group, cohort) over all fields, unpivoted afterwards: rows are not multiplied by fields.
    """
    members = F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in cohorts.items()]), lambda v: v.isNotNull()))
    stats = []
    for f in fields:
        value = F.col(f)
        stats += [F.struct(
            F.lit(f).alias("field"), F.count(value).alias("populated_rows"), count_true(value != 0).alias("nonzero_rows"),
            F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))]
    long = df.select(group, members.alias("cohort"), *fields).groupBy(group, "cohort").agg(
        F.count(F.lit(1)).alias("rows"), F.array(*stats).alias("_s"))
    rows = long.select(group, "cohort", "rows", F.inline("_s"))
    return rows.withColumns({
        "coverage": safe_rate(F.col("populated_rows"), F.col("rows")),
        "nonzero_rate": safe_rate(F.col("nonzero_rows"), F.col("rows")),
    })


def two_level_usability(df: DataFrame, season: str, match: str, team: str, field: str, minimum: float = 0.9, sides: int = 2) -> DataFrame:
    """Share of matches per season in which both teams have the field for enough players."""
    teams = df.groupBy(season, match, team).agg((F.count(field) / F.count(F.lit(1)) >= minimum).alias("usable"))
    fixtures = teams.groupBy(season, match).agg((F.min("usable") & (F.count(F.lit(1)) == sides)).alias("usable"))
    return fixtures.groupBy(season).agg(F.avg(F.col("usable").cast("double")).alias("usable_match_coverage"))


def coverage_collapse(df: DataFrame, season: str, coverage: str, minimum: float = 0.9, drop: float = 0.2) -> DataFrame:
    """Change from the season before, and the two warning flags (one row per season)."""
    change = F.lag(coverage).over(Window.orderBy(season)) - F.col(coverage)
    return df.select(
        season, coverage, change.alias("coverage_drop"), (F.col(coverage) < minimum).alias("low_coverage"),
        F.coalesce(change > drop, F.lit(False)).alias("collapsed"))


def grouped_coverage(report: DataFrame, keys: Sequence[str], result: str = "result_3way") -> DataFrame:
    """Target and retained matches with their outcome rates, at any key list."""
    target, ready = F.col("football_data_match"), F.col("football_data_match") & F.col("model_ready")

    def rates(prefix: str, rows: Column) -> list[Column]:
        known = count_true(rows & F.col(result).isin(*RESULTS))
        return [safe_rate(count_true(rows & (F.col(result) == r)), known, None).alias(f"{prefix}_{n}_rate")
                for n, r in zip(("home", "draw", "away"), RESULTS)]

    return report.groupBy(*keys).agg(
        count_true(target).alias("target_matches"), count_true(ready).alias("model_ready_matches"),
        (count_true(target) - count_true(ready)).alias("excluded_matches"),
        safe_rate(count_true(ready), count_true(target), None).alias("retention_rate"),
        *rates("target", target), *rates("included", ready))


def exclusion_counts(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Excluded target matches by reason."""
    out = report.filter(F.col("football_data_match") & ~F.col("model_ready"))
    return out.groupBy(*keys, "exclusion_reason").agg(F.count(F.lit(1)).alias("matches"))


def market_by_sample(df: DataFrame, keys: Sequence[str], probs: Sequence[str], result: str = "result_3way") -> DataFrame:
    """Market log loss, Brier score, confidence and outcome rates of any sample split."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), F.avg(log_loss(result, probs, 1e-15)).alias("closing_market_log_loss"),
        F.avg(brier(result, probs)).alias("closing_market_brier"), F.avg(F.greatest(*probs)).alias("average_market_confidence"),
        *[F.avg((F.col(result) == r).cast("double")).alias(f"outcome_{n}_rate") for n, r in zip(("home", "draw", "away"), RESULTS)])


def funnel(df: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Rows that pass the first k checks, for every k, from one aggregation."""
    holds = [reduce(lambda a, b: a & b, [F.coalesce(F.col(s), F.lit(False)) for s in steps[: k + 1]]) for k in range(len(steps))]
    counts = df.agg(*[F.count_if(h).alias(f"c{k}") for k, h in enumerate(holds)])
    rows = F.array(*[F.struct(F.lit(k + 1).alias("step"), F.lit(s).alias("check"), F.col(f"c{k}").alias("matches"), (F.col(f"c{k}") / F.col("c0")).alias("share_of_first")) for k, s in enumerate(steps)])
    return counts.select(F.inline(rows))


def pivot_rates(df: DataFrame, row: str, column: str, values: Sequence, flag: str) -> DataFrame:
    """Rows by columns of a rate; the pivot values are given, so no extra pass finds them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(F.col(flag).cast("double")))


def provider_audit(fixtures: DataFrame, reference: DataFrame, keys: Sequence[str], join: Sequence[str], flags: Sequence[str], thresholds: Mapping[str, float]) -> DataFrame:
    """Per key: fixture coverage against the other provider, join rate, flag rates and threshold results."""
    ours = fixtures.join(reference.select(*join).distinct().withColumn("_hit", F.lit(1)), list(join), "left")
    per = ours.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fixtures"), F.avg(F.col("_hit").isNotNull().cast("double")).alias("join_rate"),
        *[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
    theirs = reference.groupBy(*keys).agg(F.count(F.lit(1)).alias("reference_fixtures"))
    wide = per.join(theirs, list(keys), "left").withColumn("fixture_coverage", safe_rate(F.col("fixtures"), F.col("reference_fixtures"), None))
    wide = wide.withColumns({f"{n}_pass": F.coalesce(F.col(n) >= t, F.lit(False)) for n, t in thresholds.items()})
    return wide.withColumn("provisional_pass", reduce(lambda a, b: a & b, [F.col(f"{n}_pass") for n in thresholds]))
