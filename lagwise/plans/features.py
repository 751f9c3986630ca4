"""From fixtures and player appearances to one row per fixture with home, away and difference features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.functions.scalars import home_away_diff, team_side
from lagwise.operators import history as H
from lagwise.operators import lineup as L
from lagwise.operators import recurrence as R
from lagwise.operators.checks import check_dataset, finite_rules
from lagwise.operators.joins import attach_default, checked_join, merge_complete, pivot_sides
from lagwise.operators.ordering import find_frequent
from lagwise.session import cut_lineage, store
from lagwise.sources.tables import scratch_path

WINDOWS = (1, 3, 5)
FULL_WINDOW = 5
HALF_LIFE = 2.0
RATING_BASELINE = 6.5

# Features of the two team-level tables.
TEAM_STRENGTH_FEATURES = (
    "elo_rating", "opponent_elo_rating", "elo_difference", "elo_expected_result",
    "prior_team_matches", "attack_goal_rate_ewm", "defence_goal_rate_ewm", "expected_goals_strength",
)
LINEUP_FEATURES = (
    "retained_starters", "new_starters", "missing_regular_starters", "mean_pairwise_prior_starts",
    "mean_pairwise_prior_minutes", "new_player_pairs", "replacement_quality",
)


@dataclass(frozen=True)
class FormSpec:
    """Which appearance columns play which role.

    ``events`` are counts (null means none), ``recent`` the ones followed over several horizons and
    adjusted for the opponent, ``gated`` a nullable measure that is never filled.
    """

    events: Sequence[str] = ("goals", "assists", "shots", "key_passes", "saves", "defensive_actions")
    recent: Sequence[str] = ("shots", "key_passes", "defensive_actions")
    gated: str | None = "npxg"
    rating: str = "rating"
    rating_baseline: float = RATING_BASELINE
    order: Sequence[str] = ("kickoff", "match_id")
    positions: Mapping[str, str] = field(default_factory=lambda: {"gk": "G", "def": "D", "mid": "M", "fwd": "F"})
    lineup_size: int = 11

    @property
    def targets(self) -> dict[str, R.Target]:
        found = {s: R.Target(s) for s in self.recent}
        found["rating"] = R.Target(self.rating, per90=False, baseline=self.rating_baseline, nullable=True)
        return found


def team_strength(matches: DataFrame) -> DataFrame:
    """Ratings, rates, strength and earlier fixtures of every team before every fixture."""
    keys = ["league", "match_id", "team_side"]
    teams = find_frequent(R.team_rows(matches), ["league", "team"])
    rates = cut_lineage(R.goal_rates(matches, max_rows=teams))
    strength = R.expected_goals_strength(rates)
    prior = R.prior_matches(matches, max_rows=teams).select(*keys, "prior_team_matches")
    table = R.elo(matches).join(rates.select(*keys, "attack_goal_rate_ewm", "defence_goal_rate_ewm"), keys)
    return table.join(strength, keys).join(prior, keys)


def clean_appearances(appearances: DataFrame, spec: FormSpec) -> DataFrame:
    """Played appearances of known players, counts filled with zero, rating and the gated measure left as they are."""
    rows = appearances.filter(F.coalesce(F.col("played"), F.lit(False)) & F.col("player_id").isNotNull())
    return rows.fillna(0.0, ["minutes", *spec.events])


def player_form(appearances: DataFrame, strength: DataFrame, spec: FormSpec = FormSpec()) -> DataFrame:
    """Every appearance with its form before the kickoff: windows, horizons, trends and adjusted residuals.

    All bounded windows of one player share a single shuffle and sort.
    """
    ratings = strength.select("match_id", F.col("team").alias("team_id"), "elo_rating", "opponent_elo_rating")
    rows = clean_appearances(appearances, spec)
    players = find_frequent(rows, ["player_id"])
    kickoffs = find_frequent(rows.select("league", "kickoff").distinct(), ["league"])
    rows = attach_default(rows, ratings, ["match_id", "team_id"],
                          {"elo_rating": R.ELO_START, "opponent_elo_rating": R.ELO_START})
    rows = rows.withColumn("is_home", (F.col("team_id") == F.col("home_team")).cast("double"))
    rows = R.opponent_adjusted(rows, spec.targets, positions=tuple(sorted(spec.positions.values())), max_rows=kickoffs)
    per90 = lambda c: F.when(F.col("minutes") > 0, 90.0 * F.col(c) / F.col("minutes")).otherwise(0.0)
    rows = rows.withColumns({f"_rate_{s}": per90(s) for s in spec.recent})
    order = [*spec.order]
    ewm = {f"form_{s}_per90_ewm": f"_rate_{s}" for s in spec.recent}
    ewm["form_rating_ewm"] = spec.rating
    ewm.update({f"form_adjusted_{t}_ewm": f"adjusted_{t}" for t in spec.targets})
    rows = H.with_ewm(rows, ["player_id"], order, ewm, halflife=HALF_LIFE, complete=[n for n in ewm if n != "form_rating_ewm"], max_rows=players)

    features = [
        H.window_size(FULL_WINDOW, "form_window_appearances_5"), H.days_since_previous("kickoff", "days_since_previous_appearance"),
        H.prev_value("kickoff", "previous_appearance"), H.prev_sum("minutes", 5, "form_minutes_5"),
        H.prev_sum(F.col("started").cast("int"), 5, "form_starts_5"), H.prev_std(spec.rating, 5, "form_rating_std_5"),
    ]
    features += [H.prev_mean(spec.rating, k, f"form_rating_mean_{k}") for k in WINDOWS]
    features += [H.rate(e, "minutes", 5, f"form_{e}_per90_5") for e in spec.events]
    for s in spec.recent:
        features += [H.rate(s, "minutes", k, f"form_{s}_per90_{k}") for k in (1, 3)]
        features.append(H.trend(H.rate(s, "minutes", 1, ""), H.rate(s, "minutes", 5, ""), f"form_{s}_trend_1_5"))
    features.append(H.trend(H.prev_mean(spec.rating, 1, ""), H.prev_mean(spec.rating, 5, ""), "form_rating_trend_1_5"))
    if spec.gated:
        seen = F.when(F.col(spec.gated).isNotNull(), F.col("minutes"))
        features += [H.gated_rate(spec.gated, "minutes", 5, f"form_{spec.gated}_per90_5"), H.prev_count(spec.gated, 5, f"form_{spec.gated}_observations_5"),
                     H.prev_sum(seen, 5, f"form_{spec.gated}_minutes_5")]
    for t, target in spec.targets.items():
        column, product = f"adjusted_{t}", F.col(f"adjusted_{t}") * F.col("minutes")
        mean = (lambda k, n, c=product: H.rate(c, "minutes", k, n, per=1.0)) if target.per90 else (lambda k, n, c=column: H.prev_mean(c, k, n))
        features += [mean(k, f"form_adjusted_{t}_mean_{k}") for k in WINDOWS]
        features += [H.trend(mean(1, ""), mean(5, ""), f"form_adjusted_{t}_trend_1_5"), H.prev_std(column, 5, f"form_adjusted_{t}_std_5")]
    rows = H.with_history(rows, ["player_id"], order, features, prior_count="prior_appearances", max_rows=players)
    return rows.withColumn("has_prior_history", F.col("prior_appearances") > 0).drop(*[f"_rate_{s}" for s in spec.recent])


def target_starters(form: DataFrame, matches: DataFrame) -> DataFrame:
    """Starters of the target fixtures with their side."""
    starters = form.filter("started").join(matches.select("match_id"), "match_id", "left_semi")
    return starters.withColumn("team_side", team_side("team_id", "home_team", "away_team"))


def check_starters(starters: DataFrame, spec: FormSpec = FormSpec()) -> None:
    """Raise when a history rule is broken or a side has another number of starters than declared."""
    empty = ~F.col("has_prior_history")
    zero = ["form_window_appearances_5", "form_minutes_5", "form_starts_5", "form_rating_mean_5", *[f"form_{e}_per90_5" for e in spec.events]]
    rules = {f"first_{c}_is_zero": ~empty | (F.col(c) == 0) for c in zero}
    rules["window_within_history"] = F.col("form_window_appearances_5") <= F.least(F.col("prior_appearances"), F.lit(FULL_WINDOW))
    rules["gap_not_negative"] = F.col("days_since_previous_appearance") >= 0
    if spec.gated:
        rules["first_gated_is_unknown"] = ~empty | F.col(f"form_{spec.gated}_per90_5").isNull()
    check_dataset(starters, rules, ["match_id", "player_id"])
    sizes = starters.groupBy("match_id", "team_side").agg(F.count(F.lit(1)).alias("n"))
    wrong = sizes.filter(F.col("n") != spec.lineup_size).agg(F.count(F.lit(1))).first()[0]
    if wrong:
        raise ValueError(f"{wrong} match sides do not have exactly {spec.lineup_size} starters")


def side_features(starters: DataFrame, spec: FormSpec = FormSpec()) -> DataFrame:
    """Player-based features of every (fixture, side)."""
    means = {"rating_mean_5": "form_rating_mean_5"}
    for s in spec.recent:
        for h in ("1", "3", "ewm"):
            means[f"{s}_per90_lineup_mean_{h}"] = f"form_{s}_per90_{h}"
        means[f"{s}_per90_lineup_mean_trend_1_5"] = f"form_{s}_trend_1_5"
    means.update({f"rating_lineup_mean_{h}": f"form_rating_{c}" for h, c in (
        ("1", "mean_1"), ("3", "mean_3"), ("ewm", "ewm"), ("trend_1_5", "trend_1_5"), ("std_5", "std_5"))})
    for t in spec.targets:
        means.update({f"adjusted_{t}_lineup_mean_{h}": f"form_adjusted_{t}_{c}" for h, c in (
            ("1", "mean_1"), ("3", "mean_3"), ("5", "mean_5"), ("ewm", "ewm"), ("trend_1_5", "trend_1_5"), ("std_5", "std_5"))})
    deviations = {"rating_lineup_std_across_starters_5": "form_rating_mean_5"}
    deviations.update({f"adjusted_{t}_lineup_std_across_starters_5": f"form_adjusted_{t}_mean_5" for t in spec.targets})
    focus = {"gk": {"saves_per90_5": "form_saves_per90_5"}, "def": {"adjusted_defensive_actions_5": "form_adjusted_defensive_actions_mean_5"},
             "mid": {"adjusted_key_passes_5": "form_adjusted_key_passes_mean_5"}, "fwd": {"adjusted_shots_5": "form_adjusted_shots_mean_5"}}
    by_position = {label: (code, {"rating_mean_5": "form_rating_mean_5", **{n: c for n, c in focus.get(label, {}).items() if c in starters.columns}})
                   for label, code in spec.positions.items()}
    return L.aggregate_lineup(
        starters, ["match_id", "team_side"], means=means, deviations=deviations, by_position=by_position,
        sums={**{f"{s}_per90_sum_5": f"form_{s}_per90_5" for s in spec.recent}, "recent_minutes_sum_5": "form_minutes_5"},
        counts={"starters_without_history": ~F.col("has_prior_history"), "starters_without_full_window": F.col("form_window_appearances_5") < FULL_WINDOW},
        minima={"rating_lineup_min_5": "form_rating_mean_5"}, maxima={"rating_lineup_max_5": "form_rating_mean_5"}, top3={"rating_lineup_top3_mean_5": "form_rating_mean_5"})


def lineup_features(starters: DataFrame, spec: FormSpec = FormSpec()) -> DataFrame:
    """Continuity, familiarity and replacement quality of every (fixture, side)."""
    team, order = ["league", "team_id"], ["kickoff", "match_id"]
    rows = starters.select(*team, *order, "team_side", "player_id", "minutes", F.col("form_rating_mean_5").alias("quality"))
    fixtures = L.lineups(rows, team, order, quality="quality", max_size=max(spec.lineup_size, L.MAX_LINEUP))
    continuity = L.lineup_continuity(fixtures, team, order, usual=spec.lineup_size)
    members = rows.groupBy(*team, *order, "player_id").agg(F.max("minutes").alias("minutes"))
    pairs = L.pair_familiarity(members, team, order)
    sides = rows.select(*team, *order, "team_side").distinct()
    both = continuity.join(pairs, [*team, *order], "left").fillna(0, ["mean_pairwise_prior_starts", "mean_pairwise_prior_minutes", "new_player_pairs"])
    return both.join(sides, [*team, *order]).select("match_id", "team_side", *LINEUP_FEATURES)


def starter_columns(columns: Sequence[str]) -> list[str]:
    """Columns of the starters that side and line-up features and the checks of starters read."""
    base = ("league", "match_id", "kickoff", "team_id", "team_side", "player_id", "position", "minutes", "prior_appearances",
            "has_prior_history", "days_since_previous_appearance")
    return [c for c in columns if c in base or c.startswith("form_")]


def model_dataset(matches: DataFrame, appearances: DataFrame, spec: FormSpec = FormSpec(), *, strict: bool = True) -> DataFrame:
    """One row per fixture: its own columns, then home_, away_ and diff_ of every feature.

    A side without starters is an error if ``strict``; otherwise every fixture stays, with its team strength, and the
    player and line-up features of such a side (and their differences) are null.
    ``appearances`` carries league, match_id, kickoff, home_team, away_team, team_id, player_id, position,
    played, started, minutes and the measures of ``spec``.  All appearances feed the history; only
    starters of ``matches`` become rows.
    """
    strength = cut_lineage(team_strength(matches))
    starters = target_starters(player_form(appearances, strength, spec), matches)
    # rows of the widest table: only what is used below, in columns that are encoded and compressed
    starters = store(starters.select(*starter_columns(starters.columns)), scratch_path(matches.sparkSession, "starters"))
    if strict:
        check_starters(starters, spec)
    players = side_features(starters, spec)
    # a few numbers a side, read by several checks: its pairs are shuffled once
    lineup = store(lineup_features(starters, spec), scratch_path(matches.sparkSession, "lineups"))
    keys = ["match_id", "team_side"]
    teams = strength.select(*keys, *TEAM_STRENGTH_FEATURES)
    if strict:
        merged = merge_complete(players, [teams, lineup], keys)
    else:
        with_starters = merge_complete(players, [lineup], keys)
        merged = checked_join(teams, with_starters, keys, "left", "one_to_one")
    features = [*[c for c in players.columns if c not in keys], *TEAM_STRENGTH_FEATURES, *LINEUP_FEATURES]
    wide = pivot_sides(merged.select(*keys, *features), ["match_id"], "team_side", features)
    sided = [f"{s}_{f}" for s in ("home", "away") for f in features]
    # the checks and the caller read one row per fixture; the wide rows are shuffled once for all of them
    joined = matches.join(wide, "match_id", "left").select(*matches.columns, *sided)
    joined = store(joined, scratch_path(matches.sparkSession, "fixtures"))
    result = joined.select(*matches.columns, *sided, *home_away_diff(features))
    rules = finite_rules(sided)
    if not strict:
        rules = {f"{c}_finite": F.col(c).isNull() | rules[f"{c}_finite"] for c in sided}
    check_dataset(result, rules, ["match_id"])
    return result
