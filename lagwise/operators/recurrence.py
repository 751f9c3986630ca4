"""Histories with state: ratings, scoring rates and expanding ridge residuals.

"Before" always means a strictly earlier kickoff: fixtures that start together see the same state.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.history import with_ewm
from lagwise.operators.ordering import HOT_ROWS, Limit, find_frequent, key_join, row_numbers, running_totals, small_join, split_frequent
from lagwise.session import compiled_methods, store
from lagwise.sources.tables import scratch_path

# Fixed values of the rating and rate definitions.
ELO_START = 1500.0
ELO_HOME = 60.0
ELO_K = 20.0
RATE_START = 1.35
RATE_ALPHA = 0.20
HOME_RATE_FACTOR = 1.10
RATE_BOUNDS = (0.15, 4.0)
RIDGE_STRENGTH = 25.0


def team_rows(matches: DataFrame, *carry: str) -> DataFrame:
    """Each fixture as a home and an away row (team, opponent, goals for and against)."""

    def side(name: str, other: str) -> Column:
        return F.struct(
            F.lit(name).alias("team_side"), F.col(f"{name}_team").alias("team"), F.col(f"{other}_team").alias("opponent"),
            F.col(f"{name}_score").alias("scored"), F.col(f"{other}_score").alias("conceded"))

    return matches.select("league", "kickoff", "match_id", *carry, F.inline(F.array(side("home", "away"), side("away", "home"))))


def before_batch(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], columns: Sequence[str], *, max_rows: Limit = HOT_ROWS) -> DataFrame:
    """Give every row of a (key, time) batch the value its first row has."""
    batch = [*keys, time]
    ordinary, frequent = split_frequent(df, batch, max_rows)
    first = Window.partitionBy(*batch).orderBy(*order)
    rest = [c for c in df.columns if c not in columns]
    result = ordinary.select(*rest, *[F.first(c).over(first).alias(c) for c in columns])
    if frequent is None:
        return result
    rank = F.struct(*order)
    heads = frequent.groupBy(*batch).agg(*[F.min_by(c, rank).alias(c) for c in columns])
    return result.unionByName(key_join(frequent.drop(*columns), heads, batch, "inner").select(*rest, *columns))


def goal_rates(matches: DataFrame, *, max_rows: Limit = HOT_ROWS) -> DataFrame:
    """Per team and fixture: exponentially weighted scoring and conceding rates before the kickoff."""
    rows = team_rows(matches)
    teams = find_frequent(rows, ["league", "team"], max_rows)
    rated = with_ewm(rows, ["league", "team"], ["kickoff", "match_id", "team_side"],
                     {"attack_goal_rate_ewm": "scored", "defence_goal_rate_ewm": "conceded"},
                     halflife=None, alpha=RATE_ALPHA, initial=RATE_START,
                     complete=["attack_goal_rate_ewm", "defence_goal_rate_ewm"], max_rows=teams)
    # a batch is never larger than its team
    return before_batch(rated, ["league", "team"], "kickoff", ["match_id", "team_side"],
                        ["attack_goal_rate_ewm", "defence_goal_rate_ewm"], max_rows=HOT_ROWS if teams else None)


def expected_goals_strength(rates: DataFrame) -> DataFrame:
    """attack x opponent's defence / baseline, times the home factor, kept inside the bounds."""
    sides = rates.groupBy("league", "kickoff", "match_id").agg(*[
        F.max(F.when(F.col("team_side") == s, F.col(f"{v}_goal_rate_ewm"))).alias(f"{s}_{v}")
        for s in ("home", "away") for v in ("attack", "defence")])
    low, high = [F.lit(b) for b in RATE_BOUNDS]
    home = F.lit(HOME_RATE_FACTOR) * F.col("home_attack") * F.col("away_defence") / F.lit(RATE_START)
    away = F.col("away_attack") * F.col("home_defence") / F.lit(RATE_START)
    both = F.array(*[
        F.struct(F.lit(n).alias("team_side"), F.least(F.greatest(v, low), high).alias("expected_goals_strength"))
        for n, v in (("home", home), ("away", away))])
    return sides.select("league", "match_id", F.inline(both))


def prior_matches(matches: DataFrame, *, max_rows: Limit = HOT_ROWS) -> DataFrame:
    """Per team and fixture the number of its fixtures at earlier kickoffs."""
    rows = team_rows(matches)
    teams = find_frequent(rows, ["league", "team"], max_rows)
    rows = row_numbers(rows, ["league", "team"], [F.col("kickoff"), F.col("match_id"), F.col("team_side")], "prior_team_matches", max_rows=teams)
    rows = rows.withColumn("prior_team_matches", F.col("prior_team_matches") - 1)
    return before_batch(rows, ["league", "team"], "kickoff", ["match_id", "team_side"], ["prior_team_matches"], max_rows=HOT_ROWS if teams else None)


def _elo_columns(home_rating: Column, away_rating: Column) -> list[Column]:
    expectation = 1 / (1 + F.pow(F.lit(10.0), -(home_rating + ELO_HOME - away_rating) / 400))
    both = F.array(
        F.struct(F.lit("home").alias("team_side"), F.col("home_team").alias("team"), home_rating.alias("elo_rating"),
                 away_rating.alias("opponent_elo_rating"), (home_rating - away_rating).alias("elo_difference"), expectation.alias("elo_expected_result")),
        F.struct(F.lit("away").alias("team_side"), F.col("away_team").alias("team"), away_rating.alias("elo_rating"),
                 home_rating.alias("opponent_elo_rating"), (away_rating - home_rating).alias("elo_difference"), (1 - expectation).alias("elo_expected_result")))
    return [F.inline(both)]


def elo(matches: DataFrame, *, max_rows: Limit = 2_000_000) -> DataFrame:
    """Per team and fixture: rating, opponent's rating, difference and expectation before the kickoff.

    Ratings couple all teams of a league, so a league of at most ``max_rows`` fixtures is one bounded
    group.  A larger league is solved over all executors by ``_elo_sweeps``.
    """
    games = matches.select("league", "kickoff", "match_id", "home_team", "away_team", "home_score", "away_score")
    ordinary, frequent = split_frequent(games, ["league"], max_rows)
    types = dict(games.dtypes)
    schema = f"league {types['league']}, match_id {types['match_id']}, home_team {types['home_team']}, away_team {types['away_team']}, home_rating double, away_rating double"
    rated = ordinary.groupBy("league").applyInPandas(_elo_league, schema)
    if frequent is not None:
        rated = rated.unionByName(_elo_sweeps(frequent))
    return rated.select("league", "match_id", *_elo_columns(F.col("home_rating"), F.col("away_rating")))


def _elo_league(games: pd.DataFrame) -> pd.DataFrame:
    """One league in kickoff order, a whole kickoff at a time."""
    games = games.sort_values(["kickoff", "match_id"], kind="stable")
    codes, teams = pd.factorize(pd.concat([games["home_team"], games["away_team"]]))
    home, away = codes[: len(games)], codes[len(games):]
    margin = (games["home_score"] - games["away_score"]).to_numpy(float)
    step = ELO_K * np.log1p(np.maximum(np.abs(margin), 1.0))
    actual = (np.sign(margin) + 1) / 2
    ratings = np.full(len(teams), ELO_START)
    before = np.empty((2, len(games)))
    times = games["kickoff"].to_numpy()
    edges = np.flatnonzero(np.r_[True, times[1:] != times[:-1], True])
    for start, end in zip(edges[:-1], edges[1:]):
        h, a = home[start:end], away[start:end]
        before[0, start:end], before[1, start:end] = ratings[h], ratings[a]
        expected = 1 / (1 + 10 ** (-(ratings[h] + ELO_HOME - ratings[a]) / 400))
        change = step[start:end] * (actual[start:end] - expected)
        np.add.at(ratings, h, change)
        np.add.at(ratings, a, -change)
    out = games[["league", "match_id", "home_team", "away_team"]].copy()
    out["home_rating"], out["away_rating"] = before
    return out


def _elo_sweeps(games: DataFrame, kickoffs_per_slab: int = 64, tolerance: float = 1e-10) -> DataFrame:
    """Ratings of a league of any size, all fixtures of a slab of kickoffs at once.

    A rating is 1500 plus the sum of earlier changes, and a change depends on earlier ratings only.
    Starting from no changes, each sweep recomputes all ratings by running sums and all changes from
    them; after n sweeps the first n kickoffs of the slab are final, and in practice the largest
    correction falls below ``tolerance`` much earlier.  Slabs follow one another through a table of
    current ratings.
    """
    spark = games.sparkSession
    times = games.select("league", "kickoff").distinct()
    times = row_numbers(times, ["league"], [F.col("kickoff")], "_k").withColumn("_slab", F.floor((F.col("_k") - 1) / kickoffs_per_slab))
    margin = (F.col("home_score") - F.col("away_score")).cast("double")
    step = F.lit(ELO_K) * F.log1p(F.greatest(F.abs(margin), F.lit(1.0)))
    staged = key_join(games, times.drop("_k"), ["league", "kickoff"], "inner").select(
        "league", "kickoff", "match_id", "home_team", "away_team", "_slab", step.alias("_step"), ((F.signum(margin) + 1) / 2).alias("_actual"))
    path = scratch_path(spark, "elo")
    staged.write.partitionBy("_slab").parquet(f"{path}/games")
    slabs = [r[0] for r in times.select("_slab").distinct().orderBy("_slab").collect()]
    ratings = None
    for slab in slabs:
        part = spark.read.parquet(f"{path}/games").filter(F.col("_slab") == slab).drop("_slab")
        part = part.withColumn("_change", F.lit(0.0))
        start = ratings
        for sweep in range(kickoffs_per_slab + 1):
            swept = store(_elo_sweep(part, start), f"{path}/sweeps/{slab}-{sweep}")
            worst = swept.agg(F.max(F.abs(F.col("_new") - F.col("_change")))).first()[0]
            part = swept.drop("_change", "_home", "_away").withColumnRenamed("_new", "_change")
            if worst <= tolerance:
                break
        swept.select("league", "match_id", "home_team", "away_team", F.col("_home").alias("home_rating"), F.col("_away").alias("away_rating")).write.parquet(f"{path}/done/slab={slab}")
        gained = _team_changes(part).groupBy("league", "team").agg(F.sum("_d").alias("_d"))
        if start is None:
            ratings = gained.select("league", "team", (F.lit(ELO_START) + F.col("_d")).alias("_r"))
        else:
            ratings = start.unionByName(gained.withColumnRenamed("_d", "_r")).groupBy("league", "team").agg(F.sum("_r").alias("_r"))
            known = start.select("league", "team", F.lit(1).alias("_old"))
            ratings = key_join(ratings, known, ["league", "team"]).select(
                "league", "team", (F.col("_r") + F.when(F.col("_old").isNull(), ELO_START).otherwise(0.0)).alias("_r"))
        ratings = store(ratings, f"{path}/ratings/{slab}")
    return spark.read.parquet(f"{path}/done").drop("slab")


def _team_changes(part: DataFrame) -> DataFrame:
    return part.select("league", "kickoff", F.inline(F.array(
        F.struct(F.col("home_team").alias("team"), F.col("_change").alias("_d")),
        F.struct(F.col("away_team").alias("team"), (-F.col("_change")).alias("_d")))))


def _elo_sweep(part: DataFrame, ratings: DataFrame | None) -> DataFrame:
    """Ratings before each kickoff from the current changes, and the changes that follow from them."""
    batches = _team_changes(part).groupBy("league", "team", "kickoff").agg(F.sum("_d").alias("_d"))
    before = running_totals(batches, ["league", "team"], [F.col("kickoff")], {"_gain": F.col("_d")}, max_rows=None)
    if ratings is None:
        before = before.withColumn("_rating", F.lit(ELO_START) + F.col("_gain"))
    else:
        before = key_join(before, ratings, ["league", "team"]).withColumn("_rating", F.coalesce("_r", F.lit(ELO_START)) + F.col("_gain"))
    before = before.select("league", "team", "kickoff", "_rating")
    for side in ("home", "away"):
        named = before.withColumnsRenamed({"team": f"{side}_team", "_rating": f"_{side}"})
        part = key_join(part, named, ["league", f"{side}_team", "kickoff"], "inner")
    expected = 1 / (1 + F.pow(F.lit(10.0), -(F.col("_home") + ELO_HOME - F.col("_away")) / 400))
    return part.withColumn("_new", F.col("_step") * (F.col("_actual") - expected))


@dataclass(frozen=True)
class Target:
    """A measure to adjust: its column, whether it is a count to be put per 90 minutes, its baseline, and
    whether it may be null."""

    column: str
    per90: bool = True
    baseline: float = 0.0
    nullable: bool = False


def opponent_adjusted(
    df: DataFrame,
    targets: Mapping[str, Target],
    *,
    group: str = "league",
    kickoff: str = "kickoff",
    minutes: str = "minutes",
    position: str = "position",
    positions: Sequence[str] = ("D", "F", "G", "M"),
    strength: float = RIDGE_STRENGTH,
    max_rows: Limit = HOT_ROWS,
) -> DataFrame:
    """adjusted_<target> = actual minus the expectation of a ridge fit on strictly earlier kickoffs.

    The fit needs only sums of products, so it is an aggregation per kickoff, a running sum over
    kickoffs, one small solve per kickoff, and a join back.  Side and position are the same for all rows of a
    cell of a kickoff, so a row enters few sums; products are formed per cell.  ``df`` has is_home (0/1),
    elo_rating and opponent_elo_rating; it is read twice, hence stored.
    """
    df = store(compiled_methods(df), scratch_path(df.sparkSession, "adjusted"))
    x = [F.lit(1.0), F.col("is_home").cast("double"), (F.col("elo_rating") - F.col("opponent_elo_rating")) / F.lit(400.0),
         *[F.coalesce((F.col(position) == p).cast("double"), F.lit(0.0)) for p in positions]]
    size = len(x)
    exposure = F.least(F.greatest(F.col(minutes) / 90.0, F.lit(0.0)), F.lit(1.0))

    def actual(t: Target) -> Column:
        value = F.col(t.column).cast("double")
        if t.per90:
            return F.when(F.col(minutes) > 0, F.lit(90.0) * value / F.col(minutes)).otherwise(0.0)
        return F.coalesce(value, F.lit(t.baseline))

    def weight(t: Target) -> Column:
        return F.when(F.col(t.column).isNotNull(), exposure).otherwise(0.0) if t.nullable else exposure

    def gram(name: str) -> str:
        return name if targets[name].nullable else "all"

    fits = {gram(n): weight(t) for n, t in targets.items()}
    difference, codes = x[2], list(positions)
    staged = df.select(
        group, kickoff, x[1].alias("_home"), F.when(F.col(position).isin(codes), F.col(position)).alias("_position"), difference.alias("_d"),
        *[w.alias(f"_w_{n}") for n, w in fits.items()], *[(weight(t) * (actual(t) - t.baseline)).alias(f"_y_{n}") for n, t in targets.items()])
    powers = {f"_w_{n}": 2 for n in fits} | {f"_y_{n}": 1 for n in targets}
    d = [F.lit(1.0), F.col("_d"), F.col("_d") * F.col("_d")]
    cells = staged.groupBy(group, kickoff, "_home", "_position").agg(
        *[F.sum(F.col(c) * d[k] if k else F.col(c)).alias(f"{c}_{k}") for c, most in powers.items() for k in range(most + 1)])
    constant = [F.lit(1.0), F.col("_home"), F.lit(1.0), *[F.coalesce((F.col("_position") == p).cast("double"), F.lit(0.0)) for p in codes]]

    def product(c: str, *places: int) -> Column:
        total = F.col(f"{c}_{sum(i == 2 for i in places)}")
        for i in places:
            total = total if i in (0, 2) else total * constant[i]
        return F.sum(total)

    sums = [product(f"_w_{n}", i, j).alias(f"_g_{n}_{i}_{j}") for n in fits for i in range(size) for j in range(i, size)]
    sums += [product(f"_y_{n}", i).alias(f"_b_{n}_{i}") for n in targets for i in range(size)]
    # a row per kickoff
    per_kickoff = store(cells.groupBy(group, kickoff).agg(*sums), scratch_path(df.sparkSession, "kickoffs"))
    names = [c for c in per_kickoff.columns if c not in (group, kickoff)]
    before = running_totals(per_kickoff, [group], [F.col(kickoff)], {f"_before{n}": F.col(n) for n in names}, max_rows=max_rows)
    types = dict(df.dtypes)
    schema = f"{group} {types[group]}, {kickoff} {types[kickoff]}, " + ", ".join(f"_beta_{n} array<double>" for n in targets)
    grams = {n: gram(n) for n in targets}

    def solve(batches):
        for batch in batches:
            out = batch[[group, kickoff]].copy()
            for name, g in grams.items():
                a = np.zeros((len(batch), size, size))
                for i in range(size):
                    for j in range(i, size):
                        a[:, i, j] = a[:, j, i] = batch[f"_before_g_{g}_{i}_{j}"]
                a += strength * np.eye(size)
                b = np.stack([batch[f"_before_b_{name}_{i}"] for i in range(size)], axis=1)
                out[f"_beta_{name}"] = list(np.linalg.solve(a, b[:, :, None])[:, :, 0])
            yield out

    betas = before.select(group, kickoff, *[f"_before{n}" for n in names]).mapInPandas(solve, schema)
    # one row per kickoff: the wide rows stay where they are
    joined = small_join(df, betas, [group, kickoff])

    def residual(name: str, t: Target) -> Column:
        fitted = F.lit(t.baseline)
        for i, c in enumerate(x):
            fitted = fitted + c * F.col(f"_beta_{name}")[i]
        return (actual(t) - (F.greatest(fitted, F.lit(0.0)) if t.per90 else fitted)).alias(f"adjusted_{name}")

    return joined.select(*df.columns, *[residual(n, t) for n, t in targets.items()])
