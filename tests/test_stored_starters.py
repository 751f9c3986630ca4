"""What the feature dataset stores on the way."""

import datetime as dt

from pyspark.sql import functions as F

from lagwise.plans import features as P
from lagwise.plans.features import starter_columns


def test_stored_starters_hold_what_is_read_later_only():
    read = ["league", "match_id", "kickoff", "team_id", "team_side", "player_id", "position", "minutes", "has_prior_history", "form_rating_mean_5"]
    assert starter_columns([*read, "home_team", "elo_rating", "goals", "adjusted_shots", "previous_appearance"]) == read


def test_rows_of_the_dataset_are_made_once(spark):
    """The checks and the caller read stored fixtures: nothing is shuffled again for the result."""
    day = dt.datetime(2020, 8, 1)
    fixtures = [("x", n, day + dt.timedelta(days=n), n % 2, 1 - n % 2, n % 3, 1) for n in range(6)]
    m = spark.createDataFrame(fixtures, "league string, match_id long, kickoff timestamp, home_team long, away_team long, home_score int, away_score int")
    counts = [e for e in P.FormSpec().events]
    a = m.select(
        "league", "match_id", "kickoff", "home_team", "away_team", F.explode(F.array("home_team", "away_team")).alias("team_id")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k")).select(
        "*", (F.col("team_id") * 100 + F.col("k")).alias("player_id"), F.lit("M").alias("position"), F.lit(True).alias("played"), F.lit(True).alias("started"),
        F.lit(90.0).alias("minutes"), F.lit(6.5).alias("rating"), *[F.lit(1.0).alias(c) for c in counts], F.lit(0.1).alias("npxg")).drop("k")
    data = P.model_dataset(m, a)
    assert "Exchange" not in data._jdf.queryExecution().executedPlan().toString()
    assert data.count() == 6 and data.filter("home_recent_minutes_sum_5 is null").count() == 0
