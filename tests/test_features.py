"""The feature chain on complete line-ups, the registry, and the experiment plans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagwise import catalog
from lagwise.plans import experiment as X
from lagwise.plans import features as P
from lagwise.plans import folds as E

EVENTS = ("goals", "assists", "shots", "key_passes", "saves", "defensive_actions")


@pytest.fixture(scope="module")
def league():
    rng = np.random.default_rng(11)
    fixtures, players = [], []
    for n in range(24):
        home, away = rng.choice(4, 2, replace=False)
        kickoff = pd.Timestamp("2020-08-01") + pd.Timedelta(days=int(n // 2) * 7)
        fixtures.append({"league": "x", "match_id": f"m{n:02d}", "season": "2020-21", "kickoff": kickoff.to_pydatetime(), "home_team": int(home), "away_team": int(away),
                         "home_score": int(rng.poisson(1.5)), "away_score": int(rng.poisson(1.2))})
        for team in (home, away):
            for k, p in enumerate(rng.choice(14, 11, replace=False)):
                players.append({**{c: fixtures[-1][c] for c in ("league", "match_id", "kickoff", "home_team", "away_team")}, "team_id": int(team), "player_id": int(100 * team + p),
                                "position": "GDDDDMMMMFF"[k], "played": True, "started": True, "minutes": float(rng.integers(10, 95)), "rating": float(rng.normal(6.8, 0.4)) if rng.random() > 0.2 else None,
                                **{e: float(rng.poisson(1.0)) for e in EVENTS}, "npxg": float(rng.random()) if rng.random() > 0.5 else None})
    return fixtures, players


SCHEMA = ("league string, match_id string, kickoff timestamp, home_team long, away_team long, team_id long, player_id long, position string, played boolean, started boolean, minutes double, "
          "rating double, " + ", ".join(f"{e} double" for e in EVENTS) + ", npxg double")


def test_model_dataset(spark, league):
    fixtures, players = league
    m = spark.createDataFrame(fixtures, "league string, match_id string, season string, kickoff timestamp, home_team long, away_team long, home_score int, away_score int")
    a = spark.createDataFrame(players, SCHEMA)
    data = P.model_dataset(m, a).toPandas()
    sided = [c for c in data if c.startswith(("home_", "away_", "diff_")) and c not in m.columns]
    assert len(data) == len(fixtures) and len(sided) == 249
    for feature in (c[5:] for c in sided if c.startswith("diff_")):
        np.testing.assert_allclose(data[f"diff_{feature}"], data[f"home_{feature}"] - data[f"away_{feature}"], atol=1e-10)
    frame = pd.DataFrame(players).sort_values(["player_id", "kickoff", "match_id"])
    frame["m5"] = frame.groupby("player_id").minutes.transform(lambda v: v.shift(1).rolling(5, min_periods=1).sum()).fillna(0)
    frame["ewm"] = frame.groupby("player_id").rating.transform(lambda v: v.shift(1).ewm(halflife=2, adjust=False).mean()).fillna(0)
    home = frame[frame.team_id == frame.home_team].groupby("match_id").agg(m5=("m5", "sum"), ewm=("ewm", "mean"))
    data = data.set_index("match_id")
    np.testing.assert_allclose(data["home_recent_minutes_sum_5"], home["m5"].reindex(data.index), atol=1e-9)
    np.testing.assert_allclose(data["home_rating_lineup_mean_ewm"], home["ewm"].reindex(data.index), atol=1e-9)


def test_incomplete_lineup_is_an_error(spark, league):
    fixtures, players = league
    m = spark.createDataFrame(fixtures, "league string, match_id string, season string, kickoff timestamp, home_team long, away_team long, home_score int, away_score int")
    with pytest.raises(ValueError, match="starters"):
        P.model_dataset(m, spark.createDataFrame(players[1:], SCHEMA))


def test_every_fixture_stays(spark, league):
    """A fixture without players on one side, or on both, keeps its row and all that is known of it."""
    fixtures, players = league
    m = spark.createDataFrame(fixtures, "league string, match_id string, season string, kickoff timestamp, home_team long, away_team long, home_score int, away_score int")
    bare, half = fixtures[-1], fixtures[-2]
    fewer = [p for p in players if p["match_id"] != bare["match_id"] and not (p["match_id"] == half["match_id"] and p["team_id"] == half["away_team"])]
    data = P.model_dataset(m, spark.createDataFrame(fewer, SCHEMA), strict=False).toPandas().set_index("match_id")
    assert sorted(data.index) == [f["match_id"] for f in fixtures]
    names = [c[5:] for c in data if c.startswith("diff_")]
    strength = [n for n in names if n in P.TEAM_STRENGTH_FEATURES]
    rest = [n for n in names if n not in strength]
    assert len(strength) == len(P.TEAM_STRENGTH_FEATURES) and len(names) == 83
    columns = lambda side, of: [f"{side}_{n}" for n in of]
    missing = data.isna()
    for side in ("home", "away", "diff"):
        assert not missing[columns(side, strength)].any(axis=None)
        assert missing.loc[bare["match_id"], columns(side, rest)].all()
        assert (missing.loc[half["match_id"], columns(side, rest)] == (side != "home")).all()
        assert not missing.drop([bare["match_id"], half["match_id"]])[columns(side, rest)].any(axis=None)


def test_registry_is_consistent():
    queries, oracles = catalog.queries(), catalog.oracles()
    assert set(oracles) <= set(queries) and len(queries) > 120 and "history_by_type" in oracles


def evaluation_data(spark, seed=9, n=1200):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"league": rng.choice(["a", "b"], n), "season": rng.integers(2001, 2006, n), "match_id": np.arange(n), "home_team": rng.integers(0, 6, n)})
    frame["away_team"] = (frame.home_team + rng.integers(1, 6, n)) % 6
    frame["kickoff"] = [pd.Timestamp(int(y), 1, 1) + pd.Timedelta(days=int(d)) for y, d in zip(frame.season, rng.integers(0, 300, n))]
    frame["good"], frame["noise"], frame["market"] = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    z = np.column_stack([0.9 * frame.good + 0.4 * frame.market, np.zeros(n), -0.9 * frame.good - 0.4 * frame.market])
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    frame["result_3way"] = [rng.choice(list("HDA"), p=r) for r in p]
    return spark.createDataFrame(frame)


def test_search_finds_the_useful_feature(spark):
    df = evaluation_data(spark)
    folds = X.fold_seasons(df)
    assert folds == {2003: (2001, 2002), 2004: (2001, 2002, 2003), 2005: (2001, 2002, 2003, 2004)}
    store = X.CandidateStore(df, folds, ["market"])
    chosen, changes = X.refine_by_changes(store, ["noise"], ["good", "noise"], rounds=2)
    assert "good" in chosen and changes[changes["round"] == 1].query("accepted")["feature"].tolist() == ["good"]
    assert set(X.one_feature_changes(["a", "b"], ["a", "b", "c"])["features"]) == {("b",), ("a",), ("a", "b", "c")}
    assert (changes[changes["accepted"]]["rank"] == 1).all() and changes["gain"].notna().all()
    removal = X.removal_diagnostics(store, ["good", "noise"], {"g": ["good"], "n": ["noise"]}).set_index("removed")
    assert removal.loc["group:g", "log_loss_difference_from_selected"] > 0.05


def test_negative_controls(spark):
    table = X.robustness_suite(evaluation_data(spark), {"good": ["good"], "noise": ["noise"]}, ["market"], ["good"]).toPandas().set_index("model")
    assert table.loc["shuffled_features", "log_loss_change_vs_final"] > 0.05
    assert table.loc["without_good", "log_loss_change_vs_final"] > 0.05
    assert table.loc["deliberate_hindsight", "log_loss_change_vs_final"] < 0.01


def test_holdout_must_follow_training(spark):
    df = evaluation_data(spark)
    assert X.holdout_samples(df, 2005)[2].count() == 10
    with pytest.raises(ValueError, match="strictly after"):
        X.holdout_samples(df.withColumn("kickoff", F.when(F.col("season") == 2005, F.lit("2001-01-05").cast("timestamp")).otherwise(F.col("kickoff"))), 2005)
    with pytest.raises(ValueError, match="boundaries"):
        E.validate_folds(df, E.expanding_folds(df), groups=3)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("v"))
    line = F.concat_ws(",", "id", "v")
    one, two = E.table_fingerprint(df, line).first(), E.table_fingerprint(df.orderBy(F.desc("id")).repartition(3), line).first()
    assert one == two and one != E.table_fingerprint(df.withColumn("v", F.when(F.col("id") == 3, 9).otherwise(F.col("v"))), line).first()


def test_ordered_fingerprint_by_loop(spark):
    import hashlib

    lines = [None if i == 7 else f"v{i * 37 % 11}" for i in range(50)]
    df = spark.createDataFrame([(i // 3, v) for i, v in enumerate(lines)], "id int, v string")
    level = [v or "" for _, v in sorted(((i // 3, v or "") for i, v in enumerate(lines)))]
    for _ in range(2):
        level = [hashlib.sha256("\n".join(level[i:i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
    wanted = (50, hashlib.sha256("\n".join(level).encode()).hexdigest())
    for parts, limit in ((1, 1_000), (5, 1_000), (3, 10)):
        assert tuple(E.ordered_fingerprint(df.repartition(parts), F.col("v"), [F.col("id")], 4, max_rows=limit).first()) == wanted
    assert tuple(E.ordered_fingerprint(df.limit(0), F.col("v"), [F.col("id")]).first()) == (0, hashlib.sha256(b"").hexdigest())
