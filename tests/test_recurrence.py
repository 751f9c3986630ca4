"""Ratings, rates, ridge residuals and line-ups against plain loops written for these tests."""

from collections import Counter, defaultdict, deque
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagwise.operators import lineup as L
from lagwise.operators import recurrence as R


def fixtures(n=240, teams=8, seed=1):
    rng = np.random.default_rng(seed)
    home = rng.integers(0, teams, n)
    frame = pd.DataFrame({
        "league": rng.choice(["x", "y"], n, p=[0.8, 0.2]), "match_id": np.arange(n), "home_team": home,
        "away_team": (home + rng.integers(1, teams, n)) % teams, "home_score": rng.poisson(1.5, n), "away_score": rng.poisson(1.1, n),
        "kickoff": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, n // 3, n), unit="D")})
    return frame


def slow_elo(frame):
    out = {}
    for _, league in frame.groupby("league"):
        ratings = defaultdict(lambda: 1500.0)
        for _, batch in league.sort_values(["kickoff", "match_id"]).groupby("kickoff"):
            changes = []
            for m in batch.itertuples():
                h, a = ratings[m.home_team], ratings[m.away_team]
                out[m.match_id] = (h, a)
                expected = 1 / (1 + 10 ** (-(h + 60 - a) / 400))
                gap = m.home_score - m.away_score
                score = 1.0 if gap > 0 else 0.5 if gap == 0 else 0.0
                changes.append((m.home_team, m.away_team, 20 * np.log1p(max(abs(gap), 1)) * (score - expected)))
            for h, a, c in changes:
                ratings[h] += c
                ratings[a] -= c
    return out


@pytest.mark.parametrize("max_rows", [None, 30])
def test_elo(spark, max_rows, monkeypatch):
    frame = fixtures(60 if max_rows else 240)
    if max_rows:
        original = R._elo_sweeps
        monkeypatch.setattr(R, "_elo_sweeps", lambda games: original(games, kickoffs_per_slab=10))
    got = R.elo(spark.createDataFrame(frame), max_rows=max_rows).filter("team_side = 'home'").toPandas().set_index("match_id")
    want = slow_elo(frame)
    assert len(got) == len(want)
    for key, (h, a) in want.items():
        assert got.loc[key, "elo_rating"] == pytest.approx(h, abs=1e-7)
        assert got.loc[key, "opponent_elo_rating"] == pytest.approx(a, abs=1e-7)


@pytest.mark.parametrize("max_rows", [None, 20])
def test_goal_rates_and_prior_matches(spark, max_rows):
    frame = fixtures(120)
    df = spark.createDataFrame(frame)
    rates = R.goal_rates(df, max_rows=max_rows).toPandas().set_index(["match_id", "team_side"])
    prior = R.prior_matches(df, max_rows=max_rows).toPandas().set_index(["match_id", "team_side"])
    attack, played = defaultdict(lambda: 1.35), Counter()
    for _, batch in frame.sort_values(["kickoff", "match_id"]).groupby("kickoff"):
        for m in batch.itertuples():
            for side, team in (("home", m.home_team), ("away", m.away_team)):
                assert rates.loc[(m.match_id, side), "attack_goal_rate_ewm"] == pytest.approx(attack[m.league, team], abs=1e-9)
                assert prior.loc[(m.match_id, side), "prior_team_matches"] == played[m.league, team]
        for m in batch.itertuples():
            for side, team, goals in (("away", m.away_team, m.away_score), ("home", m.home_team, m.home_score)):
                attack[m.league, team] = 0.8 * attack[m.league, team] + 0.2 * goals
                played[m.league, team] += 1


def appearances(frame, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for m in frame.itertuples():
        for team, home in ((m.home_team, 1.0), (m.away_team, 0.0)):
            for player in rng.choice(8, 5, replace=False):
                rows.append({
                    "league": m.league, "match_id": m.match_id, "kickoff": m.kickoff, "team": int(team), "player_id": int(team * 10 + player), "is_home": home,
                    "elo_rating": 1500 + 30.0 * team, "opponent_elo_rating": 1500.0, "position": "DFGM"[player % 4], "minutes": float(rng.integers(0, 95)),
                    "shots": float(rng.poisson(2)), "rating": float(rng.normal(6.8, 0.5)) if rng.random() > 0.3 else None})
    return pd.DataFrame(rows)


def as_spark(spark, frame):
    records = frame.astype(object).where(frame.notna(), None).to_dict("records")
    for row in records:
        row["kickoff"] = row["kickoff"].to_pydatetime()
    return spark.createDataFrame(records,
                                 "league string, match_id long, kickoff timestamp, team long, player_id long, is_home double, elo_rating double, "
                                 "opponent_elo_rating double, position string, minutes double, shots double, rating double")


@pytest.mark.parametrize("max_rows", [None, 10])
def test_ridge_residuals(spark, max_rows):
    frame = appearances(fixtures(60))
    targets = {"shots": R.Target("shots"), "rating": R.Target("rating", per90=False, baseline=6.5, nullable=True)}
    got = R.opponent_adjusted(as_spark(spark, frame), targets, max_rows=max_rows).toPandas().set_index(["match_id", "team", "player_id"])
    for _, league in frame.groupby("league"):
        gram = {t: 25 * np.eye(7) for t in targets}
        right = {t: np.zeros(7) for t in targets}
        for _, batch in league.groupby("kickoff"):
            x = np.column_stack([np.ones(len(batch)), batch.is_home, (batch.elo_rating - batch.opponent_elo_rating) / 400, *[(batch.position == p) for p in "DFGM"]]).astype(float)
            weight = np.clip(batch.minutes / 90, 0, 1).to_numpy()
            for t, spec in targets.items():
                beta = np.linalg.solve(gram[t], right[t])
                actual = np.where(batch.minutes > 0, 90 * batch.shots / batch.minutes.where(batch.minutes > 0, 1), 0) if spec.per90 else batch.rating.fillna(6.5).to_numpy()
                expected = spec.baseline + x @ beta
                expected = np.clip(expected, 0, None) if spec.per90 else expected
                found = got.loc[list(zip(batch.match_id, batch.team, batch.player_id)), f"adjusted_{t}"]
                np.testing.assert_allclose(found, actual - expected, atol=1e-8)
                w = weight * batch[spec.column].notna()
                gram[t] = gram[t] + x.T @ (w.to_numpy()[:, None] * x)
                right[t] = right[t] + x.T @ (w * (actual - spec.baseline)).to_numpy()


@pytest.mark.parametrize("max_rows", [None, 15])
def test_lineup_history(spark, max_rows):
    frame = appearances(fixtures(80))
    frame["quality"] = frame["shots"]
    df = as_spark(spark, frame[[c for c in frame if c != "quality"]]).withColumn("quality", F.col("shots"))
    team, order = ["league", "team"], ["kickoff", "match_id"]
    continuity = L.lineup_continuity(L.lineups(df, team, order, quality="quality"), team, order, regular=3, usual=4, max_rows=max_rows).toPandas()
    pairs = L.pair_familiarity(df, team, order, max_rows=max_rows).toPandas()
    got = continuity.merge(pairs, on=team + order).set_index(["match_id", "team"])
    for key, rows in frame.groupby(["league", "team"]):
        prior, recent, last = set(), deque(maxlen=5), {}
        starts, minutes = Counter(), Counter()
        for (_, match), group in rows.sort_values(order + ["player_id"]).groupby(order):
            current = set(group.player_id)
            counts = Counter(p for lineup in recent for p in lineup)
            usual = sorted(counts, key=lambda p: (-counts[p], p))[:4]
            own = group.quality.mean()
            row = got.loc[(match, key[1])]
            all_pairs = list(combinations(sorted(current), 2))
            assert row.retained_starters == len(current & prior)
            assert row.new_starters == (len(current - prior) if prior else 0)
            assert row.missing_regular_starters == sum(c >= 3 and p not in current for p, c in counts.items())
            assert row.replacement_quality == pytest.approx(own - np.mean([last[p] for p in usual]) if usual else 0.0)
            assert row.mean_pairwise_prior_starts == pytest.approx(np.mean([starts[p] for p in all_pairs]))
            assert row.mean_pairwise_prior_minutes == pytest.approx(np.mean([minutes[p] for p in all_pairs]))
            assert row.new_player_pairs == sum(starts[p] == 0 for p in all_pairs)
            played = dict(zip(group.player_id, group.minutes))
            for p in all_pairs:
                starts[p] += 1
                minutes[p] += min(played[p[0]], played[p[1]])
            last.update(zip(group.player_id, group.quality))
            prior = current
            recent.append(current)


def test_oversized_lineup_is_an_error(spark):
    df = as_spark(spark, appearances(fixtures(4)))
    with pytest.raises(ValueError, match="limit"):
        L.lineups(df, ["league", "team"], ["kickoff", "match_id"], max_size=3)


def test_later_fixtures_never_change_earlier_features(spark):
    frame = fixtures(90)
    cut = frame.kickoff.sort_values().iloc[60]
    changed = frame.copy()
    late = changed.kickoff > cut
    changed.loc[late, "home_score"] = 9
    one = R.elo(spark.createDataFrame(frame)).toPandas()
    two = R.elo(spark.createDataFrame(changed)).toPandas()
    early = set(frame[~late].match_id)
    key = ["match_id", "team_side"]
    a, b = [t[t.match_id.isin(early)].sort_values(key).reset_index(drop=True) for t in (one, two)]
    pd.testing.assert_frame_equal(a[b.columns], b)


def test_ridge_reads_its_rows_once(spark):
    """The plan of the rows runs once, though both the fits and the residuals need them; nulls enter no sum."""
    frame = appearances(fixtures(30))
    frame.loc[frame.index % 7 == 0, "position"] = None
    frame.loc[frame.index % 11 == 0, "elo_rating"] = np.nan
    rows, read = as_spark(spark, frame), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    targets = {"shots": R.Target("shots"), "rating": R.Target("rating", per90=False, baseline=6.5, nullable=True)}
    got = R.opponent_adjusted(rows.mapInPandas(seen, rows.schema), targets).toPandas()
    assert read.value == len(frame) == len(got)
    assert (got.adjusted_rating.isna() == got.elo_rating.isna()).all()
