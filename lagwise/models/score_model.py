"""Time-decayed bivariate score model with a low-score correction, fitted for all groups at once."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.models.newton import minimise
from lagwise.operators.joins import checked_join

# Fixed values of the model definition.
HALF_LIFE_DAYS = 365.0
MAX_GOALS = 10
PLAYER_PENALTY = 1.0
RHO_BOUND = 0.20
MIN_RATE, MAX_RATE = 0.02, 6.0
SAFETY = 1e-8
TAU_EPSILON = 1e-10


def clip_rate(rate: Column) -> Column:
    return F.least(F.greatest(rate, F.lit(MIN_RATE)), F.lit(MAX_RATE))


def corrections(home: Column, away: Column, rho: Column) -> list[Column]:
    """Factors of the scores 0-0, 0-1, 1-0 and 1-1."""
    return [1 - home * away * rho, 1 + home * rho, 1 + away * rho, 1 - rho]


def stabilize_rho(home: Column, away: Column, rho: Column) -> Column:
    """rho moved only as far as keeps all four corrections positive."""
    low = F.greatest((SAFETY - 1) / home, (SAFETY - 1) / away)
    high = F.least((1 - SAFETY) / (home * away), F.lit(1 - SAFETY))
    return F.least(F.greatest(rho, low), high)


def score_grid_probs(df: DataFrame, home: str, away: str, rho: str | Column, names: Sequence[str] = ("prob_H", "prob_D", "prob_A"), max_goals: int = MAX_GOALS) -> DataFrame:
    """Append the probabilities of a home win, draw and away win from the corrected score grid.

    The triangles of the grid are sums of products of the two goal distributions, so the grid itself is
    never built: the four corrected cells are added as differences.
    """
    h, a = F.col(home), F.col(away)
    r = F.col(rho) if isinstance(rho, str) else rho
    pmf = lambda rate: [F.exp(k * F.log(rate) - rate - math.lgamma(k + 1)) for k in range(max_goals + 1)]
    wide = df.withColumns({**{f"_h{k}": c for k, c in enumerate(pmf(h))}, **{f"_a{k}": c for k, c in enumerate(pmf(a))}, "_rho": r})
    ph, pa = [F.col(f"_h{k}") for k in range(max_goals + 1)], [F.col(f"_a{k}") for k in range(max_goals + 1)]

    def below(p: list[Column], k: int) -> Column:
        total = p[0]
        for c in p[1:k]:
            total = total + c
        return total

    def total(parts: list[Column]) -> Column:
        out = parts[0]
        for c in parts[1:]:
            out = out + c
        return out

    t = corrections(h, a, F.col("_rho"))
    home_win = total([ph[k] * below(pa, k) for k in range(1, max_goals + 1)]) + (t[2] - 1) * ph[1] * pa[0]
    draw = total([ph[k] * pa[k] for k in range(max_goals + 1)]) + (t[0] - 1) * ph[0] * pa[0] + (t[3] - 1) * ph[1] * pa[1]
    away_win = total([pa[k] * below(ph, k) for k in range(1, max_goals + 1)]) + (t[1] - 1) * ph[0] * pa[1]
    valid = F.least(*t) > TAU_EPSILON
    wide = wide.withColumns({"_H": home_win, "_D": draw, "_A": away_win, "_ok": valid})
    mass = F.when(F.col("_ok"), F.col("_H") + F.col("_D") + F.col("_A")).otherwise(F.raise_error(F.lit("a low-score correction is not positive")))
    return wide.withColumn("_mass", mass).select(*df.columns, *[(F.col(c) / F.col("_mass")).alias(n) for c, n in zip(("_H", "_D", "_A"), names)])


@dataclass
class ScoreFit:
    """Parameters of one problem (a group and a set of training seasons)."""

    key: str
    group: object
    teams: tuple
    intercept: float = 0.0
    home_advantage: float = 0.0
    rho: float = 0.0
    attack: np.ndarray | None = None
    defence: np.ndarray | None = None
    player: np.ndarray | None = None
    features: tuple[str, ...] = ()
    means: np.ndarray | None = None
    scales: np.ndarray | None = None
    loss: float = math.nan
    seasons: tuple = ()


@dataclass
class ScoreProblem:
    key: str
    group: object
    seasons: tuple
    features: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)


def _reduced(df: DataFrame, moments: pd.DataFrame, features: Sequence[str], decay: float, season: str, group: str, time: str) -> DataFrame:
    """Fixtures that differ in nothing the likelihood sees but their day are merged: within a (group, season) a day only sets
    a weight, so the sum of the weights (``_w``, as of the cell's last day) and a count serve for all of them."""
    keys = [group, season, "home_team", "away_team", "home_score", "away_score"]
    types = dict(df.dtypes)
    cells = df.sparkSession.createDataFrame(
        list(moments[[group, season, "last"]].itertuples(index=False, name=None)), f"{group} {types[group]}, {season} {types[season]}, _last double")
    # an unknown day must spoil the fit, not count for nothing
    weight = F.coalesce(F.exp(-decay * (F.col("_last") - _day(time))), F.lit(math.nan))
    merged = df.select(*keys, time, *features).join(F.broadcast(cells), [group, season]).groupBy(*keys, *features).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(weight).alias("_w"))
    return merged.repartitionByRange(group, season, "home_team", "away_team").sortWithinPartitions(group, season)


def _day(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp")) / F.lit(86_400_000_000.0)


def fit_score_models(df: DataFrame, problems: Sequence[ScoreProblem], *, season: str = "season", group: str = "league", time: str = "kickoff",
                     half_life: float = HALF_LIFE_DAYS, player_penalty: float = PLAYER_PENALTY, tolerance: float = 1e-7) -> dict[str, ScoreFit]:
    """Weighted maximum likelihood of every problem.

    log rates: home = intercept + home advantage + attack[home] + defence[away] + player shift, away =
    intercept + attack[away] + defence[home] - player shift.  Weights halve every ``half_life`` days
    before the last training fixture and average one.  Attack and defence are centred at the end, which
    the likelihood does not notice.
    """
    features = sorted({f for p in problems for f in p.features})
    decay = math.log(2) / half_life
    moments = _moments(df, features, season, group, time)
    rows = _reduced(df, moments, features, decay, season, group, time).persist()
    teams = rows.select(group, season, F.explode(F.array("home_team", "away_team")).alias("team")).distinct().toPandas()
    specs = {}
    for p in problems:
        part = moments[(moments[group] == p.group) & moments[season].isin(p.seasons)]
        names = tuple(sorted(teams[(teams[group] == p.group) & teams[season].isin(p.seasons)]["team"].unique().tolist()))
        if len(names) < 2:
            raise ValueError(f"{p.key}: fewer than two training teams")
        n = part["n"].to_numpy(float)
        means = scales = np.empty(0)
        if p.features:
            m, v = part[[f"m_{f}" for f in p.features]].to_numpy(float), part[[f"v_{f}" for f in p.features]].to_numpy(float)
            means = (n[:, None] * m).sum(0) / n.sum()
            scales = np.sqrt((n[:, None] * (v + (m - means) ** 2)).sum(0) / n.sum())
            scales = np.where(scales > 0, scales, 1.0)
        specs[p.key] = {"p": p, "teams": names, "index": {t: i for i, t in enumerate(names)}, "last": part["last"].max(), "means": means, "scales": scales}
        specs[p.key]["decay"] = {r.season: math.exp(-decay * (specs[p.key]["last"] - r.last)) for r in part.rename(columns={season: "season"}).itertuples()}
    _mean_weights(rows, specs, season, group)

    def partials(batch, thetas):
        for (g, s), part in batch.groupby([group, season], sort=False):
            cell = None
            for key, theta in thetas.items():
                spec = specs[key]
                if spec["p"].group == g and s in spec["decay"]:
                    cell = cell or _Cell(part, features)
                    yield key, *_score_partials(cell, spec, theta, spec["decay"][s] / spec["mean_weight"])

    def penalty(key, theta):
        count = len(specs[key]["p"].features)
        mask = np.zeros(len(theta))
        if count:
            mask[-count:] = player_penalty
        return float(mask @ theta**2), 2 * mask * theta, np.diag(2 * mask)

    def bounds(key):
        t, k = 2 * len(specs[key]["teams"]), len(specs[key]["p"].features)
        high = np.concatenate([[2.0, 1.0, RHO_BOUND], np.full(t, 2.5), np.full(k, 2.0)])
        low = -high.copy()
        low[0] = -3.0
        return low, high

    start = {k: np.concatenate([s["start"], np.zeros(2 * len(s["teams"]) + len(s["p"].features))]) for k, s in specs.items()}
    fits = minimise(rows, start, partials, penalty=penalty, bounds=bounds, tolerance=tolerance, max_iterations=80)
    rows.unpersist()
    return {k: _centred(k, specs[k], f) for k, f in fits.items()}


def _moments(df: DataFrame, features, season, group, time):
    stats = [F.count(F.lit(1)).cast("double").alias("n"), F.max(_day(time)).alias("last")]
    for f in features:
        stats += [F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}")]
    return df.filter(F.col(group).isNotNull() & F.col(season).isNotNull()).groupBy(group, season).agg(*stats).toPandas()


def _mean_weights(rows: DataFrame, specs: Mapping, season: str, group: str) -> None:
    """Mean weight and weighted mean goals of every problem, from sums per (group, season)."""
    sums = rows.groupBy(group, season).agg(
        F.sum("_w").alias("w"), F.sum("_n").alias("n"), F.sum(F.col("_w") * F.col("home_score")).alias("h"), F.sum(F.col("_w") * F.col("away_score")).alias("a")).toPandas()
    for s in specs.values():
        part = sums[(sums[group] == s["p"].group) & sums[season].isin(s["p"].seasons)]
        share = part[season].map(s["decay"])
        weights = {c: (part[c] * share).sum() for c in "wha"}
        s["mean_weight"] = weights["w"] / part["n"].sum()
        home, away = max(weights["h"] / weights["w"], 0.05), max(weights["a"] / weights["w"], 0.05)
        s["start"] = np.array([math.log(away), min(max(math.log(home / away), -1.0), 1.0), 0.0])


class _Cell:
    """Rows of one (group, season), as arrays that all problems share."""

    def __init__(self, part: pd.DataFrame, features: Sequence[str]) -> None:
        codes, self.teams = pd.factorize(pd.concat([part["home_team"], part["away_team"]]))
        self.pair = codes[: len(part)] * len(self.teams) + codes[len(part):]
        self.yh, self.ya, self.w = (part[c].to_numpy(float) for c in ("home_score", "away_score", "_w"))
        self.x = {f: part[f].to_numpy(float) for f in features}
        logs = np.array([math.lgamma(k + 1) for k in range(int(max(self.yh.max(), self.ya.max())) + 1)])
        self.constant = float(self.w @ (logs[self.yh.astype(int)] + logs[self.ya.astype(int)]))
        # rows at the scores 0-0, 0-1, 1-0 and 1-1, which alone are corrected
        self.low = np.flatnonzero(((self.yh == 0) | (self.yh == 1)) & ((self.ya == 0) | (self.ya == 1)))
        self.kind = (2 * self.yh[self.low] + self.ya[self.low]).astype(int)


def _score_partials(cell: _Cell, spec, theta, share):
    """Loss, gradient and Poisson curvature over some rows of one problem, whose weights are ``share`` times the cell's.

    Teams enter through sums per pair of teams, of which there are few beside the rows.
    """
    count, features, size, n = len(spec["teams"]), spec["p"].features, len(theta), len(cell.teams)
    place = np.array([spec["index"][t] for t in cell.teams])
    x = np.stack([(cell.x[f] - m) / s for f, m, s in zip(features, spec["means"], spec["scales"])], axis=1) if features else np.empty((len(cell.w), 0))
    rho, attack, defence, beta = theta[2], theta[3: 3 + count][place], theta[3 + count: 3 + 2 * count][place], theta[3 + 2 * count:]
    # log rates by (home, away)
    base_h, base_a = theta[0] + theta[1] + attack[:, None] + defence[None, :], theta[0] + attack[None, :] + defence[:, None]
    shift = x @ beta
    raw_h, raw_a = np.exp(base_h.ravel()[cell.pair] + shift), np.exp(base_a.ravel()[cell.pair] - shift)
    lh, la = np.clip(raw_h, MIN_RATE, MAX_RATE), np.clip(raw_a, MIN_RATE, MAX_RATE)
    if min(np.min(1 - lh * la * rho), np.min(1 + lh * rho), np.min(1 + la * rho), 1 - rho) <= TAU_EPSILON:
        return math.inf, np.zeros(size), np.zeros((size, size))
    w = cell.w * share
    low_w, low_lh, low_la = w[cell.low], lh[cell.low], la[cell.low]
    slope = np.choose(cell.kind, [-low_lh * low_la, low_lh, low_la, -np.ones(len(cell.low))])
    tau = 1 + slope * rho
    loss = share * cell.constant - float(w @ (cell.yh * np.log(lh) - lh + cell.ya * np.log(la) - la)) - float(low_w @ np.log(tau))
    bent = slope * rho / tau
    gh, ga = cell.yh - lh, cell.ya - la
    gh[cell.low] += np.where(cell.kind <= 1, bent, 0.0)
    ga[cell.low] += np.where((cell.kind == 0) | (cell.kind == 2), bent, 0.0)
    moves_h, moves_a = w * (raw_h == lh), w * (raw_a == la)
    gh, ga, ch, ca = -gh * moves_h, -ga * moves_a, lh * moves_h, la * moves_a

    def pairs(values: np.ndarray) -> np.ndarray:
        """Sums by (home, away), in the problem's order of teams."""
        out = np.zeros((count, count))
        out[np.ix_(place, place)] = np.bincount(cell.pair, weights=values, minlength=n * n).reshape(n, n)
        return out

    def sums(of_h: np.ndarray, of_a: np.ndarray) -> np.ndarray:
        """Sums by intercept, home advantage, (rho,) attack and defence."""
        return np.concatenate([[of_h.sum() + of_a.sum(), of_h.sum(), 0.0], of_h.sum(1) + of_a.sum(0), of_h.sum(0) + of_a.sum(1)])

    teams = 3 + 2 * count
    gradient, hessian = np.zeros(size), np.zeros((size, size))
    gradient[:teams] = sums(pairs(gh), pairs(ga))
    by_h, by_a = pairs(ch), pairs(ca)
    hessian[0, :teams] = hessian[:teams, 0] = sums(by_h, by_a)
    hessian[1, :teams] = hessian[:teams, 1] = sums(by_h, np.zeros_like(by_a))
    hessian[range(3, teams), range(3, teams)] = sums(by_h, by_a)[3:]
    hessian[3: 3 + count, 3 + count: teams] = by_h + by_a.T
    hessian[3 + count: teams, 3: 3 + count] = by_h.T + by_a
    if features:
        gradient[teams:] = (gh - ga) @ x
        for f in range(len(features)):
            hessian[:teams, teams + f] = hessian[teams + f, :teams] = sums(pairs(ch * x[:, f]), -pairs(ca * x[:, f]))
        hessian[teams:, teams:] = x.T @ ((ch + ca)[:, None] * x)
    gradient[2] = -float(low_w @ (slope / tau))
    hessian[2, 2] = float(low_w @ (slope / tau) ** 2) + 1e-9
    return loss, gradient, hessian


def _centred(key: str, spec, fit) -> ScoreFit:
    count, t = len(spec["teams"]), fit.theta
    attack, defence = t[3: 3 + count], t[3 + count: 3 + 2 * count]
    p = spec["p"]
    return ScoreFit(key, p.group, spec["teams"], float(t[0] + attack.mean() + defence.mean()), float(t[1]), float(t[2]), attack - attack.mean(), defence - defence.mean(),
                    t[3 + 2 * count:], tuple(p.features), spec["means"], spec["scales"], fit.loss, tuple(p.seasons))


def parameter_tables(spark, fits: Mapping[str, ScoreFit], group_type: str, team_type: str, group: str = "league") -> tuple[DataFrame, DataFrame]:
    """(one row per problem, one row per problem and team) of fitted parameters."""
    problems = [(k, f.group, f.intercept, f.home_advantage, f.rho, [float(v) for v in f.player]) for k, f in fits.items()]
    teams = [(k, t, float(f.attack[i]), float(f.defence[i])) for k, f in fits.items() for i, t in enumerate(f.teams)]
    return (spark.createDataFrame(problems, f"key string, {group} {group_type}, intercept double, home_advantage double, rho double, player array<double>"),
            spark.createDataFrame(teams, f"key string, team {team_type}, attack double, defence double"))


def expected_rates(df: DataFrame, fits: Mapping[str, ScoreFit], tests: Mapping[str, object], *, season: str = "season", group: str = "league") -> DataFrame:
    """Rows of each problem's test season with clipped home and away rates; an unseen team has no effect."""
    types = dict(df.dtypes)
    problems, teams = parameter_tables(df.sparkSession, fits, types[group], types["home_team"], group)
    test = df.sparkSession.createDataFrame([(k, v) for k, v in tests.items()], f"key string, {season} {types[season]}")
    rows = df.join(checked_join(problems, test, ["key"], "inner", "one_to_one"), [group, season])
    for side in ("home", "away"):
        named = teams.select("key", F.col("team").alias(f"{side}_team"), F.col("attack").alias(f"_{side}_attack"), F.col("defence").alias(f"_{side}_defence"))
        rows = rows.join(named, ["key", f"{side}_team"], "left").fillna(0.0, [f"_{side}_attack", f"_{side}_defence"])
    some = next(iter(fits.values()))
    shift = F.lit(0.0)
    for i, f in enumerate(some.features):
        scaled = F.lit(0.0)
        for k, fit in fits.items():
            scaled = F.when(F.col("key") == k, (F.col(f) - float(fit.means[i])) / float(fit.scales[i])).otherwise(scaled)
        shift = shift + scaled * F.col("player")[i]
    home = F.exp(F.col("intercept") + F.col("home_advantage") + F.col("_home_attack") + F.col("_away_defence") + shift)
    away = F.exp(F.col("intercept") + F.col("_away_attack") + F.col("_home_defence") - shift)
    return rows.select("key", *df.columns, "rho", clip_rate(home).alias("home_rate"), clip_rate(away).alias("away_rate"))


def predict_scores(df: DataFrame, fits: Mapping[str, ScoreFit], tests: Mapping[str, object], **columns: str) -> DataFrame:
    """Probabilities with their diagnostics: rates, fitted and effective rho, smallest correction."""
    rated = expected_rates(df, fits, tests, **columns)
    h, a = F.col("home_rate"), F.col("away_rate")
    rated = rated.withColumn("effective_rho", stabilize_rho(h, a, F.col("rho")))
    rated = rated.withColumns({
        "rho_adjusted": F.abs(F.col("effective_rho") - F.col("rho")) > 1e-8 + 1e-5 * F.abs(F.col("rho")),
        "minimum_correction": F.least(*corrections(h, a, F.col("effective_rho")))})
    return score_grid_probs(rated, "home_rate", "away_rate", "effective_rho")


def export_parameters(spark, fits: Mapping[str, ScoreFit], model: str) -> DataFrame:
    """Long parameter table: intercept, home advantage, rho, team effects, player effects."""
    rows = []
    for k, f in fits.items():
        rows += [(model, k, n, float(v)) for n, v in (("goal_intercept", f.intercept), ("home_advantage", f.home_advantage), ("rho", f.rho))]
        rows += [(model, k, f"attack[{t}]", float(v)) for t, v in zip(f.teams, f.attack)] + [(model, k, f"defence[{t}]", float(v)) for t, v in zip(f.teams, f.defence)]
        rows += [(model, k, f"player_form[{n}]", float(v)) for n, v in zip(f.features, f.player)]
    return spark.createDataFrame(rows, "model string, problem string, feature string, standardized_coefficient double")
