"""Cubic spline bases with quantile knots, and the two additive models built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.models.logistic import LogisticFit, Standardizer, fit_logistic, fit_standardizer
from lagwise.models.score_model import RHO_BOUND, TAU_EPSILON, clip_rate, score_grid_probs, stabilize_rho
from lagwise.operators.ordering import HOT_ROWS, Limit, exact_quantiles

# The match-level columns of the multinomial model, as (name, form, source).
MULTINOMIAL_SMOOTH = (
    ("elo_difference", "difference", "elo_rating"),
    ("expected_goal_difference", "difference", "expected_goals_strength"),
    ("expected_goal_total", "total", "expected_goals_strength"),
    ("adjusted_shots_difference", "difference", "adjusted_shots_lineup_mean_5"),
    ("adjusted_key_passes_difference", "difference", "adjusted_key_passes_lineup_mean_5"),
    ("adjusted_defensive_difference", "difference", "adjusted_defensive_actions_lineup_mean_5"),
    ("forward_shots_difference", "difference", "fwd_adjusted_shots_5"),
    ("pairwise_minutes_difference", "difference", "mean_pairwise_prior_minutes"),
    ("pairwise_minutes_mean", "mean", "mean_pairwise_prior_minutes"),
    ("replacement_quality_difference", "difference", "replacement_quality"),
    ("rating_trend_difference", "difference", "rating_lineup_mean_trend_1_5"),
)
MULTINOMIAL_LINEAR = (
    ("retained_starters_difference", "difference", "retained_starters"),
    ("retained_starters_mean", "mean", "retained_starters"),
    ("missing_regulars_difference", "difference", "missing_regular_starters"),
    ("missing_regulars_total", "total", "missing_regular_starters"),
    ("new_starters_difference", "difference", "new_starters"),
    ("new_starters_total", "total", "new_starters"),
    ("missing_history_difference", "difference", "starters_without_history"),
    ("missing_history_total", "total", "starters_without_history"),
)
# The team-level columns of the scoring model, as (name, side, source).
POISSON_SMOOTH = (
    ("expected_goals_strength", "own", "expected_goals_strength"),
    ("attack_goal_rate_ewm", "own", "attack_goal_rate_ewm"),
    ("opponent_defence_goal_rate_ewm", "opponent", "defence_goal_rate_ewm"),
    ("adjusted_shots_form", "own", "adjusted_shots_lineup_mean_5"),
    ("adjusted_key_passes_form", "own", "adjusted_key_passes_lineup_mean_5"),
    ("opponent_adjusted_defensive_form", "opponent", "adjusted_defensive_actions_lineup_mean_5"),
    ("forward_adjusted_shots", "own", "fwd_adjusted_shots_5"),
    ("mean_pairwise_prior_minutes", "own", "mean_pairwise_prior_minutes"),
    ("replacement_quality", "own", "replacement_quality"),
    ("rating_form_trend", "own", "rating_lineup_mean_trend_1_5"),
)
POISSON_LINEAR = ("retained_starters", "missing_regular_starters", "new_starters", "starters_without_history")


def match_projection(forms: Sequence[tuple[str, str, str]]) -> list[Column]:
    """Differences, totals and means of home_x and away_x."""
    build = {
        "difference": lambda s: F.col(f"home_{s}") - F.col(f"away_{s}"),
        "total": lambda s: F.col(f"home_{s}") + F.col(f"away_{s}"),
        "mean": lambda s: (F.col(f"home_{s}") + F.col(f"away_{s}")) / 2,
    }
    return [build[form](source).alias(name) for name, form, source in forms]


def attacking_rows(df: DataFrame, keep: Sequence[str], own: Mapping[str, str], opponent: Mapping[str, str], difference: Mapping[str, str] | None = None) -> DataFrame:
    """Every fixture as two team-oriented rows: own columns, the opponent's, differences, is_home and goals."""

    def side(a: str, b: str, home: float) -> Column:
        fields = [F.lit(a).alias("team_side"), F.lit(home).alias("is_home"), F.col(f"{a}_score").cast("double").alias("goals")]
        fields += [F.col(f"{a}_{s}").cast("double").alias(n) for n, s in own.items()]
        fields += [F.col(f"{b}_{s}").cast("double").alias(n) for n, s in opponent.items()]
        fields += [(F.col(f"{a}_{s}") - F.col(f"{b}_{s}")).cast("double").alias(n) for n, s in (difference or {}).items()]
        return F.struct(*fields)

    return df.select(*keep, F.inline(F.array(side("home", "away", 1.0), side("away", "home", 0.0))))


@dataclass(frozen=True)
class Spline:
    """Basis of one column: each piece between two knots is a polynomial per basis function."""

    column: str
    knots: tuple[float, ...]
    degree: int = 3

    @property
    def size(self) -> int:
        """Basis functions without the last one, which the intercept already covers."""
        return len(self.knots) + self.degree - 2

    def _extended(self) -> np.ndarray:
        k, d = np.array(self.knots), self.degree
        left, right = k[1] - k[0], k[-1] - k[-2]
        return np.concatenate([k[0] - left * np.arange(d, 0, -1), k, k[-1] + right * np.arange(1, d + 1)])

    def pieces(self) -> np.ndarray:
        """Polynomial coefficients [piece, function, power] in (x - left knot), by the usual recursion."""
        t, d = self._extended(), self.degree
        count = len(self.knots) - 1
        out = np.zeros((count, count + d, d + 1))
        for piece in range(count):
            start = t[d + piece]
            basis = np.zeros((len(t) - 1, d + 1))
            basis[d + piece, 0] = 1.0
            for order in range(1, d + 1):
                new = np.zeros((len(t) - 1 - order, d + 1))
                for i in range(len(new)):
                    for j, low, sign in ((i, t[i], 1.0), (i + 1, t[i + order + 1], -1.0)):
                        width = t[i + order] - t[i] if sign > 0 else t[i + order + 1] - t[i + 1]
                        if width > 0:
                            poly = basis[j] / width
                            new[i] += sign * (np.r_[0, poly[:-1]] + (start - low) * poly)
                basis = new
            out[piece] = basis[: count + d]
        return out

    def columns(self, prefix: str = "") -> list[Column]:
        """Basis values; outside the outer knots each function goes on along its tangent."""
        x, k, poly = F.col(self.column), self.knots, self.pieces()
        inside = F.least(F.greatest(x, F.lit(k[0])), F.lit(k[-1]))
        out = []
        for f in range(self.size):
            value = None
            for piece in range(len(k) - 1):
                u, total = inside - k[piece], F.lit(float(poly[piece, f, -1]))
                for c in poly[piece, f, -2::-1]:
                    total = total * u + float(c)
                last = piece == len(k) - 2
                value = total if value is None and last else (
                    F.when(inside < k[piece + 1], total) if value is None else (value.otherwise(total) if last else value.when(inside < k[piece + 1], total)))
            slope_low = float(poly[0, f, 1])
            width = k[-1] - k[-2]
            slope_high = float(sum(p * c * width ** (p - 1) for p, c in enumerate(poly[-1, f]) if p))
            tail = F.when(x < k[0], (x - k[0]) * slope_low).when(x > k[-1], (x - k[-1]) * slope_high).otherwise(0.0)
            out.append((value + tail).alias(f"{prefix}{self.column}_s{f}"))
        return out


def fit_splines(df: DataFrame, columns: Sequence[str], n_knots: int = 4, degree: int = 3, *, max_rows: Limit = HOT_ROWS) -> list[Spline]:
    """Knots at evenly spaced exact quantiles of every column, found in one job."""
    if n_knots < 3 or degree < 1:
        raise ValueError("a spline needs at least three knots and degree one")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])))
    points = [i / (n_knots - 1) for i in range(n_knots)]
    found = exact_quantiles(long, ["column"], "value", points, max_rows=max_rows).collect()
    knots = {c: tuple(sorted(r["quantile"] for r in found if r["column"] == c)) for c in columns}
    return [Spline(c, knots[c], degree) for c in columns]


def spline_features(df: DataFrame, splines: Sequence[Spline], linear: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The table with its basis columns, and the names of all model columns."""
    basis = [c for s in splines for c in s.columns()]
    names = [f"{s.column}_s{f}" for s in splines for f in range(s.size)]
    return df.select("*", *basis), [*names, *linear]


@dataclass(frozen=True)
class MultinomialGam:
    splines: list[Spline]
    linear: tuple[str, ...]
    fit: LogisticFit

    def transform(self, df: DataFrame) -> DataFrame:
        wide, _ = spline_features(df, self.splines, self.linear)
        return self.fit.transform(wide).select(*df.columns, "prob_H", "prob_D", "prob_A")


def fit_multinomial_gam(df: DataFrame, smooth: Sequence[str], linear: Sequence[str], **options) -> MultinomialGam:
    """Multinomial regression on spline bases and linear columns, all standardised."""
    splines = fit_splines(df, smooth)
    wide, names = spline_features(df, splines, linear)
    return MultinomialGam(splines, tuple(linear), fit_logistic(wide, names, **options))


@dataclass(frozen=True)
class PoissonGam:
    splines: list[Spline]
    names: tuple[str, ...]
    linear: tuple[str, ...]
    standardizer: Standardizer
    intercept: float
    coefficients: tuple[float, ...]
    rho: float = 0.0

    def rates(self, rows: DataFrame) -> DataFrame:
        """Append the clipped expected goals of each team-oriented row."""
        wide, _ = spline_features(rows, self.splines, self.linear)
        linear = F.lit(self.intercept)
        for name, coefficient in zip(self.names, self.coefficients):
            linear = linear + (F.col(name) - self.standardizer.means[name]) / self.standardizer.scales[name] * coefficient
        return wide.select(*rows.columns, clip_rate(F.exp(linear)).alias("rate"))

    def predict(self, rows: DataFrame, match: str) -> DataFrame:
        """Probabilities per match from its two rows."""
        wide = self.rates(rows).groupBy(match).agg(*[F.max(F.when(F.col("team_side") == s, F.col("rate"))).alias(f"{s}_rate") for s in ("home", "away")])
        wide = wide.withColumn("effective_rho", stabilize_rho(F.col("home_rate"), F.col("away_rate"), F.lit(self.rho)))
        return score_grid_probs(wide, "home_rate", "away_rate", "effective_rho")


def fit_poisson_gam(rows: DataFrame, smooth: Sequence[str], linear: Sequence[str], match: str, alpha: float = 1.0) -> PoissonGam:
    """Penalised Poisson regression of goals on team-oriented rows, then rho by itself.

    Spark divides by the sum of the mean, so the penalty is alpha over the mean number of goals.
    """
    splines = fit_splines(rows, smooth)
    wide, names = spline_features(rows, splines, linear)
    standardizer = fit_standardizer(wide, names)
    scaled = wide.select("goals", *standardizer.columns("_z_"))
    ready = VectorAssembler(inputCols=[f"_z_{n}" for n in names], outputCol="_f").transform(scaled).select("goals", "_f").persist()
    mean = ready.agg(F.avg("goals")).first()[0]
    glm = GeneralizedLinearRegression(featuresCol="_f", labelCol="goals", family="poisson", link="log", regParam=alpha / mean, maxIter=100, tol=1e-8)
    model = glm.fit(ready)
    ready.unpersist()
    if model.summary.numIterations >= glm.getMaxIter():
        raise ValueError("the rate model did not converge")
    gam = PoissonGam(splines, tuple(names), tuple(linear), standardizer, float(model.intercept), tuple(float(v) for v in model.coefficients))
    sides = gam.rates(rows).groupBy(match).agg(*[F.max(F.when(F.col("team_side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("home", "away") for c in ("rate", "goals")])
    rho = fit_rho(sides, "home_rate", "away_rate", "home_goals", "away_goals")
    return PoissonGam(splines, tuple(names), tuple(linear), standardizer, gam.intercept, gam.coefficients, rho)


def fit_rho(df: DataFrame, home_rate: str, away_rate: str, home_goals: str, away_goals: str, tolerance: float = 1e-9) -> float:
    """Maximise the sum of log corrections over rho inside its bounds: concave, so Newton with a bracket."""
    h, a = F.col(home_rate), F.col(away_rate)
    x, y = F.col(home_goals), F.col(away_goals)
    slope = F.when((x == 0) & (y == 0), -h * a).when((x == 0) & (y == 1), h).when((x == 1) & (y == 0), a).when((x == 1) & (y == 1), F.lit(-1.0))
    rows = df.select(slope.alias("s"), (h * a).alias("p"), F.greatest(h, a).alias("m")).persist()
    edge = rows.agg(F.max("p"), F.max("m")).first()
    high = min(RHO_BOUND, (1 - 1e-6) / max(edge[0], 1.0))
    low = max(-RHO_BOUND, -(1 - 1e-6) / edge[1])
    rho = 0.0
    used = rows.filter("s IS NOT NULL")
    for _ in range(50):
        t = 1 + F.col("s") * rho
        g, c = used.agg(F.sum(F.col("s") / t), F.sum(F.col("s") * F.col("s") / (t * t))).first()
        if not c:
            break
        low, high = (rho, high) if g > 0 else (low, rho)
        new = rho + g / c
        new = new if low <= new <= high else (low + high) / 2
        moved, rho = abs(new - rho), new
        if moved < tolerance:
            break
    else:
        raise ValueError("rho did not converge")
    worst = min(1 - edge[0] * rho, 1 + edge[1] * rho, 1 - rho)
    rows.unpersist()
    return rho if worst > TAU_EPSILON else 0.0
