"""Multinomial logistic regression with Spark ML: pooled fits, probabilities and coefficient tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.functions.scores import CLASSES, PROBS

MARKET_FEATURES = ("market_log_home_vs_draw", "market_log_away_vs_draw")


@dataclass(frozen=True)
class Standardizer:
    """Weighted means and population deviations of the training rows (a zero deviation counts as one)."""

    means: dict[str, float]
    scales: dict[str, float]

    def columns(self, prefix: str = "") -> list[Column]:
        return [((F.col(c) - self.means[c]) / self.scales[c]).alias(f"{prefix}{c}") for c in self.means]


def fit_standardizer(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> Standardizer:
    """Two aggregations over all columns: the means, then the deviations around them."""
    w = F.col(weight) if weight else F.lit(1.0)
    means = df.agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns]).first().asDict()
    var = df.agg(*[(F.sum(w * (F.col(c) - means[c]) * (F.col(c) - means[c])) / F.sum(w)).alias(c) for c in columns]).first().asDict()
    return Standardizer(means, {c: (v**0.5 if v > 0 else 1.0) for c, v in var.items()})


@dataclass(frozen=True)
class LogisticFit:
    columns: tuple[str, ...]
    standardizer: Standardizer
    model: LogisticRegressionModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Append prob_H, prob_D, prob_A."""
        ready = _assemble(df, self.columns, self.standardizer)
        p = vector_to_array("probability")
        scored = self.model.transform(ready)
        return scored.select(*df.columns, *[p[i].alias(n) for i, n in enumerate(PROBS)])


def _assemble(df: DataFrame, columns: Sequence[str], standardizer: Standardizer, *more: Column) -> DataFrame:
    scaled = [c for c in standardizer.columns("_z_")]
    wide = df.select("*", *scaled, *more)
    return VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol="_features").transform(wide)


def fit_logistic(df: DataFrame, columns: Sequence[str], *, result: str = "result_3way", weight: str | None = None, c: float = 1.0, max_iter: int = 2000, tol: float = 1e-8) -> LogisticFit:
    """Fit on standardised columns; the strength of the penalty is 1 / (c x total weight)."""
    standardizer = fit_standardizer(df, columns, weight)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    label = F.when(F.col(result) == "H", 0.0).when(F.col(result) == "D", 1.0).when(F.col(result) == "A", 2.0).otherwise(F.raise_error(F.lit("unknown outcome class")))
    ready = _assemble(df, columns, standardizer, w.alias("_w"), label.alias("_label")).select("_features", "_w", "_label").persist()
    total = ready.agg(F.sum("_w")).first()[0]
    estimator = LogisticRegression(
        featuresCol="_features", labelCol="_label", weightCol="_w", family="multinomial", regParam=1 / (c * total), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=tol)
    model = estimator.fit(ready)
    ready.unpersist()
    if model.summary.totalIterations >= max_iter:
        raise ValueError("the logistic model did not converge")
    if model.numClasses != 3:
        raise ValueError("training data lacks an outcome class")
    return LogisticFit(tuple(columns), standardizer, model)


def coefficient_table(fit: LogisticFit, model: str, test_season, spark) -> DataFrame:
    """Long table of standardised coefficients, intercepts included."""
    matrix, intercepts = fit.model.coefficientMatrix.toArray(), fit.model.interceptVector.toArray()
    rows = [(model, str(test_season), c, "intercept", float(intercepts[i])) for i, c in enumerate(CLASSES)]
    rows += [(model, str(test_season), c, f, float(matrix[i, j])) for i, c in enumerate(CLASSES) for j, f in enumerate(fit.columns)]
    return spark.createDataFrame(rows, "model string, test_season string, result_class string, feature string, standardized_coefficient double")


def market_features(df: DataFrame, home: str, draw: str, away: str) -> DataFrame:
    """Add the two market log ratios."""
    return df.withColumns({MARKET_FEATURES[0]: F.log(F.col(home) / F.col(draw)), MARKET_FEATURES[1]: F.log(F.col(away) / F.col(draw))})


def closing_market(df: DataFrame, home: str, draw: str, away: str) -> DataFrame:
    """The market's own probabilities as a forecast."""
    return df.withColumns({p: F.col(c) for p, c in zip(PROBS, (home, draw, away))})


def model_columns(kind: str, player: Sequence[str] = (), context: Sequence[str] = ()) -> list[str]:
    """Feature columns of the declared model kinds."""
    kinds = {
        "recalibrated_market": [*MARKET_FEATURES, *context],
        "market_plus_player_form": [*MARKET_FEATURES, *player, *context],
        "player_form": [*player, *context],
    }
    return kinds[kind]
