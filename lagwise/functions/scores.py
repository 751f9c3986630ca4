"""Per-row scores of three-class probability forecasts (classes ordered H, D, A)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagwise.functions.scalars import predicted_class

CLASSES = ("H", "D", "A")
PROBS = ("prob_H", "prob_D", "prob_A")
METRICS = ("log_loss", "brier_score", "rps")
EPSILON = 2.220446049250313e-16


def observed(result: str) -> list[Column]:
    return [(F.col(result) == c).cast("double") for c in CLASSES]


def log_loss(result: str = "result_3way", probs=PROBS, epsilon: float = EPSILON) -> Column:
    """-log of the probability given to the outcome, clipped at ``epsilon``; an unknown outcome is an error."""
    chosen = F.when(F.col(result) == "H", F.col(probs[0])).when(F.col(result) == "D", F.col(probs[1])).when(
        F.col(result) == "A", F.col(probs[2])).otherwise(F.raise_error(F.lit("unknown outcome class")))
    return -F.log(F.least(F.greatest(chosen, F.lit(epsilon)), F.lit(1.0)))


def brier(result: str = "result_3way", probs=PROBS) -> Column:
    """Sum of squared differences over the three classes."""
    h, d, a = [(F.col(p) - o) * (F.col(p) - o) for p, o in zip(probs, observed(result))]
    return h + d + a


def rps(result: str = "result_3way", probs=PROBS) -> Column:
    """Ranked probability score: squared differences of the cumulative distributions, halved."""
    h, d, _ = observed(result)
    first = F.col(probs[0]) - h
    second = (F.col(probs[0]) + F.col(probs[1])) - (h + d)
    return (first * first + second * second) / F.lit(2.0)


def correct(result: str = "result_3way", probs=PROBS) -> Column:
    return (predicted_class(*probs) == F.col(result)).cast("double")


def row_scores(result: str = "result_3way", probs=PROBS, prefix: str = "") -> list[Column]:
    """log_loss, brier_score and rps of one row."""
    return [
        log_loss(result, probs).alias(f"{prefix}log_loss"),
        brier(result, probs).alias(f"{prefix}brier_score"),
        rps(result, probs).alias(f"{prefix}rps"),
    ]
