"""Temperature and vector scaling, calibration slopes, and chronological calibration."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.scalars import predicted_class
from lagwise.functions.scores import CLASSES, PROBS
from lagwise.models.newton import minimise, softmax
from lagwise.operators.metrics import by_outcome, equal_group_weights
from lagwise.operators.ordering import small_join

TEMPERATURE_BOUNDS = (0.25, 4.0)
LOG_FLOOR = 1e-12


def apply_temperature(df: DataFrame, temperature: float | str | Column, probs: Sequence[str] = PROBS) -> DataFrame:
    """softmax(log p / T): softer for T > 1, sharper for T < 1, same order."""
    t = F.col(temperature) if isinstance(temperature, str) else (F.lit(float(temperature)) if not isinstance(temperature, Column) else temperature)
    logs = [F.log(F.col(p)) / t for p in probs]
    wide = df.withColumn("_top", F.greatest(*logs)).withColumns({f"_e{i}": F.exp(v - F.col("_top")) for i, v in enumerate(logs)})
    total = F.col("_e0") + F.col("_e1") + F.col("_e2")
    scaled = {p: F.col(f"_e{i}") / total for i, p in enumerate(probs)}
    return wide.withColumns(scaled).select(*df.columns)


def fit_temperatures(df: DataFrame, keys: Sequence[str], result: str = "result_3way", weight: str | None = None, probs: Sequence[str] = PROBS, tolerance: float = 1e-10, max_iterations: int = 60) -> DataFrame:
    """Temperature per key that minimises the weighted log loss, inside the bounds.

    The loss is convex in 1/T and its two derivatives are averages, so every Newton step is one
    aggregation for all keys.
    """
    spark = df.sparkSession
    w = F.col(weight) if weight else F.lit(1.0)
    logs = [F.log(F.greatest(F.col(p), F.lit(LOG_FLOOR))) for p in probs]
    chosen = F.when(F.col(result) == "H", logs[0]).when(F.col(result) == "D", logs[1]).when(F.col(result) == "A", logs[2])
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    # the name of a row's key is formed once, not in every iteration
    rows = df.select(*keys, key.alias("_k"), w.alias("_w"), chosen.alias("_y"), *[v.alias(f"_l{i}") for i, v in enumerate(logs)]).persist()
    state = {r[0]: [1.0, *_inverse_bounds()] for r in rows.select("_k").distinct().collect()}
    for _ in range(max_iterations):
        table = spark.createDataFrame([(k, float(v[0])) for k, v in state.items()], "_k string, _b double")
        joined = rows.join(F.broadcast(table), "_k")
        top = F.greatest(*[F.col(f"_l{i}") for i in range(3)]) * F.col("_b")
        joined = joined.withColumns({f"_e{i}": F.exp(F.col(f"_l{i}") * F.col("_b") - top) for i in range(3)})
        total = F.col("_e0") + F.col("_e1") + F.col("_e2")
        mean = sum((F.col(f"_e{i}") * F.col(f"_l{i}") for i in range(1, 3)), F.col("_e0") * F.col("_l0")) / total
        square = sum((F.col(f"_e{i}") * F.col(f"_l{i}") * F.col(f"_l{i}") for i in range(1, 3)), F.col("_e0") * F.col("_l0") * F.col("_l0")) / total
        found = joined.groupBy("_k").agg(F.sum(F.col("_w") * (mean - F.col("_y"))).alias("g"), F.sum(F.col("_w") * (square - mean * mean)).alias("h")).collect()
        moved = 0.0
        for r in found:
            b, low, high = state[r["_k"]]
            low, high = (low, b) if r["g"] > 0 else (b, high)
            new = b - r["g"] / r["h"] if r["h"] > 0 else b
            # outside the bracket of the sign change: bisect
            new = new if low <= new <= high else (low + high) / 2
            moved = max(moved, abs(new - b))
            state[r["_k"]] = [new, low, high]
        if moved < tolerance:
            break
    else:
        raise ValueError(f"temperatures did not converge in {max_iterations} iterations")
    table = spark.createDataFrame([(k, 1.0 / v[0]) for k, v in state.items()], "_k string, temperature double")
    out = rows.select(*keys, "_k").distinct().join(table, "_k").drop("_k") if keys else table.drop("_k")
    return out


def _inverse_bounds() -> tuple[float, float]:
    return 1 / TEMPERATURE_BOUNDS[1], 1 / TEMPERATURE_BOUNDS[0]


def chronological_temperature_scale(predictions: DataFrame, *, season: str = "season", group: str = "league", result: str = "result_3way", model: str = "model") -> tuple[DataFrame, DataFrame]:
    """(calibrated predictions, fitted temperatures): each season uses all earlier prediction seasons, leagues weighing the same."""
    seasons = predictions.select(season).distinct()
    ordered = seasons.withColumn("_p", F.row_number().over(Window.orderBy(season)))
    test = ordered.select(F.col(season).alias("test_season"), F.col("_p").alias("_t"))
    folds = test.join(F.broadcast(ordered), F.col("_p") < F.col("_t")).select("test_season", season)
    train = equal_group_weights(small_join(predictions, folds, [season]), group, "_weight", [model, "test_season"])
    fitted = fit_temperatures(train, [model, "test_season"], result, "_weight")
    sizes = train.groupBy(model, "test_season").agg(F.count(F.lit(1)).alias("calibration_matches"), F.countDistinct(season).alias("calibration_seasons"))
    scaled = small_join(predictions, fitted.withColumnRenamed("test_season", season), [model, season])
    scaled = apply_temperature(scaled, "temperature").withColumn("predicted_result", predicted_class(*PROBS))
    named = scaled.withColumn("source_model", F.col(model)).withColumn(model, F.concat(F.col(model), F.lit("_temperature_scaled")))
    return named, fitted.join(sizes, [model, "test_season"])


def fit_vector_scaling(df: DataFrame, result: str = "result_3way", probs: Sequence[str] = PROBS, regularization: float = 10.0) -> dict[str, float]:
    """Three slopes and two biases on log probabilities, shrunk towards the identity (the last bias is zero)."""
    code = F.when(F.col(result) == CLASSES[0], 0).when(F.col(result) == CLASSES[1], 1).when(F.col(result) == CLASSES[2], 2)
    rows = df.select(code.alias("_y"), *[F.log(F.greatest(F.col(p), F.lit(LOG_FLOOR))).alias(f"_l{i}") for i, p in enumerate(probs)]).persist()
    n = rows.count()

    def partials(batch, thetas):
        theta = thetas["fit"]
        logs, y = batch[["_l0", "_l1", "_l2"]].to_numpy(float), batch["_y"].to_numpy(int)
        p = softmax(logs * theta[:3] + np.array([theta[3], theta[4], 0.0]))
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        gradient = np.concatenate([(d * logs).sum(0), d[:, :2].sum(0)]) / n
        # a class score moves by its log per slope and by one per bias, each class by its own parameters only
        mean = np.hstack([p * logs, p[:, :2]])
        hessian = -(mean.T @ mean)
        hessian[np.arange(5), np.arange(5)] += np.concatenate([(p * logs * logs).sum(0), p[:, :2].sum(0)])
        cross = (p * logs)[:, :2].sum(0)
        hessian[[0, 1], [3, 4]] += cross
        hessian[[3, 4], [0, 1]] += cross
        yield "fit", float(-np.log(np.clip(p[np.arange(len(y)), y], LOG_FLOOR, 1)).sum() / n), gradient, hessian / n

    target = np.array([1.0, 1.0, 1.0, 0.0, 0.0])
    strength = regularization / n

    def penalty(_, theta):
        return strength * float(((theta - target) ** 2).sum()), 2 * strength * (theta - target), 2 * strength * np.eye(5)

    bounds = (np.array([0.1] * 3 + [-2.0] * 2), np.array([4.0] * 3 + [2.0] * 2))
    theta = minimise(rows, {"fit": target}, partials, penalty=penalty, bounds=lambda _: bounds, tolerance=1e-10)["fit"].theta
    rows.unpersist()
    names = [f"slope_{c}" for c in CLASSES] + [f"bias_{c}" for c in CLASSES[:2]]
    return {**{k: float(v) for k, v in zip(names, theta)}, "bias_A": 0.0}


def apply_vector_scaling(df: DataFrame, parameters: dict[str, float], probs: Sequence[str] = PROBS) -> DataFrame:
    scores = [F.log(F.greatest(F.col(p), F.lit(LOG_FLOOR))) * parameters[f"slope_{c}"] + parameters[f"bias_{c}"] for p, c in zip(probs, CLASSES)]
    wide = df.withColumn("_top", F.greatest(*scores)).withColumns({f"_e{i}": F.exp(v - F.col("_top")) for i, v in enumerate(scores)})
    total = F.col("_e0") + F.col("_e1") + F.col("_e2")
    return wide.withColumns({p: F.col(f"_e{i}") / total for i, p in enumerate(probs)}).select(*df.columns)


def calibration_slopes(df: DataFrame, keys: Sequence[str], c: float = 1e6, probs: Sequence[str] = PROBS, tolerance: float = 1e-10, max_iterations: int = 50) -> DataFrame:
    """Intercept and slope of the outcome on the logit of its probability, per (keys, class).

    All fits advance together: one aggregation yields the five sums of each two-parameter system.
    """
    spark = df.sparkSession
    long = by_outcome(df.select(*keys, "result_3way", *probs), probs=probs)
    p = F.least(F.greatest(F.col("prediction"), F.lit(1e-6)), F.lit(1 - 1e-6))
    key = F.to_json(F.struct(*keys, "outcome"), {"ignoreNullFields": "false"})
    # equal predictions of one key merge before the iterations start
    rows = long.select(*keys, "outcome", F.log(p / (1 - p)).alias("_x"), F.col("observed").alias("_y")).groupBy(*keys, "outcome", "_x").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s")).withColumn("_k", key).persist()
    state = {r[0]: np.zeros(2) for r in rows.select("_k").distinct().collect()}
    for _ in range(max_iterations):
        table = spark.createDataFrame([(k, float(v[0]), float(v[1])) for k, v in state.items()], "_k string, _a double, _b double")
        q = 1 / (1 + F.exp(-(F.col("_a") + F.col("_b") * F.col("_x"))))
        e, v = F.col("_n") * q - F.col("_s"), F.col("_n") * q * (1 - q)
        x = F.col("_x")
        found = rows.join(F.broadcast(table), "_k").groupBy("_k").agg(
            F.sum(e).alias("g0"), F.sum(e * x).alias("g1"), F.sum(v).alias("h00"), F.sum(v * x).alias("h01"), F.sum(v * x * x).alias("h11")).collect()
        moved = 0.0
        for r in found:
            t = state[r["_k"]]
            g = np.array([r["g0"], r["g1"] + t[1] / c])
            h = np.array([[r["h00"], r["h01"]], [r["h01"], r["h11"] + 1 / c]])
            step = np.linalg.lstsq(h, -g, rcond=None)[0]
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
            state[r["_k"]] = t + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    else:
        raise ValueError(f"calibration slopes did not converge in {max_iterations} iterations")
    if not all(math.isfinite(v) for t in state.values() for v in t):
        raise ValueError("a calibration slope is not finite")
    table = spark.createDataFrame([(k, float(v[0]), float(v[1])) for k, v in state.items()], "_k string, calibration_intercept double, calibration_slope double")
    return rows.select(*keys, "outcome", "_k").distinct().join(table, "_k").drop("_k")
