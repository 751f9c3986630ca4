"""Forecast scores by any grouping, equal-group means, calibration tables and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.scores import CLASSES, METRICS, PROBS, brier, correct, log_loss, rps
from lagwise.operators.ordering import HOT_ROWS, Limit, exact_quantiles, small_join
from lagwise.operators.sampling import equal_frequency_sums


def score_groups(df: DataFrame, keys: Sequence[str], result: str = "result_3way", probs: Sequence[str] = PROBS) -> DataFrame:
    """Matches, log loss, Brier score, ranked probability score and accuracy per group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), F.avg(log_loss(result, probs)).alias("log_loss"), F.avg(brier(result, probs)).alias("brier_score"),
        F.avg(rps(result, probs)).alias("rps"), F.avg(correct(result, probs)).alias("accuracy"))


def score_sums(df: DataFrame, keys: Sequence[str], result: str = "result_3way", probs: Sequence[str] = PROBS) -> DataFrame:
    """Rows per group, and for every metric its sum and its number of values: what ``scores_of_sums`` needs of a large table."""
    values = {"log_loss": log_loss(result, probs), "brier_score": brier(result, probs), "rps": rps(result, probs), "accuracy": correct(result, probs)}
    stats = [f(v).alias(f"{kind}_{m}") for m, v in values.items() for kind, f in (("sum", F.sum), ("n", F.count))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), *stats)


def scores_of_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``score_groups`` of coarser groups, from the sums of finer ones."""
    means = [F.try_divide(F.sum(f"sum_{m}"), F.sum(f"n_{m}")).alias(m) for m in ("log_loss", "brier_score", "rps", "accuracy")]
    return sums.groupBy(*keys).agg(F.sum("matches").alias("matches"), *means)


def equal_group_metrics(scores: DataFrame, keys: Sequence[str], group: str, expected: int, metrics: Sequence[str] = ("log_loss", "brier_score", "rps", "accuracy")) -> DataFrame:
    """Mean over groups of the group means; fewer groups than expected is an error."""
    found = F.countDistinct(group)
    checked = F.when(found == expected, found).otherwise(F.raise_error(F.lit("a group is missing from an equal-group metric")))
    return scores.groupBy(*keys).agg(checked.alias("groups"), F.sum("matches").alias("matches"), *[F.avg(m).alias(m) for m in metrics])


def equal_group_weights(df: DataFrame, group: str, name: str = "weight", partition: Sequence[str] = ()) -> DataFrame:
    """Mean-one row weights that give every group the same total.

    Group sizes come from an aggregate that is joined back, so a large group is never one task.
    """
    sizes = df.groupBy(*partition, group).agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.groupBy(*partition).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_groups"))
    per = sizes.join(totals, list(partition)) if partition else sizes.join(F.broadcast(totals))
    per = per.select(*partition, group, (F.col("_total") / F.col("_groups") / F.col("_n")).alias(name))
    return small_join(df, per, [*partition, group])


def weight_audit(df: DataFrame, group: str, weight: str = "weight") -> DataFrame:
    """Rows, total and mean weight per group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("train_matches"), F.sum(weight).alias("total_training_weight"), F.avg(weight).alias("mean_match_weight"))


def class_frequencies(df: DataFrame, keys: Sequence[str] = (), result: str = "result_3way", weight: str | None = None, require_all: bool = False) -> DataFrame:
    """Share of each class, optionally weighted; with ``require_all`` an absent class is an error."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    shares = [F.sum(F.when(F.col(result) == c, w).otherwise(0.0)) / F.sum(w) for c in CLASSES]
    if require_all:
        shares = [F.when(s > 0, s).otherwise(F.raise_error(F.lit("training data lacks an outcome class"))) for s in shares]
    return df.groupBy(*keys).agg(*[s.alias(p) for s, p in zip(shares, PROBS)])


def fold_counts(df: DataFrame, folds: DataFrame, season: str, group: str) -> DataFrame:
    """Train and test rows per (test season, group), from season-by-group counts."""
    sizes = df.groupBy(season, group).agg(F.count(F.lit(1)).alias("_n"))
    roles = folds.select("test_season", F.col("train_season").alias(season), F.lit("train").alias("_role")).unionByName(
        folds.select("test_season", F.col("test_season").alias(season), F.lit("test").alias("_role")).distinct())
    return roles.join(sizes, season).groupBy("test_season", group).agg(
        F.sum(F.when(F.col("_role") == "train", F.col("_n")).otherwise(0)).alias("train_matches"),
        F.sum(F.when(F.col("_role") == "test", F.col("_n")).otherwise(0)).alias("test_matches"))


def by_outcome(df: DataFrame, result: str = "result_3way", probs: Sequence[str] = PROBS) -> DataFrame:
    """One row per forecast and class: outcome, prediction, observed (0/1)."""
    parts = [F.struct(F.lit(c).alias("outcome"), F.col(p).alias("prediction"), (F.col(result) == c).cast("int").alias("observed")) for c, p in zip(CLASSES, probs)]
    return df.select(*[c for c in df.columns if c not in probs], F.inline(F.array(*parts)))


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a proportion, inside [0, 1]."""
    p, z2 = successes / total, F.lit(z * z)
    below = 1 + z2 / total
    centre = (p + z2 / (2 * total)) / below
    margin = F.lit(z) * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total)) / below
    return F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)


def reliability_table(df: DataFrame, keys: Sequence[str], tie: Sequence[str], *, max_rows: Limit = HOT_ROWS, **bins) -> DataFrame:
    """Per (keys, outcome, bin): mean prediction, observed rate, Wilson interval and absolute gap."""
    groups = [*keys, "outcome"]
    per = equal_frequency_sums(by_outcome(df), groups, "prediction", tie, "observed", max_rows=max_rows, **bins)
    per = per.withColumnsRenamed({"mean_value": "average_prediction", "outcomes": "_s"})
    low, high = wilson(F.col("_s"), F.col("matches"))
    rate = F.col("_s") / F.col("matches")
    return per.select(*groups, "bin", "matches", "average_prediction", rate.alias("actual_frequency"), low.alias("wilson_lower"),
                      high.alias("wilson_upper"), F.abs(rate - F.col("average_prediction")).alias("absolute_gap"))


def calibration_errors(reliability: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected calibration error per class and on average, and the largest bin gap."""
    per = reliability.groupBy(*keys, "outcome").agg(
        (F.sum(F.col("absolute_gap") * F.col("matches")) / F.sum("matches")).alias("ece"), F.max("absolute_gap").alias("gap"))
    return per.groupBy(*keys).agg(
        *[F.max(F.when(F.col("outcome") == c, F.col("ece"))).alias(f"ece_{c}") for c in CLASSES], F.avg("ece").alias("ece"), F.max("gap").alias("mce"))


def confidence_table(df: DataFrame, keys: Sequence[str], tie: Sequence[str], *, max_rows: Limit = HOT_ROWS, **bins) -> DataFrame:
    """Accuracy by bins of the largest probability."""
    sure = df.select(*keys, *tie, F.greatest(*PROBS).alias("confidence"), correct().alias("correct"))
    per = equal_frequency_sums(sure, keys, "confidence", tie, "correct", max_rows=max_rows, **bins)
    return per.select(*keys, "bin", "matches", F.col("mean_value").alias("average_confidence"), (F.col("outcomes") / F.col("known")).alias("accuracy"))


def seasonal_stability(scores: DataFrame, keys: Sequence[str], metric: str = "log_loss") -> DataFrame:
    """Mean, worst and sample deviation of a metric over seasons."""
    return scores.groupBy(*keys).agg(F.avg(metric).alias("mean_season"), F.max(metric).alias("worst_season"), F.stddev_samp(metric).alias("season_std"))


def unpivot_metrics(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Wide prefix_metric columns to one row per metric: ``columns`` maps an output name to its prefix."""
    rows = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{prefix}{m}").alias(name) for name, prefix in columns.items()]) for m in metrics]
    return df.select(*keys, F.inline(F.array(*rows)))


def calibration_effect_table(paired: DataFrame, group: str, equal_group: str | None = None) -> DataFrame:
    """Uncalibrated, calibrated and improvement per group and metric, plain or averaged over leagues."""
    names = [f"{p}_{m}" for p in ("baseline", "enhanced", "improvement") for m in METRICS]
    means = [F.avg(n).alias(n) for n in names]
    wide = paired.groupBy(group, equal_group).agg(*means).groupBy(group).agg(*means) if equal_group else paired.groupBy(group).agg(*means)
    return unpivot_metrics(wide, [group], {"uncalibrated_score": "baseline_", "calibrated_score": "enhanced_", "calibration_improvement": "improvement_"})


def primary_comparison(match_weighted: DataFrame, by_group: DataFrame, equal_group: DataFrame, group: str, model: str, baseline: str, enhanced: str) -> DataFrame:
    """Baseline against enhanced for three aggregations and three metrics."""

    def compare(scores: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
        wide = [F.max(F.when(F.col(model) == n, F.col(m))).alias(f"{p}{m}") for p, n in (("b_", baseline), ("e_", enhanced)) for m in METRICS]
        per = scores.filter(F.col(model).isin(baseline, enhanced)).groupBy(*keys).agg(*wide)
        rows = unpivot_metrics(per, keys, {"baseline_score": "b_", "player_score": "e_"})
        return rows.withColumn("aggregation", F.lit(label)) if keys else rows.withColumn("aggregation", F.lit(label)).withColumn(group, F.lit(None).cast(dict(by_group.dtypes)[group]))

    rows = compare(equal_group, "equal_league", []).unionByName(compare(match_weighted, "match_weighted", [])).unionByName(compare(by_group, "individual_league", [group]))
    gain = F.col("baseline_score") - F.col("player_score")
    return rows.withColumn("improvement", gain).withColumn("relative_improvement_pct", 100 * gain / F.col("baseline_score"))


def season_points(df: DataFrame, keys: Sequence[str], home: str, away: str, result: str = "result_3way") -> DataFrame:
    """Points per match of every team over a whole season (a deliberate hindsight feature)."""
    r = F.col(result)
    home_points = F.when(r == "H", 3.0).when(r == "D", 1.0).when(r == "A", 0.0).otherwise(F.raise_error(F.lit("unknown result class")))
    away_points = F.when(r == "A", 3.0).when(r == "D", 1.0).otherwise(0.0)
    rows = df.select(*keys, F.inline(F.array(
        F.struct(F.col(home).alias("team"), home_points.alias("points")), F.struct(F.col(away).alias("team"), away_points.alias("points")))))
    return rows.groupBy(*keys, "team").agg(F.avg("points").alias("points_per_match"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise Pearson correlations in one aggregation, as (x, y, correlation) rows."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{n}") for n, (a, b) in enumerate(pairs)])
    rows = []
    for n, (a, b) in enumerate(pairs):
        rows += [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{n}").alias("correlation")),
                 F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), F.col(f"c{n}").alias("correlation"))]
    rows += [F.struct(F.lit(a).alias("x"), F.lit(a).alias("y"), F.lit(1.0).alias("correlation")) for a in columns]
    return wide.select(F.inline(F.array(*rows)))


def linear_fits(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Least-squares slope and intercept of y on x per pair, in one aggregation."""
    wide = df.agg(*[c for n, (x, y) in enumerate(pairs) for c in (
        F.regr_slope(F.col(y), F.col(x)).alias(f"s{n}"), F.regr_intercept(F.col(y), F.col(x)).alias(f"i{n}"))])
    rows = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"s{n}").alias("slope"), F.col(f"i{n}").alias("intercept")) for n, (x, y) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*rows)))


def axis_limits(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, *, max_rows: Limit = HOT_ROWS) -> DataFrame:
    """Lower and upper quantile per column, one wider on both sides when they coincide."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])))
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    q = exact_quantiles(long, ["column"], "value", [low, high], max_rows=max_rows)
    ends = q.groupBy("column").agg(F.min("quantile").alias("lower"), F.max("quantile").alias("upper"))
    same = F.col("lower") == F.col("upper")
    return ends.select("column", F.when(same, F.col("lower") - 1).otherwise(F.col("lower")).alias("lower"), F.when(same, F.col("upper") + 1).otherwise(F.col("upper")).alias("upper"))


def comparison_audit(df: DataFrame, keys: Sequence[str], week: str = "match_week") -> DataFrame:
    """Matches, leagues and distinct (league, season, week) blocks per comparison."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matches"), F.countDistinct("league").alias("leagues"), F.countDistinct("league", "season", week).alias("league_season_weeks"))


def search_summary(df: DataFrame, model: str, groups: str, loss: str, names: Sequence[str]) -> DataFrame:
    """Per (model, feature group): mean loss with and without the group, and the gap of the best set that has it."""
    best = df.groupBy(model).agg(F.min(loss).alias("_best"))
    df = small_join(df, best, [model])
    parts = [F.struct(F.lit(n).alias("feature_group"), F.array_contains(F.split(groups, r"\|"), n).alias("has")) for n in names]
    long = df.select(model, loss, "_best", F.inline(F.array(*parts)))
    return long.groupBy(model, "feature_group").agg(
        F.avg(F.when(F.col("has"), F.col(loss))).alias("mean_loss_with"), F.avg(F.when(~F.col("has"), F.col(loss))).alias("mean_loss_without"),
        F.min(F.when(F.col("has"), F.col(loss) - F.col("_best"))).alias("best_gap_with"))


def gap_by_count(df: DataFrame, model: str, count: str, loss: str) -> DataFrame:
    """Best gap from the overall best loss per number of groups."""
    per = df.groupBy(model, count).agg(F.min(loss).alias("_loss"))
    return per.select(model, count, (F.col("_loss") - F.min("_loss").over(Window.partitionBy(model))).alias("best_gap"))
