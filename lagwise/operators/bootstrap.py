"""Paired losses, block bootstrap over match weeks, and the intervals and decisions drawn from it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.scalars import match_week
from lagwise.functions.scores import METRICS, PROBS, row_scores
from lagwise.operators.joins import paired_rows

PAIR_KEYS = ("league", "match_id", "season", "match_date", "result_3way")
LOSSES = tuple(f"{p}_{m}" for p in ("baseline", "improvement") for m in METRICS)
WEIGHTINGS = ("equal_league", "match_weighted")


def paired_losses(predictions: DataFrame, baseline: str, enhanced: str, *, model: str = "model", keys: Sequence[str] = PAIR_KEYS) -> DataFrame:
    """Per match the three losses of both models, their improvement and the match week."""
    paired = paired_rows(predictions, model, baseline, enhanced, keys, PROBS)
    scored = paired.select(
        *keys, match_week("match_date").alias("match_week"),
        *row_scores(probs=[f"baseline_{p}" for p in PROBS], prefix="baseline_"), *row_scores(probs=[f"enhanced_{p}" for p in PROBS], prefix="enhanced_"))
    return scored.withColumns({f"improvement_{m}": F.col(f"baseline_{m}") - F.col(f"enhanced_{m}") for m in METRICS})


def observed_improvement(paired: DataFrame) -> DataFrame:
    """Baseline and improvement per weighting and metric (equal leagues, and match weighted)."""
    sums = paired.groupBy("league").agg(F.count(F.lit(1)).alias("matches"), *[F.sum(c).alias(c) for c in LOSSES])
    return _weighted(sums, []).select("weighting", "metric", "matches", "leagues", "baseline", "improvement",
                                      (100 * F.col("improvement") / F.col("baseline")).alias("relative_pct"))


def _weighted(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """League sums to both weightings, one row per metric."""
    totals = sums.groupBy(*keys).agg(
        F.sum("matches").alias("matches"), F.count(F.lit(1)).alias("leagues"),
        *[F.avg(F.col(c) / F.col("matches")).alias(f"e_{c}") for c in LOSSES], *[(F.sum(c) / F.sum("matches")).alias(f"m_{c}") for c in LOSSES])
    rows = []
    for label, p in zip(WEIGHTINGS, ("e_", "m_")):
        for m in METRICS:
            rows.append(F.struct(F.lit(label).alias("weighting"), F.lit(m).alias("metric"), F.col(f"{p}baseline_{m}").alias("baseline"), F.col(f"{p}improvement_{m}").alias("improvement")))
    return totals.select(*keys, "matches", "leagues", F.inline(F.array(*rows)))


def weekly_blocks(paired: DataFrame) -> DataFrame:
    """Sums per (league, season, week), numbered inside (league, season): the units that are resampled."""
    weekly = paired.groupBy("league", "season", "match_week").agg(F.count(F.lit(1)).alias("matches"), *[F.sum(c).alias(c) for c in LOSSES])
    block = Window.partitionBy("league", "season")
    return weekly.select(
        "*", (F.row_number().over(block.orderBy("match_week")) - 1).cast("bigint").alias("slot"), F.count(F.lit(1)).over(block).alias("blocks"))


#: Repetitions that a task draws for a league at once.
BUNDLE = 100
_SUMS = ("matches", *LOSSES)


def _drawn_sums(stream: Iterator[pa.RecordBatch], repetitions: int) -> Iterator[pa.RecordBatch]:
    """Rows (bundle, league, seed, blocks) to sums per repetition.

    Every slot of a season draws a block by the hash of (seed, repetition, league, season, slot); how often each block is
    drawn in each repetition is a matrix, and its product with the blocks' sums are the sums of all repetitions.
    """
    for batch in stream:
        schema = pa.schema([("repetition", pa.int32()), batch.schema.field("league"), *[(c, pa.float64()) for c in _SUMS]])
        for at, (bundle, seed, name) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)))):
            held = batch.column(4)[at].values
            season, slot, blocks = (held.field(c).to_pylist() for c in ("season", "slot", "blocks"))
            values = np.array([held.field(c).to_numpy(zero_copy_only=False).astype(float) for c in _SUMS]).T
            ends = [f"|{name}|{s}|{k}".encode() for s, k in zip(season, slot)]
            first = np.arange(len(ends)) - np.array(slot)  # row of the season's first block
            turns = range(bundle * BUNDLE, min((bundle + 1) * BUNDLE, repetitions))
            heads = (hashlib.md5(f"{seed}|{turn}".encode(), usedforsecurity=False) for turn in turns)
            numbers = bytearray()
            for head in heads:
                for end in ends:
                    whole = head.copy()
                    whole.update(end)
                    numbers += whole.digest()[:4]
            drawn = np.frombuffer(numbers, dtype=">u4").astype(np.int64).reshape(len(turns), -1) % np.array(blocks) + first
            drawn += np.arange(len(turns))[:, None] * len(ends)
            counts = np.bincount(drawn.ravel(), minlength=len(turns) * len(ends)).reshape(len(turns), -1)
            sums = counts @ values
            yield pa.record_batch([
                pa.array(turns, type=pa.int32()), pa.repeat(batch.column(1)[at], len(turns)), *[pa.array(c) for c in sums.T]], schema=schema)


def resample_weeks(paired: DataFrame, repetitions: int = 10_000, seed: int = 42) -> DataFrame:
    """Bootstrap samples (repetition, weighting, metric, absolute and relative improvement)."""
    weekly = weekly_blocks(paired)
    sums = _resampled(weekly, repetitions, F.lit(seed))
    return _weighted(sums, ["repetition"]).select(
        "repetition", "weighting", "metric", F.col("improvement").alias("absolute_improvement"),
        (100 * F.col("improvement") / F.col("baseline")).alias("relative_improvement_pct"))


def _resampled(weekly: DataFrame, repetitions: int, seed: Column) -> DataFrame:
    """Sums per repetition and league.  A league is one row with its weeks, which the calendar bounds, for every bundle of
    repetitions; no draw is a row and nothing is joined."""
    block = F.struct(F.col("season").cast("string").alias("season"), "slot", "blocks", *_SUMS)
    leagues = weekly.withColumn("_seed", seed.cast("string")).groupBy("league").agg(
        F.first("_seed").alias("seed"), F.sort_array(F.collect_list(block)).alias("held"))
    bundles = F.sequence(F.lit(0), F.lit((repetitions - 1) // BUNDLE))
    dealt = leagues.select(F.explode(bundles).alias("bundle"), "league", "seed", F.col("league").cast("string").alias("name"), "held").repartition("league", "bundle")
    kind = weekly.schema["league"].dataType.simpleString()
    schema = f"repetition int, league {kind}, " + ", ".join(f"{c} double" for c in _SUMS)
    return dealt.mapInArrow(lambda it: _drawn_sums(it, repetitions), schema)


def resample_weeks_by_league(paired: DataFrame, repetitions: int = 10_000, seed: int = 42) -> DataFrame:
    """The same inside every league on its own; league n of the sorted leagues uses seed + n."""
    leagues = paired.select("league").distinct()
    numbered = leagues.withColumn("_shift", F.row_number().over(Window.orderBy("league")) - 1)
    weekly = weekly_blocks(paired).join(numbered, "league")
    sums = _resampled(weekly, repetitions, F.lit(seed) + F.col("_shift"))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"baseline_{m}") / F.col("matches")).alias("baseline"), (F.col(f"improvement_{m}") / F.col("matches")).alias("improvement")) for m in METRICS])
    return sums.select("repetition", "league", F.inline(rows)).select(
        "repetition", "league", "metric", F.col("improvement").alias("absolute_improvement"), (100 * F.col("improvement") / F.col("baseline")).alias("relative_improvement_pct"))


def intervals(samples: DataFrame, keys: Sequence[str] = ("weighting", "metric"), level: float = 0.95) -> DataFrame:
    """Percentile interval, share favouring the enhanced model, and whether zero is outside.

    A group holds one value per repetition, so the exact percentile is bounded by the repetitions.
    """
    low, high = F.lit((1 - level) / 2), F.lit((1 + level) / 2)
    ends = {f"{e}_{n}": F.percentile(c, q) for n, c in (("absolute", "absolute_improvement"), ("relative_pct", "relative_improvement_pct")) for e, q in (("lower", low), ("upper", high))}
    per = samples.groupBy(*keys).agg(*[c.alias(n) for n, c in ends.items()], (100 * F.avg((F.col("absolute_improvement") > 0).cast("double"))).alias("samples_favouring_enhanced_pct"))
    return per.withColumn("interval_excludes_zero", (F.col("lower_absolute") > 0) | (F.col("upper_absolute") < 0))


def calibration_decision(paired: DataFrame, max_fold_deterioration: float = 0.001) -> DataFrame:
    """The four rules for keeping a calibration, and their conjunction, in one row."""
    log, br = "improvement_log_loss", "improvement_brier_score"
    sums = paired.groupBy("season", "league").agg(F.count(F.lit(1)).alias("n"), F.sum(log).alias("l"), F.sum(br).alias("b"))
    leagues = sums.groupBy("league").agg((F.sum("l") / F.sum("n")).alias("l"), (F.sum("b") / F.sum("n")).alias("b"))
    overall = leagues.agg(
        F.avg("l").alias("equal_league_log_loss_improvement"), F.avg("b").alias("equal_league_brier_improvement"),
        F.count_if(F.col("l") > 0).alias("leagues_improved"), (F.floor(F.count(F.lit(1)) / 2) + 1).alias("leagues_required"))
    worst = sums.groupBy("season").agg(F.avg(F.col("l") / F.col("n")).alias("l")).agg(F.min("l").alias("worst_fold_log_loss_improvement"))
    rules = {
        "equal_league_log_loss_improved": F.col("equal_league_log_loss_improvement") > 0,
        "equal_league_brier_not_worse": F.col("equal_league_brier_improvement") >= 0,
        "no_fold_log_loss_deterioration_over_limit": F.col("worst_fold_log_loss_improvement") >= -max_fold_deterioration,
        "log_loss_improved_in_league_majority": F.col("leagues_improved") >= F.col("leagues_required"),
    }
    one = overall.join(F.broadcast(worst)).withColumns(rules)
    keep = F.lit(True)
    for name in rules:
        keep = keep & F.col(name)
    return one.withColumn("retain_calibration", keep)
