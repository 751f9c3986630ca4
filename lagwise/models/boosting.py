"""Boosted trees for three classes: one softmax model over binned columns, and its chronological tuning.

Bins are quantiles of all rows, counted by Spark.  A fit learns from all rows: those with equal bins, class and weight are
one kind with a count.  Fits of a search, which are hundreds, run side by side, a task each, and read the kinds of their fold
from one broadcast table of a byte per value.  Where there are more than ``TASK_KINDS`` kinds, they are dealt over tasks that
grow the trees of a fit together and exchange nothing but sums per bin.  Predictions cover all rows.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.scores import CLASSES, PROBS, log_loss
from lagwise.models.calibration import apply_temperature, apply_vector_scaling, fit_temperatures, fit_vector_scaling
from lagwise.models.softmax_trees import BINS, DEFAULT_SETTINGS, Trees, alone, bin_columns, boost_steps, softmax, together
from lagwise.operators.sampling import ordered_groups
from lagwise.plans.folds import late_block_cutoff
from lagwise.session import cut_lineage

#: Kinds of rows of all folds up to which a task holds a fit of its own; beyond, a fit is spread over tasks.
TASK_KINDS = 1_000_000
#: Kinds, times problems, whose scores a task of a spread fit holds.
SLICE_SCORES = 4_000_000
#: Least number of trees that a tuned model keeps.
LEAST_ROUNDS = 10


# --- binned rows --------------------------------------------------------------------------------

def quantile_edges(df: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Borders between the bins of every column, from one pass over all rows."""
    shares = [i / BINS for i in range(1, BINS)]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(value(c), shares, 10_000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(cuts or [], dtype=float)) for cuts in row]


def _sampled(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows; all rows where there are no more.

    Equal rows are counted, and each kind gives its share of copies, rounded up or down by a hash of its values.  So the
    number of rows and the shares of values stay what they are even where few kinds of rows make up the whole table.
    """
    count = rows.count()
    if count <= bound:
        return rows
    names = rows.columns
    draw = F.pmod(F.xxhash64(*names, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    kinds = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    taken = kinds.withColumn("_n", F.floor(F.col("_n") * (bound / count) + draw).cast("int")).filter("_n > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*names)


_BINNED = "fold int, held boolean, label int, weight double, bins binary"
_BINNED_ARROW = pa.schema([("fold", pa.int32()), ("held", pa.bool_()), ("label", pa.int32()), ("weight", pa.float64()), ("bins", pa.binary())])
_BLOCKS = "fold int, held boolean, n long, bins binary, labels binary, weights binary, counts binary"
_BLOCKS_ARROW = pa.schema([("fold", pa.int32()), ("held", pa.bool_()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("bins", "labels", "weights", "counts")]])


def _bin(stream: Iterator[pa.RecordBatch], edges: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (fold, held, label, weight, values...) with a byte for every value."""
    for batch in stream:
        values = np.array([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(4, batch.num_columns)]).reshape(len(edges), -1)
        lines = np.ascontiguousarray(bin_columns(values, edges).T)
        offsets = np.arange(len(lines) + 1, dtype=np.int32) * len(edges)
        bins = pa.Array.from_buffers(pa.binary(), len(lines), [None, pa.py_buffer(offsets), pa.py_buffer(lines)])
        yield pa.record_batch([*[batch.column(i).cast(_BINNED_ARROW[i].type) for i in range(4)], bins], schema=_BINNED_ARROW)


def _pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds (fold, held, label, weight, bins, count) as blocks of bytes, one per fold and role of a batch."""
    for batch in stream:
        fold, held, label, weight, bins, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        for f, h in sorted(set(zip(fold.tolist(), held.tolist()))):
            inside = np.flatnonzero((fold == f) & (held == h))
            row = (f, h, len(inside), b"".join(bins[inside]), label[inside].astype(np.int8).tobytes(), weight[inside].astype(float).tobytes(), count[inside].astype(np.int64).tobytes())
            yield pa.record_batch([pa.array([v], type=t.type) for v, t in zip(row, _BLOCKS_ARROW)], schema=_BLOCKS_ARROW)


def _blocks(df: DataFrame, columns: Sequence[str], edges: list[np.ndarray], fold: Column, held: Column, result: str, weight: str | None, fit_rows: int | None, task_kinds: int) -> tuple[DataFrame, int]:
    """(blocks, number of slices they are dealt over): all kinds of rows, or those of a sample where ``fit_rows`` asks for one."""
    label = reduce(lambda found, k: F.when(F.col(result) == CLASSES[k], k).otherwise(found), range(len(CLASSES)), F.raise_error(F.lit("unknown class")).cast("int"))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(fold.cast("int"), F.coalesce(held, F.lit(False)), label, w, *[F.col(c).cast("double") for c in columns])
    rows = rows.toDF(*[f"v{i}" for i in range(len(rows.columns))])
    binned = (rows if fit_rows is None else _sampled(rows, fit_rows)).mapInArrow(lambda it: _bin(it, edges), _BINNED)
    kinds = cut_lineage(binned.groupBy(*binned.columns).agg(F.count(F.lit(1)).alias("count")))
    count = kinds.count()
    slices = min(math.ceil(count / task_kinds), df.sparkSession.sparkContext.defaultParallelism) or 1
    # a slice holds its part of every fold, whichever way the kinds were dealt before
    dealt = kinds.repartition(slices, "label", "bins", "weight") if slices > 1 else kinds
    return cut_lineage(dealt.mapInArrow(_pack, _BLOCKS)), slices


# --- fits in tasks ------------------------------------------------------------------------------

_FITS = "problem int, loss double, rounds int, model binary"
_FITS_ARROW = pa.schema([("problem", pa.int32()), ("loss", pa.float64()), ("rounds", pa.int32()), ("model", pa.binary())])


def _rows_of(blocks: list[dict], chosen: list[int], columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins of the chosen columns, labels, weights, counts) in an order that does not depend on how the kinds were dealt; kinds
    that differ in other columns only are one."""
    joined = lambda c, t: np.concatenate([np.frombuffer(b[c], dtype=t) for b in blocks]) if blocks else np.empty(0, dtype=t)
    bins = np.ascontiguousarray(joined("bins", np.uint8).reshape(-1, columns).T[chosen])
    labels, weights, counts = joined("labels", np.int8), joined("weights", float), joined("counts", np.int64)
    order = np.lexsort((weights, labels, *bins))
    bins, labels, weights, counts = bins[:, order], labels[order], weights[order], counts[order]
    other = (bins[:, 1:] != bins[:, :-1]).any(axis=0) | (labels[1:] != labels[:-1]) | (weights[1:] != weights[:-1])
    first = np.flatnonzero(np.r_[True, other][: len(order)])
    return bins[:, first], labels[first].astype(np.int64), weights[first], np.add.reduceat(counts, first) if len(first) else counts


def _fit_problem(problem: int, plan: dict, blocks: list[dict], columns: int, part: int = 0) -> Generator:
    """Steps of a fit on the blocks of slice number ``part``."""
    fit, held = ([b for b in blocks if b["held"] == h] for h in (False, True))
    bins, labels, weights, counts = _rows_of(fit, plan["columns"], columns)
    present = yield np.array([*np.bincount(labels, minlength=len(CLASSES)), sum(b["n"] for b in held)], dtype=float)
    if not present[:-1].any():
        raise ValueError(f"no rows to fit problem {problem}")
    if not present[:-1].all():
        raise ValueError(f"a class is absent from the rows of problem {problem}")
    held_rows = None
    if present[-1]:
        held_bins, held_labels, _, held_counts = _rows_of(held, plan["columns"], columns)
        held_rows = (held_bins, held_labels, held_counts)
    trees, losses = yield from boost_steps(bins, labels, weights, plan["settings"], len(CLASSES), held_rows, counts, part)
    row = (problem, min(losses, default=None), trees.rounds, trees.dump() if plan["keep"] else None)
    return pa.record_batch([pa.array([v], type=t.type) for v, t in zip(row, _FITS_ARROW)], schema=_FITS_ARROW)


def _fit_all(stream: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Rows (problem, plan, block...), all blocks of a problem one after the other."""
    problem, plan, blocks = None, None, []
    for batch in stream:
        for row in batch.to_pylist():
            if row["problem"] != problem:
                if blocks:
                    yield alone(_fit_problem(problem, json.loads(plan), blocks, columns))
                problem, plan, blocks = row["problem"], row["plan"], []
            blocks.append(row)
    if blocks:
        yield alone(_fit_problem(problem, json.loads(plan), blocks, columns))


def _fit_slices(stream: Iterator[pa.RecordBatch], columns: int, problems: Sequence[tuple[int, dict]], at_once: int) -> Iterator[pa.RecordBatch]:
    """All tasks of the stage fit the problems together, ``at_once`` side by side; each holds its slice of the kinds."""
    context = BarrierTaskContext.get()
    part, blocks = context.partitionId(), {}
    for batch in stream:
        for row in batch.to_pylist():
            blocks.setdefault(row["fold"], []).append(row)

    def exchanged(steps: Generator):
        try:
            sums = next(steps)
            while True:
                told = context.allGather(base64.b64encode(sums.tobytes()).decode())
                sums = steps.send(np.sum([np.frombuffer(base64.b64decode(t)) for t in told], axis=0))
        except StopIteration as end:
            return end.value

    for first in range(0, len(problems), at_once):
        some = enumerate(problems[first: first + at_once], first)
        found = exchanged(together([_fit_problem(i, plan, blocks.get(fold, []), columns, part) for i, (fold, plan) in some]))
        if part == 0:
            yield from found


def _run(blocks: DataFrame, slices: int, columns: int, problems: Sequence[tuple[int, dict]]) -> list:
    """One row per problem (fold, plan): all of them in one pass, a task each, or a few at once in all slices."""
    spark = blocks.sparkSession
    if slices > 1:
        # an exchange takes a second, so problems share it as long as their scores fit
        kinds = blocks.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        planned, at_once = list(problems), max(1, SLICE_SCORES // kinds)
        fitted = blocks.mapInArrow(lambda it: _fit_slices(it, columns, planned, at_once), _FITS, barrier=True)
        return sorted(fitted.collect(), key=lambda r: r.problem)
    rows = [(i, fold, json.dumps(plan)) for i, (fold, plan) in enumerate(problems)]
    table = spark.createDataFrame(rows, "problem int, fold int, plan string").repartitionByRange(len(rows), "problem")
    # at most TASK_KINDS kinds of a byte per column and 17 more
    joined = table.join(F.broadcast(blocks), "fold").select("problem", "plan", "held", "n", "bins", "labels", "weights", "counts")
    return sorted(joined.mapInArrow(lambda it: _fit_all(it, columns), _FITS).collect(), key=lambda r: r.problem)


@dataclass(frozen=True)
class BoostedFit:
    columns: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    trees: Trees

    @property
    def rounds(self) -> int:
        return self.trees.rounds

    def transform(self, df: DataFrame) -> DataFrame:
        """Append the probabilities of the three classes."""
        trees, edges = self.trees, list(self.edges)

        @F.pandas_udf(", ".join(f"{p} double" for p in PROBS))
        def probabilities(*values: pd.Series) -> pd.DataFrame:
            bins = bin_columns(np.array([v.to_numpy(dtype=float, na_value=np.nan) for v in values]), edges)
            return pd.DataFrame(softmax(trees.scores(bins)), columns=list(PROBS))

        scored = df.withColumn("_scored", probabilities(*[F.col(c).cast("double") for c in self.columns]))
        return scored.select(*df.columns, *[F.col(f"_scored.{p}").alias(p) for p in PROBS])

    def importances(self, spark, model: str) -> DataFrame:
        """Share of the gain per class and column."""
        shares = self.trees.importances(len(self.columns))
        rows = [(model, c, f, float(v)) for c, line in zip(CLASSES, shares) for f, v in zip(self.columns, line)]
        return spark.createDataFrame(rows, "model string, result_class string, feature string, importance double")


def fit_boosted(
    df: DataFrame, columns: Sequence[str], *, result: str = "result_3way", weight: str | None = None, settings: Mapping | None = None,
    validation: Column | None = None, fit_rows: int | None = None, task_kinds: int = TASK_KINDS,
) -> BoostedFit:
    """One model of three classes, learnt from all rows unless a caller sets ``fit_rows``.  Rows where ``validation`` holds are not
    learnt from: trees are added until the loss there has not improved for ``patience`` rounds, and those after the best round
    are dropped."""
    edges = quantile_edges(df, columns)
    held = F.lit(False) if validation is None else validation
    blocks, slices = _blocks(df, columns, edges, F.lit(0), held, result, weight, fit_rows, task_kinds)
    plan = {"settings": {**DEFAULT_SETTINGS, **(settings or {})}, "columns": list(range(len(columns))), "keep": True}
    return BoostedFit(tuple(columns), tuple(edges), Trees.load(bytes(_run(blocks, slices, len(columns), [(0, plan)])[0].model)))


# --- tuning -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Range:
    """A numeric setting between two ends; ``log`` spreads trials evenly over orders of magnitude."""

    low: float
    high: float
    log: bool = False

    def at(self, share: float) -> float:
        return self.low * (self.high / self.low) ** share if self.log else self.low + (self.high - self.low) * share


@dataclass(frozen=True)
class Choice:
    """One of several values."""

    values: tuple

    def at(self, share: float) -> float | int:
        return self.values[int(share * len(self.values))]


# The settings that a search varies.
SPACE: dict[str, Range | Choice] = {
    "learning_rate": Range(0.005, 0.08, log=True),
    "max_depth": Choice((2, 3, 4, 5, 6)),
    "num_leaves": Choice((3, 5, 7, 11, 15, 23)),
    "min_child_samples": Choice((20, 40, 60, 90, 130)),
    "subsample": Choice((0.65, 0.8, 1.0)),
    "colsample_bytree": Choice((0.5, 0.7, 0.85, 1.0)),
    "reg_alpha": Range(1e-3, 10.0, log=True),
    "reg_lambda": Range(0.1, 100.0, log=True),
    "min_split_gain": Choice((0.0, 0.01, 0.05, 0.2)),
    "max_bin": Choice((32, 64, 128)),
}


def _van_der_corput(number: int, base: int) -> float:
    """The digits of a number mirrored behind the point: spreads any first numbers evenly over [0, 1)."""
    share, step = 0.0, 1.0
    while number:
        step /= base
        number, digit = divmod(number, base)
        share += digit * step
    return share


def trial_settings(space: Mapping[str, Range | Choice], trials: int, offset: int = 1) -> list[dict]:
    """Evenly spread settings: one mirrored-digit sequence per setting, each in a prime base of its own.  A tree of some depth
    has no more leaves than fit it."""
    bases = [p for p in range(2, 100) if all(p % q for q in range(2, p))]
    found = [{name: r.at(_van_der_corput(offset + k, base)) for (name, r), base in zip(space.items(), bases)} for k in range(trials)]
    for settings in found:
        if {"max_depth", "num_leaves"} <= settings.keys():
            settings["num_leaves"] = max(v for v in space["num_leaves"].values if v <= min(settings["num_leaves"], 2 ** settings["max_depth"]))
    return found


def time_folds(train: DataFrame, season: str = "season", time: str = "kickoff", share: float = 0.7) -> tuple[DataFrame, object]:
    """((fold, fold_name, role, all columns), calibration season).

    The last season is only for calibration.  Every season before it but the first validates a fit on those before it;
    where there is one only, its late dates validate a fit on the earlier ``share``.
    """
    order = ordered_groups(train, season, time)
    count = order.count()
    if count < 2:
        raise ValueError("tuning needs at least two training seasons")
    placed = train.join(F.broadcast(order.select(F.col(season).alias("_s"), "position")), F.col(season) == F.col("_s")).drop("_s")
    last = order.agg(F.max("position")).first()[0]
    calibration = order.filter(F.col("position") == last).first()[season]
    first = order.agg(F.min("position")).first()[0]
    inner = placed.filter(F.col("position") < last)
    if count == 2:
        late = F.to_date(time) > F.lit(late_block_cutoff(inner, time, share).first()[0])
        folds = inner.select(
            F.lit(0).alias("fold"), F.concat(F.col(season).cast("string"), F.lit(" late")).alias("fold_name"),
            F.when(late, "validate").otherwise("fit").alias("role"), *train.columns)
        return folds, calibration
    targets = F.sequence(F.greatest(F.col("position"), F.lit(first + 1)), F.lit(last - 1))
    spread = inner.withColumn("fold", F.explode(targets))
    names = order.select(F.col("position").alias("fold"), F.col(season).cast("string").alias("fold_name"))
    role = F.when(F.col("position") == F.col("fold"), "validate").otherwise("fit")
    return spread.join(F.broadcast(names), "fold").select("fold", "fold_name", role.alias("role"), *train.columns), calibration


class Search:
    """Trials over one set of folds; every fit's validation loss and number of trees becomes a row of ``runs``."""

    def __init__(self, folds: DataFrame, feature_sets: Mapping[str, Sequence[str]], max_rounds: int, result: str = "result_3way", task_kinds: int = TASK_KINDS) -> None:
        self.folds, self.max_rounds, self.runs = folds, max_rounds, []
        self.columns = sorted({c for columns in feature_sets.values() for c in columns})
        self.places = {name: [self.columns.index(c) for c in columns] for name, columns in feature_sets.items()}
        self.names = sorted(tuple(r) for r in folds.select("fold", "fold_name").distinct().collect())
        self.result, self.task_kinds, self.blocks, self.slices = result, task_kinds, None, 1

    def run(self, trials: Sequence[tuple[int, str, Mapping]], stage: str, seeds: Sequence[int]) -> None:
        """Fits of all (trial, feature set, settings), folds and seeds in one pass."""
        if self.blocks is None:
            edges = quantile_edges(self.folds, self.columns)
            self.blocks, self.slices = _blocks(self.folds, self.columns, edges, F.col("fold"), F.col("role") == "validate", self.result, None, None, self.task_kinds)
        labels, problems = [], []
        for trial, feature_set, settings in trials:
            for fold, name in self.names:
                for seed in seeds:
                    options = {**settings, "rounds": self.max_rounds, "seed": seed + fold}
                    labels.append((trial, feature_set, stage, name, seed))
                    problems.append((fold, {"settings": options, "columns": self.places[feature_set], "keep": False}))
        for label, r in zip(labels, _run(self.blocks, self.slices, len(self.columns), problems), strict=True):
            self.runs.append((*label, r.loss, float(r.rounds)))

    def table(self) -> DataFrame:
        """One row per trial: mean and worst loss of the search and of the repeats, and the median number of trees in the
        repeats (in the search where there are none)."""
        schema = "trial int, feature_set string, stage string, fold string, seed int, loss double, rounds double"
        runs = self.folds.sparkSession.createDataFrame(self.runs, schema)

        def of(stage: str, f, column: str = "loss") -> Column:
            return f(F.when(F.col("stage") == stage, F.col(column)))

        median = lambda c: F.percentile(c, F.lit(0.5))
        return runs.groupBy("trial", "feature_set").agg(
            of("search", F.avg).alias("mean_log_loss"), of("search", F.max).alias("worst_fold_log_loss"),
            of("repeat", F.avg).alias("stability_mean_log_loss"), of("repeat", F.max).alias("stability_worst_log_loss"),
            F.coalesce(of("repeat", median, "rounds"), of("search", median, "rounds")).alias("median_rounds"),
            F.concat_ws(";", F.array_sort(F.collect_set("fold"))).alias("folds"))


def tune_boosted(
    train: DataFrame, feature_sets: Mapping[str, Sequence[str]], *, trials: int = 50, finalists: int = 5, repeats: int = 3, max_rounds: int = 2000,
    space: Mapping[str, Range | Choice] | None = None, season: str = "season", time: str = "kickoff", seed: int = 42, task_kinds: int = TASK_KINDS,
) -> tuple[DataFrame, dict, object]:
    """(trials with rank and selection, settings of the selected one, calibration season).

    All trials are scored on the folds with early stopping.  The ``finalists`` of least mean and worst loss are fitted
    again with ``repeats`` other seeds; of those the most stable is selected, its number of trees frozen at the median.
    """
    folds, calibration = time_folds(train, season, time)
    read = sorted({c for columns in feature_sets.values() for c in columns})
    folds = cut_lineage(folds.select("fold", "fold_name", "role", "result_3way", *read))
    search, names = Search(folds, feature_sets, max_rounds, task_kinds=task_kinds), list(feature_sets)
    designs = trial_settings(space or SPACE, trials)
    planned = [(k, names[k % len(names)], settings) for k, settings in enumerate(designs)]
    search.run(planned, "search", [seed])
    near = search.table().orderBy("mean_log_loss", "worst_fold_log_loss", "trial").limit(finalists).select("trial").collect()
    search.run([planned[k] for (k,) in near], "repeat", [seed + 100 + 10 * r for r in range(repeats)])
    order = [F.col(c).asc_nulls_last() for c in ("stability_mean_log_loss", "stability_worst_log_loss", "mean_log_loss", "trial")]
    ranked = search.table().withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # one row per trial
    described = train.sparkSession.createDataFrame([(k, *map(float, s.values())) for k, s in enumerate(designs)], ["trial", *designs[0]])
    table = ranked.join(described, "trial").withColumn("selected", F.col("rank") == 1)
    best = table.filter("selected").first()
    chosen = {**designs[best.trial], "rounds": max(int(best.median_rounds), LEAST_ROUNDS), "seed": seed}
    return table, {"feature_set": best.feature_set, "settings": chosen}, calibration


@dataclass(frozen=True)
class TunedBoosting:
    """A tuned model with a frozen calibrator fitted on the season before the test."""

    fit: BoostedFit
    method: str
    calibration: dict
    trials: DataFrame
    raw_log_loss: float
    calibrated_log_loss: float

    def raw(self, df: DataFrame) -> DataFrame:
        return self.fit.transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        return _calibrate(self.fit.transform(df), self.method, self.calibration)


def _calibrate(df: DataFrame, method: str, parameters: dict) -> DataFrame:
    return apply_temperature(df, parameters["temperature"]) if method == "temperature" else apply_vector_scaling(df, parameters)


def fit_tuned_boosting(
    train: DataFrame, feature_sets: Mapping[str, Sequence[str]], *, method: str = "temperature", season: str = "season", time: str = "kickoff", **options,
) -> TunedBoosting:
    """Tune on the earlier seasons, fit the calibrator on the last one, and fit all seasons with both frozen."""
    trials, chosen, last = tune_boosted(train, feature_sets, season=season, time=time, **options)
    columns, settings = feature_sets[chosen["feature_set"]], chosen["settings"]
    is_last, loss = F.col(season) == F.lit(last), F.avg(log_loss(epsilon=1e-12))
    scored = fit_boosted(train.filter(~is_last), columns, settings=settings).transform(train.filter(is_last)).persist()
    parameters = {"temperature": fit_temperatures(scored, []).first()["temperature"]} if method == "temperature" else fit_vector_scaling(scored)
    before, after = scored.agg(loss).first()[0], _calibrate(scored, method, parameters).agg(loss).first()[0]
    scored.unpersist()
    return TunedBoosting(fit_boosted(train, columns, settings=settings), method, parameters, trials, before, after)
