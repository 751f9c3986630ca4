"""Many small regressions fitted at once.

Every iteration is one pass: tasks add up loss, gradient and curvature of each problem over their own
rows, Spark sums these by problem, and the driver solves one small system per problem.  What reaches
the driver does not depend on the number of rows.  When the systems together would be large, problems
are taken in slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRIVER_VALUES = 20_000_000


@dataclass
class Fit:
    """State of one problem."""

    theta: np.ndarray
    loss: float = np.inf
    best: np.ndarray | None = None
    step: np.ndarray | None = None
    done: bool = False
    iterations: int = 0


Partials = Callable[[pd.DataFrame, Mapping[str, np.ndarray]], Iterable[tuple[str, float, np.ndarray, np.ndarray]]]


def _packed(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size)


def one_pass(df: DataFrame, partials: Partials, thetas: Mapping[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Sum (loss, gradient, curvature) of every problem over all rows."""
    shared = df.sparkSession.sparkContext.broadcast(dict(thetas))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, loss, gradient, hessian in partials(batch, shared.value):
                flat = np.concatenate([[loss], gradient, hessian[_packed(len(gradient))]])
                sums[key] = sums[key] + flat if key in sums else flat
        for key, flat in sums.items():
            yield pd.DataFrame({"key": key, "i": np.arange(len(flat)), "v": flat})

    rows = df.mapInPandas(run, "key string, i int, v double").groupBy("key", "i").agg(F.sum("v").alias("v")).toPandas()
    shared.unpersist()
    out = {}
    for key, part in rows.groupby("key"):
        flat = part.sort_values("i")["v"].to_numpy()
        size = len(thetas[key])
        hessian = np.zeros((size, size))
        hessian[_packed(size)] = flat[1 + size:]
        out[key] = (flat[0], flat[1: 1 + size], hessian + np.triu(hessian, 1).T)
    return out


def minimise(
    df: DataFrame,
    start: Mapping[str, np.ndarray],
    partials: Partials,
    *,
    penalty: Callable[[str, np.ndarray], tuple[float, np.ndarray, np.ndarray]] | None = None,
    bounds: Callable[[str], tuple[np.ndarray, np.ndarray]] | None = None,
    tolerance: float = 1e-9,
    max_iterations: int = 60,
) -> dict[str, Fit]:
    """Damped Newton steps for all problems together, until no parameter moves by ``tolerance``.

    A step that does not lower the loss is halved.  ``penalty`` adds (value, gradient, curvature) and
    ``bounds`` clips the parameters.  Problems are solved in slices of bounded total size.
    """
    fits: dict[str, Fit] = {}
    names = sorted(start)
    per_slice = max(1, DRIVER_VALUES // max(len(v) ** 2 for v in start.values()))
    for first in range(0, len(names), per_slice):
        fits.update(_minimise_slice(df, {n: start[n] for n in names[first: first + per_slice]}, partials, penalty, bounds, tolerance, max_iterations))
    return fits


def _minimise_slice(df, start, partials, penalty, bounds, tolerance, max_iterations):
    fits = {k: Fit(np.array(v, dtype=float)) for k, v in start.items()}
    limits = {k: bounds(k) for k in fits} if bounds else {}
    for _ in range(max_iterations):
        active = {k: f.theta for k, f in fits.items() if not f.done}
        if not active:
            break
        found = one_pass(df, partials, active)
        for key in active:
            fit = fits[key]
            if key not in found:
                raise ValueError(f"problem {key} has no rows")
            loss, gradient, hessian = found[key]
            if penalty:
                p, dp, hp = penalty(key, fit.theta)
                loss, gradient, hessian = loss + p, gradient + dp, hessian + hp
            fit.iterations += 1
            slack = 1e-12 * max(1.0, abs(fit.loss)) if np.isfinite(fit.loss) else 0.0
            if not np.isfinite(loss) or loss > fit.loss + slack:
                if fit.best is None:
                    raise ValueError(f"problem {key} starts outside its domain")
                fit.step = fit.step / 2
            else:
                fit.loss, fit.best = loss, fit.theta
                fit.step = -_solve(hessian, gradient, fit.theta, limits.get(key))
            fit.theta = fit.best + fit.step
            if key in limits:
                fit.theta = np.clip(fit.theta, *limits[key])
            if np.max(np.abs(fit.theta - fit.best)) < tolerance:
                fit.theta, fit.done = fit.best, True
    open_ = sorted(k for k, f in fits.items() if not f.done)
    if open_:
        raise ValueError(f"no convergence in {max_iterations} iterations: {open_[:5]}")
    for fit in fits.values():
        fit.theta = fit.best
    return fits


def _solve(hessian: np.ndarray, gradient: np.ndarray, theta: np.ndarray, limits) -> np.ndarray:
    """Least-squares solution over the parameters that are not pressed against a bound."""
    free = np.ones(len(theta), dtype=bool)
    if limits is not None:
        low, high = limits
        free = ~(((theta <= low) & (gradient > 0)) | ((theta >= high) & (gradient < 0)))
    step = np.zeros(len(theta))
    if free.any():
        step[free] = np.linalg.lstsq(hessian[np.ix_(free, free)], gradient[free], rcond=1e-12)[0]
    return step


@dataclass
class Problem:
    """A multinomial regression: which rows train it and which columns it uses (already named in the data)."""

    key: str
    columns: tuple[str, ...]
    seasons: tuple
    group: object | None = None
    group_weights: Mapping[object, float] = field(default_factory=dict)
    means: np.ndarray | None = None
    scales: np.ndarray | None = None


def group_moments(df: DataFrame, columns: Sequence[str], season: str, group: str) -> pd.DataFrame:
    """Count, mean and population variance per (season, group) and column: one aggregation, one row each."""
    stats = [c for n in columns for c in (F.avg(n).alias(f"m_{n}"), F.var_pop(n).alias(f"v_{n}"))]
    return df.groupBy(season, group).agg(F.count(F.lit(1)).alias("n"), *stats).toPandas()


def prepare_problems(problems: Sequence[Problem], moments: pd.DataFrame, season: str, group: str, equal_groups: bool) -> list[Problem]:
    """Fill in weights (equal totals per group for pooled problems), weighted means and population scales."""
    for p in problems:
        rows = moments[moments[season].isin(p.seasons)]
        if p.group is not None:
            rows = rows[rows[group] == p.group]
        sizes = rows.groupby(group)["n"].sum()
        if rows.empty:
            raise ValueError(f"problem {p.key} has no training rows")
        if p.group is None and equal_groups:
            p.group_weights = {g: sizes.sum() / len(sizes) / n for g, n in sizes.items()}
        w = rows["n"].to_numpy(float) * np.array([p.group_weights.get(g, 1.0) for g in rows[group]])
        m = rows[[f"m_{c}" for c in p.columns]].to_numpy(float)
        v = rows[[f"v_{c}" for c in p.columns]].to_numpy(float)
        p.means = (w[:, None] * m).sum(0) / w.sum()
        scale = np.sqrt((w[:, None] * (v + (m - p.means) ** 2)).sum(0) / w.sum())
        p.scales = np.where(scale > 0, scale, 1.0)
    return list(problems)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _design(values: np.ndarray, p: Problem) -> np.ndarray:
    x = (values - p.means) / p.scales
    return np.hstack([np.ones((len(x), 1)), x])


CLASS_CODES = {"H": 0, "D": 1, "A": 2}


def _problem_places(batch: pd.DataFrame, problems: Sequence[Problem], season: str, group: str):
    """Every problem with the places of its rows in the batch; problems without rows there are left out."""
    by_group = {None: np.arange(len(batch)), **batch.groupby(group).indices} if len(batch) else {}
    found: dict[tuple, np.ndarray] = {}
    for p in problems:
        if (p.group, p.seasons) not in found:
            places = by_group.get(p.group, np.empty(0, dtype=int))
            found[p.group, p.seasons] = places[batch[season].isin(p.seasons).to_numpy()[places]]
        if len(found[p.group, p.seasons]):
            yield p, found[p.group, p.seasons]


def _class_codes(results: pd.Series) -> np.ndarray:
    """Codes of the classes; -1 for a row without one, which no problem may learn from."""
    return results.map(CLASS_CODES).fillna(-1).to_numpy(int)


class _Stack:
    """Problems that use the same columns: one design matrix and one product of matrices serve them all.

    Rows are standardised once for the stack; each problem's own standardisation is a linear map of that, which is applied
    to its coefficients and sums instead of its rows.
    """

    def __init__(self, columns: tuple[str, ...], problems: Sequence[Problem]) -> None:
        self.columns, self.problems, self.size = list(columns), problems, len(columns) + 1
        self.means, self.scales = np.mean([p.means for p in problems], axis=0), np.mean([p.scales for p in problems], axis=0)
        self.maps = {}
        for p in problems:
            own = np.eye(self.size)
            own[1:, 1:] = np.diag(self.scales / p.scales)
            own[1:, 0] = (self.means - p.means) / p.scales
            self.maps[p.key] = own
        self.pairs = np.triu_indices(self.size)

    def design(self, batch: pd.DataFrame, order: np.ndarray) -> np.ndarray:
        x = np.ones((len(batch), self.size))
        x[:, 1:] = (batch[self.columns].to_numpy(float)[order] - self.means) / self.scales
        return x

    def add(self, sums: dict, x: np.ndarray, y: np.ndarray, weights: Mapping[str, float], thetas: Mapping[str, np.ndarray]) -> None:
        """Add the sums over some rows to those of the problems that have a weight for them."""
        keys, n = list(weights), len(x)
        # classes first, then problems: every step below works on whole (rows, problems) tables
        theta = np.stack([thetas[k].reshape(3, -1) @ self.maps[k] for k in keys], axis=1)
        z = (x @ theta.reshape(-1, self.size).T).reshape(n, 3, len(keys))
        e = np.exp(z - np.maximum(np.maximum(z[:, 0], z[:, 1]), z[:, 2])[:, None])
        prob = e / (e[:, 0] + e[:, 1] + e[:, 2])[:, None]
        loss = -np.log(prob[np.arange(n), y]).sum(axis=0)
        curves = np.concatenate([prob[:, a] * ((a == b) - prob[:, b]) for a, b in _CLASS_PAIRS], axis=1)
        curvature = (curves.T @ (x[:, self.pairs[0]] * x[:, self.pairs[1]])).reshape(len(_CLASS_PAIRS), len(keys), -1).swapaxes(0, 1)
        prob[np.arange(n), y] -= 1
        gradient = (prob.reshape(n, -1).T @ x).reshape(3, len(keys), -1).swapaxes(0, 1)
        for i, k in enumerate(keys):
            flat = weights[k] * np.concatenate([[loss[i]], gradient[i].ravel(), curvature[i].ravel()])
            sums[k] = sums[k] + flat if k in sums else flat

    def mapped(self, key: str, flat: np.ndarray) -> tuple[str, float, np.ndarray, np.ndarray]:
        """(problem, loss, gradient, curvature) on the problem's own standardised columns."""
        own, size = self.maps[key], self.size
        gradient = flat[1: 1 + 3 * size].reshape(3, size) @ own.T
        hessian = np.empty((3 * size, 3 * size))
        for (a, b), packed in zip(_CLASS_PAIRS, flat[1 + 3 * size:].reshape(len(_CLASS_PAIRS), -1)):
            block = np.zeros((size, size))
            block[self.pairs] = packed
            block = own @ (block + np.triu(block, 1).T) @ own.T
            hessian[a * size:(a + 1) * size, b * size:(b + 1) * size] = block
            hessian[b * size:(b + 1) * size, a * size:(a + 1) * size] = block.T
        return key, float(flat[0]), gradient.ravel(), hessian


_CLASS_PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def _multinomial_partials(batch: pd.DataFrame, thetas: Mapping[str, np.ndarray], stacks: Sequence[_Stack], season: str, group: str, result: str):
    """Loss, gradient and curvature of every problem over a batch, cell (season, group) by cell: a problem's weight is the
    same for all rows of a cell."""
    s_codes, seasons = pd.factorize(batch[season], use_na_sentinel=False)
    g_codes, groups = pd.factorize(batch[group], use_na_sentinel=False)
    cells = s_codes * len(groups) + g_codes
    order = np.argsort(cells, kind="stable")
    found, starts = np.unique(cells[order], return_index=True)
    ends = [*starts[1:], len(batch)]
    y = _class_codes(batch[result])[order]
    inside: dict[tuple, np.ndarray] = {}
    for stack in stacks:
        problems, sums = [p for p in stack.problems if p.key in thetas], {}
        if not problems:
            continue
        x = stack.design(batch, order)
        for p in problems:
            if p.seasons not in inside:
                inside[p.seasons] = pd.Series(seasons).isin(p.seasons).to_numpy()
        for cell, lo, hi in zip(found.tolist(), starts, ends):
            s, g = divmod(cell, len(groups))
            weights = {p.key: p.group_weights.get(groups[g], 1.0) for p in problems if inside[p.seasons][s] and (p.group is None or p.group == groups[g])}
            if weights:
                if (y[lo:hi] < 0).any():
                    raise ValueError("a training row has no outcome class")
                stack.add(sums, x[lo:hi], y[lo:hi], weights, thetas)
        for key, flat in sums.items():
            yield stack.mapped(key, flat)


def fit_multinomials(df: DataFrame, problems: Sequence[Problem], *, season: str = "season", group: str = "league", result: str = "result_3way",
                     c: float = 1.0, tolerance: float = 1e-8) -> dict[str, np.ndarray]:
    """Coefficients (3 classes x intercept and features, on standardised columns) of every problem.

    The objective is the weighted log loss plus 1/(2c) times the squared coefficients, intercepts free.
    """
    used = sorted({n for p in problems for n in p.columns})
    rows = df.select(season, group, result, *used).persist()
    together: dict[tuple, list[Problem]] = {}
    for p in problems:
        together.setdefault(tuple(p.columns), []).append(p)
    stacks = [_Stack(columns, same) for columns, same in together.items()]

    def partials(batch, thetas):
        return _multinomial_partials(batch, thetas, stacks, season, group, result)

    def penalty(key, theta):
        mask = np.ones((3, len(theta) // 3))
        mask[:, 0] = 0
        mask = mask.ravel() / c
        return 0.5 * float(mask @ theta**2), mask * theta, np.diag(mask)

    start = {p.key: np.zeros(3 * (len(p.columns) + 1)) for p in problems}
    fits = minimise(rows, start, partials, penalty=penalty, tolerance=tolerance)
    rows.unpersist()
    return {k: f.theta.reshape(3, -1) for k, f in fits.items()}


def score_multinomials(df: DataFrame, problems: Sequence[Problem], coefficients: Mapping[str, np.ndarray], tests: Mapping[str, object], *,
                       season: str = "season", group: str = "league", result: str = "result_3way") -> DataFrame:
    """Per (problem, group): test rows, log loss and Brier score on the problem's test season."""
    used = sorted({n for p in problems for n in p.columns})
    specs = [Problem(p.key, tuple(p.columns), (tests[p.key],), p.group, {}, p.means, p.scales) for p in problems]
    types = dict(df.dtypes)

    def run(batches):
        for batch in batches:
            codes = _class_codes(batch[result])
            values = {p.columns: batch[list(p.columns)].to_numpy(float) for p in specs}
            for p, places in _problem_places(batch, specs, season, group):
                prob = softmax(_design(values[p.columns][places], p) @ coefficients[p.key].T)
                y = codes[places]
                if (y < 0).any():
                    raise ValueError("a scored row has no outcome class")
                hit = np.eye(3)[y]
                scores = pd.DataFrame({
                    group: batch[group].to_numpy()[places], "l": -np.log(np.clip(prob[np.arange(len(y)), y], 2.220446049250313e-16, 1)), "b": ((prob - hit) ** 2).sum(1)})
                sums = scores.groupby(group).agg(n=("l", "size"), l=("l", "sum"), b=("b", "sum")).reset_index()
                sums.insert(0, "key", p.key)
                yield sums

    rows = df.select(season, group, result, *used).mapInPandas(run, f"key string, {group} {types[group]}, n long, l double, b double")
    return rows.groupBy("key", group).agg(F.sum("n").alias("matches"), (F.sum("l") / F.sum("n")).alias("log_loss"), (F.sum("b") / F.sum("n")).alias("brier_score"))


def predict_multinomials(df: DataFrame, problems: Sequence[Problem], coefficients: Mapping[str, np.ndarray], tests: Mapping[str, object], identity: Sequence[str], *,
                         season: str = "season", group: str = "league") -> DataFrame:
    """Probabilities of every problem on its test season, with the identity columns and the problem's key."""
    used = sorted({n for p in problems for n in p.columns})
    specs = [Problem(p.key, tuple(p.columns), (tests[p.key],), p.group, {}, p.means, p.scales) for p in problems]
    keep = list(dict.fromkeys([*identity, season, group]))
    types = dict(df.dtypes)
    schema = "key string, " + ", ".join(f"{c} {types[c]}" for c in keep) + ", prob_H double, prob_D double, prob_A double"

    def run(batches):
        for batch in batches:
            values = {p.columns: batch[list(p.columns)].to_numpy(float) for p in specs}
            found = list(_problem_places(batch, specs, season, group))
            if found:
                out = batch[keep].take(np.concatenate([places for _, places in found]))
                out.insert(0, "key", np.repeat(np.array([p.key for p, _ in found], dtype=object), [len(places) for _, places in found]))
                out[["prob_H", "prob_D", "prob_A"]] = np.concatenate(
                    [softmax(_design(values[p.columns][places], p) @ coefficients[p.key].T) for p, places in found])
                yield out

    return df.select(*dict.fromkeys([*keep, *used])).mapInPandas(run, schema)
