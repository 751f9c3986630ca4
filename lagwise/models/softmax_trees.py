"""Gradient-boosted trees with a softmax objective on binned columns: one problem's rows in, trees out.

Columns are binned by quantiles of the whole table, so a split is a bin and its gain comes from sums per bin.  A round
adds one tree per class, grown leaf by leaf where the gain is greatest; all trees of a round see the same gradients.

Equal rows are one kind with a count.  A problem may be cut into slices of kinds: every slice grows the same trees, since
all it decides by are sums over all slices.  Hence the steps of a fit are generators: they yield the sums of their slice and
are sent those of all.
"""

from __future__ import annotations

import io
from collections.abc import Generator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np

#: Bins of a column besides bin 0, which holds missing values.
BINS = 128
# Fixed values of the untuned model.
DEFAULT_SETTINGS = {"rounds": 100, "learning_rate": 0.03, "max_depth": 3, "num_leaves": 7, "min_child_samples": 30, "reg_lambda": 1.0, "seed": 42}
OTHERS = {"reg_alpha": 0.0, "min_split_gain": 0.0, "subsample": 1.0, "colsample_bytree": 1.0, "max_bin": BINS, "patience": 100}
#: Least curvature of a leaf.
LEAST_CURVATURE = 1e-3
#: Rows of a slice from which the part of a round is drawn by the exact number, at most; beyond, each kind draws by itself.
EXACT_DRAW = 10**9


def bin_columns(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Columns of numbers (one row per column) as bins; a missing value is bin 0."""
    out = np.empty(values.shape, dtype=np.uint8)
    for place, (column, cuts) in enumerate(zip(values, edges)):
        out[place] = np.where(np.isnan(column), 0, 1 + np.searchsorted(cuts, column, side="right"))
    return out


@dataclass
class Trees:
    """All trees of a model, one row per node; a leaf has feature -1.  ``tree`` is round * classes + class."""

    tree: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    start: np.ndarray

    @property
    def rounds(self) -> int:
        return int(self.tree[-1]) // len(self.start) + 1 if len(self.tree) else 0

    def first(self, rounds: int) -> Trees:
        keep = self.tree < rounds * len(self.start)
        return Trees(*[getattr(self, n)[keep] for n in ("tree", "feature", "bin", "left", "right", "value", "gain")], self.start)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Sum of the trees for every row (columns of ``bins``), one column per class."""
        classes, out = len(self.start), np.repeat(self.start[:, None], bins.shape[1], axis=1)
        rows = np.arange(bins.shape[1])
        roots = np.flatnonzero(np.diff(self.tree, prepend=-1))
        for root in roots.tolist():
            at = np.full(bins.shape[1], root)
            while (inner := self.feature[at] >= 0).any():
                x, n = rows[inner], at[inner]
                at[inner] = np.where(bins[self.feature[n], x] <= self.bin[n], self.left[n], self.right[n])
            out[int(self.tree[root]) % classes] += self.value[at]
        return out.T

    def importances(self, columns: int) -> np.ndarray:
        """Total gain of every column in the trees of every class, as shares."""
        classes = len(self.start)
        total = np.zeros((classes, columns))
        inner = self.feature >= 0
        np.add.at(total, (self.tree[inner] % classes, self.feature[inner]), self.gain[inner])
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **vars(self))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Trees:
        with np.load(io.BytesIO(raw)) as held:
            return cls(**{n: held[n] for n in held.files})


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def mean_log_loss(scores: np.ndarray, labels: np.ndarray) -> float:
    total, rows = total_log_loss(scores, labels, np.ones(len(labels)))
    return float(total / rows)


def total_log_loss(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(sum of the loss, number of rows)."""
    return np.array([-np.log(np.maximum(softmax(scores)[np.arange(len(labels)), labels], 1e-12)) @ counts, counts.sum()])


def alone(steps: Generator):
    """Result of steps that know all rows."""
    try:
        sums = next(steps)
        while True:
            sums = steps.send(sums)
    except StopIteration as end:
        return end.value


def together(many: Sequence[Generator]) -> Generator:
    """Several generators side by side, the sums of all in one exchange; their results in a list."""
    results, asked = [None] * len(many), {}

    def go_on(place: int, sums: np.ndarray | None) -> None:
        asked.pop(place, None)
        try:
            asked[place] = many[place].send(sums)
        except StopIteration as end:
            results[place] = end.value

    for place in range(len(many)):
        go_on(place, None)
    while asked:
        waiting = sorted(asked.items())
        told = yield np.concatenate([sums.ravel() for _, sums in waiting])
        ends = np.cumsum([sums.size for _, sums in waiting])
        for (place, sums), end in zip(waiting, ends.tolist()):
            go_on(place, told[end - sums.size: end].reshape(sums.shape))
    return results


def draw(rng: np.random.Generator, counts: np.ndarray, share: float) -> np.ndarray:
    """How many rows of each kind are among a share of all rows, drawn without replacement."""
    total = int(counts.sum())
    if total >= EXACT_DRAW:
        return rng.binomial(counts, share)
    return rng.multivariate_hypergeometric(counts, min(total, max(1, round(share * total))), method="marginals")


class _Grower:
    """One tree over the kinds and columns of a round; ``g``, ``h`` and ``counts`` are totals of all rows of a kind."""

    def __init__(self, bins: np.ndarray, columns: np.ndarray, g: np.ndarray, h: np.ndarray, options: Mapping, counts: np.ndarray | None = None) -> None:
        self.bins, self.columns, self.g, self.h, self.options = bins, columns, g, h, options
        self.counts = np.ones(len(g)) if counts is None else counts
        self.width = BINS + 1

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Gradient, curvature and rows per column and bin."""
        out = np.empty((3, len(self.columns), self.width))
        g, h, counts = self.g[rows], self.h[rows], self.counts[rows]
        for place, c in enumerate(self.columns):
            b = self.bins[c, rows]
            out[0, place] = np.bincount(b, g, self.width)
            out[1, place] = np.bincount(b, h, self.width)
            out[2, place] = np.bincount(b, counts, self.width)
        return out

    def worth(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        shrunk = np.maximum(np.abs(g) - self.options["reg_alpha"], 0)
        return shrunk * shrunk / (h + self.options["reg_lambda"])

    def best(self, sums: np.ndarray, depth: int) -> tuple[float, int, int] | None:
        """(gain, place of the column, last bin of the left side) of the best split, the first one of equals."""
        if depth >= self.options["max_depth"]:
            return None
        left = np.cumsum(sums, axis=2)[:, :, :-1]
        total = sums[:, :1].sum(axis=2, keepdims=True)
        right = total - left
        least = self.options["min_child_samples"]
        allowed = (left[2] >= least) & (right[2] >= least) & (left[1] >= LEAST_CURVATURE) & (right[1] >= LEAST_CURVATURE)
        gain = self.worth(left[0], left[1]) + self.worth(right[0], right[1]) - self.worth(total[0], total[1])
        gain = np.where(allowed, gain, -np.inf)
        at = int(gain.argmax())
        found = float(gain.flat[at])
        return (found, at // gain.shape[1], at % gain.shape[1]) if found > max(self.options["min_split_gain"], 1e-10) else None

    def grow(self, rows: np.ndarray) -> list[list]:
        """Nodes (feature, bin, left, right, value, gain)."""
        return alone(self.steps(rows))

    def steps(self, rows: np.ndarray) -> Generator:
        sums = yield self.sums(rows)
        leaves = [(rows, sums, 0, self.best(sums, 0), 0)]
        nodes: list[list] = [[-1, 0, 0, 0, 0.0, 0.0]]
        while len(leaves) < self.options["num_leaves"]:
            ranked = [(leaf[3][0], -i) for i, leaf in enumerate(leaves) if leaf[3]]
            if not ranked:
                break
            rows, sums, depth, (gain, place, cut), node = leaves.pop(-max(ranked)[1])
            column = int(self.columns[place])
            goes_left = self.bins[column, rows] <= cut
            sides = [rows[goes_left], rows[~goes_left]]
            left = sums[2, place, : cut + 1].sum()
            small = int(sums[2, place].sum() - left < left)
            own = yield self.sums(sides[small])
            both = [own, sums - own] if small == 0 else [sums - own, own]
            nodes[node] = [column, cut, len(nodes), len(nodes) + 1, 0.0, gain]
            for side, part in zip(sides, both):
                leaves.append((side, part, depth + 1, self.best(part, depth + 1), len(nodes)))
                nodes.append([-1, 0, 0, 0, 0.0, 0.0])
        # rows that count for nothing went along, so every row knows its leaf
        self.leaves = [(rows, node) for rows, _, _, _, node in leaves]
        for _, sums, _, _, node in leaves:
            g, h = float(sums[0, 0].sum()), float(sums[1, 0].sum())
            shrunk = np.sign(g) * max(abs(g) - self.options["reg_alpha"], 0)
            nodes[node][4] = -shrunk / (h + self.options["reg_lambda"]) * self.options["learning_rate"]
        return nodes


def boost(
    bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, settings: Mapping, classes: int = 3,
    held: tuple[np.ndarray, ...] | None = None, counts: np.ndarray | None = None,
) -> tuple[Trees, list[float]]:
    """Trees and, with ``held`` (bins, labels, counts if not 1), the loss there after every round; growth then stops when the
    loss has not improved for ``patience`` rounds, and the trees up to the best round are returned.

    ``counts`` are the rows of every kind, ``weights`` the weight of one of them."""
    return alone(boost_steps(bins, labels, weights, settings, classes, held, counts))


def boost_steps(
    bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, settings: Mapping, classes: int,
    held: tuple[np.ndarray, ...] | None, counts: np.ndarray | None, part: int = 0,
) -> Generator:
    """The steps of ``boost`` on slice number ``part``."""
    options = {**OTHERS, **DEFAULT_SETTINGS, **settings}
    shift = int(BINS // options["max_bin"]).bit_length() - 1
    coarse = lambda b: ((b.astype(np.int16) - 1 >> shift) + 1).astype(np.uint8)
    rng = np.random.default_rng(options["seed"])
    # columns are drawn alike in all slices, rows are not
    row_rng = np.random.default_rng([options["seed"], part])
    bins = coarse(bins)
    counts = np.ones(len(labels), dtype=np.int64) if counts is None else counts
    whole = counts * weights
    share = yield np.bincount(labels, whole, classes)
    start = np.log(np.maximum(share / share.sum(), 1e-12))
    scores = np.repeat(start[None], len(labels), axis=0)
    target = np.eye(classes)[labels]
    if held is not None:
        held_bins, held_labels = coarse(held[0]), held[1]
        held_counts = held[2] if len(held) > 2 else np.ones(len(held_labels), dtype=np.int64)
        held_scores = np.repeat(start[None], len(held_labels), axis=0)
    rows: list[list] = []
    losses: list[float] = []
    picked = max(1, round(options["colsample_bytree"] * len(bins)))
    for turn in range(int(options["rounds"])):
        p = softmax(scores)
        drawn, mass = counts, whole
        if options["subsample"] < 1 and len(labels):
            drawn = draw(row_rng, counts, options["subsample"])
            mass = drawn * weights
        growers = []
        for k in range(classes):
            columns = np.sort(rng.choice(len(bins), picked, replace=False)) if picked < len(bins) else np.arange(len(bins))
            g = (p[:, k] - target[:, k]) * mass
            h = classes / (classes - 1) * p[:, k] * (1 - p[:, k]) * mass
            growers.append(_Grower(bins, columns, g, h, options, drawn))
        grown = yield from together([grower.steps(np.arange(len(labels))) for grower in growers])
        for k, (grower, nodes) in enumerate(zip(growers, grown)):
            base = len(rows)
            rows += [[turn * classes + k, f, b, l + base, r + base, v, gain] for f, b, l, r, v, gain in nodes]
            for place, node in grower.leaves:
                scores[place, k] += nodes[node][4]
            if held is not None:
                held_scores[:, k] += _trees(rows[base:], np.zeros(classes), base).scores(held_bins)[:, k]
        if held is not None:
            lost, rows_held = yield total_log_loss(held_scores, held_labels, held_counts)
            losses.append(float(lost / rows_held))
            if turn - int(np.argmin(losses)) >= options["patience"]:
                break
    trees = _trees(rows, start)
    # a split between coarse bins, told in fine ones
    trees.bin = np.where(trees.feature >= 0, trees.bin << shift, 0)
    return (trees.first(int(np.argmin(losses)) + 1) if losses else trees), losses


def _trees(rows: list[list], start: np.ndarray, base: int = 0) -> Trees:
    columns = list(zip(*rows)) or [()] * 7
    tree, feature, cut, left, right = (np.array(c, dtype=np.int64) for c in columns[:5])
    return Trees(tree, feature, cut, left - base, right - base, *(np.array(c, dtype=float) for c in columns[5:]), start)
