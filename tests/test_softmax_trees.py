"""Joint trees against a plain loop over rows and borders."""

import numpy as np
import pytest

from lagwise.models import softmax_trees as T

OPTIONS = {**T.OTHERS, **T.DEFAULT_SETTINGS}


def plain_tree(bins, g, h, options, depth=0, rows=None):
    """Nested tuples of the tree that splits every node, as long as it may, at the border of greatest gain."""
    rows = list(range(len(g))) if rows is None else rows

    def worth(some):
        a, b = sum(g[i] for i in some), sum(h[i] for i in some)
        return max(abs(a) - options["reg_alpha"], 0) ** 2 / (b + options["reg_lambda"])

    best = None
    if depth < options["max_depth"]:
        for c in range(len(bins)):
            for cut in sorted({int(bins[c][i]) for i in rows}):
                left, right = [i for i in rows if bins[c][i] <= cut], [i for i in rows if bins[c][i] > cut]
                if min(len(left), len(right)) < options["min_child_samples"] or min(sum(h[i] for i in s) for s in (left, right)) < 1e-3:
                    continue
                gain = worth(left) + worth(right) - worth(rows)
                if gain > max(options["min_split_gain"], 1e-10) and (best is None or gain > best[0] + 1e-12):
                    best = (gain, c, cut, left, right)
    if best is None:
        a, b = sum(g[i] for i in rows), sum(h[i] for i in rows)
        return -np.sign(a) * max(abs(a) - options["reg_alpha"], 0) / (b + options["reg_lambda"]) * options["learning_rate"]
    _, c, cut, left, right = best
    return c, cut, plain_tree(bins, g, h, options, depth + 1, left), plain_tree(bins, g, h, options, depth + 1, right)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_losses(bins, labels, weights, settings, rounds):
    options = {**OPTIONS, **settings}
    n = len(labels)
    share = [sum(w for w, y in zip(weights, labels) if y == k) / sum(weights) for k in range(3)]
    scores = [[float(np.log(s)) for s in share] for _ in range(n)]
    losses = []
    for _ in range(rounds):
        p = [[float(np.exp(v)) / sum(float(np.exp(u)) for u in s) for v in s] for s in scores]
        for k in range(3):
            g = [(p[i][k] - (labels[i] == k)) * weights[i] for i in range(n)]
            h = [1.5 * p[i][k] * (1 - p[i][k]) * weights[i] for i in range(n)]
            tree = plain_tree(bins, g, h, options)
            for i in range(n):
                scores[i][k] += plain_value(tree, bins[:, i])
        losses.append(-float(np.mean([s[y] - np.log(sum(np.exp(s))) for s, y in zip(scores, labels)])))
    return losses


def problem(n=500, columns=3, values=9, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(columns, n)) * 2)
    x[0, :7] = np.nan
    labels = np.where(np.nan_to_num(x[0]) + rng.normal(size=n) > 1, 0, np.where(x[1] * np.nan_to_num(x[0]) > 2, 2, 1))
    edges = [np.unique(c[~np.isnan(c)])[1:values] for c in x]
    return T.bin_columns(x, edges), labels, rng.uniform(0.5, 2, n)


@pytest.mark.parametrize("settings", [
    {"learning_rate": 0.3, "num_leaves": 64, "max_depth": 3, "min_child_samples": 15},
    {"learning_rate": 0.3, "num_leaves": 64, "max_depth": 2, "min_child_samples": 40, "reg_alpha": 2.0, "reg_lambda": 9.0, "min_split_gain": 1.0}])
def test_losses_of_a_plain_loop(settings):
    bins, labels, weights = problem()
    trees, _ = T.boost(bins, labels, weights, {**settings, "rounds": 4})
    got = [T.mean_log_loss(trees.first(r).scores(bins), labels) for r in range(1, 5)]
    assert got == pytest.approx(plain_losses(bins, labels, weights, settings, 4), abs=1e-9)


def test_leaves_grow_where_the_gain_is_greatest():
    """With few leaves the tree is the best-first part of the full one."""
    bins, labels, weights = problem()
    g, h = np.where(labels == 0, -1.0, 0.4) * weights, np.full(len(labels), 0.3)
    options = {**OPTIONS, "num_leaves": 4, "max_depth": 6, "min_child_samples": 10}
    nodes = T._Grower(bins.astype(np.int64), np.arange(3), g, h, options).grow(np.arange(len(labels)))
    assert sum(n[0] < 0 for n in nodes) == 4
    full = T._Grower(bins.astype(np.int64), np.arange(3), g, h, {**options, "num_leaves": 64}).grow(np.arange(len(labels)))
    frontier, taken = [0], []
    for _ in range(3):
        best = max((i for i in frontier if full[i][0] >= 0), key=lambda i: full[i][5])
        frontier = [i for i in frontier if i != best] + full[best][2:4]
        taken.append(full[best][5])
    assert sorted(n[5] for n in nodes if n[0] >= 0) == sorted(taken)


def test_early_stopping_and_coarse_bins():
    bins, labels, weights = problem(800, values=40)
    held = (bins[:, 600:], labels[600:])
    trees, losses = T.boost(bins[:, :600], labels[:600], weights[:600], {"rounds": 400, "learning_rate": 0.3, "patience": 10, "max_bin": 32, "subsample": 0.8, "colsample_bytree": 0.7}, held=held)
    best = int(np.argmin(losses))
    assert len(losses) == best + 11 and trees.rounds == best + 1
    assert T.mean_log_loss(trees.scores(held[0]), held[1]) == pytest.approx(losses[best])
    again = T.Trees.load(trees.dump())
    assert (again.scores(bins) == trees.scores(bins)).all() and again.importances(3).sum(axis=1) == pytest.approx(np.ones(3))


def test_copies_count_as_rows():
    """Kinds with counts grow the trees of the rows they stand for, and the part of a round is drawn from rows."""
    bins, labels, weights = problem(300)
    counts = np.random.default_rng(1).integers(1, 6, 300)
    rows = np.repeat(np.arange(300), counts)
    settings = {"rounds": 5, "learning_rate": 0.3, "min_child_samples": 40}
    merged, lost = T.boost(bins, labels, weights, settings, held=(bins, labels, counts), counts=counts)
    single, each = T.boost(bins[:, rows], labels[rows], weights[rows], settings, held=(bins[:, rows], labels[rows]))
    assert np.array_equal(merged.bin, single.bin) and np.allclose(merged.value, single.value) and lost == pytest.approx(each)
    drawn = T.draw(np.random.default_rng(2), counts, 0.65)
    assert drawn.sum() == round(0.65 * counts.sum()) and (drawn <= counts).all()


@pytest.mark.parametrize("share", [1.0, 0.7])
def test_slices_add_up_to_one_problem(share):
    """Problems that run side by side on slices grow the trees of whole problems; with a drawn part, all slices still agree."""
    bins, labels, weights = problem(900, values=30)
    settings = [{"rounds": 60, "learning_rate": 0.3, "patience": 5, "colsample_bytree": 0.7, "subsample": share, "seed": s} for s in (1, 2)]
    train, test = np.arange(600), np.arange(600, 900)
    whole = [T.boost(bins[:, train], labels[train], weights[train], o, held=(bins[:, test], labels[test])) for o in settings]

    def steps(part):
        a, b = train[train % 3 == part], test[test % 3 == part]
        return T.together([T.boost_steps(bins[:, a], labels[a], weights[a], o, 3, (bins[:, b], labels[b]), None, part) for o in settings])

    slices, results = [steps(part) for part in range(3)], []
    sums = [next(s) for s in slices]
    while not results:
        total, asked = np.sum(sums, axis=0), []
        for s in slices:
            try:
                asked.append(s.send(total))
            except StopIteration as end:
                results.append(end.value)
        sums = asked
    assert len(results) == 3
    for fits in results:
        for (trees, losses), (first, first_losses), (single, each) in zip(fits, results[0], whole):
            assert np.array_equal(trees.value, first.value) and losses == first_losses
            if share == 1:
                assert losses == pytest.approx(each) and np.array_equal(trees.bin, single.bin) and np.allclose(trees.value, single.value)
            else:
                assert abs(min(losses) - min(each)) < 0.1
