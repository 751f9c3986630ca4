"""Quality scores by naive Bayes support vectors.

A text is the set of its n-grams over two streams: character classes, in which runs of letters, digits or blanks are
one sign and every other character stands for itself, and words, each given by its letter case, its last sign and
whether it repeats a word just before.  Each n-gram's indicator is scaled by the logarithm of the ratio of its shares
in the two classes, counted over all labelled documents to learn from; a linear hinge-loss model over the scaled
indicators is fitted by dual coordinate descent, and its margin becomes a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import discard, first_row, held_out, map_arrow, read, store, utf8
from lagwise.llm.registry import query

FEATURE_BITS = 18
CHAR_ORDER = 5
WORD_ORDER = 4
#: Labelled documents of the fit itself and of its calibration; the ratios come from all labelled documents.
FIT_ROWS = 8_000
CALIBRATION_ROWS = 4_000
CUT = 0.3


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[97:123] = ord("a")
    table[128:] = ord("a")
    table[65:91] = ord("A")
    table[48:58] = ord("0")
    table[[9, 10, 11, 12, 13, 32]] = 32
    return table


_CLASS = _classes()
_RUNS = np.isin(np.arange(256), [ord("a"), ord("A"), ord("0"), 32])
_WEIGHT = np.random.default_rng(7).integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _ngrams(signs: np.ndarray, order: int, salt: int) -> list[np.ndarray]:
    """Hashed n-grams of all lengths up to ``order``."""
    found, key = [], np.zeros(len(signs), dtype=np.uint64)
    signs = signs.astype(np.uint64) + np.uint64(1)
    for n in range(1, order + 1):
        if len(signs) < n:
            break
        key = (key[:len(signs) - n + 1] + signs[n - 1:]) * _STEP
        key ^= key >> np.uint64(29)
        found.append(np.unique((key + np.uint64(salt * 97 + n)) * _STEP >> np.uint64(64 - FEATURE_BITS)))
    return found


def features(text: bytes) -> np.ndarray:
    """Sorted distinct feature numbers of a text; empty for an empty one."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int32)
    kinds = _CLASS[raw]
    kept = np.ones(len(kinds), dtype=bool)
    kept[1:] = (kinds[1:] != kinds[:-1]) | ~_RUNS[kinds[1:]]
    parts = _ngrams(kinds[kept], CHAR_ORDER, 1)
    inside = kinds != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts):
        letters = raw[inside].astype(np.uint64)
        length = ends - starts
        first = np.cumsum(length) - length
        place = np.arange(len(letters)) - np.repeat(first, length)
        words = np.add.reduceat(letters * _WEIGHT[place & 63], first)
        again = np.zeros(len(words), dtype=np.int64)
        again[1:] |= words[1:] == words[:-1]
        again[2:] |= 2 * (words[2:] == words[:-2])
        case = np.add.reduceat((kinds[inside] == ord("A")).astype(np.int64), first)
        shape = np.where(case == 0, 0, np.where(case == length, 2, 1)) + 3 * np.minimum(length // 4, 3)
        parts += _ngrams((kinds[ends - 1].astype(np.int64) * 16 + shape) * 4 + again, WORD_ORDER, 2)
    return np.unique(np.concatenate(parts)).astype(np.int32)


_FEATURES_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("features", pa.list_(pa.int32()))])


def _extract(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = first_row()
    for batch in stream:
        texts = utf8(batch.column(2))
        for at in range(0, len(texts), 1000):
            found = [features(t) for t in texts[at:at + 1000]]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            n = len(found)
            yield pa.record_batch([
                pa.array(np.arange(row, row + n)), batch.column(0).slice(at, n), batch.column(1).slice(at, n), lists], schema=_FEATURES_ARROW)
            row += n


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists without nulls."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy()[offsets[0]:offsets[-1]]


def _count_classes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: documents of either class that hold each feature; feature -1 counts the documents."""
    seen = np.zeros((2, 1 << FEATURE_BITS), dtype=np.int64)
    docs = np.zeros(2, dtype=np.int64)
    for batch in stream:
        label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, values = _lists(batch.column(1))
        owner = np.repeat(label, np.diff(offsets))
        for c in (0, 1):
            seen[c] += np.bincount(values[owner == c], minlength=seen.shape[1])
            docs[c] += int((label == c).sum())
    found = np.flatnonzero(seen.any(axis=0))
    yield pa.record_batch([
        pa.array(np.append(found, -1)), *[pa.array(np.append(seen[c][found], docs[c])) for c in (0, 1)]], names=["feature", "zeros", "ones"])


@dataclass(frozen=True)
class Model:
    """Weight per feature (ratio times hinge weight) and the logistic map of the length-adjusted margin."""

    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return 0.0
        size = np.linalg.norm(self.ratio[found])
        return float(self.weight[found].sum() / size) if size else 0.0

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -50, 50))))


def hinge_fit(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, size: int, cost: np.ndarray, rounds: int = 40, tol: float = 1e-3) -> np.ndarray:
    """Linear hinge-loss weights by dual coordinate descent; rows are (features, values), ``cost`` bounds each dual."""
    weight, dual = np.zeros(size), np.zeros(len(rows))
    square = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            if not square[i]:
                continue
            slope = sign[i] * float(weight[at] @ value) - 1
            moved = min(max(dual[i] - slope / square[i], 0.0), cost[i])
            step = moved - dual[i]
            if step:
                worst = max(worst, abs(step) * square[i])
                weight[at] += step * sign[i] * value
                dual[i] = moved
        if worst < tol:
            break
    return weight


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, lightly drawn to slope 1, by Newton steps."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    beta, prior = np.array([1.0, 0.0]), np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior, x.T @ (label - p) - prior @ (beta - [1.0, 0.0]))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _fit_sample(stream: Iterator[pa.RecordBatch], ratio: np.ndarray, ones: float, fit_rows: int, cost: float) -> Iterator[pa.RecordBatch]:
    """Fit and calibrate on the one batch of sampled rows (label, features); yields the weights of the features."""
    labels, found = [], []
    for batch in stream:
        offsets, values = _lists(batch.column(1))
        labels.append(batch.column(0).to_numpy())
        found += [values[lo:hi].astype(np.int64) for lo, hi in zip(offsets, offsets[1:])]
    label = np.concatenate([*labels, np.zeros(0, dtype=np.int32)]).astype(np.int64)
    cut = min(fit_rows, max(len(label) * 2 // 3, 1))
    model = Model(ratio, np.zeros(len(ratio)), 1.0, float(np.log(ones / (1 - ones))))
    if len(set(label[:cut].tolist())) == 2:
        values = [ratio[f] for f in found[:cut]]
        rows = [(f, v / max(float(np.linalg.norm(v)), 1e-12)) for f, v in zip(found, values)]
        many = np.maximum(np.bincount(label[:cut], minlength=2), 1)
        weight = hinge_fit(rows, 2.0 * label[:cut] - 1, len(ratio), cost * (cut / 2 / many)[label[:cut]])
        model = Model(ratio, weight * ratio, 1.0, 0.0)
        later = np.arange(cut if len(set(label[cut:].tolist())) == 2 else 0, len(label))
        slope, offset = _logistic(np.array([model.margin(found[i]) for i in later]), label[later])
        model = Model(ratio, model.weight, slope, offset)
    yield pa.record_batch([pa.array([model.weight.tobytes()]), pa.array([model.slope]), pa.array([model.offset])], names=["weight", "slope", "offset"])


def fit(labelled: DataFrame, *, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS, cost: float = 1.0) -> Model:
    """Model of (doc_id, label 0 or 1, features).

    The ratios count every row; the hinge fit and the calibration take the ``fit_rows`` and then the ``calibration_rows``
    rows that come first by a hash of their id and features, in one task.  The driver gets one number per feature.
    Beyond four times as many rows, only rows whose hash lies below a bound that leaves about twice as many as are taken are
    sorted; equal rows share a hash, so a table that mostly repeats a few labelled rows may leave fewer rows than that.
    """
    size, bound = 1 << FEATURE_BITS, fit_rows + calibration_rows
    counts = map_arrow(labelled, ["label", "features"], _count_classes, "feature long, zeros long, ones long")
    table = counts.groupBy("feature").agg(F.sum("zeros"), F.sum("ones")).toArrow()
    feature, *per_class = (c.to_numpy() for c in table.columns)
    seen, docs, inside = np.zeros((2, size)), np.zeros(2), feature >= 0
    for c in (0, 1):
        seen[c, feature[inside]] = per_class[c][inside]
        docs[c] = per_class[c][~inside].sum()
    share = (seen + 1) / (docs + 2)[:, None]
    ratio = np.where(seen.any(axis=0), np.log(share[1] / share[0]), 0.0)
    ones = min(max(docs[1] / docs.sum() if docs.any() else 0.5, 1e-3), 1 - 1e-3)
    rank = F.xxhash64("doc_id", "features")
    chosen = labelled.select("label", "features", rank.alias("rank"))
    if docs.sum() > 4 * bound:  # twice as many rows as are taken lie below this hash; saves sorting the others
        chosen = chosen.filter(F.col("rank") < int((4 * bound / docs.sum() - 1) * (1 << 63)))
    sample = chosen.orderBy("rank", "label").limit(bound).select("label", "features")
    row = sample.mapInArrow(lambda it: _fit_sample(it, ratio, ones, fit_rows, cost), "weight binary, slope double, offset double").first()
    if row is None:
        return Model(ratio, np.zeros(size), 1.0, float(np.log(ones / (1 - ones))))
    return Model(ratio, np.frombuffer(row.weight), row.slope, row.offset)


_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("row", pa.int64())])


def _score(stream: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        offsets, values = _lists(batch.column(3))
        score = np.array([model.score(values[a:b]) for a, b in zip(offsets, offsets[1:])])
        yield pa.record_batch([
            batch.column(1), batch.column(2), pa.array(score, type=pa.float64()), pa.array((score >= CUT).astype(np.int32)), batch.column(0)], schema=_SCORES_ARROW)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, row.

    Rows of ``labels`` join by id; null ids, null labels and labels other than 0 and 1 teach nothing, and repeated ones
    count each time.  A null text is empty; an empty text has margin 0 and so the score of the calibration's offset.
    Without labels of both classes the score is the share of label 1 learnt from, or a half.
    """
    ident = F.col(id_col).cast("long")
    found = store(map_arrow(
        docs, [ident.alias("doc_id"), held_out(ident).alias("held_out"), F.col(text_col).cast("string")], _extract,
        "row long, doc_id long, held_out boolean, features array<int>"), "features")
    known = labels.select(ident.alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    # labels grow with the corpus: both sides are dealt by id at every size
    taught = found.filter("NOT held_out").join(known.filter(~held_out(F.col("doc_id"))).hint("merge"), "doc_id")
    labelled = store(taught.select("doc_id", "label", "features"), "labelled")
    model = fit(labelled, fit_rows=fit_rows)
    discard(labelled)
    return map_arrow(found, ["row", "doc_id", "held_out", "features"], lambda it: _score(it, model), "doc_id long, held_out boolean, score double, predicted int, row long")


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("row")
