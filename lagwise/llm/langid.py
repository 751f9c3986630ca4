"""Language identification with hyperdimensional profiles.

Every letter has a random sign vector.  A letter n-gram binds its letters' vectors, each permuted by its place, in
one product; a text bundles the vectors of its n-grams in a sum.  A language's prototype is the bundle of all its
texts to learn from, and a text belongs to the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import held, held_out, map_arrow, read, strings
from lagwise.llm.registry import query
from lagwise.llm.tokens import slices

DIMENSIONS = 1024
ORDER = 3
SEED = 5
UNKNOWN = "und"
#: Languages that a model may have, and n-grams whose vectors a worker holds (40 MB).
MAX_LANGUAGES = 4096
HELD_NGRAMS = 20_000
#: Characters and texts bundled at once: a text takes a count per distinct n-gram of its slice.
SLICE_CHARS, SLICE_ROWS = 500_000, 512


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True at the code points of letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=65_536)
def letter_vector(code: int) -> np.ndarray:
    """Random signs of a letter; code 0 is the border of a word."""
    return np.random.default_rng([SEED, code]).choice(np.array([-1, 1], dtype=np.int8), size=DIMENSIONS)


def ngram_vector(codes: tuple[int, ...]) -> np.ndarray:
    """Product of the letters' vectors, rotated by their distance from the end."""
    bound = np.ones(DIMENSIONS, dtype=np.int8)
    for place, code in enumerate(reversed(codes)):
        bound *= np.roll(letter_vector(code), place)
    return bound


def ngram_keys(text: str) -> np.ndarray:
    """Letter n-grams of a text, 21 bits a letter; everything between words is one border.  Empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes, 0)
    if not codes.any():
        return codes[:0]
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]


class Bundler:
    """Bundles of n-gram counts; holds the vectors of the n-grams seen so far."""

    def __init__(self) -> None:
        self.keys, self.vectors = np.zeros(0, dtype=np.int64), np.zeros((0, DIMENSIONS), dtype=np.float32)

    def _places(self, distinct: np.ndarray) -> np.ndarray:
        new = distinct[~np.isin(distinct, self.keys, assume_unique=True)]
        if len(new):
            if len(self.keys) + len(new) > HELD_NGRAMS:
                self.keys, self.vectors, new = self.keys[:0], self.vectors[:0], distinct
            mask = (1 << 21) - 1
            made = [ngram_vector((k >> 42, k >> 21 & mask, k & mask)) for k in new.tolist()]
            keys = np.concatenate((self.keys, new))
            order = np.argsort(keys)
            self.keys = keys[order]
            self.vectors = np.concatenate((self.vectors, np.array(made, dtype=np.float32)))[order]
        return np.searchsorted(self.keys, distinct)

    def bundle(self, keys: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """Sum of the n-gram vectors of every owner, n-grams in stretches of the distinct ones."""
        distinct, place = np.unique(keys, return_inverse=True)
        total = np.zeros((owners, DIMENSIONS), dtype=np.float32)
        for at in range(0, len(distinct), HELD_NGRAMS // 2):
            inside = (place >= at) & (place < at + HELD_NGRAMS // 2)
            some = distinct[at:at + HELD_NGRAMS // 2]
            counts = np.bincount(owner[inside] * len(some) + place[inside] - at, minlength=owners * len(some)).reshape(owners, len(some))
            places = self._places(some)
            total += counts.astype(np.float32) @ self.vectors[places]
        return total


def bundler() -> Bundler:
    """One per worker process."""
    return held(Bundler)


def _owned(texts: list[str], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    keys = [ngram_keys(t) for t in texts]
    return np.concatenate([*keys, np.zeros(0, dtype=np.int64)]), np.repeat(np.array(owners, dtype=np.int64), [len(k) for k in keys])


_SUMS_ARROW = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))])


def _bundle_languages(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bundle per language and task."""
    sums: dict[str, np.ndarray] = {}
    for batch in stream:
        langs, texts = batch.column(0).to_pylist(), strings(batch.column(1))
        for a, b in slices(texts, SLICE_CHARS):
            names = sorted(set(langs[a:b]))
            place = {x: i for i, x in enumerate(names)}
            bundles = bundler().bundle(*_owned(texts[a:b], [place[x] for x in langs[a:b]]), len(names))
            for name, bundle in zip(names, bundles.astype(np.float64)):
                sums[name] = sums[name] + bundle if name in sums else bundle
    if sums:
        yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], type=pa.list_(pa.float64()))], schema=_SUMS_ARROW)


def learn(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Unit prototype of every language in ``docs``; all texts count, rows without language or text do not.

    Tasks bundle their texts, Spark adds the bundles; the driver gets one vector per language, so more than
    ``MAX_LANGUAGES`` languages are an error.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sums = map_arrow(known, [F.col(lang_col).cast("string"), F.col(text_col).cast("string")], _bundle_languages, "lang string, vector array<double>")
    whole = sums.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = whole.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value")))["value"].alias("vector")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    vectors = {r.lang: np.array(r.vector) for r in sorted(rows, key=lambda r: r.lang)}
    return {k: v / np.linalg.norm(v) for k, v in vectors.items() if v.any()}


_PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, row long"
_PREDICTED_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("row", pa.int64())])


def predict_texts(texts: list[str], names: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and cosine of every text; ``und`` and 0 without letters or prototypes."""
    keys, owner = _owned(texts, list(range(len(texts))))
    vectors = bundler().bundle(keys, owner, len(texts))
    length = np.linalg.norm(vectors, axis=1)
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    cosines = vectors.astype(np.float64) @ prototypes.T / np.maximum(length, 1e-9)[:, None]
    best = cosines.argmax(axis=1)
    lettered = np.bincount(owner, minlength=len(texts)) > 0
    found = [names[b] if known else UNKNOWN for b, known in zip(best, lettered)]
    return found, np.where(lettered, np.clip(cosines.max(axis=1), 0, 1), 0.0)


def _bounded(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``SLICE_ROWS`` texts and some ``SLICE_CHARS`` characters."""
    for a, b in slices(texts, SLICE_CHARS):
        for lo in range(a, b, SLICE_ROWS):
            yield lo, min(lo + SLICE_ROWS, b)


def _predict(stream: Iterator[pa.RecordBatch], names: list[str], prototypes: np.ndarray) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in stream:
        texts = strings(batch.column(2))
        for lo, hi in _bounded(texts):
            found, score = predict_texts(texts[lo:hi], names, prototypes)
            yield pa.record_batch([
                batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(found, type=pa.string()), pa.array(score),
                pa.array(np.arange(row, row + hi - lo))], schema=_PREDICTED_ARROW)
            row += hi - lo


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, row; only the text decides.

    A null text, or one without letters, is ``und`` with score 0; a null id counts as not held out.
    """
    names, matrix = list(prototypes), np.array(list(prototypes.values())).reshape(len(prototypes), DIMENSIONS)
    ident = F.col(id_col).cast("long")
    return map_arrow(
        docs, [ident.alias("doc_id"), held_out(ident).alias("held_out"), F.col(text_col).cast("string")],
        lambda it: _predict(it, names, matrix), _PREDICTED)


def _keep_known(
    stream: Iterator[pa.RecordBatch], place: int, lang: int | None, names: list[str], prototypes: np.ndarray,
) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        texts = strings(batch.column(place))
        for lo, hi in _bounded(texts):
            found, _ = predict_texts(texts[lo:hi], names, prototypes)
            some = batch.slice(lo, hi - lo)
            if lang is not None and some.column(lang).null_count:
                filled = pa.array([p if x is None else x for x, p in zip(some.column(lang).to_pylist(), found)], type=some.schema.field(lang).type)
                some = some.set_column(lang, some.schema.field(lang), filled)
            yield some.filter(pa.array([x != UNKNOWN for x in found]))


def keep_known(
    docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` whose text has a language; texts that are null or without letters go.  A null in ``lang_col``, if
    there is such a column of strings, becomes the predicted language."""
    names, matrix = list(prototypes), np.array(list(prototypes.values())).reshape(len(prototypes), DIMENSIONS)
    place = docs.columns.index(text_col)
    lang = docs.columns.index(lang_col) if dict(docs.dtypes).get(lang_col) == "string" else None
    return docs.mapInArrow(lambda it: _keep_known(it, place, lang, names, matrix), docs.schema)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that aren't held out and predict all; an empty table gives an empty result."""
    prototypes = learn(docs.filter(~held_out(F.col(id_col).cast("long"))), lang_col=lang_col, text_col=text_col)
    return predict(docs, prototypes, id_col=id_col, text_col=text_col)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents")).drop("row")
