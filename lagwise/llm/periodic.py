"""Runs of repeated word sequences, found with string synchronising sets.

At the dyadic scale t, a position is selected when the hash of its t words or of the t words that start t later is the
least among the t + 1 windows between them; windows that lie in a run of period t/4 or less, known from smaller scales,
are left out.  Selection depends on 2t words only, so inside a run of period q a position is selected exactly if the one
q later is, and every t positions hold a selected one for t <= q <= 2t.  Two neighbouring selected positions with equal
2t words therefore propose the period of every run of four periods; a proposal is compared word by word and extended
as far as it holds.  The scale 1 finds the periods 1 and 2, whose regions the larger scales omit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import map_arrow, read, utf8
from lagwise.llm.registry import query

#: A run holds its period at least so often, and has at least so many words.
PERIODS, LEAST_WORDS = 4, 6
#: Words searched at once (more only if one text has more).
SLICE_WORDS = 200_000

_BLANK = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.uint64).max

Run = tuple[int, int, int]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * _MULTIPLIER + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Least of every ``span`` neighbours, a power of two."""
    have = 1
    while have < span:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return values


def _selected(windows: np.ndarray, scale: int, covered: np.ndarray) -> np.ndarray:
    """Positions of the synchronising set; ``windows`` are the hashes of the words from each position on."""
    ranks = np.where(covered, _NONE, _mix(windows, np.uint64(scale)) >> np.uint64(1))
    least = np.minimum(_least(ranks, scale)[:len(ranks) - scale], ranks[scale:])
    chosen = (least != _NONE) & ((least == ranks[:-scale]) | (least == ranks[scale:]))
    return np.flatnonzero(chosen)


def _reach(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, in the direction ``step``, equal those a period later."""
    n, done, size = len(words) - period, 0, 64
    while True:
        lo, hi = (at + done, min(at + done + size, n)) if step > 0 else (max(at - done - size + 1, 0), at - done + 1)
        if lo >= hi:
            return done
        other = np.flatnonzero(words[lo:hi] != words[lo + period:hi + period])
        if len(other):
            return done + int(other[0] if step > 0 else hi - lo - 1 - other[-1])
        done += hi - lo
        size = min(2 * size, 1 << 16)


def find_runs(words: np.ndarray, longest: int | None = None) -> list[Run]:
    """(start, length, period) of every maximal run of at least ``PERIODS`` smallest periods, by start, then period.

    ``words`` are numbers, equal for equal words; no run is longer than ``longest``.
    """
    n = len(words)
    longest = n if longest is None else longest
    runs: list[Run] = []
    windows = _mix(words.astype(np.uint64), np.uint64(0x5851F42D4C957F2D))
    scale = 1
    while PERIODS * scale <= longest and len(windows) > scale:
        covered = np.zeros(len(windows) + 1, dtype=np.int64)
        for start, length, period in runs:
            if PERIODS * period <= scale <= length:
                covered[start] += 1
                covered[start + length - scale + 1] -= 1
        chosen = _selected(windows, scale, np.cumsum(covered[:-1]) > 0)
        doubled = _mix(windows[:-scale], windows[scale:])
        context = doubled[chosen]
        order = np.argsort(context, kind="stable")
        place, context = chosen[order], context[order]
        period = np.diff(place)
        likely = (np.diff(context.view(np.int64)) == 0) & (period >= scale) & (period <= 2 * scale)
        place, period = place[:-1][likely], period[likely]
        order = np.lexsort((place, period))
        place, period = place[order].tolist(), period[order].tolist()
        last = (0, 0)  # the period compared last, and up to where its last stretch reaches
        for at, q in zip(place, period):
            if last[0] == q and at < last[1]:
                continue
            end = at + _reach(words, at, q, 1) + q
            start = at + 1 - _reach(words, at, q, -1)
            last = (q, end - q)
            if end - start >= PERIODS * q:
                runs.append((start, end - start, q))
        windows = doubled
        scale *= 2
    return sorted(set(runs), key=lambda r: (r[0], r[2]))


def words_of(text: bytes) -> list[bytes]:
    return [w for w in text.translate(_BLANK).split(b" ") if w]


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a tenth of the documents, chosen by id, repeat a stretch from some word on."""
    h = 1 if doc_id is None else crc32(b"%d" % doc_id)
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts in one row, each text followed by a number of its own, and where each text starts."""
    known: dict[bytes, int] = {}
    total = sum(map(len, texts)) + len(texts)
    row = np.empty(total, dtype=np.int64)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, words in enumerate(texts):
        a = int(starts[i])
        row[a:a + len(words)] = [known.setdefault(w, len(known)) for w in words]
        row[a + len(words)] = -1 - i
        starts[i + 1] = a + len(words) + 1
    return row, starts


def runs_of_texts(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of every text that have ``LEAST_WORDS`` words; one search over all texts."""
    row, starts = _numbered(texts)
    found: list[list[Run]] = [[] for _ in texts]
    for start, length, period in find_runs(row, max(map(len, texts), default=0)):
        if length >= LEAST_WORDS:
            i = int(np.searchsorted(starts, start, side="right")) - 1
            found[i].append((start - int(starts[i]), length, period))
    return found


def highest(runs: list[Run]) -> Run | None:
    """The run of the greatest length per period; of equal ones the first, then the one of the shortest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that repeat earlier ones of a run."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


_RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS_ARROW = pa.schema([
    ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")],
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def _slices(stream: Iterator[pa.RecordBatch], rewrite: bool) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    for batch in stream:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            words = words_of(text)
            if ids and size + len(words) > SLICE_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(rewritten(words, doc_id) if rewrite else words)
            size += len(words) + 1
        if ids:
            yield ids, texts


def _search(stream: Iterator[pa.RecordBatch], rewrite: bool, whole: bool) -> Iterator[pa.RecordBatch]:
    names = ("start", "length", "period")
    for ids, texts in _slices(stream, rewrite):
        rows = []
        for doc_id, words, runs in zip(ids, texts, runs_of_texts(texts)):
            best = highest(runs)
            kept = b" ".join(collapsed(words, runs))
            lines = b"".join(b"%d,%d,%d\n" % run for run in runs)
            rows.append((
                doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest(),
                [dict(zip(names, run)) for run in runs] if whole else None, kept.decode() if whole else None))
        for at in range(0, len(rows), 2_000):
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows[at:at + 2_000]), _RUNS_ARROW)], schema=_RUNS_ARROW)


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False, whole: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: its number of runs, the run of greatest length per period (nulls if there is none),
    digests of all runs and of the text without repetitions, and, if ``whole``, ``runs`` and ``collapsed`` themselves.

    ``rewrite`` first makes a tenth of the documents periodic from some word on, chosen by id.  A null text has no word, a
    row with a null id is never rewritten, equal rows each give their own row, and an empty table gives an empty result.
    One text is searched in one task, in memory in proportion to its words.
    """
    return map_arrow(
        docs, [F.col(id_col).cast("long"), F.col(text_col).cast("string")], lambda it: _search(it, rewrite, whole), _RUNS)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"), rewrite=True, whole=False).drop("runs", "collapsed")
