"""Benchmark decontamination: windows of documents within a small edit distance of a benchmark item.

Item and window are word sequences.  Both are walked by the same random walk (the output repeats the current word, and
a random bit of word and step decides whether to move on), so that few edits become few differing places of the
output.  Windows whose outputs agree with an item's on all places of some random sample are candidates; the number of
samples follows from the recall aimed at.  Candidates are verified by the exact edit distance.

Walking every window of every document is not needed: with at most e edits on m words, one of the e + 1 stretches
between edits is shared word for word, so only windows placed around such a shared stretch are embedded.

Walks drift apart, so that the places they agree in grow fewer with the length.  Long items are cut into even blocks:
of an item within its edit budget at least one block is within its own, and only blocks are embedded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import first_row, map_arrow, read, strings
from lagwise.llm.registry import query

SIMILARITY = 0.8
RECALL = 0.99
#: Share of output places in which windows of a block at the edit budget still agree, places of a sample, samples of one walk.
AGREEMENT = 0.5
SAMPLED = 4
PER_WALK = 8
STRETCH = 4
#: Words of the longest block that is embedded as one; up to it the walks keep the recall for all kinds of edits.
BLOCK_WORDS = 24
#: Benchmark text that is sent to every task at once; a larger benchmark is taken in several passes.
BLOCK_BYTES = 16 << 20
#: Windows embedded at once.
WINDOWS = 20_000

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, Tai Le to Khmer symbols, Tai Tham, kana and bopomofo, ideographs, Yi,
#: Myanmar and Tai Viet extensions, compatibility ideographs, half-width kana, kana supplements, further ideographs.
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F),
    (0x20000, 0x3FFFF))


class _Plain(dict):
    """What stands for a character beyond ASCII between words: itself, a space, nothing (joiners), or itself as a word."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = category(c)
        if code < 128 or kind[0] in "LMN" and not 0xFE00 <= code <= 0xFE0F or kind == "Co":
            put = f" {c} " if any(a <= code <= b for a, b in _UNSPACED) else c
        else:
            put = "" if kind[0] == "M" or kind == "Cf" and code != 0x200B else " "
        self[code] = put
        return put


_AS_PLAIN = _Plain()


def words_of(text: str) -> list[bytes]:
    """Lower-case words between white space, punctuation and symbols; in scripts without spaces each character is a word."""
    text = text.lower()
    if not text.isascii():
        other = [c for c in set(text) if c > "\x7f" and _AS_PLAIN[ord(c)] != c]
        if len(other) > 8:
            text = text.translate(_AS_PLAIN)
        else:
            for c in other:
                text = text.replace(c, _AS_PLAIN[ord(c)])
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def budget(length: int, similarity: float) -> int:
    """Edits that leave a word sequence similar enough."""
    return int((1 - similarity) * length + 1e-9)


def stretch(length: int, similarity: float) -> int:
    """Words of the longest stretch that is surely shared, up to ``STRETCH``."""
    e = budget(length, similarity)
    return min(-(-(length - e) // (e + 1)), STRETCH)


def block_bounds(length: int) -> list[tuple[int, int]]:
    """(start, end) of the even blocks of an item."""
    count = -(-length // BLOCK_WORDS)
    return [(length * i // count, length * (i + 1) // count) for i in range(count)]


def edit_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end): the stretch of ``text`` nearest to the item by edit distance; the shortest last one of equals."""
    n = len(text)
    row, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    place = np.arange(n + 1)
    for i, word in enumerate(item, 1):
        change = row[:-1] + (text != word)
        drop = row + 1
        best = np.empty(n + 1, dtype=np.int64)
        best[0] = i
        best[1:] = np.minimum(change, drop[1:])
        source = begin.copy()
        source[1:] = np.where(change <= drop[1:], begin[:-1], begin[1:])
        # an inserted word continues the best cell on its left: carry (value - place, -start) along the row
        code = (best - place) * (2 * n + 4) - source
        least = np.minimum.accumulate(code)
        moved = -(-least // (2 * n + 4))
        row, begin = moved + place, moved * (2 * n + 4) - least
    end = n - int(np.argmin((row * (n + 2) + (place - begin))[::-1]))
    return int(row[end]), int(begin[end]), end


class Walks:
    """Random walks over word ids: ``many`` sequences of equal length at once."""

    def __init__(self, recall: float, seed: int = 17) -> None:
        samples = math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT ** SAMPLED))
        self.walks = -(-samples // PER_WALK)
        self.seed = seed

    @lru_cache(maxsize=4096)
    def places(self, walk: int, length: int) -> np.ndarray:
        """Sampled output places of a walk, one row per sample; the early two thirds are where walks still stand on words."""
        return np.random.default_rng([self.seed, walk, length]).integers(0, max(2 * length, 1), size=(PER_WALK, SAMPLED))

    def keys(self, windows: np.ndarray, walk: int) -> np.ndarray:
        """Per sequence and sample the words at the sampled places, as one number."""
        count, length = windows.shape
        places = self.places(walk, length)
        padded = np.concatenate([windows, np.zeros((count, 1), dtype=np.int64)], axis=1)
        at, rows = np.zeros(count, dtype=np.int64), np.arange(count)
        output = np.empty((count, int(places.max()) + 1), dtype=np.int64)
        for step in range(output.shape[1]):
            word = padded[rows, at]
            output[:, step] = word
            mixed = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((walk * 1_000_003 + step) * 0xC2B2AE3D27D4EB4F % (1 << 64))
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            at = np.minimum(at + (mixed >> np.uint64(63)).astype(np.int64), length)
        key = np.zeros((count, PER_WALK), dtype=np.int64)
        for j in range(SAMPLED):
            key = key * 1_000_003 + output[:, places[:, j]] + 1
        return key


class Benchmark:
    """Items of one part of the benchmark by word ids, their blocks, and the blocks' shared-stretch index and walks."""

    def __init__(self, items: Sequence[tuple[int, str]], similarity: float, recall: float) -> None:
        self.similarity, self.walks = similarity, Walks(recall)
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.items: list[np.ndarray] = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64))
        placed = [(k, a, b) for k, item in enumerate(self.items) for a, b in block_bounds(len(item))]
        #: Item of a block, its place there, its words.
        self.item_of = [k for k, _, _ in placed]
        self.offset = [a for _, a, _ in placed]
        self.blocks = [self.items[k][a:b] for k, a, b in placed]
        self.sizes = np.array([len(w) for w in self.blocks], dtype=np.int64)
        self.budgets = np.array([budget(len(w), similarity) for w in self.blocks], dtype=np.int64)
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for k, block in enumerate(self.blocks):
            q = stretch(len(block), similarity)
            by_size.setdefault(q, []).extend((int(g), k, at) for at, g in enumerate(self._grams(block, q)[1]))
        for q, rows in by_size.items():
            gram, k, at = (np.array(c, dtype=np.int64) for c in zip(*sorted(rows)))
            self.index[q] = gram, k, at
        self.keys = [np.stack([self.walks.keys(item[None, :], w)[0] for w in range(self.walks.walks)]) for item in self.blocks]

    @staticmethod
    def _grams(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the q-word stretches whose words are all known."""
        n = len(ids) - q + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        known, key = np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64)
        for j in range(q):
            part = ids[j:j + n]
            known &= part > 0
            key = key * 1_000_000_007 + part
        at = np.flatnonzero(known)
        return at, key[at]

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """(block, start) of the block-sized windows that lie around a shared stretch; rows are distinct."""
        found = []
        for q, (gram, block, offset) in self.index.items():
            at, key = self._grams(ids, q)
            lo, hi = np.searchsorted(gram, key, "left"), np.searchsorted(gram, key, "right")
            hit = np.flatnonzero(hi > lo)
            for a, l, h in zip(at[hit].tolist(), lo[hit].tolist(), hi[hit].tolist()):
                for k, s in zip(block[l:h].tolist(), offset[l:h].tolist()):
                    e = int(self.budgets[k])
                    found.append(np.stack([np.full(2 * e + 1, k), np.arange(a - s - e, a - s + e + 1)], axis=1))
        if not found:
            return np.zeros((0, 2), dtype=np.int64)
        both = np.unique(np.concatenate(found), axis=0)
        size, low = self.sizes[both[:, 0]], self.budgets[both[:, 0]]
        return both[(both[:, 1] > -size + low) & (both[:, 1] < len(ids) - low) | (both[:, 1] == 0)]

    def candidates(self, docs: list[np.ndarray], rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Of windows (doc, block, start) those that agree with their block on a whole sample of some walk."""
        kept = []
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for r in rows:
            by_length.setdefault(len(self.blocks[r[1]]), []).append(r)
        for length, some in by_length.items():
            windows = np.zeros((len(some), length), dtype=np.int64)
            for i, (d, _, start) in enumerate(some):
                ids = docs[d]
                a, b = max(start, 0), min(start + length, len(ids))
                windows[i, :max(b - a, 0)] = ids[a:b]  # a window over the border of the text starts at the text
            block = np.array([k for _, k, _ in some])
            open_ = np.arange(len(some))
            for walk in range(self.walks.walks):
                wanted = np.stack([self.keys[k][walk] for k in block[open_]])
                agree = (self.walks.keys(windows[open_], walk) == wanted).any(axis=1)
                kept += [some[i] for i in open_[agree]]
                open_ = open_[~agree]
                if not len(open_):
                    break
        return kept

    def verify(self, ids: np.ndarray, item: int, starts: list[int]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the nearest stretch around the places where candidates put the item, if it is near enough."""
        words = self.items[item]
        e, best = budget(len(words), self.similarity), None
        starts = sorted(starts)
        while starts:
            reach = [s for s in starts if s - starts[0] <= 4 * len(words)]
            # a window is off by its block's budget at most, and the item's edits before or behind the block move the ends
            a, b = max(reach[0] - 2 * e, 0), min(max(reach[-1] + len(words) + 2 * e, 0), len(ids))
            distance, lo, hi = edit_match(words, ids[a:b])
            if distance <= e and (best is None or distance < best[0]):
                best = distance, a + lo, a + hi
            starts = starts[len(reach):]
        return best


_HITS = "row long, doc_id long, item_id long, distance long, item_words long, start_word long, n_words long, similarity double"
_HITS_ARROW = pa.schema([
    *[(c, pa.int64()) for c in ("row", "doc_id", "item_id", "distance", "item_words", "start_word", "n_words")], ("similarity", pa.float64())])


@lru_cache(maxsize=4)
def _benchmark(items: tuple[tuple[int, str], ...], similarity: float, recall: float) -> Benchmark:
    return Benchmark(items, similarity, recall)


class _Search:
    """Collects documents that have windows to look at and finds their hits together."""

    def __init__(self, bench: Benchmark) -> None:
        self.bench = bench
        self.held: list[tuple[int, int | None, np.ndarray]] = []
        self.windows: list[tuple[int, int, int]] = []

    def add(self, row: int, doc_id: int | None, text: str) -> None:
        known = self.bench.vocabulary.get
        ids = np.array([known(w, 0) for w in words_of(text)], dtype=np.int64)
        placed = self.bench.windows(ids)
        if len(placed):
            self.windows += [(len(self.held), k, s) for k, s in placed.tolist()]
            self.held.append((row, doc_id, ids))

    def hits(self) -> list[tuple]:
        """Rows of the result for the documents added since the last call."""
        out, found, bench = [], {}, self.bench
        for d, block, start in bench.candidates([ids for *_, ids in self.held], self.windows):
            found.setdefault((d, bench.item_of[block]), []).append(start - bench.offset[block])
        for (d, item), starts in sorted(found.items()):
            row, doc_id, ids = self.held[d]
            if match := bench.verify(ids, item, starts):
                distance, lo, hi = match
                size = len(bench.items[item])
                out.append((row, doc_id, bench.ids[item], distance, size, lo, hi - lo, 1 - distance / size))
        self.held, self.windows = [], []
        return out


def _search(stream: Iterator[pa.RecordBatch], items: tuple[tuple[int, str], ...], similarity: float, recall: float) -> Iterator[pa.RecordBatch]:
    search, row = _Search(_benchmark(items, similarity, recall)), first_row()

    def batch_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _HITS_ARROW)], schema=_HITS_ARROW)

    for batch in stream:
        for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
            search.add(row, doc_id, text)
            row += 1
            if len(search.windows) > WINDOWS:
                yield from batch_of(search.hits())
    yield from batch_of(search.hits())


def _drop_hit(stream: Iterator[pa.RecordBatch], place: int, items: tuple[tuple[int, str], ...], similarity: float, recall: float) -> Iterator[pa.RecordBatch]:
    search = _Search(_benchmark(items, similarity, recall))
    for batch in stream:
        clean = np.ones(batch.num_rows, dtype=bool)
        for row, text in enumerate(strings(batch.column(place))):
            search.add(row, None, text)
            if len(search.windows) > WINDOWS:
                clean[[h[0] for h in search.hits()]] = False
        clean[[h[0] for h in search.hits()]] = False
        yield batch.filter(pa.array(clean))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items in blocks of about ``block_bytes`` of text; each block is small enough for driver and tasks."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for block in range(blocks):
        chosen = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else items
        yield tuple(sorted(((r.item_id, r.text) for r in chosen.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, recall: float = RECALL, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item it contains: row, doc_id, item_id, distance (word edits), item_words, start_word,
    n_words and similarity (1 - distance / item_words) of the nearest stretch.

    Items without words match nothing and items of fewer than five words only exactly; null texts are empty.  ``row`` tells
    rows with equal or null ids apart.  A benchmark above ``block_bytes`` is taken in blocks, each against all documents.
    """
    result = None
    for items in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        hits = map_arrow(
            docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")],
            lambda it, items=items: _search(it, items, similarity, recall), _HITS)
        result = hits if result is None else result.unionByName(hits)
    return result


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, recall: float = RECALL, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that contain no item, by the rule of ``benchmark_hits``, with all their columns."""
    place = docs.columns.index(text_col)
    for items in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        docs = docs.mapInArrow(lambda it, items=items: _drop_hit(it, place, items, similarity, recall), docs.schema)
    return docs


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row")
