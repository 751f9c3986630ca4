"""Packing of documents into token sequences along a space-filling curve.

A document's hashed token vector is projected to four coordinates; its Hilbert key puts similar documents near
each other.  Only keys and lengths are range-sorted: a running sum over that order gives every document its place
in one long token stream, which is cut at every multiple of the sequence length.  The rest after the last full
sequence is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagwise.llm.common import first_row, map_arrow, read, store, strings
from lagwise.llm.registry import query
from lagwise.llm.tokens import encoder, slices, word_tokenizer

SEQUENCE = 4096
DIMENSIONS = 4
#: Buckets of the hashed vector, and bits of each coordinate in the key.
BUCKETS = 1024
COORDINATE_BITS = 12


def _projection(seed: int = 11) -> np.ndarray:
    """Signs that take a hashed vector to the few coordinates."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(BUCKETS, DIMENSIONS))


def coordinates(ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Projection of the unit vector of damped, hashed token counts."""
    slot = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.log1p(np.bincount(slot, minlength=BUCKETS))
    return counts @ signs / max(float(np.linalg.norm(counts)), 1e-12)


def hilbert_key(points: np.ndarray, bits: int = COORDINATE_BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate.

    Bit-transposed form: undo the excess rotations from the top bit down, Gray-code, then interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i in range(dims):
            flip = (x[i] & level) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(flip, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        carry = np.where(x[-1] & level, carry ^ (level - 1), carry)
        level >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_COORDINATES = [f"c{i}" for i in range(DIMENSIONS)]
_TOKENS = f"row long, doc_id long, n long, {', '.join(f'{c} double' for c in _COORDINATES)}, ids binary"
_TOKENS_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), *[(c, pa.float64()) for c in _COORDINATES], ("ids", pa.binary())])


def _tokenize(stream: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    words, signs, row = encoder(path), _projection(), first_row()
    for batch in stream:
        texts = strings(batch.column(1))
        for a, b in slices(texts):
            ids = words.encode(texts[a:b])
            arrays = [np.frombuffer(i, dtype=words.dtype) for i in ids]
            points = np.array([coordinates(x, signs) for x in arrays])
            yield pa.record_batch([
                pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array([len(x) for x in arrays], type=pa.int64()),
                *[pa.array(points[:, i]) for i in range(DIMENSIONS)], pa.array(ids, type=pa.binary())], schema=_TOKENS_ARROW)
            row += b - a


def _keys(stream: Iterator[pa.RecordBatch], centre: list[float], spread: list[float]) -> Iterator[pa.RecordBatch]:
    """Coordinates within three deviations of the mean fill the grid; others lie on its border."""
    top = (1 << COORDINATE_BITS) - 1
    for batch in stream:
        points = np.stack([batch.column(3 + i).to_numpy() for i in range(DIMENSIONS)], axis=1)
        scaled = (points - centre) / np.maximum(spread, 1e-12) / 6 + 0.5
        key = hilbert_key(np.clip(scaled * top, 0, top).astype(np.int64))
        yield pa.record_batch([pa.array(key), *batch.columns[:3]], names=["key", "row", "doc_id", "n"])


def _local_starts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sum inside a range partition."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in stream:
        n = batch.column(1).to_numpy()
        ends = total + np.cumsum(n)
        yield pa.record_batch([pa.array(np.full(len(n), part)), batch.column(0), pa.array(ends - n), batch.column(1)], names=["part", "row", "start", "n"])
        total = int(ends[-1]) if len(n) else total


def stream_starts(lengths: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """((row, start), all tokens): ``start`` is the sum of ``n`` over the rows before, in the given order.

    Rows (row, n, order columns) are range partitioned; the only table on one task has one row per partition.
    """
    ranged = lengths.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n")
    local = store(ranged.mapInArrow(_local_starts, "part long, row long, start long, n long"), "starts")
    totals = local.groupBy("part").agg(F.sum("n").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    starts = local.join(bases, "part").select("row", (F.col("start") + F.col("base")).alias("at"))
    return starts, totals.agg(F.sum("tokens")).first()[0] or 0


def sequence_borders(total: int, length: int) -> list[int]:
    """Starts of the sequences after the last full one: the rest as powers of two, largest first, and the end."""
    at, rest = total - total % length, total % length
    borders = [at]
    while rest:
        at += 1 << (rest.bit_length() - 1)
        rest -= 1 << (rest.bit_length() - 1)
        borders.append(at)
    return borders


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long, ids binary"
_PIECES_ARROW = pa.schema([
    *[(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row")], ("ids", pa.binary())])


def _cut(stream: Iterator[pa.RecordBatch], total: int, length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of documents (row, doc_id, n, at, ids): one per sequence that a document reaches into."""
    borders = sequence_borders(total, length)
    full = borders[0]
    for batch in stream:
        out = []
        for row, doc_id, n, at, raw in zip(*(c.to_pylist() for c in batch.columns)):
            ids = np.frombuffer(raw, dtype=f"<u{len(raw) // n}")  # every document has its end id
            cuts = [*range((at // length + 1) * length, min(at + len(ids), full + 1), length), *borders[1:]]
            edges = [at, *sorted({c for c in cuts if at < c < at + len(ids)}), at + len(ids)]
            for lo, hi in zip(edges, edges[1:]):
                if lo < full:
                    sequence, offset = divmod(lo, length)
                else:
                    tail = int(np.searchsorted(borders, lo, side="right")) - 1
                    sequence, offset = full // length + tail, lo - borders[tail]
                piece = ids[lo - at:hi - at]
                out.append((doc_id, lo - at, hi - lo, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence, offset, row, piece.tobytes()))
        if out:
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out), _PIECES_ARROW)], schema=_PIECES_ARROW)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row, ids.

    ``ids`` are little-endian, two bytes each where the vocabulary allows.  Sequences are numbered along the curve
    and hold ``length`` ids, but for the powers of two at the very end; nothing is padded.  A null text is empty and
    gives its end id alone; rows with equal or null ids are packed one by one (``row`` tells them apart); an empty
    table gives an empty result.
    """
    path = tokenizer or word_tokenizer()
    tokens = store(map_arrow(
        docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")], lambda it: _tokenize(it, path), _TOKENS), "tokens")
    stats = tokens.agg(*[f(c) for f in (F.avg, F.stddev_pop) for c in _COORDINATES]).first()
    centre, spread = [[float(v or 0) for v in part] for part in (stats[:DIMENSIONS], stats[DIMENSIONS:])]
    keys = map_arrow(tokens, ["row", "doc_id", "n", *_COORDINATES], lambda it: _keys(it, centre, spread), "key long, row long, doc_id long, n long")
    starts, total = stream_starts(keys, ["key", "doc_id", "row"])
    placed = tokens.join(starts.hint("shuffle_hash"), "row").select("row", "doc_id", "n", "at", "ids")
    return placed.mapInArrow(lambda it: _cut(it, total, length), _PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; a group is at most one sequence long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"))


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("row", "ids")
