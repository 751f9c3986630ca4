"""Near-duplicates by SimHash fingerprints and a self-join of binary tries.

Equal fingerprints are one leaf.  Fingerprints differ in at most three bits, so of ``blocks`` bit blocks all but
three agree; for each choice of agreeing blocks, only the trie nodes reached by equal bits can be traversed
together, and each such node is one group that Spark deals to a task.  Below it, node pairs descend together: a
pair of children on different sides costs one bit, and a pair whose bits exceed the budget is dropped.  The number
of blocks grows with the number of fingerprints, which keeps the groups small; a node that is crowded nonetheless
is cut into parts, and every pair of parts is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import discard, first_row, map_arrow, read, store, utf8
from lagwise.llm.components import components
from lagwise.llm.registry import query

BITS = 64
SEED = 42
#: Fingerprints of one node beyond which it is cut into parts.
CROWDED = 65_536
#: Fingerprints joined at once in a task (more only if one group has more), node pairs held at once.
GROUP_ROWS = 100_000
PAIRS = 500_000

_FOLD = bytes(range(256)).translate(bytes.maketrans(
    bytes(range(65, 91)) + b"\t\n\v\f\r", bytes(range(97, 123)) + b"     "))
#: Bit b of every byte value; row b.
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256)[None, :]


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, ASCII letters in lower case."""
    words = text.translate(_FOLD).split(b" ")
    return [w for w in words if w] if b"" in words else words


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """SimHash of the ``width``-word shingles, repeats included; 0 if there is no word."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1:].tolist())], dtype=np.uint64)
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


_PRINTS_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("bits", pa.int64())])


def _fingerprints(stream: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    following = first_row()
    for batch in stream:
        bits = np.array([fingerprint(t, width) for t in utf8(batch.column(1))], dtype=np.uint64).view(np.int64)
        rows = batch.column(2) if batch.num_columns > 2 else pa.array(np.arange(following, following + len(bits)))
        following += len(bits)
        yield pa.record_batch([rows, batch.column(0), pa.array(bits)], schema=_PRINTS_ARROW)


# --- trie self-join -----------------------------------------------------------------------------

def _join_tries(prints: np.ndarray, starts: tuple[np.ndarray, ...], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints that differ in at most ``budget`` bits.

    ``starts`` are node pairs (a_lo, a_hi, b_lo, b_hi): index ranges of sorted fingerprints; a node with itself gives
    each pair once.  A trie node at depth d is the range of fingerprints that share their first d bits.
    """
    zero = np.zeros(len(starts[0]), dtype=np.int64)
    stack = [(0, (*starts, zero))]
    below: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if depth not in below:
            bit = (prints >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            below[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int32))))
        return hi - (below[depth][hi] - below[depth][lo])

    while stack:
        depth, frame = stack.pop()
        if len(frame[0]) > PAIRS:
            half = len(frame[0]) // 2
            stack += [(depth, tuple(x[:half] for x in frame)), (depth, tuple(x[half:] for x in frame))]
            continue
        a_lo, a_hi, b_lo, b_hi, errors = frame
        few = (a_hi - a_lo) * (b_hi - b_lo) <= 16
        if depth == BITS:
            few[:] = True
        if few.any():
            lo, n, base, m = a_lo[few], (a_hi - a_lo)[few], b_lo[few], (b_hi - b_lo)[few]
            size = n * m
            pair = np.repeat(np.arange(len(size)), size)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            x, y = lo[pair] + at // m[pair], base[pair] + at % m[pair]
            new = (x < y) | (lo != base)[pair]
            x, y = x[new], y[new]
            near = np.bitwise_count(prints[x] ^ prints[y]) <= budget
            if near.any():
                yield x[near], y[near]
            if few.all():
                continue
        a_lo, a_hi, b_lo, b_hi, errors = (v[~few] for v in (a_lo, a_hi, b_lo, b_hi, errors))
        a_mid, b_mid, same = split(a_lo, a_hi, depth), split(b_lo, b_hi, depth), a_lo == b_lo
        children = [
            (a_lo, a_mid, b_lo, b_mid, errors), (a_mid, a_hi, b_mid, b_hi, errors), (a_lo, a_mid, b_mid, b_hi, errors + 1),
            tuple(v[~same] for v in (a_mid, a_hi, b_lo, b_mid, errors + 1)),
        ]
        merged = tuple(np.concatenate(v) for v in zip(*children))
        alive = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= budget)
        if alive.any():
            stack.append((depth + 1, tuple(v[alive] for v in merged)))


class _Forest:
    """Least reachable index per index; keeps the links of a task down to a spanning forest."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.root[x], self.root[y]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(self.root, up := self.root[self.root]):
                self.root = up


_EDGES = "a long, b long"
_EDGES_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _group_links(tables: pa.Table, budget: int) -> pa.RecordBatch:
    """Spanning forest of the links inside each group; rows are (cell, key, part_i, part_j, side, bits)."""
    columns = [c.to_numpy() for c in tables.columns]
    bits = columns[5].view(np.uint64)
    order = np.lexsort((bits, *columns[4::-1]))
    bits = bits[order]
    changed = np.zeros(len(bits), dtype=bool)
    changed[:1] = True
    for c in columns[:4]:
        changed[1:] |= np.diff(c[order]) != 0
    lo = np.flatnonzero(changed)
    hi = np.append(lo[1:], len(bits))
    ones = np.concatenate(([0], np.cumsum(columns[4][order])))
    mid = hi - (ones[hi] - ones[lo])  # rows of the second part follow those of the first
    own = (columns[2] == columns[3])[order][lo]
    starts = (lo, np.where(own, hi, mid), np.where(own, lo, mid), hi)
    forest = _Forest(len(bits))
    for x, y in _join_tries(bits, starts, budget):
        forest.link(x, y)
    tied = np.flatnonzero(forest.root != np.arange(len(bits)))
    signed = bits.view(np.int64)
    return pa.record_batch([pa.array(signed[tied]), pa.array(signed[forest.root[tied]])], schema=_EDGES_ARROW)


def _trie_links(stream: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Cut the sorted rows of a task at group borders and join each piece."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in stream:
        if rows + batch.num_rows > GROUP_ROWS:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            borders = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            if held and (keys[:, 0] != [held[-1].column(i)[-1].as_py() for i in range(4)]).any():
                borders = np.append(borders, 0)
            if len(borders):
                cut = int(borders.max())
                yield _group_links(pa.Table.from_batches([*held, batch.slice(0, cut)]), budget)
                held, rows, batch = [], 0, batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if rows:
        yield _group_links(pa.Table.from_batches(held), budget)


def _block_count(prints: int, budget: int) -> int:
    """Blocks such that the bits of the agreeing ones tell about as many nodes apart as there are fingerprints."""
    blocks = budget + 1
    while blocks < 12 and prints >> (BITS * (blocks - budget) // blocks) > 16:
        blocks += 1
    return blocks


def near_links(nodes: DataFrame, budget: int = 3, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints (column bits) reachable at ``budget`` bits."""
    blocks = _block_count(nodes.count(), budget)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    cells = []
    for cell, chosen in enumerate(combinations(range(blocks), blocks - budget)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask -= (mask >> 63) << 64
        cells.append(F.struct(F.lit(cell).alias("cell"), F.col("bits").bitwiseAND(F.lit(mask)).alias("key")))
    keyed = nodes.select("bits", F.inline(F.array(*cells)))
    plain = F.struct(F.lit(0).alias("part_i"), F.lit(0).alias("part_j"), F.lit(0).alias("side"))
    hot = store(
        keyed.groupBy("cell", "key").agg(F.count("bits").alias("n")).filter(F.col("n") > crowded)
        .select("cell", "key", F.ceil(F.col("n") / crowded).cast("int").alias("parts")), "crowded")
    if hot.isEmpty():
        rows = keyed.select("cell", "key", plain.alias("g"), "bits")
    else:
        part = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(
            F.least("part", q).alias("part_i"), F.greatest("part", q).alias("part_j"), (F.col("part") > q).cast("int").alias("side")))
        spread = keyed.join(hot, ["cell", "key"], "left").withColumn("part", part)
        rows = spread.select(
            "cell", "key", F.explode(F.when(F.col("parts").isNull(), F.array(plain)).otherwise(pairs)).alias("g"), "bits")
    groups = rows.select("cell", "key", "g.*", "bits")
    dealt = groups.repartition("cell", "key", "part_i", "part_j").sortWithinPartitions("cell", "key", "part_i", "part_j")
    return dealt.mapInArrow(lambda it: _trie_links(it, budget), _EDGES)


def near_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, width: int = 3, budget: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id, the smallest doc_id reachable by links, plus
    ``row`` (``row_col``, or a number) and ``component``, which names the component even where its ids are null.

    A null or empty text, or one of white space, has fingerprint zero, which links like any other; a text of fewer
    than ``width`` words is one shingle.  Null ids are larger than all others; an empty table gives an empty result.
    """
    prints = store(map_arrow(
        docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"), *([row_col] if row_col else [])],
        lambda it: _fingerprints(it, width), "row long, doc_id long, bits long"), "prints")
    nodes = store(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "nodes")
    links = components(near_links(nodes, budget))
    rooted = nodes.join(links, nodes.bits == links.node, "left").select("bits", "least", F.coalesce("root", "bits").alias("component"))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = store(rooted.join(least, "component").select("bits", "component", "component_id"), "labels")
    discard(nodes)
    return prints.join(labels, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "component", "row")


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents")).drop("component", "row")
