"""Removal of long strings that occur more than once, by suffix sorting.

A byte goes when a string of ``width`` bytes that covers it starts anywhere else.  Equal strings hold equal anchors: of
the ``ANCHOR``-byte grams inside a string, the one with the least hash.  Consecutive strings with one anchor form a
segment, and only segments whose anchor occurs again can hold a repeated string.  Segments that are equal as wholes are
repeated throughout.  Of the others, those with one anchor are cut to what agrees with another one on either side of
the anchor, and a suffix array over them tells which strings start twice.

The suffix array is built by linear grouping: suffixes in groups by first sign; groups taken in descending order, each
suffix pointing to the nearest earlier one of a smaller group, which moves behind its group by the number of pointers it
got (by then groups are those of equal Lyndon prefixes); last, ascending placement along the pointers gives the order
inside each group.  No sign is renamed and nothing recurses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import discard, map_arrow, read, release, store, utf8
from lagwise.llm.registry import query

WIDTH = 200
ANCHOR = 32
#: Bytes of a text looked at once.
CHUNK = 1 << 20
#: Signs of one suffix array (more only if one anchor has more), and segments of one anchor beyond which strings are counted.
SORTED = 150_000
CROWDED = 2_000

_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_PLACE_BITS = np.uint64(22)


def suffix_order(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes in ascending order; the last sign must be smaller than all others."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size, previous = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for i, suffix in enumerate(order):
        if text[suffix] != text[order[start]]:
            start = i
        place[suffix] = i
        group[suffix] = start
        size[start] += 1
    end = n
    while end:
        start = group[order[end - 1]]
        if end - start == 1:
            suffix = order[start]
            target = suffix - 1
            while target >= 0 and group[target] >= start:
                target = previous[target]
            previous[suffix] = target
            if target >= 0 and size[group[target]] > 1:
                old = group[target]
                size[old] -= 1
                last = old + size[old]
                other, at = order[last], place[target]
                order[at], place[other] = other, at
                order[last], place[target] = target, last
                group[target] = last
                size[last] = 1
        else:
            pointers: dict[int, int] = {}
            for suffix in sorted(order[start:end]):
                target = suffix - 1
                while target >= 0 and group[target] >= start:
                    target = previous[target]
                previous[suffix] = target
                if target >= 0:
                    pointers[target] = pointers.get(target, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for target, count in pointers.items():
                moves.setdefault((-count, group[target]), []).append(target)
            for _, old in sorted(moves):
                targets = moves[_, old]
                if len(targets) == size[old]:
                    continue  # the whole rest of the group moves: it stays where it is
                size[old] -= len(targets)
                new = old + size[old]
                size[new] = len(targets)
                last = new + len(targets)
                for target in targets:
                    last -= 1
                    other, at = order[last], place[target]
                    order[at], place[other] = other, at
                    order[last], place[target] = target, last
                    group[target] = new
        end = start
    result, free, placed = [0] * n, list(range(n)), bytearray(n)
    if n:
        result[0] = n - 1
        placed[n - 1] = 1
    for i in range(n):
        suffix = result[i] - 1
        while suffix >= 0 and not placed[suffix]:
            at = group[suffix]
            result[free[at]] = suffix
            free[at] += 1
            placed[suffix] = 1
            suffix = previous[suffix]
    return result


# --- anchors ------------------------------------------------------------------------------------

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        both = [np.full(max(n, 1 << 16), p, dtype=np.uint64) for p in (_POWER, _INVERSE)]
        for table in both:
            table[0] = 1
        _powers[:] = [np.cumprod(t) for t in both]
    return _powers[0][:n], _powers[1][:n]


def segments(text: bytes, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first start, starts, place of the anchor behind the first start) of the segments of a text."""
    gram = min(ANCHOR, width)
    span = width - gram + 1
    for base in range(0, len(text) - width + 1, CHUNK):
        part = np.frombuffer(text, dtype=np.uint8, offset=base, count=min(CHUNK + width - 1, len(text) - base)).astype(np.uint64) + np.uint64(1)
        up, down = _power_tables(len(part) + 1)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(part * up[:-1])))
        hashes = (sums[gram:] - sums[:-gram]) * down[:len(part) - gram + 1]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(29)
        least = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        have = 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[:len(least) - (span - have)], least[span - have:])
        at = (least & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.append(first[1:], len(at)) - first
        yield hashes[at[first]].view(np.int64), first + base, count, at[first] - first


_KEY = ["k1", "k2"]
_ANCHORS = "k1 long, k2 long, anchor long, digest long, first long, starts long, inside long"
_ANCHORS_ARROW = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "anchor", "digest", "first", "starts", "inside")])


def _anchors(stream: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in stream:
        out, rows = [], 0
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
            for anchor, first, starts, inside in segments(text, width):
                codes = np.array([digest(text[a:a + n + width - 1]) for a, n in zip(first.tolist(), starts.tolist())], dtype=np.uint64).view(np.int64)
                out.append((np.full(len(first), k1), np.full(len(first), k2), anchor, codes, first, starts, inside))
                rows += len(first)
            if rows > 50_000:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_ANCHORS_ARROW)
                out, rows = [], 0
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_ANCHORS_ARROW)


# --- segments with one anchor ------------------------------------------------------------------

_PARTS = "anchor long, copies long, k1 long, k2 long, first long, inside long, segment binary"
_PARTS_ARROW = pa.schema([*[(c, pa.int64()) for c in ("anchor", "copies", "k1", "k2", "first", "inside")], ("segment", pa.binary())])


def _cut_out(stream: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for batch in stream:
        out = []
        for k1, k2, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist()):
            out += [(w["anchor"], w["copies"], k1, k2, w["first"], w["inside"], text[w["first"]:w["first"] + w["starts"] + width - 1]) for w in wanted]
        for at in range(0, len(out), 5_000):
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out[at:at + 5_000]), _PARTS_ARROW)], schema=_PARTS_ARROW)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _longest_shared(texts: list[bytes]) -> list[int]:
    """For every text its longest common prefix with any other: that with a neighbour in sorted order."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    best = [0] * len(texts)
    for a, b in zip(order, order[1:]):
        common = _shared(texts[a], texts[b])
        best[a], best[b] = max(best[a], common), max(best[b], common)
    return best


class _Sorter:
    """Collects the segments of whole anchors and finds the strings that start in them more than once."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.texts: list[bytes] = []  # different strings to sort
        self.owners: list[list[tuple[int, int, int]]] = []  # of each string: single segments (k1, k2, first start)
        self.decided: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, group: list[tuple[int, int, int, int, int, bytes]]) -> None:
        """Segments (copies, k1, k2, first, inside, bytes) of one anchor."""
        if len(group) < 2 or all(copies > 1 for copies, *_ in group):
            return
        right = _longest_shared([g[5][g[4]:] for g in group])
        left = _longest_shared([g[5][:g[4]][::-1] for g in group])
        strings: dict[bytes, tuple[int, list[tuple[int, int, int]]]] = {}
        for (copies, k1, k2, first, inside, segment), l, r in zip(group, left, right):
            if l + r < self.width:
                continue
            text = segment[inside - l:inside + r]
            n, owners = strings.get(text, (0, []))
            strings[text] = n + copies, owners + [(k1, k2, first + inside - l)] if copies == 1 else owners
        for text, (n, owners) in strings.items():
            if n > 1:
                self.decided += [(k1, k2, first, first + len(text)) for k1, k2, first in owners]
        if len(strings) > 1:
            for text, (n, owners) in strings.items():
                self.texts.append(text)
                self.owners.append(owners if n == 1 else [])
                self.size += len(text) + 1

    def repeated(self) -> list[tuple[int, int, int, int]]:
        """(k1, k2, from, to): covered stretches of the single segments."""
        found, self.decided = self.decided, []
        if not self.texts:
            return found
        joined = b"".join(t + b"\0" for t in self.texts)
        raw = np.frombuffer(joined, dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in self.texts])
        begins = ends - [len(t) + 1 for t in self.texts]
        signs = raw.astype(np.int64) + 2
        signs[ends - 1] = 1
        order = np.array(suffix_order([*signs.tolist(), 0]), dtype=np.int64)
        whole = np.zeros(len(raw) + 1, dtype=bool)  # starts with ``width`` bytes of their own string ahead
        for a, b in zip(begins.tolist(), ends.tolist()):
            whole[a:max(b - self.width, a)] = True
        order = order[whole[order]]
        twice = np.zeros(len(raw), dtype=bool)
        span = np.lib.stride_tricks.sliding_window_view(raw, self.width)
        for at in range(0, len(order) - 1, 20_000):
            a, b = order[at:min(at + 20_000, len(order) - 1)], order[at + 1:at + 20_001]
            near = np.flatnonzero(raw[a + self.width - 1] == raw[b + self.width - 1])
            same = near[(span[a[near]] == span[b[near]]).all(axis=1)]
            twice[a[same]] = twice[b[same]] = True
        for begin, end, owners in zip(begins.tolist(), ends.tolist(), self.owners):
            if owners:
                for lo, hi in _runs(np.flatnonzero(twice[begin:end]), self.width):
                    found += [(k1, k2, first + lo, first + hi) for k1, k2, first in owners]
        self.texts, self.owners, self.size = [], [], 0
        return found


def _runs(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches covered by strings of ``width`` bytes at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.append(cut, len(starts) - 1)] + width).tolist()))


_SPANS = "k1 long, k2 long, lo long, hi long"
_SPANS_ARROW = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "lo", "hi")])


def _spans(rows: list[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.record_batch([pa.array(c) for c in zip(*rows)], schema=_SPANS_ARROW)


def _sort_groups(stream: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Spans of the sorted rows of a task, anchor by anchor."""
    sorter, group, current = _Sorter(width), [], None
    for batch in stream:
        for anchor, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if anchor != current:
                sorter.add(group)
                group, current = [], anchor
                if sorter.size > SORTED:
                    yield from _spans(sorter.repeated())
            group.append(tuple(row))
    sorter.add(group)
    yield from _spans(sorter.repeated())


# --- crowded anchors ----------------------------------------------------------------------------

#: Consecutive strings of a piece.
PIECE = 8

_PIECES = "m1 long, m2 long, u1 long, u2 long, copies long, k1 long, k2 long, lo long, piece binary"
_PIECES_ARROW = pa.schema([*[(c, pa.int64()) for c in ("m1", "m2", "u1", "u2", "copies", "k1", "k2", "lo")], ("piece", pa.binary())])
_WINDOWS = "w1 long, w2 long, copies long, k1 long, k2 long, lo long"
_WINDOWS_ARROW = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "copies", "k1", "k2", "lo")])


def _digest(text: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(text)
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def _pieces(stream: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Segments in pieces of ``PIECE`` strings, at fixed distances from the anchor.

    m: digest of the bytes that all strings of the piece's place share, whichever of them the segment has; u: of the piece.
    """
    step = min(PIECE, width)
    for batch in stream:
        out = []
        for copies, k1, k2, first, inside, segment in zip(*(c.to_pylist() for c in batch.columns)):
            at, last = 0, len(segment) - width
            while at <= last:
                ahead = inside - at  # from the string's start to the anchor; falls by one from string to string
                rest = ahead % step
                until = min(at + rest, last)
                piece = segment[at:until + width]
                shared = segment[at + rest:at + rest - (step - 1) + width]
                out.append((*_digest(shared), *_digest(piece), copies, k1, k2, first + at, piece))
                at = until + 1
        for at in range(0, len(out), 20_000):
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out[at:at + 20_000]), _PIECES_ARROW)], schema=_PIECES_ARROW)


def _each_string(stream: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Digest of every string of the pieces."""
    for batch in stream:
        out = []
        for copies, k1, k2, lo, piece in zip(*(c.to_pylist() for c in batch.columns)):
            out += [(*_digest(piece[i:i + width]), copies, k1, k2, lo + i) for i in range(len(piece) - width + 1)]
        for at in range(0, len(out), 50_000):
            yield pa.record_batch([pa.array(c) for c in zip(*out[at:at + 50_000])], schema=_WINDOWS_ARROW)


def _crowded_spans(parts: DataFrame, width: int) -> list[DataFrame]:
    """Spans of single segments with crowded anchors, by counting instead of sorting in one task.

    A piece whose shared bytes are met nowhere else holds nothing repeated; pieces met again are repeated throughout; of
    the few others each string is counted, against one of every kind of piece.
    """
    pieces = store(parts.select("copies", *_KEY, "first", "inside", "segment").mapInArrow(lambda it: _pieces(it, width), _PIECES), "pieces")
    shared = pieces.groupBy("m1", "m2").agg(F.sum("copies").alias("n")).filter("n > 1").select("m1", "m2")
    alive = store(pieces.join(shared, ["m1", "m2"], "left_semi"), "alive")
    kinds = store(alive.groupBy("u1", "u2").agg(F.sum("copies").alias("copies"), F.min(F.struct(*_KEY, "lo", "piece")).alias("one")), "kinds")
    again = kinds.filter("copies > 1").select("u1", "u2")
    end = F.col("lo") + F.octet_length("piece")
    whole = alive.filter("copies = 1").join(again, ["u1", "u2"], "left_semi").select(*_KEY, "lo", end.alias("hi"))
    strings = store(kinds.select("copies", "one.k1", "one.k2", "one.lo", "one.piece").mapInArrow(lambda it: _each_string(it, width), _WINDOWS), "strings")
    twice = strings.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).filter("n > 1").select("w1", "w2")
    single = strings.filter("copies = 1").join(twice, ["w1", "w2"], "left_semi").select(*_KEY, "lo", (F.col("lo") + width).alias("hi"))
    return [whole, single]


# --- documents ----------------------------------------------------------------------------------

_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_RESULT_ARROW = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")], ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(stream: Iterator[pa.RecordBatch], keep_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        out = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
            kept, end, removed, runs = [], 0, 0, 0
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                if lo > end or not runs:
                    kept.append(text[end:lo])
                    runs += 1
                removed += max(hi - max(lo, end), 0)
                end = max(end, hi)
            kept.append(text[end:])
            rest = b"".join(kept)
            out.append((doc_id, len(text), removed, runs, hashlib.sha256(rest).hexdigest(), rest if keep_bytes else None))
        for at in range(0, len(out), 10_000):
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out[at:at + 10_000]), _RESULT_ARROW)], schema=_RESULT_ARROW)


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, crowded: int = CROWDED, keep_bytes: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Strings are judged on the input, whatever else is removed, and never cross documents; every row is a document of
    its own, also one with the id or text of another.  Null texts are empty; texts shorter than ``width`` keep all.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).select(F.xxhash64("text").alias("k1"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k2"), "doc_id", "text")
    long = texts.filter(F.octet_length("text") >= width)
    anchors = store(map_arrow(long, ["k1", "k2", "text"], lambda it: _anchors(it, width), _ANCHORS), "anchors")
    counted = anchors.groupBy("anchor").agg(F.count("digest").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
    # stored, so that the join deals both sides anew and can split the rows of a frequent anchor
    again = store(counted.filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("several")), "again")
    found = store(anchors.join(again, "anchor"), "repeated")
    discard(anchors)
    release(spark)
    kinds = store(
        found.groupBy("anchor", "digest", "several")
        .agg(F.count("first").alias("copies"), F.min(F.struct(*_KEY, "first", "starts", "inside")).alias("one")), "segments")
    copied = kinds.filter("copies > 1").select("anchor", "digest")
    spans = [found.join(copied, ["anchor", "digest"]).select(*_KEY, F.col("first").alias("lo"), (F.col("first") + F.col("starts") + (width - 1)).alias("hi"))]
    wanted = kinds.filter("several").select("anchor", "copies", "one.*").groupBy(*_KEY).agg(
        F.collect_list(F.struct("anchor", "copies", "first", "starts", "inside")).alias("wanted"))
    parts = store(long.select(*_KEY, "text").join(wanted, _KEY).mapInArrow(lambda it: _cut_out(it, width), _PARTS), "parts")
    release(spark)
    many = store(parts.groupBy("anchor").agg(F.count("first").alias("n")).filter(F.col("n") > crowded).select("anchor"), "crowded")
    few = parts
    if not many.isEmpty():
        few = parts.join(many, "anchor", "left_anti")
        spans += _crowded_spans(parts.join(many, "anchor", "left_semi"), width)
    columns = ["anchor", "copies", *_KEY, "first", "inside", "segment"]
    spans.append(few.select(columns).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda it: _sort_groups(it, width), _SPANS))
    whole = spans[0]
    for more in spans[1:]:
        whole = whole.unionByName(more)
    by_doc = store(whole.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(found, kinds, parts)
    release(spark)
    joined = texts.join(by_doc, _KEY, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lambda it: _remove(it, keep_bytes), _RESULT)


@query("op7_suffix_array_dedup")
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")
