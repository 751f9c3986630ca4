"""Exact deduplication by Grace hashing.

Map tasks first merge the copies they meet themselves in a bounded open-addressing table, so that of a text
with any number of copies each task passes on one representative.  Representatives are dealt to tasks by digest
(the first partitioning); a task fills its table and sends what does not fit to spill files by further digest
bits, and treats each file in the same way until it fits.  Digests only choose slots and files: texts are equal
when their whole contents are.  Documents find their group through their representative, so no join key has more
rows than one map task.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import batches, first_row, map_arrow, read, store, utf8
from lagwise.llm.registry import query

#: Bytes of distinct texts that one table may hold.
MAP_BYTES = 24 << 20
TABLE_BYTES = 96 << 20
#: Spill files of one partitioning step.
FAN_OUT = 16

_BLANK = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_RUN = re.compile(rb"  +")


def squeeze(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    text = text.translate(_BLANK)
    return _RUN.sub(b" ", text) if b"  " in text else text


class OpenTable:
    """Open addressing with linear probing; an entry is found by its whole content."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def find(self, digest: bytes, content: bytes) -> tuple[int, int]:
        """(entry or -1, the slot where it is or would be)."""
        mask = len(self.slots) - 1
        code = int.from_bytes(digest[-8:], "little")
        slot = code & mask
        while (entry := int(self.slots[slot])) >= 0:
            if self.hashes[entry] == code and self.contents[entry] == content:
                return entry, slot
            slot = (slot + 1) & mask
        return -1, slot

    def insert(self, digest: bytes, content: bytes, slot: int) -> int:
        entry = len(self.contents)
        self.slots[slot] = entry
        self.hashes.append(int.from_bytes(digest[-8:], "little"))
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for entry, code in enumerate(self.hashes):
            slot = code & mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & mask
            self.slots[slot] = entry


# --- map side -----------------------------------------------------------------------------------

_MAPPED = "row long, doc_id long, rep long, digest binary, content binary, n long, least_id long, least_row long"
_MAPPED_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("digest", pa.binary()),
    ("content", pa.binary()), ("n", pa.int64()), ("least_id", pa.int64()), ("least_row", pa.int64())])


def _rank(doc_id: int | None, row: int) -> tuple[bool, int, int]:
    """Order of the rows of a group: smallest doc_id first, null last, then the first row."""
    return doc_id is None, doc_id or 0, row


@dataclass
class _Merged:
    """Copies of one text seen by a map task."""

    rep: int
    least: tuple[bool, int, int]
    n: int = 1


def _merge_copies(stream: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: documents (row, doc_id, rep) and representatives (rep, digest, content, ...)."""
    following = first_row()
    table, merged, digests = OpenTable(), [], []

    def flush() -> Iterator[pa.RecordBatch]:
        none = [None] * len(table)
        least = [m.least for m in merged]
        yield from batches(_MAPPED_ARROW, [
            none, none, [m.rep for m in merged], digests, table.contents, [m.n for m in merged],
            [None if a else b for a, b, _ in least], [c for *_, c in least]], rows=2_000)

    for batch in stream:
        rows, reps = [], []
        ids = batch.column(0).to_pylist()
        numbers = batch.column(2).to_pylist() if batch.num_columns > 2 else range(following, following + batch.num_rows)
        following += batch.num_rows
        for row, doc_id, raw in zip(numbers, ids, utf8(batch.column(1))):
            content = squeeze(raw)
            digest = hashlib.sha256(content).digest()
            entry, slot = table.find(digest, content)
            if entry < 0 and len(table) and table.bytes + len(content) > limit:
                yield from flush()
                table, merged, digests = OpenTable(), [], []
                entry, slot = table.find(digest, content)
            if entry < 0:
                table.insert(digest, content, slot)
                digests.append(digest)
                merged.append(_Merged(row, _rank(doc_id, row)))
                reps.append(row)
            else:
                m = merged[entry]
                m.n += 1
                m.least = min(m.least, _rank(doc_id, row))
                reps.append(m.rep)
            rows.append(row)
        none = [None] * len(rows)
        yield from batches(_MAPPED_ARROW, [rows, ids, reps, none, none, none, none, none])
    yield from flush()


# --- Grace partitioning -------------------------------------------------------------------------

_GROUPS = "rep long, keep_id long, keep_row long, group_size long, digest binary"
_GROUPS_ARROW = pa.schema([
    ("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("digest", pa.binary())])
_RECORD = pa.schema([
    ("rep", pa.int64()), ("digest", pa.binary()), ("content", pa.binary()), ("n", pa.int64()), ("least_id", pa.int64()), ("least_row", pa.int64())])

Record = tuple[int, bytes, bytes, int, int | None, int]


@dataclass
class _Group:
    digest: bytes
    least: tuple[bool, int, int]
    n: int = 0
    reps: list[int] = field(default_factory=list)


class _SpillFile:
    """Records of one sub-bucket, written in small batches."""

    def __init__(self, path: str) -> None:
        self.path, self.rows, self.bytes = path, [], 0
        self.writer = pa.ipc.new_stream(path, _RECORD)

    def add(self, record: Record) -> None:
        self.rows.append(record)
        self.bytes += len(record[2])
        if self.bytes > 1 << 20:
            self._write()

    def _write(self) -> None:
        self.writer.write_batch(pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*self.rows), _RECORD)], schema=_RECORD))
        self.rows, self.bytes = [], 0

    def close(self) -> None:
        if self.rows:
            self._write()
        self.writer.close()

    def read(self) -> Iterator[Record]:
        with pa.ipc.open_stream(self.path) as stream:
            for batch in stream:
                yield from zip(*(c.to_pylist() for c in batch.columns))
        os.remove(self.path)


def _bucket(records: Iterable[Record], limit: int, folder: str, depth: int = 0) -> Iterator[list[_Group]]:
    """Groups of the bucket; what does not fit the table is partitioned to files and treated again.

    A text enters the table only while there is room, and room never comes back: no text is both in the table
    and in a file.
    """
    table, groups, files = OpenTable(), [], {}
    for record in records:
        rep, digest, content, n, least_id, least_row = record
        entry, slot = table.find(digest, content)
        if entry < 0 and (not len(table) or table.bytes + len(content) <= limit and not files):
            entry = table.insert(digest, content, slot)
            groups.append(_Group(digest, _rank(least_id, least_row)))
        if entry >= 0:
            g = groups[entry]
            g.n += n
            g.least = min(g.least, _rank(least_id, least_row))
            g.reps.append(rep)
            continue
        part = hashlib.blake2b(digest, digest_size=2, salt=depth.to_bytes(4, "little")).digest()[0] % FAN_OUT
        if part not in files:
            files[part] = _SpillFile(f"{folder}/{depth}-{part}-{len(os.listdir(folder))}")
        files[part].add(record)
    yield groups
    del table, groups
    for file in files.values():
        file.close()
    for file in files.values():
        yield from _bucket(file.read(), limit, folder, depth + 1)


def _grace(stream: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    records = (r for batch in stream for r in zip(*(c.to_pylist() for c in batch.columns)))
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for groups in _bucket(records, limit, folder):
            rows = [(rep, None if g.least[0] else g.least[1], g.least[2], g.n, g.digest) for g in groups for rep in g.reps]
            if rows:
                yield from batches(_GROUPS_ARROW, list(zip(*rows)))


def exact_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
    map_bytes: int = MAP_BYTES, table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, plus ``row`` (``row_col``, or a number).

    Texts are compared after each run of ASCII white space became one space; null is the empty text.  The row with
    the smallest doc_id stays; a null id is larger than all others, and of rows with the same id the first one
    stays.  An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    mapped = store(map_arrow(
        docs, [F.col(id_col).cast("long"), F.col(text_col).cast("string"), *([row_col] if row_col else [])],
        lambda it: _merge_copies(it, map_bytes), _MAPPED), "exact")
    reps = mapped.filter(F.col("content").isNotNull()).select("rep", "digest", "content", "n", "least_id", "least_row")
    groups = reps.repartition("digest").mapInArrow(lambda it: _grace(it, table_bytes), _GROUPS)
    members = mapped.filter(F.col("row").isNotNull()).select("row", "doc_id", "rep")
    return members.join(groups, "rep").select(
        "row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


@query("op3_exact_dedup", """
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY body)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).drop("row")
