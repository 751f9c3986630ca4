"""Token sequences of equal length in Arrow files.

A file holds a stretch of documents in id order: their ids one after the other in rows of ``LENGTH`` ids
(fixed-size lists), with a mask of bytes, 1 up to the last id of the file and 0 behind it.  Lists of one size and record batches
of one number of rows make the place of any row a product, so a memory-mapped row is read without a copy.  A second
Arrow file beside it tells where each document starts.  Files are written under names of their own attempt; the
manifest, which is returned by the tasks that finished, names the ones that count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagwise.llm.common import read, shared_path, store, strings
from lagwise.llm.registry import query
from lagwise.llm.tokens import encoder, slices, word_tokenizer

LENGTH = 2048
BATCH_ROWS = 64

_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype.newbyteorder("=")), length)), ("mask", pa.list_(pa.uint8(), length))])


class TokenFileWriter:
    """Appends documents; keeps less than one record batch of ids in memory."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int) -> None:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        self.length, self.dtype, self.schema = length, dtype, _schema(dtype, length)
        self.sinks = [system.open_output_stream(f"{root}/{name}{end}") for end in (".arrow", ".docs.arrow")]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], _DOCS)
        self.held: list[bytes] = []
        self.held_bytes = self.tokens = self.rows = 0

    def add(self, doc_ids: list[int | None], encoded: list[bytes]) -> None:
        n = np.array([len(e) // self.dtype.itemsize for e in encoded], dtype=np.int64)
        starts = self.tokens + np.cumsum(n) - n
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, type=pa.int64()), pa.array(starts), pa.array(n)], schema=_DOCS))
        self.tokens += int(n.sum())
        self.held += encoded
        self.held_bytes += sum(map(len, encoded))
        self._write(BATCH_ROWS * self.length)

    def _write(self, step: int) -> None:
        """Full batches of ``step`` ids; the rest is held."""
        size = step * self.dtype.itemsize
        if self.held_bytes < size:
            return
        raw = b"".join(self.held)
        for at in range(0, len(raw) - size + 1, size):
            self._batch(np.frombuffer(raw, dtype=self.dtype, count=step, offset=at), step)
        rest = raw[len(raw) // size * size:]
        self.held, self.held_bytes = [rest], len(rest)

    def _batch(self, ids: np.ndarray, used: int) -> None:
        mask = pa.array((np.arange(len(ids)) < used).astype(np.uint8))
        kind = self.schema.field("ids").type.value_type
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids, type=kind), mask)]
        self.ids.write_batch(pa.record_batch(lists, schema=self.schema))
        self.rows += len(lists[0])

    def close(self) -> None:
        raw = np.frombuffer(b"".join(self.held), dtype=self.dtype)
        if len(raw):
            padded = np.zeros(-(-len(raw) // self.length) * self.length, dtype=self.dtype)
            padded[:len(raw)] = raw
            self._batch(padded, len(raw))
        for closing in (self.ids, self.docs, *self.sinks):
            closing.close()


def _open(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """Memory-mapped where the folder is a local path, else read through its file system."""
    system, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path))


def sequence(folder: str, name: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one row of a file, found by its number; both are views of the file."""
    batch = _open(folder, f"{name}.arrow").get_batch(row // BATCH_ROWS)
    ids, mask = batch.column(0)[row % BATCH_ROWS].values, batch.column(1)[row % BATCH_ROWS].values
    return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=True)


_MANIFEST = "part long, folder string, file string, docs long, tokens long, sequences long"


def _write_files(stream: Iterator[pa.RecordBatch], folder: str, path: str, length: int) -> Iterator[pa.RecordBatch]:
    words, part, name, docs = encoder(path), TaskContext.get().partitionId(), None, 0
    for batch in stream:
        ids, texts = batch.column(0).to_pylist(), strings(batch.column(1))
        for a, b in slices(texts):
            if name is None:
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                writer = TokenFileWriter(folder, name, words.dtype, length)
            writer.add(ids[a:b], words.encode(texts[a:b]))
            docs += b - a
    if name is not None:
        writer.close()
        row = (part, folder, name, docs, writer.tokens, writer.rows)
        yield pa.record_batch([pa.array([v]) for v in row], names=["part", "folder", "file", "docs", "tokens", "sequences"])


def write_token_files(
    docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None,
) -> DataFrame:
    """Write all documents to ``folder``, which every executor can reach; returns the manifest, one row per file.

    Documents are in ascending id order over the files in ``part`` order: null ids first, rows with one id by a hash of the text, then by text.
    A null text is empty; each document ends with id 2.  An empty table writes no file.
    """
    path = tokenizer or word_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # rows without an id, or with one id, are spread by their text
    ranged = rows.withColumn("spread", F.xxhash64("text")).repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text").drop("spread")
    return store(ranged.mapInArrow(lambda it: _write_files(it, folder, path, length), _MANIFEST), "manifest")


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _read_files(stream: Iterator[pa.RecordBatch], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Documents of the files (folder, file, base), a stretch of sequences at a time."""
    for batch in stream:
        for folder, name, base in zip(*(c.to_pylist() for c in batch.columns)):
            ids, index = _open(folder, f"{name}.arrow"), _open(folder, f"{name}.docs.arrow")
            following = (ids.get_batch(i) for i in range(ids.num_record_batches))
            held, first = np.zeros(0, dtype=np.uint16), 0  # ids from place ``first`` of the file on
            for i in range(index.num_record_batches):
                docs = index.get_batch(i)
                crcs, raws = [], []
                for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist()):
                    more = [held[start - first:]]
                    first, size = start, len(more[0])
                    while size < n:
                        block = next(following)
                        values, mask = (block.column(j).flatten().to_numpy(zero_copy_only=False) for j in (0, 1))
                        more.append(values if mask[-1] else values[:np.count_nonzero(mask)])
                        size += len(more[-1])
                    held = more[0] if len(more) == 1 else np.concatenate([m for m in more if len(m)])
                    piece = held[:n]
                    crcs.append(zlib.crc32(piece.astype("<u4").tobytes()))
                    raws.append(piece.tobytes() if keep_ids else None)
                yield pa.record_batch([
                    docs.column(0), pa.array(docs.column(1).to_numpy() + base), docs.column(2), pa.array(crcs, type=pa.int64()),
                    pa.array(raws, type=pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_token_files(manifest: DataFrame, *, keep_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, ids."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("folder", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    dealt = files.repartition(max(1, min(manifest.count(), 10_000)))
    return dealt.mapInArrow(lambda it: _read_files(it, keep_ids), _READ)


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(read(spark, sf_dir, "documents"), shared_path(spark, "token-files"))
    return read_token_files(manifest, keep_ids=False).drop("ids")
