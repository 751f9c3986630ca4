"""Helpers of the document operators: input tables, stored intermediate tables, Arrow streams."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.session import ensure_checkpoint_dir

#: A map task numbers its rows from ``partition << ROW_BITS``.
ROW_BITS = 36
#: Bitmaps of 4 KB (for 32,768 numbers each) that are sent to every task at most.
BITMAPS = 8_192


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Folders stored inside ``step`` by the step before, and whether one is running.
_left: list[str] = []
_running = False


def store(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and not lost with an executor."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    if _running:
        _left.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder below ``spark.checkpoint.dir``; others are left alone."""
    base = ensure_checkpoint_dir(spark).rstrip("/").removeprefix("file:").lstrip("/")
    if f"/{base}/" in folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``store`` once nothing will read them again."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _delete(table.sparkSession, folder)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """One step of a chain in which every step's result is written before the next step begins: what the step before has
    stored inside is deleted first."""
    global _running
    while _left:
        _delete(spark, _left.pop())
    release(spark)
    _running = True
    try:
        yield
    finally:
        _running = False


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written; they go when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def bitmaps(numbers: DataFrame, number: str | Column) -> DataFrame:
    """(bucket, bits): a set of numbers, not negative, as one bitmap for each stretch of 32,768 of them."""
    number = F.col(number) if isinstance(number, str) else number
    return numbers.groupBy(F.bitmap_bucket_number(number).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))


def in_bitmaps(df: DataFrame, number: str | Column, maps: DataFrame) -> DataFrame:
    """The rows of ``df`` whose number is in the bitmaps, which every task gets; the rows stay where they are."""
    number = F.col(number) if isinstance(number, str) else number
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return df.withColumn("_bucket", F.bitmap_bucket_number(number)).join(F.broadcast(maps), "_bucket").filter(
        F.getbit(byte, (place % 8).cast("int")) == 1).select(*df.columns)


def likely_in(df: DataFrame, keys: Sequence[str], wanted: DataFrame, count: int) -> DataFrame:
    """The rows of ``df`` whose keys are among the ``count`` of ``wanted`` (columns of the same names and types), and a few
    others: a filter by one bit a hash, of bounded size, for what an exact join by ``keys`` would else move in vain."""
    bits = min(max(1 << (16 * count).bit_length(), 1 << 15), BITMAPS << 15)
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    return in_bitmaps(df, place, bitmaps(wanted, place))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all documents that no model learns from; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def map_arrow(
    df: DataFrame, columns: Sequence[str | Column], fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str, **kw,
) -> DataFrame:
    """``mapInArrow`` over the named columns only, so that others are neither read nor sent to Python."""
    return df.select(*columns).mapInArrow(fn, schema, **kw)


_held: dict[tuple, object] = {}


def held[T](make: Callable[..., T], *args: Hashable) -> T:
    """``make(*args)``, kept between the tasks of a worker process; asking for another object drops the one before, so
    that a worker that serves several operators holds the words or vectors of one at a time."""
    key = (make, *args)
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[key] = make(*args)
    return _held[key]


def first_row() -> int:
    """Number of the first row of this task; unique in the table as long as a task has fewer than 2^36 rows."""
    return TaskContext.get().partitionId() << ROW_BITS


def strings(column: pa.Array) -> list[str]:
    """Texts of a column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of a column as UTF-8, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def batches(schema: pa.Schema, columns: Sequence[Sequence], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded length from whole columns."""
    for at in range(0, len(columns[0]), rows):
        yield pa.record_batch([pa.array(c[at:at + rows], type=f.type) for c, f in zip(columns, schema)], schema=schema)
