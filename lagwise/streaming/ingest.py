"""File stream into a keyed table: raw payload files are exploded, appended per batch and merged when read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.sources.tables import upsert

BATCH = "batch"


def ingest_stream(
    spark: SparkSession,
    source: str,
    table: str,
    parse: Callable[[DataFrame], DataFrame],
    *,
    checkpoint: str | None = None,
) -> None:
    """Process the files not seen yet.

    Each micro-batch writes its own partition and a batch that runs again after a failure overwrites
    that partition, so replaying changes nothing.  The cost of a batch does not depend on the table.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{table}/{BATCH}={batch_id}")

    stream = spark.readStream.schema("value string").text(source)
    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint or f"{table}-progress")
    writer.trigger(availableNow=True).start().awaitTermination()


def read_current(spark: SparkSession, table: str, keys: Sequence[str], version: Sequence[str | Column] = (BATCH,)) -> DataFrame:
    """The table with one row per key: the highest version wins, by default the latest batch."""
    rows = spark.read.parquet(table)
    return upsert(rows, rows.limit(0), keys, [*version, BATCH]).drop(BATCH)


def compact(spark: SparkSession, table: str, target: str, keys: Sequence[str], version: Sequence[str | Column] = (BATCH,)) -> None:
    """Write the merged table as a single batch of a new table."""
    read_current(spark, table, keys, version).withColumn(BATCH, F.lit(-1)).write.partitionBy(BATCH).parquet(target)
