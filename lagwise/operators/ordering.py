"""Row order inside a key that holds any share of the data.

A plain window puts all rows of a key into one task.  Here keys above ``max_rows`` take another way:
rows are range partitioned by (key, order), so that a large key spreads over many tasks; each task
numbers or sums its own stretch, and a small table with one row per (key, stretch) supplies the
offset of what came before.  The two ways return the same values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.session import cut_lineage, shuffle_partitions

HOT_ROWS = 5_000_000
BROADCAST_ROWS = 500_000
CHUNK = "_chunk"


def frequent_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Keys with more than ``max_rows`` rows: never more than rows / max_rows of them."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > max_rows).drop("_n")
    )


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys, nulls pairing with nulls; the key columns of ``left`` are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def broadcast_if_small(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Store a derived table and mark it for broadcast when its counted rows allow it."""
    stored = cut_lineage(table)
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored


def small_join(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-key table to many rows: without moving the rows as long as the table is small.

    Beyond that the rows are shuffled, and adaptive execution splits the partitions of frequent keys.
    """
    return key_join(df, broadcast_if_small(table), keys, how)


@dataclass(frozen=True)
class Frequent:
    """Keys already found to be large (None: there are none), to be passed as ``max_rows`` by callers
    that use one key several times, so that it is counted once and on the smallest table."""

    table: DataFrame | None

    def __bool__(self) -> bool:
        return self.table is not None


Limit = int | Frequent | None


def find_frequent(df: DataFrame, keys: Sequence[str], max_rows: Limit = HOT_ROWS) -> Frequent:
    """Count the rows of every key once."""
    if isinstance(max_rows, Frequent):
        return max_rows
    if max_rows is None:
        return Frequent(None)
    found = frequent_keys(df, keys, max_rows)
    return Frequent(None if found.isEmpty() else broadcast_if_small(found))


def split_frequent(df: DataFrame, keys: Sequence[str], max_rows: Limit) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys above ``max_rows`` or None)."""
    if max_rows is None:
        return df, None
    if not keys and not isinstance(max_rows, Frequent):
        return (df, None) if df.limit(max_rows + 1).count() <= max_rows else (df.limit(0), df)
    frequent = find_frequent(df, keys, max_rows)
    if not frequent:
        return df, None
    return key_join(df, frequent.table, keys, "left_anti"), key_join(df, frequent.table, keys, "left_semi")


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range partition by (keys, order) and keep the partition number; stored, so that it never changes."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id()))


def chunk_offsets(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Per (key, chunk) the totals of all earlier chunks: one row per stretch, so the window is small."""
    totals = df.groupBy(*keys, CHUNK).agg(*[F.sum(c).alias(f"_off_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, CHUNK,
        *[F.coalesce(F.sum(f"_off_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )


def join_offsets(df: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return key_join(df, offsets, [*keys, CHUNK])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    *,
    inclusive: bool = False,
    max_rows: Limit = HOT_ROWS,
) -> DataFrame:
    """Per row the sum of each expression over the earlier rows of its key (0 at the first row)."""
    ordinary, frequent = split_frequent(df, keys, max_rows)
    end = 0 if inclusive else -1
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    result = ordinary.select("*", *[F.coalesce(F.sum(c).over(window), F.lit(0)).alias(n) for n, c in sums.items()])
    if frequent is None:
        return result
    parts = chunked(frequent, keys, order)
    inner = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = parts.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(n) for n, c in sums.items()])
    joined = join_offsets(local, chunk_offsets(parts, keys, sums), keys)
    shifted = joined.select(*df.columns, *[(F.col(n) + F.col(f"_off_{n}")).alias(n) for n in sums])
    return result.unionByName(shifted)


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "row_no",
    *,
    max_rows: Limit = HOT_ROWS,
) -> DataFrame:
    """1-based position of each row inside its key, as a bigint."""
    ordinary, frequent = split_frequent(df, keys, max_rows)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    result = ordinary.withColumn(name, number)
    if frequent is None:
        return result
    numbered = running_totals(
        frequent, keys, order, {name: F.lit(1).cast("bigint")}, inclusive=True, max_rows=0
    )
    return result.unionByName(numbered)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    *,
    max_rows: Limit = HOT_ROWS,
) -> DataFrame:
    """Linear-interpolation quantiles per key (columns keys, probability, quantile).

    Equal values are merged first and the merged rows are ranked, so no task holds a whole group.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, keys, [F.col(value)], {"_before": F.col("_n")}, max_rows=max_rows)
    size = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    targets = (
        size.select(*keys, "_size", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability"))
        .withColumn("_at", F.col("probability") * (F.col("_size") - 1))
        .select(*keys, "probability", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_pos"))
        .distinct()
    )
    wanted = broadcast_if_small(targets.withColumnsRenamed({k: f"_r_{k}" for k in keys}))
    inside = (F.col("_before") <= F.col("_pos")) & (F.col("_pos") < F.col("_before") + F.col("_n"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], inside)
    picked = ranked.join(wanted, on).withColumn("_v", F.col(value))
    low, high = F.min("_v"), F.max("_v")
    share = F.max("_at") - F.floor(F.max("_at"))
    return picked.groupBy(*keys, "probability").agg((low + (high - low) * share).alias("quantile"))
