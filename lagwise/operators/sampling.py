"""Bins, deterministic samples, shuffles, ranked picks and running minima."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.ordering import HOT_ROWS, Limit, key_join, row_numbers, running_totals, small_join
from lagwise.session import cut_lineage


def sorted_output(df: DataFrame, *order: Column | str) -> DataFrame:
    """Total order over all rows (range partitioned, so no single task sorts everything)."""
    return df.orderBy(*order)


def equal_frequency_bins(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "bin",
    *, bins: int | None = None, minimum_size: int = 50, maximum_bins: int = 10, max_rows: Limit = HOT_ROWS,
) -> DataFrame:
    """0-based quantile bin of each row's rank; without ``bins`` their number follows from the group size."""
    ranked = row_numbers(df, keys, order, "_r", max_rows=max_rows)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = small_join(ranked, sizes, keys) if keys else ranked.join(F.broadcast(sizes))
    return ranked.withColumn(name, _quantile_bin(F.col("_r"), F.col("_n"), bins, minimum_size, maximum_bins)).drop("_r", "_n")


def _quantile_bin(rank: Column, size: Column, bins: int | None, minimum_size: int, maximum_bins: int) -> Column:
    q = F.lit(bins) if bins else F.greatest(F.lit(2), F.least(F.lit(maximum_bins), F.floor(size / minimum_size)))
    # ceil((r - 1) * q / (n - 1)) in whole numbers; a single row falls into bin 0
    span = F.greatest(size - 1, F.lit(1))
    edge = F.floor(((rank - 1) * q + span - 1) / span)
    return (F.greatest(edge, F.lit(1)) - 1).cast("bigint")


def equal_frequency_sums(
    df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], outcome: str,
    *, bins: int | None = None, minimum_size: int = 50, maximum_bins: int = 10, max_rows: Limit = HOT_ROWS,
) -> DataFrame:
    """Rows, mean value, and sum and number of outcomes per ``equal_frequency_bins`` of (value, tie).

    Equal values are merged before they are ranked; only rows of the few values that a border of bins cuts are ranked singly.
    """
    columns = ("_m", "_s", "_c")
    merged = cut_lineage(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m"), F.sum(outcome).alias("_s"), F.count(outcome).alias("_c")))
    sizes = merged.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    ranked = running_totals(merged, keys, [F.col(value)], {"_before": F.col("_m")}, max_rows=max_rows)
    ranked = small_join(ranked, sizes, keys) if keys else ranked.join(F.broadcast(sizes))
    at = lambda rank: _quantile_bin(F.col("_before") + rank, F.col("_n"), bins, minimum_size, maximum_bins)
    ranked = ranked.withColumns({"bin": at(F.lit(1)), "_last": at(F.col("_m"))})
    whole = ranked.filter("bin = _last").select(*keys, "bin", value, *columns)
    cut = ranked.filter("bin < _last").select(*keys, value, "_before", "_n")
    rows = small_join(df.select(*keys, value, *tie, outcome), cut, [*keys, value])
    rows = row_numbers(rows, [*keys, value], [F.col(t) for t in tie], "_r", max_rows=max_rows).withColumn("bin", at(F.col("_r")))
    single = rows.groupBy(*keys, "bin", value).agg(F.count(F.lit(1)).alias("_m"), F.sum(outcome).alias("_s"), F.count(outcome).alias("_c"))
    known = F.when(F.col(value).isNotNull(), F.col("_m"))
    return whole.unionByName(single).groupBy(*keys, "bin").agg(
        F.sum("_m").alias("matches"), (F.sum(F.col(value) * F.col("_m")) / F.sum(known)).alias("mean_value"), F.sum("_s").alias("outcomes"), F.sum("_c").alias("known"))


def evenly_spaced_sample(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int, *, max_rows: Limit = HOT_ROWS) -> DataFrame:
    """``size`` rows at evenly spaced ranks per key (all rows of a smaller group)."""
    ranked = row_numbers(df, keys, order, "_r", max_rows=max_rows)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    picks = sizes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    at = F.bround(F.col("_i") * (F.col("_n") - 1) / F.lit(size - 1)).cast("bigint") + 1
    wanted = picks.select(*keys, F.when(F.col("_n") <= size, F.col("_i") + 1).otherwise(at).alias("_r"))
    return small_join(ranked, wanted.distinct(), [*keys, "_r"]).drop("_r")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key; Spark trims every partition to k rows before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def pick_within_tolerance(df: DataFrame, keys: Sequence[str], loss: str, tolerance: float, order: Sequence[Column]) -> DataFrame:
    """Best row per key by ``order`` among the rows within ``tolerance`` of the lowest loss."""
    best = df.groupBy(*keys).agg(F.min(loss).alias("best_observed"))
    joined = small_join(df, best, keys) if keys else df.join(F.broadcast(best))
    return top_k(joined.filter(F.col(loss) <= F.col("best_observed") + tolerance), keys, order, 1).drop("rank")


def seeded_order(seed: int, *keys: str) -> Column:
    """A hash order that any engine can reproduce."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def shuffle_within(df: DataFrame, groups: Sequence[str], key: str, columns: Sequence[str], seed: int, prefix: str = "shuffled_", *, max_rows: Limit = HOT_ROWS) -> DataFrame:
    """Permute a block of columns jointly inside each group: rank by key meets rank by seeded hash."""
    natural = row_numbers(df, groups, [F.col(key)], "_rank", max_rows=max_rows)
    donors = df.select(*groups, key, *columns)
    donors = row_numbers(donors, groups, [seeded_order(seed, key), F.col(key)], "_rank", max_rows=max_rows)
    donors = donors.select(*groups, "_rank", *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return key_join(natural, donors, [*groups, "_rank"], "inner").drop("_rank")


def running_minimum(df: DataFrame, keys: Sequence[str], size: str, loss: str) -> DataFrame:
    """Lowest loss per size, the lowest so far, and whether the size lies on the frontier."""
    best = df.groupBy(*keys, size).agg(F.min(loss).alias(loss))
    upto = Window.partitionBy(*keys).orderBy(size).rowsBetween(Window.unboundedPreceding, 0)
    return best.withColumn("running_best", F.min(loss).over(upto)).withColumn("on_frontier", F.col(loss) == F.col("running_best"))


def ordered_groups(df: DataFrame, group: str, time: str, name: str = "position") -> DataFrame:
    """Groups numbered by their first time (one row per group)."""
    firsts = df.groupBy(group).agg(F.min(time).alias("first_time"))
    return firsts.withColumn(name, F.row_number().over(Window.orderBy("first_time", group)).cast("bigint"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks."""
    return left.subtract(right)


def concat_by_name(*parts: DataFrame) -> DataFrame:
    """Union by column name, absent columns null."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result
