"""Expanding time folds, boundary checks and table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.ordering import HOT_ROWS, Limit, row_numbers, small_join
from lagwise.operators.sampling import ordered_groups


def expanding_folds(df: DataFrame, season: str = "season", time: str = "kickoff", min_train: int = 2) -> DataFrame:
    """(test_season, train_season): every season from the third on is tested on all seasons before it."""
    ordered = ordered_groups(df, season, time)
    test = ordered.select(F.col(season).alias("test_season"), F.col("position").alias("_t"))
    train = ordered.select(F.col(season).alias("train_season"), F.col("position").alias("_p"))
    # one row per season on both sides
    return test.join(F.broadcast(train), (F.col("_p") < F.col("_t")) & (F.col("_t") > min_train)).drop("_t", "_p")


def fold_rows(df: DataFrame, folds: DataFrame, season: str = "season") -> DataFrame:
    """Every row once per fold it belongs to, with its role (train or test)."""
    roles = folds.select("test_season", F.col("train_season").alias(season), F.lit("train").alias("role")).unionByName(
        folds.select("test_season", F.col("test_season").alias(season), F.lit("test").alias("role")).distinct())
    return small_join(df, roles, [season])


def fold_checks(df: DataFrame, folds: DataFrame, *, season: str = "season", group: str = "league", time: str = "kickoff", result: str = "result_3way") -> DataFrame:
    """Per fold: sizes, groups on both sides, classes in training, and whether training ends before the test starts."""
    rows = fold_rows(df, folds, season)
    train, test = F.col("role") == "train", F.col("role") == "test"
    per = rows.groupBy("test_season", "role", season, group, result).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return per.groupBy("test_season").agg(
        F.sum(F.when(train, F.col("n")).otherwise(0)).alias("train_rows"), F.sum(F.when(test, F.col("n")).otherwise(0)).alias("test_rows"),
        F.countDistinct(F.when(train, F.col(group))).alias("train_groups"), F.countDistinct(F.when(test, F.col(group))).alias("test_groups"),
        F.countDistinct(F.when(train, F.col(result))).alias("train_classes"), F.countDistinct(F.when(train, F.col(season))).alias("train_seasons"),
        (F.max(F.when(train, F.col("last"))) < F.min(F.when(test, F.col("first")))).alias("train_before_test"))


def validate_folds(df: DataFrame, folds: DataFrame, groups: int, classes: int = 3, **columns: str) -> None:
    """Raise unless every fold covers all groups and classes and trains strictly before it tests."""
    bad = fold_checks(df, folds, **columns).filter(
        (F.col("train_groups") != groups) | (F.col("test_groups") != groups) | (F.col("train_classes") != classes) | ~F.col("train_before_test"))
    if rows := bad.collect():
        raise ValueError(f"fold boundaries are broken: {[r.asDict() for r in rows]}")


def feature_list_checks(df: DataFrame, allowed: Sequence[str], model: str = "model", feature: str = "feature") -> DataFrame:
    """Per model: features, repeated features and features outside the allowed names."""
    return df.groupBy(model).agg(
        F.count(F.lit(1)).alias("features"), (F.count(F.lit(1)) - F.countDistinct(feature)).alias("repeated"),
        F.count_if(~F.col(feature).isin(*allowed)).alias("unknown"))


def table_fingerprint(df: DataFrame, line: Column, buckets: int = 256) -> DataFrame:
    """One SHA-256 for a table as a set of text lines, whatever their order.

    Line digests are added up as four 60-bit numbers per bucket, and the digest of the sorted bucket
    sums is the fingerprint, so nothing larger than one row per bucket is ever in one place.
    """
    digest = df.select(F.sha2(line, 256).alias("_d"))
    part = lambda n: F.conv(F.substring("_d", 1 + 15 * n, 15), 16, 10).cast("decimal(38,0)")
    bucket = F.conv(F.substring("_d", 61, 4), 16, 10).cast("bigint") % buckets
    sums = digest.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(part(k)).alias(f"s{k}") for k in range(4)])
    text = F.concat_ws(",", F.lpad(F.col("_bucket").cast("string"), 5, "0"), F.col("n").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)])
    joined = F.array_join(F.sort_array(F.collect_list(text)), "\n")
    return sums.agg(F.sum("n").alias("rows"), F.sha2(joined, 256).alias("fingerprint"))


def ordered_fingerprint(df: DataFrame, line: Column, order: Sequence[Column], fanout: int = 4_096, *, max_rows: Limit = HOT_ROWS) -> DataFrame:
    """Rows and SHA-256 of a table as a sequence of text lines in the given order (ties by line; a null line is empty).

    A tree of digests: every ``fanout`` lines in a row have one digest, so have every ``fanout`` of those, and the digest of
    what remains is the fingerprint.  It depends on the sequence alone, not on partitions; the last step holds one digest per
    ``fanout`` squared lines (60,000 for 10^12).  An empty table has the digest of the empty text.
    """
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    lines = df.select(F.lit(0).alias("_all"), F.coalesce(line, F.lit("")).alias("_line"), *keys)
    by = [F.col(f"_o{i}") for i in range(len(keys))] + [F.col("_line")]
    level = row_numbers(lines, ["_all"], by, "_r", max_rows=max_rows).select((F.col("_r") - 1).alias("at"), F.col("_line").alias("text"), F.lit(1).cast("bigint").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n")
    for _ in range(2):
        level = level.groupBy(F.floor(F.col("at") / fanout).alias("block")).agg(F.sha2(joined, 256).alias("text"), F.sum("n").alias("n")).withColumnRenamed("block", "at")
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(joined, 256).alias("fingerprint"))


def list_fingerprint(df: DataFrame, line: Column, max_rows: int = 100_000) -> str:
    """SHA-256 over the sorted lines of a short list, each ended by a newline."""
    lines = [r[0] for r in df.select(line.alias("l")).orderBy("l").take(max_rows + 1)]
    if len(lines) > max_rows:
        raise ValueError("use table_fingerprint for long tables")
    return df.sparkSession.range(1).select(F.sha2(F.lit("".join(f"{v}\n" for v in lines)), 256)).first()[0]


def season_positions(df: DataFrame, season: str, time: str) -> DataFrame:
    """Seasons with their position by first date."""
    return ordered_groups(df, season, time).select(season, "position")


def late_block_cutoff(df: DataFrame, time: str, share: float = 0.7) -> DataFrame:
    """The latest date of the first ``share`` of distinct dates: a chronological split inside one season."""
    dates = df.select(F.to_date(time).alias("day")).distinct()
    ranked = dates.select("day", F.row_number().over(Window.orderBy("day")).alias("r"))
    size = dates.agg(F.greatest(F.floor(F.count(F.lit(1)) * share), F.lit(1)).alias("k"))
    return ranked.join(F.broadcast(size), F.col("r") == F.col("k")).select(F.col("day").alias("cutoff"))
