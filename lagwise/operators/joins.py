"""Joins whose cardinality is checked, and comparisons of key sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.operators.checks import duplicate_key_count


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", cardinality: str = "many_to_one") -> DataFrame:
    """Join after asserting that the side(s) called "one" hold each key once."""
    sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}[cardinality]
    for side in sides:
        if n := duplicate_key_count(side, on).first()[0]:
            raise ValueError(f"{cardinality} join on {list(on)}: {n} keys occur more than once")
    return left.join(right, list(on), how)


def attach_summary(df: DataFrame, summary: DataFrame, on: Sequence[str], fill: float | int = 0) -> DataFrame:
    """Left join of an aggregate, missing groups filled."""
    added = [c for c in summary.columns if c not in on]
    return df.join(summary, list(on), "left").fillna(fill, subset=added)


def lookup_both_sides(df: DataFrame, table: DataFrame, keys: Sequence[str], team: str, home: str, away: str,
                      values: Sequence[str], default=None, how: str = "left") -> DataFrame:
    """Look a (keys, team) table up for the home and for the away team."""
    for side, column in (("home", home), ("away", away)):
        named = table.select(*keys, F.col(team).alias("_team"), *[F.col(v).alias(f"{side}_{v}") for v in values])
        df = df.withColumn("_team", F.col(column)).join(named, [*keys, "_team"], how).drop("_team")
    if default is not None:
        df = df.fillna(default, subset=[f"{s}_{v}" for s in ("home", "away") for v in values])
    return df


def attach_default(df: DataFrame, table: DataFrame, on: Sequence[str], defaults: Mapping[str, float]) -> DataFrame:
    """Many-to-one left join with a default per column."""
    return df.join(table.select(*on, *defaults), list(on), "left").fillna(dict(defaults))


def merge_complete(first: DataFrame, others: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """One-to-one left joins of feature tables; a null in any added column is an error."""
    merged, added = first, []
    for other in others:
        merged = checked_join(merged, other, on, "left", "one_to_one")
        added += [c for c in other.columns if c not in on]
    nulls = merged.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in added]).first().asDict()
    if missing := sorted(c for c, n in nulls.items() if n):
        raise ValueError(f"combined features have missing values in: {missing}")
    return merged


def pivot_sides(long: DataFrame, keys: Sequence[str], side: str, features: Sequence[str]) -> DataFrame:
    """(key, side) rows to one row with home_x and away_x columns, in one aggregation."""
    wide = [
        F.first(F.when(F.col(side) == s, F.col(f)), ignorenulls=True).alias(f"{s}_{f}")
        for s in ("home", "away") for f in features
    ]
    return long.groupBy(*keys).agg(*wide)


def key_origins(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with the side(s) that have it: both, left_only or right_only."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    origin = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return a.join(b, list(keys), "full_outer").select(*keys, origin.alias("origin"))


def assert_same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    """Raise unless both tables hold the same keys."""
    counts = {r[0]: r[1] for r in key_origins(left, right, keys).groupBy("origin").count().collect()}
    if set(counts) - {"both"}:
        raise ValueError(f"the tables cover different keys: {counts}")


def membership_difference(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing from, or unexpected in, ``found``."""
    missing = expected.select(*keys).distinct().join(found.select(*keys), list(keys), "left_anti").withColumn("difference", F.lit("missing"))
    extra = found.select(*keys).distinct().join(expected.select(*keys), list(keys), "left_anti").withColumn("difference", F.lit("unexpected"))
    return missing.unionByName(extra)


def unordered_pairs(df: DataFrame, group: Sequence[str], member: str, values: Sequence[str] = (), max_size: int = 30) -> DataFrame:
    """Pairs a < b of distinct members inside each group: (group, first, second, first_v, second_v).

    A group is a line-up, so its size has a known bound; a larger group is an error, not a truncation.
    """
    largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > max_size:
        raise ValueError(f"a group of {largest} members exceeds the declared size {max_size}")
    other = df.select(*group, F.col(member).alias("second"), *[F.col(v).alias(f"second_{v}") for v in values])
    own = df.select(*group, F.col(member).alias("first"), *[F.col(v).alias(f"first_{v}") for v in values])
    return own.join(other, list(group)).filter(F.col("first") < F.col("second"))


def attach_benchmark(df: DataFrame, groups: Sequence[str], model: str, baseline: str, metric: str) -> DataFrame:
    """Metric of the benchmark row of the same group, the difference and the relative difference."""
    base = df.filter(F.col(model) == baseline).select(*groups, F.col(metric).alias("benchmark"))
    joined = checked_join(df, base, groups, "left") if groups else df.join(F.broadcast(_single(base)))
    safe = F.when(F.col("benchmark").isNull(), F.raise_error(F.lit("a group has no benchmark row"))).otherwise(F.col("benchmark"))
    joined = joined.withColumn("benchmark", safe)
    return joined.withColumns({
        "vs_benchmark": F.col(metric) - F.col("benchmark"),
        "relative_to_benchmark": (F.col(metric) - F.col("benchmark")) / F.col("benchmark"),
    })


def _single(df: DataFrame) -> DataFrame:
    """Raise unless there is exactly one row."""
    count, value = F.count(F.lit(1)), F.first(F.col(df.columns[0]))
    checked = F.when(count == 1, value).otherwise(F.raise_error(F.lit("expected one benchmark row")))
    return df.agg(checked.alias(df.columns[0]))


def paired_rows(df: DataFrame, role: str, baseline: str, enhanced: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Baseline and enhanced values of the same key side by side; differing keys or duplicates are an error.

    Both roles are read in one pass and meet in one aggregation.
    """
    named = (("baseline", baseline), ("enhanced", enhanced))
    wide = [F.first(F.when(F.col(role) == name, F.col(v)), True).alias(f"{label}_{v}") for label, name in named for v in values]
    seen = [F.count_if(F.col(role) == name).alias(f"_{label}") for label, name in named]
    paired = df.filter(F.col(role).isin(baseline, enhanced)).groupBy(*keys).agg(*wide, *seen)
    found = paired.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if((F.col("_baseline") != 1) | (F.col("_enhanced") != 1)).alias("unpaired")).first()
    if not found["keys"] or found["unpaired"]:
        raise ValueError(f"{baseline} and {enhanced} do not cover identical keys once: {found.asDict()}")
    return paired.drop("_baseline", "_enhanced")
