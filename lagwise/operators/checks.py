"""One-pass data checks: every rule becomes a violation count, one aggregation reads them all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row with, per rule, the number of rows that break it; a null outcome counts as broken."""
    counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts)


def duplicate_key_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of keys held by more than one row."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    )


def check_dataset(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str] | None = None) -> DataFrame:
    """Raise with the violation counts when a rule is broken, otherwise return ``df`` unchanged."""
    found = violation_counts(df, rules).first().asDict()
    if found["rows"] == 0:
        raise ValueError("the table is empty")
    broken = {name: n for name, n in found.items() if name != "rows" and n}
    if keys and (n := duplicate_key_count(df, keys).first()[0]):
        broken["duplicate_keys"] = n
    if broken:
        raise ValueError(f"dataset checks failed: {broken}")
    return df


def match_rules(home: str, draw: str, away: str, scores: Sequence[str], result: str, tolerance: float = 1e-10) -> dict[str, Column]:
    """Rules for a fixture table: scores are whole and not negative, the result is known, probabilities are
    positive and sum to one."""
    rules = {f"{s}_is_count": (F.col(s) >= 0) & (F.col(s) == F.floor(F.col(s))) for s in scores}
    rules["result_known"] = F.col(result).isin("H", "D", "A")
    rules["probabilities_positive"] = (F.col(home) > 0) & (F.col(draw) > 0) & (F.col(away) > 0)
    rules["probabilities_sum_to_one"] = F.abs(F.col(home) + F.col(draw) + F.col(away) - 1) <= tolerance
    return rules


def finite_rules(columns: Sequence[str]) -> dict[str, Column]:
    """No nulls, NaN or infinities in the given columns."""
    return {
        f"{c}_finite": F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
        for c in columns
    }


def require_columns(df: DataFrame, required: Sequence[str], label: str = "table") -> None:
    """Raise when a required column is missing."""
    missing = sorted(set(required).difference(df.columns))
    if missing:
        raise ValueError(f"{label} is missing required columns: {', '.join(missing)}")


def assert_max_group(df: DataFrame, keys: Sequence[str], limit: int, label: str) -> DataFrame:
    """Raise when a group has more than ``limit`` rows (counts combine on the map side)."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > limit:
        raise ValueError(f"{label}: a group of {largest} rows exceeds the limit of {limit}")
    return df
