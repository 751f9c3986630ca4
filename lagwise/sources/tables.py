"""Readers and writers: text tables, filtered scans, keyed upserts, result sets."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.functions.scalars import ODDS_CANDIDATES, devig, first_complete_candidate, parse_day, result_3way, season_label
from lagwise.operators.checks import check_dataset, require_columns
from lagwise.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_text_table(spark: SparkSession, path: str, required: Sequence[str], coerce: Mapping[str, Column] | None = None) -> DataFrame:
    """CSV with every column as text; required columns are asserted, then the given columns are coerced.

    Columns are read by header name file by file, so the files may differ in column order.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False, encoding="UTF-8")
    require_columns(raw, required, path)
    return raw.withColumns(dict(coerce or {}))


def scan_seasons(df: DataFrame, division: str, division_value, season: str, seasons: Sequence) -> DataFrame:
    """Filtered scan: both predicates reach the Parquet reader."""
    return df.filter((F.col(division) == division_value) & F.col(season).isin(*seasons))


def trimmed_headers(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks or a byte-order mark."""
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def normalize_season_results(df: DataFrame, start_year: str | Column, *, source: str, division: Column | None = None, url: Column | None = None) -> DataFrame:
    """One clean row per fixture of a season file.

    Header blanks are trimmed, alternative column names are accepted, rows without teams, date or goals
    are dropped, the best complete odds triplet is chosen, and a stated result that contradicts the
    goals is an error.
    """
    raw = trimmed_headers(df)
    have = set(raw.columns)

    def text(*names: str) -> Column:
        found = [F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    home_goals, away_goals = text("FTHG", "HG").try_cast("int"), text("FTAG", "AG").try_cast("int")
    odds_columns = sorted({c for _, names, _ in ODDS_CANDIDATES for c in names} - have)
    wide = raw.withColumns({c: F.lit(None).cast("string") for c in odds_columns})
    start = F.col(start_year) if isinstance(start_year, str) else start_year
    staged = wide.select(
        F.lit(source).alias("source"), season_label(start).alias("season"),
        F.coalesce(text("Div"), division if division is not None else F.lit(None)).alias("division"),
        text("Date").alias("_date"), text("HomeTeam").alias("home_team"), text("AwayTeam").alias("away_team"),
        home_goals.alias("full_time_home"), away_goals.alias("full_time_away"),
        F.upper(text("FTR", "Res")).alias("_stated"), first_complete_candidate().alias("_odds"),
        (url if url is not None else F.lit(None).cast("string")).alias("source_url"),
    ).dropna(subset=["_date", "home_team", "away_team", "full_time_home", "full_time_away"])
    derived = result_3way("full_time_home", "full_time_away")
    agreed = F.when(
        F.col("_stated").isNotNull() & (F.col("_stated") != derived),
        F.raise_error(F.concat(F.lit("result contradicts goals: "), F.col("home_team"), F.lit(" v "), F.col("away_team"))),
    ).otherwise(derived)
    market = devig("_odds.home", "_odds.draw", "_odds.away", strict=False)
    return staged.select(
        "source", "season", "division", parse_day("_date").cast("string").alias("match_date"),
        "home_team", "away_team", "full_time_home", "full_time_away", agreed.alias("result_3way"),
        F.col("_odds.source").alias("odds_source"), F.coalesce(F.col("_odds.is_closing"), F.lit(False)).alias("odds_is_closing"),
        F.col("_odds.home").alias("home_odds"), F.col("_odds.draw").alias("draw_odds"), F.col("_odds.away").alias("away_odds"),
        market["home"].alias("market_p_home"), market["draw"].alias("market_p_draw"), market["away"].alias("market_p_away"),
        "source_url",
    )


def pending_keys(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` that are not done yet."""
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: Sequence[str | Column]) -> DataFrame:
    """Last writer wins per key: incoming beats existing, then the higher version beats the lower.

    The winner is a ``max_by`` aggregate, so many versions of one key combine before the shuffle.  A
    null or blank key is an error.
    """
    marked = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    blank = [F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == "" for k in keys]
    safe = [F.when(b, F.raise_error(F.lit(f"empty key column {k}"))).otherwise(F.col(k)).alias(k) for k, b in zip(keys, blank)]
    rest = [c for c in existing.columns if c not in keys]
    rank = F.struct("_new", *[F.col(v).alias(f"_v{n}") if isinstance(v, str) else v.alias(f"_v{n}") for n, v in enumerate(version)])
    winners = marked.select(*safe, F.struct(*rest).alias("_row"), rank.alias("_rank")).groupBy(*keys).agg(
        F.max_by("_row", "_rank").alias("_row"))
    return winners.select(*keys, "_row.*").select(*existing.columns)


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a log table."""
    df.write.mode("append").parquet(path)


def write_result_tables(tables: Mapping[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """Write named result tables; without ``overwrite`` an existing table is an error."""
    for name, table in tables.items():
        table.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/{name}")


def add_missing_column(df: DataFrame, name: str, dtype: str) -> DataFrame:
    """The table with a null column added unless it is already there."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def split_and_write(parts: Sequence[DataFrame], path: str, *, season: str, final_season, keys: Sequence[str], sort: Sequence[str]) -> None:
    """Combine the parts by name, check the keys, and write a development and a final table by season."""
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    check_dataset(combined, {f"{k}_present": F.col(k).isNotNull() for k in keys}, keys)
    for name, rows in (("development", F.col(season) != final_season), ("final", F.col(season) == final_season)):
        combined.filter(rows).repartitionByRange(season, *sort).sortWithinPartitions(*sort).write.partitionBy(season).parquet(f"{path}/{name}")
