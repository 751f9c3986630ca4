"""Nested provider payloads: exploding, flattening, fixture rows and context columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns every player row carries in front.
MATCH_CONTEXT = ("match_id", "season", "utc_date", "home_team_id", "home_team", "away_team_id", "away_team")


def _array(text: Column) -> Column:
    """Elements of a JSON array as text; null unless it is an array."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>"))


def explode_player_payload(df: DataFrame, json: str, output: str = "player") -> DataFrame:
    """One row per player object of a payload.

    ``data`` may be a list, an object with ``players``, or an object with ``home`` and ``away`` that are
    lists or hold ``players``.  Elements that are not objects are dropped.  Every level is parsed once:
    members stay JSON text until they are needed, and the outer explode keeps the optimizer from
    evaluating the parsed array a second time in an inferred filter.
    """
    none = F.array().cast("array<string>")
    names = df.columns
    staged = df.withColumn("_data", F.get_json_object(json, "$.data"))
    staged = staged.withColumn("_parts", F.when(F.col("_data").startswith("{"), F.from_json("_data", "players string, home string, away string")))

    def side(name: str) -> Column:
        text = F.col(f"_parts.{name}")
        return F.when(text.startswith("["), _array(text)).when(text.startswith("{"), _array(F.get_json_object(text, "$.players")))

    players = F.col("_parts.players")
    found = (
        F.when(F.col("_data").startswith("["), _array(F.col("_data"))).when(players.startswith("["), _array(players))
        .otherwise(F.concat(F.coalesce(side("home"), none), F.coalesce(side("away"), none)))
    )
    exploded = staged.select(*[F.col(f"`{c}`") for c in names], F.explode_outer(found).alias(output))
    return exploded.filter(F.col(output).startswith("{"))


def infer_json_type(df: DataFrame, json: str) -> str:
    """DDL type of a JSON text column, from one aggregation over all rows."""
    found = df.agg(F.schema_of_variant_agg(F.parse_json(json)).alias("t")).first()[0]
    return found.replace("OBJECT<", "STRUCT<")


def flatten_struct(df: DataFrame, column: str, sep: str = ".") -> DataFrame:
    """Replace a struct column by its leaves with joined names; lists become JSON text."""

    def leaves(fields, path: Column, prefix: str):
        for field in fields:
            name, value = f"{prefix}{field.name}", path[field.name]
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType.fields, value, f"{name}{sep}")
            elif isinstance(field.dataType, T.ArrayType):
                yield F.to_json(value).alias(name)
            else:
                yield value.alias(name)

    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*others, *leaves(df.schema[column].dataType.fields, F.col(column), ""))


def _first_text(json: str, *paths: str) -> Column:
    """First present, non-empty text among alternative paths."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, p), F.lit("")) for p in paths])


def match_row(df: DataFrame, json: str, *, competition: str | Column, season_id: str | Column, season: str | Column) -> DataFrame:
    """The 15 fixture columns, each from the first place that has it."""

    def given(value):
        return F.lit(value) if isinstance(value, str) else value

    def side(name: str, *keys: str) -> Column:
        has_long = F.get_json_object(json, f"$.{name}_team").startswith("{")
        long = F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{name}_team.{k}"), F.lit("")) for k in keys])
        short = F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{name}.{k}"), F.lit("")) for k in keys])
        return F.when(F.coalesce(has_long, F.lit(False)), long).otherwise(short)

    def score(name: str) -> Column:
        paths = (f"$.score.final_score.{name}", f"$.score.full_time.{name}", f"$.score.{name}", f"$.{name}_team.score", f"$.{name}_score")
        return F.coalesce(*[F.get_json_object(json, p) for p in paths]).try_cast("int")

    stage = F.get_json_object(json, "$.stage")
    return df.select(
        given(competition).alias("competition_id"), given(season_id).alias("season_id"), given(season).alias("season"),
        _first_text(json, "$.id", "$.match_id").alias("match_id"),
        _first_text(json, "$.utc_date", "$.kickoff_utc").alias("utc_date"),
        F.get_json_object(json, "$.status").alias("status"),
        F.get_json_object(json, "$.matchday").try_cast("int").alias("matchday"),
        F.when(stage.startswith("{"), F.get_json_object(json, "$.stage.name")).otherwise(F.nullif(stage, F.lit(""))).alias("stage_name"),
        side("home", "id", "team_id").alias("home_team_id"), side("home", "name", "team").alias("home_team"),
        side("away", "id", "team_id").alias("away_team_id"), side("away", "name", "team").alias("away_team"),
        score("home").alias("home_score"), score("away").alias("away_score"),
        F.get_json_object(json, "$.xg_available").try_cast("boolean").alias("xg_available"),
    )


def attach_context(stats: DataFrame, matches: DataFrame, on: str, context: Sequence[str] = MATCH_CONTEXT, prefix: str = "player.") -> DataFrame:
    """Context columns in front, then the statistics sorted by name; a colliding name gets a prefix.

    ``on`` names the column of ``stats`` that holds the fixture id.
    """
    key = context[0]
    held = {c: (f"{prefix}{c}" if c in context and c != on else c) for c in stats.columns}
    renamed = stats.select(*[F.col(f"`{c}`").alias("_on" if c == on else new) for c, new in held.items()])
    joined = renamed.join(matches.select(*context), F.col("_on") == F.col(key))
    rest = sorted(c for c in renamed.columns if c != "_on")
    return joined.select(*context, *[F.col(f"`{c}`") for c in rest])
