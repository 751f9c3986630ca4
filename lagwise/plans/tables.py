"""Fixtures, appearances and provider tables derived from the driver's star schema, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.session import deal_by_rows

TEAMS = 20
#: Tables that grow with the input; the others are small beside them.
LARGE = ("orders", "lineitem", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return deal_by_rows(table) if name in LARGE else table


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fixture per order: the region is the league, the year the season."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    league = (
        read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "n_regionkey")
    )
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return orders.join(league, cust == F.col("c_custkey")).select(
        key.alias("match_id"),
        F.col("n_regionkey").alias("league"),
        F.year("o_orderdate").alias("season"),
        F.col("o_orderdate").alias("kickoff"),
        (cust % TEAMS).alias("home_team"),
        ((cust % TEAMS + 1 + key % (TEAMS - 1)) % TEAMS).alias("away_team"),
        (key % 4).cast("int").alias("home_score"),
        ((key * 7 + cust) % 3).cast("int").alias("away_score"),
        (F.lit(1.5) + (key % 37).cast("double") / F.lit(10.0)).alias("home_odds"),
        (F.lit(2.5) + (key % 23).cast("double") / F.lit(10.0)).alias("draw_odds"),
        (F.lit(1.6) + (key % 41).cast("double") / F.lit(10.0)).alias("away_odds"),
    )


MATCHES = """matches AS (
SELECT o_orderkey AS match_id, n_regionkey AS league, CAST(year(o_orderdate) AS INT) AS season,
       o_orderdate AS kickoff,
       o_custkey % 20 AS home_team,
       (o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS away_team,
       CAST(o_orderkey % 4 AS INT) AS home_score,
       CAST((o_orderkey * 7 + o_custkey) % 3 AS INT) AS away_score,
       CAST(1.5 AS DOUBLE) + CAST(o_orderkey % 37 AS DOUBLE) / CAST(10 AS DOUBLE) AS home_odds,
       CAST(2.5 AS DOUBLE) + CAST(o_orderkey % 23 AS DOUBLE) / CAST(10 AS DOUBLE) AS draw_odds,
       CAST(1.6 AS DOUBLE) + CAST(o_orderkey % 41 AS DOUBLE) / CAST(10 AS DOUBLE) AS away_odds
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One appearance per line item; the supplier is the player."""
    lines = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("match_id"),
        F.col("l_suppkey").alias("player_id"),
        "l_partkey", "l_linenumber",
        F.col("o_orderdate").alias("kickoff"),
        F.col("l_quantity").alias("minutes"),
        (F.col("l_discount") * 100).alias("shots"),
        (F.col("l_tax") * 100).alias("key_passes"),
        F.col("l_extendedprice").alias("rating"),
        F.col("l_returnflag").alias("position"),
    )


APPEARANCES = """appearances AS (
SELECT l_orderkey AS match_id, l_suppkey AS player_id, l_partkey, l_linenumber, o_orderdate AS kickoff,
       l_quantity AS minutes, l_discount * 100 AS shots, l_tax * 100 AS key_passes,
       l_extendedprice AS rating, l_returnflag AS position
FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

APPEARANCE_ORDER = ["kickoff", "match_id", "l_linenumber", "l_partkey", "minutes", "rating"]


def provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second provider: it knows the fixtures that have line items, and disagrees on some scores."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(
        F.max("l_quantity").alias("top_quantity"), F.min("l_returnflag").alias("first_flag"),
        F.max("l_discount").alias("top_discount"),
    )
    m = matches(spark, sf_dir)
    return m.join(lines, "match_id").select(
        F.concat_ws("|", F.col("season").cast("string"), F.date_format("kickoff", "yyyy-MM-dd"),
                    F.col("match_id").cast("string")).alias("join_key"),
        (F.col("home_score") + F.when(F.col("top_quantity") >= 50, 1).otherwise(0)).cast("int").alias("full_time_home"),
        F.col("away_score").alias("full_time_away"),
        (F.col("first_flag") != "R").alias("odds_is_closing"),
        F.when(F.col("top_discount") > 0.02, F.col("home_odds")).otherwise(F.lit(1.0)).alias("home_odds"),
        "draw_odds", "away_odds",
    )


PROVIDER = """provider AS (
SELECT concat_ws('|', CAST(season AS VARCHAR), strftime(kickoff, '%Y-%m-%d'), CAST(match_id AS VARCHAR)) AS join_key,
       CAST(home_score + CASE WHEN top_quantity >= 50 THEN 1 ELSE 0 END AS INT) AS full_time_home,
       away_score AS full_time_away, first_flag <> 'R' AS odds_is_closing,
       CASE WHEN top_discount > CAST(0.02 AS DOUBLE) THEN home_odds ELSE CAST(1 AS DOUBLE) END AS home_odds,
       draw_odds, away_odds
FROM matches JOIN (SELECT l_orderkey, max(l_quantity) AS top_quantity, min(l_returnflag) AS first_flag,
                          max(l_discount) AS top_discount FROM lineitem GROUP BY l_orderkey) ON match_id = l_orderkey)"""


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player rows with a side, a starter flag and some missing ids and minutes."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag",
        "l_linestatus", "l_discount", "l_tax",
    )
    m = matches(spark, sf_dir).select("match_id", "season", "home_team", "away_team")
    return lines.join(m, "match_id").select(
        "match_id", "season",
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_suppkey")).alias("player_id"),
        F.when(F.col("l_discount") >= 0.1, F.lit(99).cast("bigint"))
        .when(F.col("l_linenumber") % 2 == 1, F.col("home_team")).otherwise(F.col("away_team")).alias("team_id"),
        (F.col("l_linestatus") == "F").alias("started"),
        (F.col("l_returnflag") != "R").alias("played"),
        F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("minutes"),
        F.when(F.col("l_returnflag") != "A", F.col("l_tax") * 100).alias("npxg"),
        (F.col("l_discount") * 100).alias("shots"),
    )


PLAYERS = """players AS (
SELECT l_orderkey AS match_id, season, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END AS player_id,
       CASE WHEN l_discount >= CAST(0.1 AS DOUBLE) THEN 99 WHEN l_linenumber % 2 = 1 THEN home_team ELSE away_team END AS team_id,
       l_linestatus = 'F' AS started, l_returnflag <> 'R' AS played,
       CASE WHEN l_quantity <= 45 THEN l_quantity END AS minutes,
       CASE WHEN l_returnflag <> 'A' THEN l_tax * 100 END AS npxg, l_discount * 100 AS shots
FROM lineitem JOIN matches ON l_orderkey = match_id)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forecasts per fixture: the market, and the market pulled one fifth towards even chances."""
    m = matches(spark, sf_dir)
    inverse = [F.lit(1.0) / F.col(c) for c in ("home_odds", "draw_odds", "away_odds")]
    total = inverse[0] + inverse[1] + inverse[2]
    base = m.select(
        "match_id", "league", "season", "kickoff",
        F.when(F.col("home_score") > F.col("away_score"), "H").when(F.col("home_score") < F.col("away_score"), "A")
        .otherwise("D").alias("result_3way"),
        *[(i / total).alias(f"p{n}") for n, i in enumerate(inverse)],
    )
    options = F.array(*[
        F.struct(F.lit(name).alias("model"), *[
            (F.col(f"p{n}") * F.lit(share) + F.lit((1 - share) / 3)).alias(f"prob_{c}") for n, c in enumerate("HDA")
        ]) for name, share in (("closing_market", 1.0), ("softened_market", 0.8))
    ])
    return base.select("match_id", "league", "season", "kickoff", "result_3way", F.inline(options))


FORECASTS = """inverse AS (
SELECT match_id, league, season, kickoff,
       CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS result_3way,
       1 / home_odds AS ih, 1 / draw_odds AS idr, 1 / away_odds AS ia FROM matches),
forecasts AS (
SELECT match_id, league, season, kickoff, result_3way, model,
       ih / (ih + idr + ia) * share + (1 - share) / 3 AS prob_H,
       idr / (ih + idr + ia) * share + (1 - share) / 3 AS prob_D,
       ia / (ih + idr + ia) * share + (1 - share) / 3 AS prob_A
FROM inverse CROSS JOIN (VALUES ('closing_market', CAST(1.0 AS DOUBLE)), ('softened_market', CAST(0.8 AS DOUBLE))) AS v(model, share))"""
