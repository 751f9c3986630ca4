"""Sources and sinks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.catalog.registry import query, r6, with_ctes
from lagwise.functions import scalars as S
from lagwise.plans.tables import MATCHES, matches, read
from lagwise.sources import payload as P
from lagwise.sources import tables as T
from lagwise.streaming.ingest import ingest_stream, read_current


@query("read_text_table", """
SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day, o_orderpriority FROM orders""")
def _text_table(spark, sf):
    path = T.scratch_path(spark, "orders-csv")
    read(spark, sf, "orders").select(*[F.col(c).cast("string") for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]).write.csv(path, header=True)
    table = T.read_text_table(
        spark, path, ["o_orderkey", "o_totalprice", "o_orderdate"],
        {"o_orderkey": F.col("o_orderkey").try_cast("bigint"), "o_totalprice": S.to_number("o_totalprice"),
         "order_day": S.iso_date("o_orderdate")})
    return table.drop("o_orderdate")


@query("scan_seasons", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def _scan(spark, sf):
    o = T.scan_seasons(read(spark, sf, "orders"), "o_orderstatus", "F", "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return o.select("o_orderkey", "o_custkey", "o_totalprice")


_ODDS = {"AvgCH": "home_odds", "AvgCD": "draw_odds", "AvgCA": "away_odds", "B365H": "home_odds", "B365D": "draw_odds", "B365A": "away_odds"}


def _season_file(spark, sf):
    """Fixtures as a season file writes them: blanks around headers, missing closing prices, some rows without goals."""
    m = matches(spark, sf)
    closing = F.col("home_odds") <= 4.0
    prices = [F.when(closing if c.startswith("AvgC") else F.lit(True), F.col(v)).cast("string").alias(f" {c} ") for c, v in _ODDS.items()]
    return m.select(
        F.concat(F.lit("D"), F.col("league").cast("string")).alias("﻿Div"), F.date_format("kickoff", "dd/MM/yyyy").alias("Date "),
        F.concat(F.lit(" T"), F.col("home_team").cast("string"), F.lit("-"), F.col("match_id").cast("string")).alias("HomeTeam"),
        F.concat(F.lit("T"), F.col("away_team").cast("string")).alias("AwayTeam"),
        F.when(F.col("draw_odds") <= 4.5, F.col("home_score")).cast("string").alias("HG"), F.col("away_score").cast("string").alias("FTAG"),
        F.lower(S.result_3way("home_score", "away_score")).alias("Res"), F.col("season").alias("start_year"), *prices)


@query("normalize_season_results", with_ctes(MATCHES, body="""
SELECT concat('T', home_team, '-', match_id) AS home_team, concat('T', away_team) AS away_team, concat('D', league) AS division,
  concat(season, '-', lpad(CAST((season + 1) % 100 AS VARCHAR), 2, '0')) AS season, strftime(kickoff, '%Y-%m-%d') AS match_date,
  home_score AS full_time_home, away_score AS full_time_away,
  CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS result_3way,
  CASE WHEN home_odds <= 4 THEN 'market_average_closing' ELSE 'bet365_preclosing' END AS odds_source, home_odds <= 4 AS odds_is_closing,
  home_odds, draw_odds, away_odds, round(1/home_odds / (1/home_odds + 1/draw_odds + 1/away_odds), 6) AS market_p_home
FROM matches WHERE draw_odds <= CAST(4.5 AS DOUBLE)"""))
def _season(spark, sf):
    clean = T.normalize_season_results(_season_file(spark, sf), "start_year", source="provider")
    return clean.select("home_team", "away_team", "division", "season", "match_date", "full_time_home", "full_time_away", "result_3way",
                        "odds_source", "odds_is_closing", "home_odds", "draw_odds", "away_odds", r6("market_p_home"))


@query("first_complete_candidate", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_discount*100 > 1 AND l_tax*100 > 1 THEN 'closing' WHEN l_quantity > 1 THEN 'opening' END AS source,
  coalesce(l_discount*100 > 1 AND l_tax*100 > 1, false) AS is_closing,
  CASE WHEN l_discount*100 > 1 AND l_tax*100 > 1 THEN round(l_discount*100, 6) WHEN l_quantity > 1 THEN l_quantity END AS home FROM lineitem""")
def _candidate(spark, sf):
    lines = read(spark, sf, "lineitem").withColumn("d", F.col("l_discount") * 100).withColumn("t", F.col("l_tax") * 100)
    chosen = S.first_complete_candidate((("closing", ("d", "t", "d"), True), ("opening", ("l_quantity", "l_quantity", "l_quantity"), False)))
    return lines.withColumn("c", chosen).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                                F.col("c.source").alias("source"), F.coalesce("c.is_closing", F.lit(False)).alias("is_closing"), r6("c.home", "home"))


def _payloads(spark, sf):
    """One payload per line item, in each accepted layout, with an element that is not an object."""
    lines = read(spark, sf, "lineitem")
    player = lambda shift: F.struct(
        (F.col("l_suppkey") + shift).alias("player_id"), F.struct(F.col("l_quantity").alias("goals"), F.col("l_tax").alias("shots")).alias("shooting"),
        F.array(F.col("l_partkey"), F.col("l_linenumber").cast("bigint")).alias("tags"), F.col("l_returnflag").alias("status"))
    players = F.array(player(0), player(1))
    text = lambda c: F.to_json(c)
    listed = F.concat(F.lit('{"data": ['), text(player(0)), F.lit(', 5, "x", '), text(player(1)), F.lit("]}"))
    held = text(F.struct(F.struct(players.alias("players")).alias("data")))
    sides = text(F.struct(F.struct(F.array(player(0)).alias("home"), F.struct(F.array(player(1)).alias("players")).alias("away")).alias("data")))
    layout = F.when(F.col("l_returnflag") == "A", listed).when(F.col("l_returnflag") == "N", held).otherwise(sides)
    return lines.select(F.col("l_orderkey").alias("match_id"), "l_linenumber", layout.alias("payload"))


_PLAYER_TYPE = "player_id bigint, shooting struct<goals: double, shots: double>, tags array<bigint>, status string"


@query("explode_player_payload", """
SELECT l_orderkey AS match_id, l_linenumber, l_suppkey + s AS player_id, count(*) AS rows FROM lineitem CROSS JOIN (VALUES (0), (1)) AS v(s) GROUP BY ALL""")
def _explode(spark, sf):
    rows = P.explode_player_payload(_payloads(spark, sf), "payload")
    return rows.groupBy("match_id", "l_linenumber", F.get_json_object("player", "$.player_id").cast("bigint").alias("player_id")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("flatten_struct", """
SELECT l_orderkey AS match_id, l_suppkey + s AS player_id, l_quantity AS "shooting.goals", l_tax AS "shooting.shots",
  concat('[', l_partkey, ',', l_linenumber, ']') AS tags, l_returnflag AS status FROM lineitem CROSS JOIN (VALUES (0), (1)) AS v(s)""")
def _flatten(spark, sf):
    rows = P.explode_player_payload(_payloads(spark, sf), "payload").select("match_id", F.from_json("player", _PLAYER_TYPE).alias("p"))
    return P.flatten_struct(rows, "p")


@query("match_row", with_ctes(MATCHES, body="""
SELECT CAST(match_id AS VARCHAR) AS match_id, CAST(season AS VARCHAR) AS season, strftime(kickoff, '%Y-%m-%d') AS utc_date, 'finished' AS status, season - 1994 AS matchday,
 CASE WHEN league < 2 THEN concat('Stage ', league) WHEN league = 2 THEN 'Plain' END AS stage_name, CAST(home_team AS VARCHAR) AS home_team_id, concat('T', home_team) AS home_team,
 CAST(away_team AS VARCHAR) AS away_team_id, concat('T', away_team) AS away_team, home_score, away_score, league = 4 AS xg_available FROM matches"""))
def _match_row(spark, sf):
    m = matches(spark, sf)
    s = lambda c: F.col(c).cast("string")
    team = lambda side, *names: F.struct(s(f"{side}_team").alias(names[0]), F.concat(F.lit("T"), s(f"{side}_team")).alias(names[1]))
    scored = lambda side: F.struct(s(f"{side}_team").alias("id"), F.concat(F.lit("T"), s(f"{side}_team")).alias("name"), F.col(f"{side}_score").alias("score"))
    pair = F.struct(F.col("home_score").alias("home"), F.col("away_score").alias("away"))
    common = [F.lit("finished").alias("status"), (F.col("season") - 1994).alias("matchday")]
    day = F.date_format("kickoff", "yyyy-MM-dd")
    long = [s("match_id").alias("id"), day.alias("utc_date"), team("home", "id", "name").alias("home_team"), team("away", "id", "name").alias("away_team"), *common]
    short = [s("match_id").alias("match_id"), day.alias("kickoff_utc"), team("home", "team_id", "team").alias("home"), team("away", "team_id", "team").alias("away"), *common]
    stage = F.struct(F.concat(F.lit("Stage "), s("league")).alias("name")).alias("stage")
    layouts = {
        0: [*long, stage, F.struct(pair.alias("final_score")).alias("score")],
        1: [*long, stage, F.struct(pair.alias("full_time")).alias("score")],
        2: [*short, F.lit("Plain").alias("stage"), pair.alias("score")],
        3: [s("match_id").alias("id"), day.alias("utc_date"), scored("home").alias("home_team"), scored("away").alias("away_team"), *common],
        4: [*short, "home_score", "away_score", F.lit(True).alias("xg_available")],
    }
    json = F.coalesce(*[F.when(F.col("league") == k, F.to_json(F.struct(*v))) for k, v in layouts.items()])
    rows = P.match_row(m.select("season", json.alias("json")), "json", competition="c", season_id="s", season=F.col("season").cast("string"))
    return rows.drop("competition_id", "season_id").fillna(False, ["xg_available"])


@query("attach_context", """
SELECT o_orderkey AS match_id, o_orderstatus AS season, o_orderpriority AS utc_date, l_returnflag AS "player.season", l_quantity AS goals, l_suppkey AS player_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _context(spark, sf):
    stats = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("player_id"), F.col("l_returnflag").alias("season"), F.col("l_quantity").alias("goals"))
    fixtures = read(spark, sf, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_orderstatus").alias("season"), F.col("o_orderpriority").alias("utc_date"))
    return P.attach_context(stats, fixtures, "l_orderkey", ("match_id", "season", "utc_date"))


@query("pending_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _pending(spark, sf):
    done = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.pending_keys(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("upsert", """
WITH base AS (SELECT l_orderkey, l_suppkey, l_shipdate, l_partkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS fresh FROM lineitem)
SELECT l_orderkey, l_suppkey, l_shipdate, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey
  ORDER BY fresh DESC, l_shipdate DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) AS r FROM base) WHERE r = 1""")
def _upsert(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_partkey", "l_quantity", "l_extendedprice", "l_linestatus")
    old, new = [lines.filter(F.col("l_linestatus") == v).drop("l_linestatus") for v in ("F", "O")]
    merged = T.upsert(old, new, ["l_orderkey", "l_suppkey"], ["l_shipdate", "l_partkey", "l_quantity", "l_extendedprice"])
    return merged.drop("l_extendedprice")


@query("append_rows", "SELECT event_type, count(*) AS rows, round(sum(value), 4) AS total FROM (SELECT * FROM events UNION ALL SELECT * FROM events) GROUP BY event_type")
def _append(spark, sf):
    path = T.scratch_path(spark, "event-log")
    events = read(spark, sf, "events").select("event_id", "event_type", "value")
    T.append_rows(events, path)
    T.append_rows(events, path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))


@query("write_result_tables", """
SELECT 'by_status' AS table_name, o_orderstatus AS key, count(*) AS rows FROM orders GROUP BY 2 UNION ALL
SELECT 'by_priority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def _results(spark, sf):
    path = T.scratch_path(spark, "results")
    orders = read(spark, sf, "orders")
    count = lambda c: orders.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    T.write_result_tables({"by_status": count("o_orderstatus"), "by_priority": count("o_orderpriority")}, path)
    named = [spark.read.parquet(f"{path}/{n}").select(F.lit(n).alias("table_name"), "key", "rows") for n in ("by_status", "by_priority")]
    return named[0].unionByName(named[1])


@query("add_missing_column", "SELECT s_suppkey, s_name, CAST(NULL AS DOUBLE) AS rating FROM supplier")
def _add_column(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey", "s_name")
    return T.add_missing_column(T.add_missing_column(s, "rating", "double"), "s_name", "string")


@query("split_and_write", with_ctes(MATCHES, body="""
SELECT CASE WHEN season = 2001 THEN 'final' ELSE 'development' END AS sample, season, count(*) AS matches,
 CAST(sum(CASE WHEN league < 2 THEN home_score END) AS BIGINT) AS goals FROM matches GROUP BY 1, 2"""))
def _split(spark, sf):
    path = T.scratch_path(spark, "model-dataset")
    m = matches(spark, sf).withColumn("match_id", S.qualify_id("league", "match_id"))
    parts = [m.filter("league < 2").select("match_id", "season", "kickoff", "home_score"), m.filter("league >= 2").select("match_id", "season", "kickoff")]
    T.split_and_write(parts, path, season="season", final_season=2001, keys=["match_id"], sort=["kickoff", "match_id"])
    both = [spark.read.parquet(f"{path}/{n}").withColumn("sample", F.lit(n)) for n in ("development", "final")]
    return both[0].unionByName(both[1]).groupBy("sample", "season").agg(F.count(F.lit(1)).alias("matches"), F.sum("home_score").alias("goals"))


@query("ingest_stream", """
SELECT l_orderkey AS match_id, l_suppkey AS player_id, max(l_quantity) AS goals FROM lineitem GROUP BY 1, 2""")
def _stream(spark, sf):
    """Payload files land in two batches, the second is replayed; the table holds each key once."""
    raw, table = T.scratch_path(spark, "raw"), T.scratch_path(spark, "player-table")
    lines = read(spark, sf, "lineitem")
    player = F.struct("l_suppkey", F.col("l_quantity").alias("goals"))
    text = lines.select(F.to_json(F.struct(F.col("l_orderkey").alias("match_id"), F.array(player).alias("data"))).alias("value"), "l_linestatus")
    parse = lambda df: P.explode_player_payload(df, "value").select(
        F.get_json_object("value", "$.match_id").cast("bigint").alias("match_id"),
        F.get_json_object("player", "$.l_suppkey").cast("bigint").alias("player_id"),
        F.get_json_object("player", "$.goals").cast("double").alias("goals"))
    for status in ("F", "O", "O"):
        text.filter(F.col("l_linestatus") == status).select("value").write.mode("append").text(raw)
        ingest_stream(spark, raw, table, parse)
    return read_current(spark, table, ["match_id", "player_id"], ["goals"])
