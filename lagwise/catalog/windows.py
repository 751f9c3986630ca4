"""History windows, orders, samples and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagwise.catalog.registry import query, r6, rounded, with_ctes
from lagwise.operators import history as H
from lagwise.operators import sampling as P
from lagwise.operators.ordering import exact_quantiles, row_numbers
from lagwise.plans.tables import APPEARANCES, APPEARANCE_ORDER, MATCHES, appearances, matches, read

_EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type, value, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS measure FROM events)"""
_W = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def _w(k):
    return _W.format(k=k)


def events(spark, sf):
    e = read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.withColumn("measure", F.when(F.col("event_type") != "error", F.col("value")))


def _history(spark, sf, features, **kw):
    return H.with_history(events(spark, sf), ["user_id"], ["ts", "event_id"], features, **kw)


@query("history_by_type", with_ctes(_EVENTS, body=f"""
, h AS (SELECT event_type, coalesce(sum(value) OVER {_w(5)}, 0) AS s, coalesce(avg(measure) OVER {_w(5)}, 0) AS m, coalesce(stddev_pop(measure) OVER {_w(5)}, 0) AS d,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) / 86400000000.0 AS g FROM ev)
SELECT event_type, count(*) AS events, round(avg(s), 6) AS mean_sum_5, round(avg(m), 6) AS mean_mean_5, round(avg(d), 6) AS mean_std_5, round(avg(n), 6) AS mean_prior, round(avg(g), 6) AS mean_gap_days FROM h GROUP BY 1"""))
def _flagship(spark, sf):
    h = _history(spark, sf, [H.prev_sum("value", 5, "s"), H.prev_mean("measure", 5, "m"), H.prev_std("measure", 5, "d"), H.days_since_previous("ts", "g")], prior_count="n")
    return h.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), r6(F.avg("s"), "mean_sum_5"), r6(F.avg("m"), "mean_mean_5"),
                                       r6(F.avg("d"), "mean_std_5"), r6(F.avg("n"), "mean_prior"), r6(F.avg("g"), "mean_gap_days"))


@query("prev_sum", with_ctes(_EVENTS, body=f"SELECT event_id, round(coalesce(sum(value) OVER {_w(1)}, 0), 6) AS s1, round(coalesce(sum(value) OVER {_w(3)}, 0), 6) AS s3, round(coalesce(sum(value) OVER {_w(5)}, 0), 6) AS s5 FROM ev"))
def _prev_sum(spark, sf):
    return rounded(_history(spark, sf, [H.prev_sum("value", k, f"s{k}") for k in (1, 3, 5)]).select("event_id", "s1", "s3", "s5"))


@query("prev_observed", with_ctes(_EVENTS, body=f"SELECT event_id, round(coalesce(sum(measure) OVER {_w(5)}, 0), 6) AS observed_sum, count(measure) OVER {_w(5)} AS observed_count FROM ev"))
def _prev_observed(spark, sf):
    return rounded(_history(spark, sf, [H.prev_sum("measure", 5, "observed_sum"), H.prev_count("measure", 5, "observed_count")]).select("event_id", "observed_sum", "observed_count"))


@query("prev_mean", with_ctes(_EVENTS, body=f"SELECT event_id, round(coalesce(avg(measure) OVER {_w(3)}, 0), 6) AS m3, round(coalesce(avg(measure) OVER {_w(5)}, 0), 6) AS m5 FROM ev"))
def _prev_mean(spark, sf):
    return rounded(_history(spark, sf, [H.prev_mean("measure", k, f"m{k}") for k in (3, 5)]).select("event_id", "m3", "m5"))


@query("prev_std", with_ctes(_EVENTS, body=f"SELECT event_id, round(coalesce(stddev_pop(measure) OVER {_w(5)}, 0), 5) AS d5 FROM ev"))
def _prev_std(spark, sf):
    return _history(spark, sf, [H.prev_std("measure", 5, "d5")]).select("event_id", F.round("d5", 5).alias("d5"))


_EWM = """
WITH RECURSIVE r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value AS x,
   CASE WHEN event_type = 'error' THEN NULL ELSE value END AS y FROM events),
s AS (SELECT event_id, user_id, n, x AS wx, y AS wy, CAST(1 AS DOUBLE) AS age, CAST(NULL AS DOUBLE) AS px, CAST(NULL AS DOUBLE) AS py FROM r WHERE n = 1
 UNION ALL SELECT r.event_id, r.user_id, r.n, s.wx * 0.5**0.5 + (1 - 0.5**0.5) * r.x,
  CASE WHEN r.y IS NULL THEN s.wy WHEN s.wy IS NULL THEN r.y ELSE (s.wy * s.age * 0.5**0.5 + (1 - 0.5**0.5) * r.y) / (s.age * 0.5**0.5 + 1 - 0.5**0.5) END,
  CASE WHEN r.y IS NULL THEN s.age * 0.5**0.5 ELSE 1 END, s.wx, s.wy FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1)
SELECT event_id, round(coalesce(px, 0), 6) AS ewm_value, round(coalesce(py, 0), 6) AS ewm_measure FROM s"""


@query("prev_ewm", _EWM)
def _ewm(spark, sf):
    e = H.with_ewm(events(spark, sf), ["user_id"], ["ts", "event_id"], {"ewm_value": "value", "ewm_measure": "measure"}, halflife=2.0)
    return rounded(e.select("event_id", "ewm_value", "ewm_measure"))


@query("prev_ewm_sparse", """
WITH RECURSIVE n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, CASE WHEN event_id % 50 = 0 THEN value END AS x FROM events),
o AS (SELECT event_type, n, x, row_number() OVER (PARTITION BY event_type ORDER BY n) AS i, n - lag(n) OVER (PARTITION BY event_type ORDER BY n) AS gap FROM n WHERE x IS NOT NULL),
s AS (SELECT event_type, n, i, x AS w FROM o WHERE i = 1 UNION ALL
 SELECT o.event_type, o.n, o.i, (s.w * 0.5**(0.5 * o.gap) + (1 - 0.5**0.5) * o.x) / (0.5**(0.5 * o.gap) + 1 - 0.5**0.5) FROM s JOIN o ON o.event_type = s.event_type AND o.i = s.i + 1)
SELECT n.event_id, round(coalesce(s.w, 0), 6) AS ewm_sparse FROM n ASOF LEFT JOIN s ON n.event_type = s.event_type AND n.n > s.n""")
def _ewm_sparse(spark, sf):
    """One value in fifty rows, thousands of rows a key."""
    rows = events(spark, sf).withColumn("rare", F.when(F.col("event_id") % 50 == 0, F.col("value")))
    return rounded(H.with_ewm(rows, ["event_type"], ["ts", "event_id"], {"ewm_sparse": "rare"}, halflife=2.0).select("event_id", "ewm_sparse"))


@query("prior_counts", with_ctes(_EVENTS, body=f"""
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS prior_events, count(*) OVER {_w(5)} AS window_events,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 AS has_history FROM ev"""))
def _prior(spark, sf):
    h = _history(spark, sf, [H.window_size(5, "window_events")], prior_count="prior_events")
    return h.select("event_id", "prior_events", "window_events", (F.col("prior_events") > 0).alias("has_history"))


@query("previous_time", with_ctes(_EVENTS, body="""
SELECT event_id, coalesce(strftime(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), '%Y-%m-%dT%H:%M:%SZ'), '') AS previous_ts,
 round(coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 86400000000.0, 0), 6) AS days_since FROM ev"""))
def _previous(spark, sf):
    h = _history(spark, sf, [H.prev_value("ts", "p"), H.days_since_previous("ts", "days_since")])
    return h.select("event_id", F.coalesce(F.date_format("p", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("previous_ts"), r6("days_since"))


_AW = "(PARTITION BY player_id ORDER BY kickoff, match_id, l_linenumber, l_partkey, minutes, rating ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def _aw(k):
    return _AW.format(k=k)


_IDS = ["match_id", "player_id", "l_linenumber", "l_partkey", "minutes", "rating"]
_IDSQL = ", ".join(_IDS)


def _form(spark, sf, features, **kw):
    return H.with_history(appearances(spark, sf), ["player_id"], APPEARANCE_ORDER, features, **kw)


def _rate_sql(event, k):
    return f"round(coalesce(90 * sum({event}) OVER {_aw(k)} / nullif(sum(minutes) OVER {_aw(k)}, 0), 0), 6)"


@query("exposure_rate", with_ctes(APPEARANCES, body=f"SELECT {_IDSQL}, {_rate_sql('shots', 1)} AS shots_1, {_rate_sql('shots', 3)} AS shots_3, {_rate_sql('shots', 5)} AS shots_5, {_rate_sql('key_passes', 5)} AS passes_5 FROM appearances"))
def _rates(spark, sf):
    features = [H.rate("shots", "minutes", k, f"shots_{k}") for k in (1, 3, 5)] + [H.rate("key_passes", "minutes", 5, "passes_5")]
    return rounded(_form(spark, sf, features).select(*_IDS, "shots_1", "shots_3", "shots_5", "passes_5"), "shots_1", "shots_3", "shots_5", "passes_5")


@query("gated_rate", with_ctes(APPEARANCES, body=f"""
, o AS (SELECT *, CASE WHEN position <> 'A' THEN shots END AS npxg, CASE WHEN position <> 'A' THEN minutes END AS om FROM appearances)
SELECT {_IDSQL}, count(npxg) OVER {_aw(5)} AS observations, CASE WHEN count(npxg) OVER {_aw(5)} >= 3 AND sum(om) OVER {_aw(5)} >= 100
 THEN round(90 * sum(npxg) OVER {_aw(5)} / sum(om) OVER {_aw(5)}, 6) END AS gated FROM o"""))
def _gated(spark, sf):
    npxg = F.when(F.col("position") != "A", F.col("shots"))
    h = _form(spark, sf, [H.gated_rate(npxg, "minutes", 5, "gated", min_exposure=100.0), H.prev_count(npxg, 5, "observations")])
    return rounded(h.select(*_IDS, "observations", "gated"), "gated")


@query("trend", with_ctes(APPEARANCES, body=f"""
SELECT {_IDSQL}, round(coalesce(90 * sum(shots) OVER {_aw(1)} / nullif(sum(minutes) OVER {_aw(1)}, 0), 0) - coalesce(90 * sum(shots) OVER {_aw(5)} / nullif(sum(minutes) OVER {_aw(5)}, 0), 0), 6) AS shots_trend,
 round(coalesce(avg(rating) OVER {_aw(1)}, 0) - coalesce(avg(rating) OVER {_aw(5)}, 0), 4) AS rating_trend FROM appearances"""))
def _trend(spark, sf):
    shots = H.trend(H.rate("shots", "minutes", 1, ""), H.rate("shots", "minutes", 5, ""), "shots_trend")
    rating = H.trend(H.prev_mean("rating", 1, ""), H.prev_mean("rating", 5, ""), "rating_trend")
    h = _form(spark, sf, [shots, rating])
    return h.select(*_IDS, r6("shots_trend"), F.round("rating_trend", 4).alias("rating_trend"))


@query("residual_form", with_ctes(APPEARANCES, body=f"""
, r AS (SELECT *, shots - avg(shots) OVER () AS residual FROM appearances)
SELECT {_IDSQL}, round(coalesce(sum(residual * minutes) OVER {_aw(5)} / nullif(sum(minutes) OVER {_aw(5)}, 0), 0), 6) AS weighted_mean_5,
 round(coalesce(avg(residual) OVER {_aw(5)}, 0), 6) AS plain_mean_5, round(coalesce(stddev_pop(residual) OVER {_aw(5)}, 0), 5) AS std_5 FROM r"""))
def _residual(spark, sf):
    a = appearances(spark, sf)
    mean = a.agg(F.avg("shots").alias("_m"))
    a = a.join(F.broadcast(mean)).withColumn("residual", F.col("shots") - F.col("_m"))
    h = H.with_history(a, ["player_id"], APPEARANCE_ORDER, [
        H.rate(F.col("residual") * F.col("minutes"), "minutes", 5, "weighted_mean_5", per=1.0), H.prev_mean("residual", 5, "plain_mean_5"), H.prev_std("residual", 5, "std_5")])
    return h.select(*_IDS, r6("weighted_mean_5"), r6("plain_mean_5"), F.round("std_5", 5).alias("std_5"))


@query("equal_frequency_bins", with_ctes(MATCHES, body="""
SELECT match_id, CAST(greatest(ceil((r - 1) * 10 / (n - 1)), 1) - 1 AS BIGINT) AS bin FROM
 (SELECT match_id, row_number() OVER (PARTITION BY league ORDER BY home_odds, match_id) AS r, count(*) OVER (PARTITION BY league) AS n FROM matches)"""))
def _bins(spark, sf):
    return P.equal_frequency_bins(matches(spark, sf), ["league"], [F.col("home_odds"), F.col("match_id")], bins=10).select("match_id", "bin")


@query("ordered_seasons", with_ctes(MATCHES, body="SELECT season, strftime(min(kickoff), '%Y-%m-%d') AS first_day, row_number() OVER (ORDER BY min(kickoff), season) AS position FROM matches GROUP BY season"))
def _seasons(spark, sf):
    return P.ordered_groups(matches(spark, sf), "season", "kickoff").select("season", F.date_format("first_time", "yyyy-MM-dd").alias("first_day"), "position")


@query("running_minimum", """
WITH b AS (SELECT p_brand, p_size, min(p_retailprice) AS price FROM part GROUP BY 1, 2)
SELECT p_brand, p_size, price, min(price) OVER (PARTITION BY p_brand ORDER BY p_size) AS running_best, price = min(price) OVER (PARTITION BY p_brand ORDER BY p_size) AS on_frontier FROM b""")
def _minimum(spark, sf):
    return P.running_minimum(read(spark, sf, "part").withColumnRenamed("p_retailprice", "price"), ["p_brand"], "p_size", "price")


@query("quantile_limits", with_ctes(MATCHES, body="""
SELECT league, unnest([0.01, 0.5, 0.99])::DOUBLE AS probability, round(unnest(quantile_cont(home_odds * draw_odds, [0.01, 0.5, 0.99])), 6) AS quantile FROM matches GROUP BY league"""))
def _quantiles(spark, sf):
    m = matches(spark, sf).withColumn("v", F.col("home_odds") * F.col("draw_odds"))
    return rounded(exact_quantiles(m, ["league"], "v", [0.01, 0.5, 0.99]))


@query("stable_sort", """
SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS place FROM orders""")
def _sort(spark, sf):
    """The sorted rows, each with its place inside its status."""
    o = P.sorted_output(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderstatus", "o_orderdate", "o_orderkey")
    return row_numbers(o, ["o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")], "place").select("o_orderkey", "o_orderstatus", "place")


@query("top_k", """
SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def _top(spark, sf):
    return P.top_k(read(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("evenly_spaced_sample", """
WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderstatus, o_orderkey FROM r JOIN (SELECT unnest(range(20)) AS i) ON r.r = CASE WHEN n <= 20 THEN i + 1 ELSE CAST(round_even(i * (n - 1) / 19.0, 0) AS BIGINT) + 1 END""")
def _sample(spark, sf):
    o = read(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_orderdate")
    return P.evenly_spaced_sample(o, ["o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")], 20).select("o_orderstatus", "o_orderkey")


@query("pick_within_tolerance", """
WITH b AS (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand) AS best_observed FROM part)
SELECT p_brand, p_partkey, p_size, best_observed FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS r FROM b WHERE p_retailprice <= best_observed + 50) WHERE r = 1""")
def _pick(spark, sf):
    p = P.pick_within_tolerance(read(spark, sf, "part"), ["p_brand"], "p_retailprice", 50.0, [F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")])
    return p.select("p_brand", "p_partkey", "p_size", "best_observed")


@query("concat_by_name", """
SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, '' AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def _concat(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return P.concat_by_name(s, c).fillna("", ["segment"])


@query("set_difference", "SELECT o_custkey AS key FROM orders EXCEPT SELECT l_suppkey FROM lineitem")
def _difference(spark, sf):
    return P.set_difference(read(spark, sf, "orders").select(F.col("o_custkey").alias("key")), read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key")))


@query("shuffle_within", with_ctes(MATCHES, body="""
, n AS (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY match_id) AS r FROM matches),
d AS (SELECT league, season, home_odds, home_score, row_number() OVER (PARTITION BY league, season ORDER BY md5('42|' || match_id), match_id) AS r FROM matches)
SELECT n.match_id, d.home_odds AS shuffled_home_odds, d.home_score AS shuffled_home_score FROM n JOIN d ON n.league = d.league AND n.season = d.season AND n.r = d.r"""))
def _shuffle(spark, sf):
    return P.shuffle_within(matches(spark, sf), ["league", "season"], "match_id", ["home_odds", "home_score"], 42).select("match_id", "shuffled_home_odds", "shuffled_home_score")
