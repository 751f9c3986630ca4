"""Sources, checks and joins: accepted layouts, and the errors that must be raised."""

import json

import pytest
from pyspark.sql import functions as F

from lagwise.functions import scalars as S
from lagwise.operators import audit as A
from lagwise.operators import joins as J
from lagwise.operators.bootstrap import paired_losses
from lagwise.operators.checks import check_dataset
from lagwise.sources import payload as P
from lagwise.sources import tables as T
from lagwise.streaming.ingest import compact, ingest_stream, read_current


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_payload_layouts(spark):
    a, b = {"id": 1}, {"id": 2}
    payloads = [
        {"data": [a, 5, "x", b]}, {"data": {"players": [a, None]}}, {"data": {"home": [a], "away": {"players": [b, 3]}}},
        {"data": {"players": {"no": 1}, "home": [b]}}, {"data": []}, {"other": 1}, {"data": "text"}]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "i int, j string")
    got = P.explode_player_payload(df, "j").select("i", F.get_json_object("player", "$.id").cast("int").alias("id")).collect()
    assert sorted((r.i, r.id) for r in got) == [(0, 1), (0, 2), (1, 1), (2, 1), (2, 2), (3, 2)]


def test_flatten_struct_and_context(spark):
    df = spark.createDataFrame([("m", "s", (1, (2.0, [1, 2])))], "match_id string, season string, p struct<a: int, b: struct<c: double, d: array<int>>>")
    flat = P.flatten_struct(df, "p")
    assert flat.columns == ["match_id", "season", "a", "b.c", "b.d"]
    assert flat.first()["b.d"] == "[1,2]"
    fixtures = spark.createDataFrame([("m", "2020")], "match_id string, season string")
    out = P.attach_context(flat, fixtures, "match_id", ("match_id", "season"))
    assert out.columns == ["match_id", "season", "a", "b.c", "b.d", "player.season"]


def test_inferred_payload_type(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"d": [1]}',)], "j string")
    wide = P.flatten_struct(df.select(F.from_json("j", P.infer_json_type(df, "j")).alias("p")), "p")
    assert set(wide.columns) == {"a", "b.c", "d"}


def test_season_file_errors_and_order_of_preference(spark):
    columns = ["Div", " Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", "AvgCH", "AvgCD", "AvgCA", "PSH", "PSD", "PSA"]
    good = ("SC0", "1/8/20", " A ", "B", "2", "1", "h", "1.9", "", "4", "2.0", "3.5", "4.1")
    short = ("SC0", "02/08/2020", "C", "D", "", "1", "", *[None] * 6)
    got = T.normalize_season_results(spark.createDataFrame([good, short], columns), F.lit(2020), source="s").collect()
    assert [(r.home_team, r.match_date, r.season, r.odds_source, r.odds_is_closing) for r in got] == [("A", "2020-08-01", "2020-21", "pinnacle_preclosing", False)]
    bad = ("SC0", "1/8/20", "A", "B", "2", "1", "A", *[None] * 6)
    with pytest.raises(Exception, match="contradicts"):
        T.normalize_season_results(spark.createDataFrame([bad], "a string, " + ", ".join(f"c{i} string" for i in range(12))).toDF(*columns), F.lit(2020), source="s").collect()


def test_text_rules(spark):
    one = spark.range(1)
    assert one.select(S.normalize_name(F.lit("  Žižkov FC ﬁn½ ßa "))).first()[0] == "zizkovfin12a"
    assert one.select(S.normalize_name(F.lit("Celtic F.C."), {"celticfc": "celtic"})).first()[0] == "celtic"
    with pytest.raises(Exception, match="unsupported date"):
        one.select(S.parse_day(F.lit("2020-01-01"))).collect()
    with pytest.raises(Exception, match="matchday"):
        one.select(S.competition_phase(F.lit("turkey"), F.lit("x"), F.lit("1.5"), F.lit(None))).collect()
    with pytest.raises(Exception, match="above 1"):
        one.select(S.devig(F.lit(1.0), F.lit(3.0), F.lit(3.0))["home"]).collect()


def test_upsert_is_idempotent_and_rejects_empty_keys(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, x int")
    new = spark.createDataFrame([("b", 2, 9), ("c", 1, 5), ("b", 3, 7)], "k string, v int, x int")
    once = T.upsert(old, new, ["k"], ["v"])
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(once) == [("a", 1, 1), ("b", 3, 7), ("c", 1, 5)]
    assert rows(T.upsert(once, new, ["k"], ["v"])) == rows(once)
    with pytest.raises(Exception, match="empty key"):
        T.upsert(old, spark.createDataFrame([(" ", 1, 1)], old.schema), ["k"], ["v"]).collect()


def test_stream_replay(spark):
    raw, table, small = (T.scratch_path(spark, n) for n in ("raw", "table", "small"))
    parse = lambda df: df.select(F.get_json_object("value", "$.k").alias("k"), F.get_json_object("value", "$.x").cast("int").alias("x"))
    for rows in ([("a", 1), ("b", 2)], [("b", 5)], [("b", 5)]):
        spark.createDataFrame([(json.dumps({"k": k, "x": x}),) for k, x in rows], "value string").write.mode("append").text(raw)
        ingest_stream(spark, raw, table, parse)
    ingest_stream(spark, raw, table, parse)
    assert sorted(map(tuple, read_current(spark, table, ["k"]).collect())) == [("a", 1), ("b", 5)]
    compact(spark, table, small, ["k"])
    assert spark.read.parquet(small).count() == 2


def test_results_are_not_overwritten(spark):
    path = T.scratch_path(spark, "results")
    T.write_result_tables({"t": spark.range(2)}, path)
    with pytest.raises(Exception, match="exists"):
        T.write_result_tables({"t": spark.range(2)}, path)


def test_cardinality_and_key_checks(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, r string")
    with pytest.raises(ValueError, match="more than once"):
        J.checked_join(left, right, ["k"])
    with pytest.raises(ValueError, match="different keys"):
        J.assert_same_keys(left, right, ["k"])
    with pytest.raises(ValueError, match="bad"):
        check_dataset(left, {"bad": F.col("k") > 1})


def test_pairing_needs_the_same_matches(spark):
    rows = [("m1", "base"), ("m1", "new"), ("m2", "base")]
    df = spark.createDataFrame([("x", m, "2020", "H", mod, 0.5, 0.3, 0.2) for m, mod in rows],
                               "league string, match_id string, season string, result_3way string, model string, prob_H double, prob_D double, prob_A double")
    with pytest.raises(ValueError, match="identical"):
        paired_losses(df.withColumn("match_date", F.to_date(F.lit("2020-01-01"))), "base", "new")


def test_every_inclusion_check_has_its_reason(spark):
    rows = [tuple(i != j for j in range(9)) for i in range(9)] + [(True,) * 9, (False,) * 9]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, " + ", ".join(f"{c} boolean" for c in S.MATCH_CHECKS))
    got = df.select("n", S.meets_all(S.MATCH_CHECKS).alias("ok"), S.exclusion_reason(S.EXCLUSION_PRIORITY).alias("why"), S.failed_checks(S.MATCH_CHECKS).alias("failed")).orderBy("n").collect()
    for n, check in enumerate(S.MATCH_CHECKS):
        assert (got[n].ok, got[n].why, got[n].failed) == (False, S.EXCLUSION_PRIORITY[check], check)
    assert (got[9].ok, got[9].why, got[9].failed) == (True, None, "")
    assert got[10].why == "not_top_division_match" and got[10].failed.count("|") == 8


def test_duplicates_ignore_missing_ids(spark):
    df = spark.createDataFrame([(1, 7), (1, 7), (1, None), (1, None), (2, 7)], "m int, p int")
    assert A.duplicate_rows(df, ["m", "p"]).count() == 2


def test_names_beyond_the_basic_plane(spark):
    from lagwise.functions.scalars import normalize_name
    names = ["𝐀𝐣𝐚𝐱 FC", "Ünión ½ ﬁ™", "Ajax", None, "😀 ok", "Ægir ﬀ𝟙"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(normalize_name("n")).collect()]
    assert got == ["ajax", "union12fitm", "ajax", "", "ok", "girff1"]
