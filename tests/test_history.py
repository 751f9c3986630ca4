"""History features against pandas, for ordinary keys and for keys cut into blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagwise.operators import history as H
from lagwise.operators.ordering import exact_quantiles, row_numbers, running_totals


def sample(n=600, seed=3):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({
        "k": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
        "t": rng.integers(0, n, n),
        "id": np.arange(n),
        "x": rng.normal(5, 2, n),
        "m": rng.integers(0, 90, n).astype(float),
    })
    frame["y"] = frame["x"].where(rng.random(n) > 0.4)
    return frame.sort_values(["k", "t", "id"]).reset_index(drop=True)


def to_spark(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None).to_dict("records"),
                                 "k string, t long, id long, x double, m double, y double")


@pytest.mark.parametrize("max_rows", [None, 50, 0])
def test_bounded_windows(spark, max_rows, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 40)
    frame = sample()
    got = H.with_history(
        to_spark(spark, frame), ["k"], ["t", "id"],
        [H.prev_sum("x", 5, "s5"), H.prev_mean("y", 3, "m3"), H.prev_std("y", 5, "d5"), H.prev_count("y", 5, "c5"),
         H.rate("x", "m", 3, "r3"), H.prev_value("id", "p")],
        prior_count="n", max_rows=max_rows,
    ).toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)
    g = frame.groupby("k")
    roll = lambda c, w, f: g[c].transform(lambda v: getattr(v.shift(1).rolling(w, min_periods=1), f)()).fillna(0)
    np.testing.assert_allclose(got.s5, roll("x", 5, "sum"))
    np.testing.assert_allclose(got.m3, roll("y", 3, "mean"), atol=1e-12)
    std = g["y"].transform(lambda v: v.shift(1).rolling(5, min_periods=1).std(ddof=0)).fillna(0)
    np.testing.assert_allclose(got.d5, std, atol=1e-7)
    np.testing.assert_allclose(got.c5, roll("y", 5, "count"))
    np.testing.assert_array_equal(got.n, g.cumcount())
    minutes = roll("m", 3, "sum")
    np.testing.assert_allclose(got.r3, np.where(minutes > 0, 90 * roll("x", 3, "sum") / minutes.where(minutes > 0, 1), 0))
    np.testing.assert_allclose(got.p.fillna(-1).astype(float), g["id"].shift(1).fillna(-1))


@pytest.mark.parametrize("complete", [(), ("ex",)])
@pytest.mark.parametrize("max_rows", [None, 50])
def test_ewm_matches_pandas(spark, max_rows, complete):
    frame = sample()
    got = H.with_ewm(to_spark(spark, frame), ["k"], ["t", "id"], {"ex": "x", "ey": "y"}, halflife=2.0, complete=complete, max_rows=max_rows)
    got = got.toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)
    for c in ("x", "y"):
        want = frame.groupby("k")[c].transform(lambda v: v.shift(1).ewm(halflife=2.0, adjust=False).mean()).fillna(0)
        np.testing.assert_allclose(got["e" + c], want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("complete", [(), ("e",)])
@pytest.mark.parametrize("max_rows", [None, 50])
def test_ewm_with_initial_state(spark, max_rows, complete):
    frame = sample()
    got = H.with_ewm(to_spark(spark, frame), ["k"], ["t", "id"], {"e": "x"}, alpha=0.2, initial=1.35, complete=complete, max_rows=max_rows)
    got = got.toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)
    want = []
    for _, group in frame.groupby("k"):
        state = 1.35
        for x in group.x:
            want.append(state)
            state = 0.8 * state + 0.2 * x
    np.testing.assert_allclose(got.e, want, rtol=1e-9)


def test_null_in_a_complete_column_is_an_error(spark):
    with pytest.raises(Exception, match="null in e"):
        H.with_ewm(to_spark(spark, sample()), ["k"], ["t", "id"], {"e": "y"}, complete=["e"]).collect()


def test_running_totals_and_ranks(spark):
    frame = sample()
    df = to_spark(spark, frame)
    for limit in (None, 30):
        got = row_numbers(df, ["k"], [F.col("t"), F.col("id")], "r", max_rows=limit).toPandas()
        got = got.sort_values(["k", "t", "id"])
        np.testing.assert_array_equal(got.r, frame.groupby("k").cumcount() + 1)
        sums = running_totals(df, ["k"], [F.col("t"), F.col("id")], {"c": F.col("x")}, max_rows=limit).toPandas()
        sums = sums.sort_values(["k", "t", "id"])
        np.testing.assert_allclose(sums.c, frame.groupby("k")["x"].cumsum() - frame.x, atol=1e-9)


@pytest.mark.parametrize("max_rows", [None, 20])
def test_exact_quantiles(spark, max_rows):
    frame = sample()
    got = exact_quantiles(to_spark(spark, frame), ["k"], "y", [0.025, 0.5, 0.975], max_rows=max_rows).toPandas()
    for (key, p), value in got.set_index(["k", "probability"])["quantile"].items():
        assert value == pytest.approx(frame[frame.k == key].y.quantile(p))


@pytest.mark.parametrize("max_rows,every", [(10**6, 30), (10**6, 1700), (0, 30)])
def test_ewm_of_a_sparse_series(spark, max_rows, every):
    """Weights shrink across long gaps: no overflow, however few values a key has."""
    rows = 5100
    rng = np.random.default_rng(every)
    frame = pd.DataFrame({"k": 1, "t": range(rows), "id": range(rows), "x": np.where(np.arange(rows) % every == 7, rng.normal(size=rows), np.nan)})
    df = spark.createDataFrame([(1, t, t, None if np.isnan(x) else float(x)) for t, x in zip(frame.t, frame.x)], "k int, t int, id int, x double")
    for initial in (None, 1.35) if max_rows else (None,):
        got = H.with_ewm(df, ["k"], ["t", "id"], {"e": "x"}, halflife=2.0, initial=initial, max_rows=max_rows).orderBy("t").toPandas()["e"].to_numpy()
        state, gap, seen, want, a = initial, 0, False, [], 1 - 0.5 ** 0.5  # rows before the first value do not count
        for x in frame.x:
            want.append(0.0 if state is None else state)
            gap += 1
            if not np.isnan(x):
                gap = gap if seen else 1
                seen = True
                keep = (1 - a) ** gap
                state = x if state is None else (keep * state + a * x) / (keep + a)
                gap = 0
        assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("max_rows", [None, 50])
def test_rows_before_give_what_frames_give(spark, max_rows, monkeypatch):
    """Features from lags equal those from frames, nulls included, and no frame of several rows is left in the plan."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 40)
    df = to_spark(spark, sample()).withColumn("m", F.when(F.col("id") % 9 > 0, F.col("m"))).withColumn("flag", (F.col("id") % 3 == 0).cast("int"))
    df = df.withColumn("time", F.timestamp_seconds(F.col("t") * 40_000))
    product = F.col("y") * F.col("m")
    features = [
        H.prev_sum("y", 5, "a"), H.prev_sum("flag", 3, "b"), H.prev_count("y", 4, "c"), H.prev_mean("y", 1, "d"), H.prev_mean("y", 5, "e"), H.prev_std("y", 5, "f"),
        H.prev_value("k", "g"), H.window_size(5, "h"), H.rate("y", "m", 5, "i"), H.rate(product, "m", 3, "j", per=1.0), H.gated_rate("y", "m", 5, "l", min_exposure=100.0),
        H.trend(H.rate("x", "m", 1, ""), H.rate("x", "m", 5, ""), "n"), H.days_since_previous("time", "o"), H.Feature("p", 2, lambda w: F.max("x").over(w.rowsBetween(-2, -1)))]
    near = H.with_history(df, ["k"], ["t", "id"], features, prior_count="z", max_rows=max_rows)
    far = H.with_history(df, ["k"], ["t", "id"], [H.Feature(f.name, f.lookback, f.over) for f in features], prior_count="z", max_rows=max_rows)
    assert near.dtypes == far.dtypes
    plan = H.with_history(df, ["k"], ["t", "id"], features[:-1], max_rows=max_rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, -5, -1" not in plan and "RowFrame, -3, -1" not in plan
    a, b = (d.toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True) for d in (near, far))
    for c in b.columns:
        if b[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c], atol=1e-9)
        else:
            assert a[c].equals(b[c]), c
