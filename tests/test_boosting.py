"""Chronological folds, spread trials and the selection rule of the boosted trees."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.models import boosting as G


def fixtures(spark, seasons=(2001, 2002, 2003, 2004), n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in seasons:
        for k in range(n):
            x = float(rng.normal())
            result = "H" if x > 0.4 else "A" if x < -0.4 else "D"
            rows.append((s, dt.datetime(s, 1, 1) + dt.timedelta(days=3 * k), x, float(rng.normal()), result))
    return spark.createDataFrame(rows, "season int, kickoff timestamp, good double, noise double, result_3way string")


def test_folds_are_chronological_and_leave_the_last_season(spark):
    folds, calibration = G.time_folds(fixtures(spark))
    assert calibration == 2004
    ends = folds.groupBy("fold", "role").agg(F.min("kickoff").alias("first"), F.max("kickoff").alias("last"), F.collect_set("season").alias("s")).collect()
    by = {(r.fold, r.role): r for r in ends}
    assert len(by) == 4 and all(2004 not in r.s for r in ends)
    for fold in {r.fold for r in ends}:
        assert by[fold, "fit"].last < by[fold, "validate"]["first"]


def test_one_inner_season_is_cut_by_date(spark):
    folds, calibration = G.time_folds(fixtures(spark, (2001, 2002)))
    counts = {r.role: r["count"] for r in folds.groupBy("role").count().collect()}
    assert calibration == 2002 and counts == {"fit": 42, "validate": 18}
    assert folds.filter("role = 'fit'").agg(F.max("kickoff")).first()[0] < folds.filter("role = 'validate'").agg(F.min("kickoff")).first()[0]
    with pytest.raises(ValueError):
        G.time_folds(fixtures(spark, (2001,)))


def test_trials_spread_over_the_space():
    trials = G.trial_settings(G.SPACE, 64)
    assert trials == G.trial_settings(G.SPACE, 64)
    for name, r in G.SPACE.items():
        values = [t[name] for t in trials]
        assert set(values) <= set(r.values) if isinstance(r, G.Choice) else r.low <= min(values) and max(values) <= r.high
    assert all(t["num_leaves"] <= 2 ** t["max_depth"] for t in trials) and len({t["num_leaves"] for t in trials}) > 3
    steps = np.log([t["learning_rate"] for t in trials])
    share = (steps - np.log(0.005)) / np.log(16)
    assert np.abs(np.sort(share) - (np.arange(64) + 0.5) / 64).max() < 0.05


def test_selection_takes_the_most_stable_finalist(spark):
    search = G.Search(fixtures(spark, n=2).withColumns({"fold": F.lit(0), "fold_name": F.lit("x"), "role": F.lit("fit")}), {"a": ["good"]}, 5)
    search.runs = [(0, "a", "search", "x", 1, 0.5, 4.0), (1, "a", "search", "x", 1, 0.6, 8.0), (0, "a", "repeat", "x", 2, 0.9, 6.0), (1, "a", "repeat", "x", 2, 0.6, 10.0)]
    rows = {r.trial: r for r in search.table().collect()}
    assert rows[0].mean_log_loss == 0.5 and rows[0].stability_mean_log_loss == 0.9 and rows[1].median_rounds == 10.0


def test_tuning_end_to_end(spark):
    train = fixtures(spark, (2001, 2002, 2003))
    tuned = G.fit_tuned_boosting(train, {"good": ["good"], "noise": ["noise"]}, trials=6, finalists=2, repeats=2, max_rounds=30)
    table = tuned.trials.toPandas()
    assert table["selected"].sum() == 1 and table[table["selected"]]["feature_set"].item() == "good"
    assert table["stability_mean_log_loss"].notna().sum() == 2
    assert 10 <= tuned.fit.rounds <= 30 and tuned.calibrated_log_loss <= tuned.raw_log_loss + 1e-9
    total = tuned.transform(train).select((F.col("prob_H") + F.col("prob_D") + F.col("prob_A")).alias("p")).agg(F.min("p"), F.max("p")).first()
    assert abs(total[0] - 1) < 1e-9 and abs(total[1] - 1) < 1e-9


def test_fit_does_not_depend_on_partitions(spark):
    df = fixtures(spark)
    a, b = (G.fit_boosted(df.repartition(n), ["good", "noise"], settings={"rounds": 12, "subsample": 0.7}) for n in (1, 7))
    assert np.array_equal(a.trees.value, b.trees.value) and a.rounds == 12
    shares = {(r.result_class, r.feature): r.importance for r in a.importances(spark, "m").collect()}
    assert shares["H", "good"] > 0.9


def test_bounded_rows_and_early_stopping(spark):
    df = fixtures(spark, n=400)
    options = {"rounds": 300, "learning_rate": 0.3, "patience": 15}
    assert 1 <= G.fit_boosted(df, ["noise"], validation=F.col("season") == 2004, settings=options).rounds < 285
    fit = G.fit_boosted(df, ["good", "noise"], settings=options, fit_rows=500)
    loss = fit.transform(df.filter("season = 2004")).agg(F.avg(G.log_loss())).first()[0]
    assert loss < 0.3
    assert fit.transform(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="class is absent"):
        G.fit_boosted(df.filter("result_3way <> 'D'"), ["good"])


def test_bounded_rows_of_few_kinds(spark):
    """A fit on few of many rows sees every common kind, though the columns have only a handful of values."""
    few = lambda df: df.withColumn("good", F.round("good")).withColumn("noise", F.lit(0.0))
    df = few(fixtures(spark, n=400, seed=3)).cache()
    for columns in (["noise"], ["good"]):
        fit = G.fit_boosted(df, columns, settings={"rounds": 3, "min_child_samples": 1}, fit_rows=60)
        assert fit.rounds == 3
        start = np.exp(fit.trees.start)
        share = np.array([df.filter(F.col("result_3way") == c).count() for c in G.CLASSES]) / df.count()
        assert np.abs(start - share).max() < 0.15
    rows = df.select("result_3way", "noise")
    assert 590 <= G._sampled(rows, 600).count() <= 610 and G._sampled(rows, 1600).count() == 1600
    df.unpersist()


def test_fits_learn_from_all_rows(spark):
    """More rows than a fit used to be given: rare rows, which no sample holds in full, count to the last one."""
    rows = spark.range(60_000).withColumns({
        "good": (F.col("id") % 40).cast("double"), "weight": F.when(F.col("id") == 31, 30_000.0).otherwise(1.0),
        "result_3way": F.when(F.col("id") < 40, "D").when(F.col("id") % 2 == 0, "H").otherwise("A")})
    fit = G.fit_boosted(rows, ["good"], weight="weight", settings={"rounds": 1})
    assert np.exp(fit.trees.start) == pytest.approx(np.array([29_980, 30_039, 29_980]) / 89_999, rel=1e-9)


def test_slices_grow_the_trees_of_one_task(spark):
    """Kinds dealt over tasks give the trees that one task gives, and the same number of them."""
    df = fixtures(spark, n=300).withColumn("weight", F.when(F.col("good") > 1, 2.0).otherwise(1.0))
    options = {"rounds": 3, "learning_rate": 0.3, "num_leaves": 3, "colsample_bytree": 0.5}
    one, many = (G.fit_boosted(df, ["good", "noise"], weight="weight", validation=F.col("season") == 2004, settings=options, task_kinds=k) for k in (10**6, 400))
    assert one.rounds == many.rounds
    assert np.array_equal(one.trees.feature, many.trees.feature) and np.array_equal(one.trees.bin, many.trees.bin)
    np.testing.assert_allclose(one.trees.value, many.trees.value, atol=1e-9)
    with pytest.raises(Exception, match="class is absent"):
        G.fit_boosted(df.filter("result_3way <> 'D'"), ["good"], task_kinds=100)
