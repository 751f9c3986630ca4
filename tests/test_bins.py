"""Bins of merged values against bins of single rows."""

import pytest
from pyspark.sql import functions as F

from lagwise.operators import sampling as S


@pytest.mark.parametrize("max_rows", [1_000_000, 50])
def test_sums_per_bin_equal_those_of_single_rows(spark, monkeypatch, max_rows):
    value = F.when(F.col("id") % 41 != 0, (F.col("id") * F.col("id") % 23).cast("double"))
    observed = F.when(F.col("id") % 13 != 0, (F.col("id") % 3 == 0).cast("int"))
    df = spark.range(1200).select("id", (F.col("id") % 2).alias("k"), value.alias("v"), observed.alias("o"))
    single = S.equal_frequency_bins(df, ["k"], [F.col("v"), F.col("id")]).groupBy("k", "bin").agg(
        F.count(F.lit(1)), F.avg("v"), F.sum("o"), F.count("o")).orderBy("k", "bin").collect()
    ranked, plain = [], S.row_numbers
    monkeypatch.setattr(S, "row_numbers", lambda rows, *rest, **kw: (ranked.append(rows.select("k", "v").distinct().count()), plain(rows, *rest, **kw))[1])
    merged = S.equal_frequency_sums(df, ["k"], "v", ["id"], "o", max_rows=max_rows).orderBy("k", "bin").collect()
    assert len(single) == 20 and [(r[0], r[1], r[2], r[4], r[5]) for r in merged] == [(r[0], r[1], r[2], r[4], r[5]) for r in single]
    assert [r[3] for r in merged] == pytest.approx([r[3] for r in single], nan_ok=True)
    assert ranked and ranked[0] <= 18  # at most nine borders a key
