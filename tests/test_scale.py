"""Work that must not grow with the share of the input that a task gets."""

from pyspark.sql import functions as F

from lagwise.operators.ordering import chunked
from lagwise.session import INITIAL_PARTITIONS, deal_by_rows, shuffle_partitions


def test_shuffles_start_with_partitions_for_the_rows(spark):
    before = spark.conf.get(INITIAL_PARTITIONS, None)
    rows = spark.range(1_000).withColumn("key", F.lit(1))
    try:
        deal_by_rows(rows, 100)
        assert shuffle_partitions(spark) == 10
        deal_by_rows(rows, 500)
        assert shuffle_partitions(spark) == 10, "the number is never lowered"
        parts = chunked(rows, ["key"], [F.col("id")])
        assert parts.rdd.getNumPartitions() == 10
        assert parts.groupBy("_chunk").count().agg(F.max("count")).first()[0] < 250
    finally:
        spark.conf.unset(INITIAL_PARTITIONS) if before is None else spark.conf.set(INITIAL_PARTITIONS, before)
