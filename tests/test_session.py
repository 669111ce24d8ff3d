"""Stored tables cut a plan's lineage and its estimated size."""

from pyspark.sql import functions as F

from antecede.session import checkpointed


def _estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_estimates_do_not_grow_with_rounds(spark):
    ahead = checkpointed(spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    first = _estimate(ahead)
    for _ in range(6):
        ahead = checkpointed(ahead.join(ahead.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
    assert _estimate(ahead) < 10 * first
    assert {(r.a, r.b) for r in ahead.collect()} == set()


def test_rows_types_and_empty_tables_are_kept(spark):
    df = spark.sql("SELECT 1 AS a, array(named_struct('x', 1.5D, 'y', CAST(NULL AS STRING))) AS s, date'2024-01-02' AS d, "
                   "map('k', X'00ff') AS m, CAST(2 AS DECIMAL(38, 0)) AS n")
    assert checkpointed(df).collect() == df.collect() and checkpointed(df).dtypes == df.dtypes
    assert checkpointed(df.filter("a = 2")).count() == 0
