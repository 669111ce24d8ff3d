import pytest
from pyspark.sql import functions as F

from antecede.operators.heavyjoin import heavy_join, heavy_keys


def _tables(spark):
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit(7)).when(n % 50 == 1, F.lit(None)).otherwise(n % 900)
    rows = spark.range(30_000).select("id", key.alias("k"), F.lit("x").alias("g"))
    side = spark.range(850).select(F.col("id").alias("k"), F.lit("x").alias("g"), (F.col("id") * 2).alias("v"))
    return rows, side


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_a_plain_join(spark, how):
    rows, side = _tables(spark)
    plain = sorted(map(str, rows.join(side, ["k", "g"], how).select("id", "k", "v").collect()))
    assert sorted(map(str, heavy_join(rows, side, ["k", "g"], how).select("id", "k", "v").collect())) == plain


def test_a_key_with_a_third_of_the_rows_is_spread(spark):
    rows, side = _tables(spark)
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert {r.k: r.parts for r in heavy_keys(counts).collect() if r.k is not None} == {7: 67}
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        joined = sizes(heavy_join(rows, side.drop("g"), ["k"], "left", counts))
        plain = sizes(rows.join(side.drop("g"), ["k"], "left"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(joined) == sum(plain) == 30_000
    assert joined[-1] <= 3 * joined[len(joined) // 2] and plain[-1] > 10 * plain[len(plain) // 2]
