"""Distributed exact quantiles equal Spark's exact percentile."""

from pyspark.sql import functions as F

from hazardlens.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _spark_exact(df, col):
    return df.agg(F.percentile(F.col(col).cast("double"), PROBS).alias("q")).first().q


def test_matches_percentile_on_many_shapes(spark):
    df = spark.range(0, 20011).select(
        (F.col("id") % 97).cast("double").alias("few"),                         # heavy ties
        (F.sin(F.col("id")) * 1e6).alias("spread"),                           # distinct doubles
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") * 0.5).alias("nulls"),
        F.when(F.col("id") < 20000, F.lit(7.0)).otherwise(F.lit(1e300)).alias("skew"))  # one hot value
    for col in ("few", "spread", "nulls", "skew"):
        assert exact_quantiles(df, col, PROBS) == _spark_exact(df, col), col


def test_empty_and_single(spark):
    empty = spark.range(0).select(F.col("id").cast("double").alias("x"))
    assert exact_quantiles(empty, "x", [0.5]) == [None]
    one = spark.range(1).select(F.lit(3.5).alias("x"))
    assert exact_quantiles(one, "x", [0.1, 0.9]) == [3.5, 3.5]


def test_multi_column_and_infinities(spark):
    from hazardlens.operators.quantiles import exact_quantiles_multi
    df = spark.range(0, 5003).select(
        (F.col("id") % 13).cast("double").alias("a"),
        F.when(F.col("id") == 0, F.lit(float("-inf"))).when(F.col("id") == 1, F.lit(float("inf")))
         .otherwise(F.col("id") * 1.25).alias("b"),
        F.lit(None).cast("double").alias("empty"))
    got = exact_quantiles_multi(df, ["a", "b", "empty"], PROBS)
    assert got["a"] == _spark_exact(df, "a")
    assert got["b"] == _spark_exact(df, "b")
    assert got["empty"] == [None] * len(PROBS)
