"""Codes, CSV reading, rounding and scratch folders on inputs that tell right from wrong."""

import math

import pytest
from pyspark.sql import functions as F

from hazardlens.functions import columns as C
from hazardlens.operators import features as FE
from hazardlens.sources import io as IO


def test_ordinal_without_exchange_reuse(spark):
    keys = spark.range(3_000_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("extra"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        coded = FE.ordinal(keys, ["k"]).select("code", "extra")
        r = coded.agg(F.countDistinct("code").alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"),
                      F.sum("extra").alias("s")).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert (r["n"], r["lo"], r["hi"]) == (3_000_000, 0, 2_999_999)
    assert r["s"] == sum(i % 7 for i in range(7)) * (3_000_000 // 7) + sum(i % 7 for i in range(3_000_000 % 7))


def test_csv_is_read_by_name(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("End_Lat,City,ID,Description,Distance(mi),Severity,Amenity,State\n"
                    "39.9,Dayton,A-1,some text,0.25,3,True,OH\n39.8,Troy,A-2,,x,2,,OH\n")
    df = IO.read_typed_csv(spark, str(path), corrupt_column="_bad")
    assert dict(df.dtypes)["Severity"] == "int" and dict(df.dtypes)["End_Lat"] == "string"
    a, b = df.orderBy("ID").collect()
    assert (a["City"], a["State"], a["Distance(mi)"], a["Severity"], a["Amenity"], a["_bad"]) == ("Dayton", "OH", 0.25, 3, True, None)
    assert b["Distance(mi)"] is None and b["City"] == "Troy" and b["Amenity"] is False and b["_bad"] is not None


@pytest.mark.parametrize("fn", [C.round_half_away, C.round_half_up])
def test_rounding_of_large_values_and_nan(spark, fn):
    df = spark.createDataFrame([(1e15,), (2.5e-7,), (float("nan"),), (None,), (12.3456785,)], "x double")
    got = [r[0] for r in df.select(fn("x", 6)).collect()]
    assert got[0] == 1e15 and got[1] == 0.0 and math.isnan(got[2]) and got[3] is None
    assert got[4] == pytest.approx(12.345679, abs=1e-6)


def test_running_sums_without_exchange_reuse(spark):
    """Sums over many keys and partitions are right, whatever the optimiser reuses."""
    from hazardlens.operators.running import running_sums
    df = spark.range(300_000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("v"))
    before = spark.conf.get("spark.sql.exchange.reuse")
    try:
        spark.conf.set("spark.sql.exchange.reuse", "false")
        got = running_sums(df, [F.col("k")], {"upto": "v"}).toPandas().sort_values("k")
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert len(got) == 300_000
    assert (got["upto"] == got["v"].cumsum()).all()
