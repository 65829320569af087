"""Scalar helpers on literal tables (the reference's own cases where it has them)."""

import math

from pyspark.sql import functions as F

from hazardlens.functions import columns as C

# The reference's weather-code table test: 14 (code, category) cases.
CODE_CASES = [(200, "Thunderstorm"), (300, "Drizzle"), (500, "Light Rain"), (501, "Rain"),
              (502, "Heavy Rain"), (600, "Light Snow"), (601, "Snow"), (602, "Heavy Snow"),
              (701, "Fog"), (741, "Fog"), (800, "Clear"), (802, "Cloudy"), (804, "Overcast"),
              (9999, "Clear")]


def test_weather_category(spark):
    df = spark.createDataFrame(CODE_CASES, "code int, expected string")
    got = df.select("expected", C.weather_category("code").alias("got")).collect()
    assert all(r.expected == r.got for r in got)


def test_hour_label_and_periods(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    rows = df.select("h", C.hour_label("h").alias("l"), C.staging_time_period("h").alias("p"),
                     C.scorer_period_code("h").alias("s"), C.api_period_code("h").alias("a"),
                     C.is_rush_hour("h").alias("r"), C.is_rush_hour("h", "scorer").alias("rs")).collect()
    by = {r.h: r for r in rows}
    assert by[0].l == "12:00 AM" and by[9].l == "9:00 AM" and by[12].l == "12:00 PM" and by[13].l == "1:00 PM"
    assert by[6].p == "Morning Rush" and by[15].p == "Midday" and by[19].p == "Evening Rush"
    assert by[23].p == "Evening" and by[3].p == "Night"
    assert [by[h].s for h in (0, 6, 10, 16, 20)] == [0, 1, 2, 3, 4]
    assert [by[h].a for h in (5, 6, 12, 18, 22)] == [0, 1, 2, 3, 0]
    assert by[19].r == 1 and by[19].rs == 0 and by[16].rs == 1


def test_minute_boundaries(spark):
    df = spark.createDataFrame([("2024-01-01 10:59:59", "2024-01-01 11:00:01", 1),
                                ("2024-01-01 10:00:00", "2024-01-01 10:00:59", 0),
                                ("2024-01-01 23:59:30", "2024-01-02 00:01:00", 2)], "a string, b string, e int")
    got = df.select("e", C.minute_boundaries(F.col("a").try_cast("timestamp_ntz"),
                                             F.col("b").try_cast("timestamp_ntz")).alias("g")).collect()
    assert all(r.e == r.g for r in got)


def test_haversine_example(spark):
    # Tempe -> Sedona. The reference's docstring says "100.5 miles"; the
    # formula it implements (and this one) gives 100.31.
    row = spark.range(1).select(C.haversine_miles(F.lit(33.4255), F.lit(-111.94), F.lit(34.8697),
                                                  F.lit(-111.761)).alias("d")).first()
    assert round(row.d, 1) == 100.3


def _py_haversine(a, b):
    la1, lo1 = a
    la2, lo2 = b
    dlat, dlon = math.radians(la2 - la1), math.radians(lo2 - lo1)
    x = math.sin(dlat / 2) ** 2 + math.cos(math.radians(la1)) * math.cos(math.radians(la2)) * math.sin(dlon / 2) ** 2
    return 3959.0 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_haversine_matches_python(spark):
    pts = [(33.4255, -111.94), (33.45, -111.9), (34.8697, -111.761), (25.0, -80.0)]
    df = spark.createDataFrame([(a[0], a[1], b[0], b[1]) for a in pts for b in pts], "a double, b double, c double, d double")
    for r in df.select("a", "b", "c", "d", C.haversine_miles("a", "b", "c", "d").alias("x")).collect():
        assert abs(r.x - _py_haversine((r.a, r.b), (r.c, r.d))) < 1e-9


def test_weather_codes_text(spark):
    df = spark.createDataFrame([("Light Rain",), ("Partly Cloudy",), ("Fog",), ("Thunderstorm",), (None,), ("Mist",)], "c string")
    rows = {r.c: r for r in df.select("c", C.scorer_weather_code("c").alias("s"), C.api_weather_code("c").alias("a"),
                                     C.poor_weather_text("c").alias("p")).collect()}
    assert rows["Light Rain"].s == 7 and rows["Light Rain"].a == 3 and rows["Light Rain"].p == 1
    assert rows["Partly Cloudy"].s == 2 and rows["Partly Cloudy"].a == 1
    assert rows["Fog"].s == 4 and rows["Fog"].a == 9
    assert rows[None].s == 0 and rows[None].a == 0 and rows["Mist"].a == 0 and rows["Mist"].p == 0


def test_levels_confidence_rounding(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (0.55,), (0.65,), (0.9,)], "p double")
    rows = df.select("p", C.risk_level3("p").alias("l3"), C.risk_level4("p", "MODERATE").alias("l4"),
                     C.confidence_distance("p").alias("cd"), C.confidence_max("p").alias("cm")).collect()
    assert [r.l3 for r in rows] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]
    assert [r.l4 for r in rows] == ["LOW", "MODERATE", "HIGH", "HIGH", "CRITICAL"]
    r = spark.range(1).select(C.round_half_away(F.lit(1.005), 2).alias("a"),
                              C.round_half_away(F.lit(-2.5), 0).alias("b"),
                              C.location_string(F.lit(33.515625), F.lit(-111.0)).alias("s")).first()
    assert r.a == 1.0 and r.b == -3.0 and r.s == "(33.51562, -111.00000)"


def test_weekday_helpers(spark):
    df = spark.createDataFrame([("monday",), ("Sunday",), ("3",), ("funday",)], "v string")
    got = [r.d for r in df.select(C.request_weekday("v").alias("d")).collect()]
    assert got == [0, 6, 3, None]
    r = spark.range(1).select(C.dow_sunday0(F.lit("2024-01-05").cast("date")).alias("s"),
                              C.dow_monday0(F.lit("2024-01-05").cast("date")).alias("m"),
                              C.weekday_name(F.lit(5)).alias("n")).first()
    assert (r.s, r.m, r.n) == (5, 4, "Friday")


def test_display_name_and_key(spark):
    r = spark.range(1).select(C.display_name(F.lit("has_traffic_signal")).alias("d"),
                              C.normalize_key(F.lit("  Tempe, AZ ")).alias("k")).first()
    assert r.d == "Has Traffic Signal" and r.k == "tempe, az"


def test_ordinal_matches_window(spark):
    from pyspark.sql import Window
    from hazardlens.operators.features import ordinal
    df = spark.range(0, 997).select(((F.col("id") * 7919) % 1009).cast("string").alias("value"),
                                    (F.col("id") % 13).alias("n"))
    got = {r.value: r.code for r in ordinal(df, [F.desc("n"), F.col("value")]).collect()}
    want = {r.value: r.code for r in df.select("value", (F.row_number().over(
        Window.orderBy(F.desc("n"), "value")) - 1).alias("code")).collect()}
    assert got == want and sorted(got.values()) == list(range(997))


def test_period_label_codes_compat(spark):
    labels = ["Night", "Morning Rush", "Midday", "Evening Rush", "Evening", "Morning", "Afternoon", None]
    df = spark.createDataFrame([(x,) for x in labels], "p string")
    rows = df.select("p", C.period_label_code("p", compat=True).alias("c"),
                     C.period_label_code("p", compat=False).alias("f")).collect()
    got = {r.p: (r.c, r.f) for r in rows}
    # training map: only Night/Morning/Afternoon/Evening exist, anything else -> 0
    assert [got[x][0] for x in labels] == [0, 0, 0, 0, 3, 1, 2, 0]
    # full five-level ordinal over the staging labels
    assert [got[x][1] for x in labels[:5]] == [0, 1, 2, 3, 4]
