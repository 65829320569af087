"""Incident-shaped inputs derived from the driver tables.

The driver ships TPC-H-like tables plus an ``events`` stream; the operators
in this package work on raw accident records. These builders derive those
shapes from ``events``/``customer``/``nation`` with integer arithmetic and
power-of-two divisions only, so any SQL engine produces identical doubles.
Their SQL twins (for the DuckDB oracle) live in ``hazardlens.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.sources.io import RAW_COLUMNS
from hazardlens.sources.tables import load_table

# Nation is the fixed 25-row TPC-H dimension: safe to broadcast at any scale.
NATION_ROWS = 25


def _d(x) -> F.Column:
    return x.cast("double")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw incident table (46-column accident shape, subset), one row per event.

    Bad dates, null coordinates and null weather readings are planted on
    fixed id residues so the cleaning paths are exercised.
    """
    return incidents_from_events(spark, sf_dir, load_table(spark, sf_dir, "events"))


def incidents_from_events(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Same as ``incidents`` over any events DataFrame, batch or streaming
    (a stream joins the static dimensions as a stream-static join)."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value")
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    # customer grows with the data: the join strategy is left to AQE, which
    # broadcasts it only when its runtime size is under the threshold and
    # otherwise sort-merges (splitting a hot user's partition if skewed).
    j = (e.join(c, e.user_id == c.c_custkey, "left")
          .join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey, "left"))

    eid, uid = F.col("event_id"), F.col("user_id")
    ts_str = F.col("ts").cast("string")
    end_ts = (F.col("ts")
              + F.make_dt_interval(mins=F.floor(F.col("value")).cast("int"))
              + F.make_dt_interval(secs=(eid % 120).cast("int")))
    return j.select(
        eid.cast("string").alias("ID"),
        F.lit("events").alias("Source"),
        (1 + (eid * 7 + uid) % 4).cast("int").alias("Severity"),
        F.when(eid % 97 == 0, F.lit("not-a-date")).otherwise(ts_str).alias("Start_Time"),
        F.when(eid % 89 == 0, F.lit(None).cast("string"))
         .otherwise(end_ts.cast("string")).alias("End_Time"),
        F.when(eid % 101 == 0, F.lit(None).cast("double"))
         .otherwise(_d(25 + uid % 24) + _d(eid % 100) / 128).alias("Start_Lat"),
        (_d(-124 + (uid * 7) % 57) + _d(eid % 50) / 64).alias("Start_Lng"),
        (_d(eid % 40) / 8).alias("Distance(mi)"),
        F.col("c_mktsegment").alias("City"),
        F.col("n_name").alias("State"),
        F.when(eid % 11 == 0, None).otherwise(_d((eid * 13) % 130 - 10)).alias("Temperature(F)"),
        F.when(eid % 13 == 0, None).otherwise(_d((eid * 3) % 100)).alias("Humidity(%)"),
        F.when(eid % 17 == 0, None).otherwise(29 + _d(eid % 16) / 8).alias("Pressure(in)"),
        F.when(eid % 19 == 0, None).otherwise(_d(eid % 21) / 2).alias("Visibility(mi)"),
        F.when(eid % 23 == 0, None).otherwise(_d(eid % 30)).alias("Wind_Speed(mph)"),
        F.when(eid % 5 == 0, _d(eid % 8) / 4).alias("Precipitation(in)"),
        F.when(F.col("event_type") == "click", "Clear")
         .when(F.col("event_type") == "view", "Light Rain")
         .when(F.col("event_type") == "error", "Fog")
         .when(F.col("event_type") == "signup", "Light Snow").alias("Weather_Condition"),
        F.when(eid % 29 == 0, F.lit(None).cast("boolean")).otherwise(eid % 3 == 0).alias("Junction"),
        F.when(eid % 31 == 0, F.lit(None).cast("boolean")).otherwise(eid % 4 == 0).alias("Traffic_Signal"),
        (eid % 6 == 0).alias("Crossing"),
        (eid % 7 == 0).alias("Stop"),
    )


def wide_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw incidents as text in all 46 columns of the accident files (those
    without a source are empty), with values no type holds: a severity in words
    (id % 53 = 0) and a latitude in words (id % 59 = 0)."""
    raw = incidents(spark, sf_dir)
    eid = F.col("ID").cast("bigint")
    changed = {"Severity": F.when(eid % 53 == 0, "severe"), "Start_Lat": F.when(eid % 59 == 0, "north")}
    text = lambda c: F.col(f"`{c}`").cast("string") if c in raw.columns else F.lit(None).cast("string")
    return raw.select(*[F.coalesce(changed.get(c, F.lit(None)), text(c)).alias(c) for c in RAW_COLUMNS])


def dirty_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw incidents with problems planted on fixed id residues, for the
    quality checks: repeated and missing ids, severities outside 1..4, places
    outside the country, missing and future start times."""
    raw = incidents(spark, sf_dir)
    eid = F.col("ID").cast("bigint")
    changed = {
        "ID": F.when(eid % 401 == 0, None).when(eid % 307 == 0, (eid - 1).cast("string")).otherwise(F.col("ID")),
        "Severity": F.when(eid % 103 == 0, None).when(eid % 109 == 0, 5).when(eid % 113 == 0, 0).otherwise(F.col("Severity")),
        "Start_Lat": F.when(eid % 127 == 0, F.lit(60.0)).otherwise(F.col("Start_Lat")),
        "Start_Lng": F.when(eid % 131 == 0, F.lit(-20.0)).otherwise(F.col("Start_Lng")),
        "Start_Time": F.when(eid % 137 == 0, None).when(eid % 139 == 0, "2031-05-06 07:08:09").otherwise(F.col("Start_Time")),
    }
    return raw.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in raw.columns])


def waypoints(spark: SparkSession, sf_dir: str, points_per_route: int = 60) -> DataFrame:
    """Exploded routes ``(trip_id, route_id, seq, lat, lon)``.

    Every customer is a route; five consecutive customer keys form a trip. A
    trip starts where the incidents of user trip_id + 1 lie. Routes 0 and 3 lead
    through these incidents, route 1 runs 0.2 km beside route 0 (a near-
    duplicate), routes 2 and 4 lead around them. Points come from a generator
    (no join), so the table grows with ``customer``.
    """
    k = F.col("c_custkey")
    user = F.floor(k / 5) + 1
    pts = (load_table(spark, sf_dir, "customer")
           .select(k, F.explode(F.sequence(F.lit(0), F.lit(points_per_route - 1))).alias("seq")))
    s, r = F.col("seq"), k % 5
    beside = (F.when(r == 1, F.lit(1.0) / 512).when(r == 2, F.lit(0.125)).when(r == 3, F.lit(50.0) / 128)
              .when(r == 4, F.lit(0.25)).otherwise(F.lit(0.0)))
    return pts.select(
        F.floor(k / 5).alias("trip_id"), k.alias("route_id"), s.cast("int").alias("seq"),
        (_d(25 + user % 24) + _d(s) / 128 + beside).alias("lat"),
        (_d(-124 + (user * 7) % 57) + _d(s) / 64).alias("lon"))


def raw_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``waypoints`` as they arrive, coordinates as text, some of them broken:
    a word (route_id % 17 = 3, point 30), a gap (route_id % 19 = 4, point 10), a
    latitude off the globe (route_id % 23 = 5, point 0)."""
    w = waypoints(spark, sf_dir)
    k, s = F.col("route_id"), F.col("seq")
    lat = (F.when((k % 17 == 3) & (s == 30), "n/a").when((k % 19 == 4) & (s == 10), None)
           .when((k % 23 == 5) & (s == 0), "95.5").otherwise(F.col("lat").cast("string")))
    return w.select("trip_id", "route_id", "seq", lat.alias("lat"), F.col("lon").cast("string").alias("lon"))


def trip_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the traveller of each trip asks for: a date (seven weekdays in
    turn), the hours between which to leave, the hour from which to search the
    best window, and two hours to compare."""
    t = F.col("trip_id")
    by = lambda a, b, c: F.when(t % 3 == 0, a).when(t % 3 == 1, b).otherwise(c)
    trips = load_table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 5).alias("trip_id")).distinct()
    return trips.select(
        "trip_id", F.date_add(F.lit("2024-02-02").cast("date"), (t % 7).cast("int")).alias("date"),
        by(6, 9, 18).alias("earliest"), by(21, 15, 21).alias("latest"), by(6, 12, 17).alias("window_from"),
        by(8, 12, 8).alias("time1"), by(17, 17, 21).alias("time2"))


def corridor_waypoints(spark: SparkSession, sf_dir: str, points_per_route: int = 60) -> DataFrame:
    """Routes ``(trip_id, route_id, seq, lat, lon)`` along the corridor of the
    weather stations, for the weather operators.

    Every customer is a route; three consecutive customer keys form a trip.
    Each route gets ``points_per_route`` points from a generator (no join),
    so the table grows with ``customer``. Route 0 of a trip is distinct,
    routes 1 and 2 run 0.2 km apart (near-duplicates).
    """
    c = load_table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    pts = c.select(k, F.explode(F.sequence(F.lit(0), F.lit(points_per_route - 1))).alias("seq"))
    s = F.col("seq")
    return pts.select(
        (k - k % 3).alias("trip_id"),
        k.alias("route_id"),
        s.cast("int").alias("seq"),
        (F.lit(33.5) + _d(s) / 128
         + F.when(k % 3 == 0, F.lit(0.125)).when(k % 3 == 1, F.lit(0.0))
            .otherwise(F.lit(1.0) / 512)).alias("lat"),
        (F.lit(-112.0) + _d((s * 5) % 7) / 256).alias("lon"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather observations (flattened weather payload).

    Every event is a reading taken at one of 60 stations placed on the
    route corridor of ``corridor_waypoints`` (station = user_id mod 60); purchases
    carry an unknown code (-> default category).
    """
    e = load_table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    et = F.col("event_type")
    st = uid % 60
    return e.select(
        eid.alias("obs_id"),
        (F.lit(33.5) + _d(st) / 128).alias("lat"),
        (F.lit(-112.0) + _d((st * 5) % 7) / 256).alias("lon"),
        F.col("ts").alias("obs_ts"),
        F.when(et == "click", 800).when(et == "view", 501).when(et == "error", 741)
         .when(et == "signup", 600).otherwise(9999).cast("int").alias("code"),
        (F.lit(273.15) + _d(eid % 40)).alias("temp_k"),
        _d((eid * 37) % 10000).alias("visibility_m"),
        (_d(eid % 25) / 2).alias("wind_ms"),
        _d(eid % 100).alias("humidity"),
    )


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that need the freshest earlier weather reading: every event,
    at the station of the next user (so a point rarely sees its own reading)."""
    e = load_table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    st = (uid + 1) % 60
    return e.select(
        eid.alias("point_id"),
        (F.lit(33.5) + _d(st) / 128).alias("lat"),
        (F.lit(-112.0) + _d((st * 5) % 7) / 256).alias("lon"),
        F.col("ts"),
    )


def trip_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One departure time per trip, spread over the events' month:
    2024-01-01 + (trip_id * 7919 mod 41760) minutes."""
    c = load_table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    trips = c.select((k - k % 3).alias("trip_id")).distinct()
    mins = ((F.col("trip_id") * 7919) % 41760).cast("int")
    return trips.select("trip_id", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                                    + F.make_dt_interval(mins=mins)).alias("departure_ts"))


# Monday = 0 weekday words used in request payloads.
_WEEKDAY_WORDS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def prediction_requests(staged: DataFrame) -> DataFrame:
    """Prediction requests derived from staged incidents, with planted
    problems: latitude 95 (id % 211 = 0), missing hour (id % 199 = 0),
    missing month (id % 13 = 0, defaulted); every third weekday is sent as
    a word instead of a number (Monday = 0)."""
    eid = F.col("ID").cast("bigint")
    dow_mon0 = ((F.col("day_of_week") + 6) % 7).cast("int")
    word = F.element_at(F.array(*[F.lit(w) for w in _WEEKDAY_WORDS]), dow_mon0 + 1)
    flags = ["has_amenity", "has_bump", "has_crossing", "has_give_way", "has_junction",
             "has_no_exit", "has_railway", "has_roundabout", "has_station", "has_stop",
             "has_traffic_calming", "has_traffic_signal"]
    return staged.select(
        F.col("ID").alias("request_id"),
        F.when(eid % 211 == 0, F.lit(95.0)).otherwise(F.col("latitude")).alias("latitude"),
        "longitude", F.col("State").alias("state"), F.col("City").alias("city"),
        F.when(eid % 199 == 0, F.lit(None).cast("int")).otherwise(F.col("hour")).alias("hour"),
        F.when(eid % 3 == 0, word).otherwise(dow_mon0.cast("string")).alias("day_of_week"),
        F.when(eid % 13 == 0, F.lit(None).cast("int")).otherwise(F.col("month")).alias("month"),
        "is_weekend", "temperature_f", "humidity_pct", "pressure_in", "visibility_mi",
        "wind_speed_mph", "precipitation_in", "weather_condition", *flags, "distance_mi")
