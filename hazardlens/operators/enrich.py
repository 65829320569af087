"""Enrichment: weather and route payloads, the freshest-weather as-of join,
weather along routes, effective weather (S11, S12, S14, C16, C19, J4, W7,
R8, R9).

Payloads are JSON strings in a column; they are parsed with ``from_json``
against an explicit schema (malformed strings yield nulls and fall back to
the defaults), never with Python.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlens.functions import columns as C
from hazardlens.operators.running import running_last

# Defaults used when a reading is missing or unusable.
DEFAULT_WEATHER = {
    "temperature_f": 70.0, "weather_condition": "Clear", "visibility_mi": 10.0,
    "humidity_pct": 50.0, "wind_speed_mph": 5.0, "description": "default (API unavailable)",
}
DEFAULT_VISIBILITY_M = 10000.0
DEFAULT_HUMIDITY = 50.0
DEFAULT_WIND_MS = 0.0
MAX_AGE_MINUTES = 30
GRID_DIGITS = 2
ROUTE_WEATHER_SAMPLES = 5

WEATHER_PAYLOAD_SCHEMA = T.StructType([
    T.StructField("main", T.StructType([T.StructField("temp", T.DoubleType()),
                                        T.StructField("humidity", T.DoubleType())])),
    T.StructField("weather", T.ArrayType(T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("description", T.StringType())]))),
    T.StructField("visibility", T.DoubleType()),
    T.StructField("wind", T.StructType([T.StructField("speed", T.DoubleType())])),
])

ROUTE_PAYLOAD_SCHEMA = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("overview_polyline", T.StructType([T.StructField("points", T.StringType())])),
    T.StructField("legs", T.ArrayType(T.StructType([
        T.StructField("distance", T.StructType([T.StructField("text", T.StringType()),
                                                T.StructField("value", T.IntegerType())])),
        T.StructField("duration", T.StructType([T.StructField("text", T.StringType()),
                                                T.StructField("value", T.IntegerType())])),
        T.StructField("duration_in_traffic", T.StructType([T.StructField("text", T.StringType()),
                                                           T.StructField("value", T.IntegerType())])),
    ]))),
])


def _r1(c):
    return C.round_half_up(c, 1)


# S12 / C16 / C19 ----------------------------------------------------------------

def parse_weather_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Weather JSON -> flat reading in US units; unusable payloads -> defaults.

    Temperature K -> F, visibility m -> mi (10 000 m when absent), wind m/s
    -> mph (0 when absent), humidity 50 when absent; each rounded as the
    service rounds (1 digit) and the code mapped to its category.
    """
    parsed = df.withColumn("_json", F.from_json(F.col(payload), WEATHER_PAYLOAD_SCHEMA))  # once per row
    p = F.col("_json")
    temp_k = p["main"]["temp"]
    code = F.element_at(p["weather"], 1)["id"]
    ok = temp_k.isNotNull() & code.isNotNull()
    cond = C.weather_category(code)
    d = DEFAULT_WEATHER
    return parsed.select(
        *[c for c in df.columns if c != payload],
        F.when(ok, _r1(C.kelvin_to_f(temp_k))).otherwise(d["temperature_f"]).alias("temperature_f"),
        F.when(ok, cond).otherwise(d["weather_condition"]).alias("weather_condition"),
        F.when(ok, _r1(C.meters_to_miles(F.coalesce(p["visibility"], F.lit(DEFAULT_VISIBILITY_M)))))
         .otherwise(d["visibility_mi"]).alias("visibility_mi"),
        F.when(ok, F.coalesce(p["main"]["humidity"], F.lit(DEFAULT_HUMIDITY)))
         .otherwise(d["humidity_pct"]).alias("humidity_pct"),
        F.when(ok, _r1(C.ms_to_mph(F.coalesce(p["wind"]["speed"], F.lit(DEFAULT_WIND_MS)))))
         .otherwise(d["wind_speed_mph"]).alias("wind_speed_mph"),
        F.when(ok, F.coalesce(F.element_at(p["weather"], 1)["description"], cond))
         .otherwise(d["description"]).alias("description"),
        ok.alias("parsed"),
    )


def weather_payloads(obs: DataFrame, corrupt_every: int = 7) -> DataFrame:
    """Serialise observations as weather-service JSON; every ``corrupt_every``-th
    payload (by obs_id) is cut short to exercise the malformed path."""
    body = F.to_json(F.struct(
        F.struct(F.col("temp_k").alias("temp"), F.col("humidity").alias("humidity")).alias("main"),
        F.array(F.struct(F.col("code").alias("id"),
                         F.lower(C.weather_category("code")).alias("description"))).alias("weather"),
        F.when(F.col("code") != 9999, F.col("visibility_m")).alias("visibility"),
        F.struct(F.col("wind_ms").alias("speed")).alias("wind")))
    cut = F.substring(body, 1, 20)
    return obs.select("obs_id", "lat", "lon", "obs_ts",
                      F.when(F.col("obs_id") % corrupt_every == 0, cut).otherwise(body).alias("payload"))


# S11 -------------------------------------------------------------------------------

def parse_route_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Directions JSON -> flat route record from its first leg; rows missing a
    required key (leg, distance, duration, polyline) are dropped."""
    # A generator is not merged with the columns and filter above it: each payload is parsed once.
    parsed = df.select(*[c for c in df.columns if c != payload],
                       F.explode(F.array(F.from_json(F.col(payload), ROUTE_PAYLOAD_SCHEMA))).alias("_json"))
    p = F.col("_json")
    leg = F.element_at(p["legs"], 1)
    out = parsed.select(
        *[c for c in df.columns if c != payload],
        leg["distance"]["text"].alias("distance_text"),
        leg["distance"]["value"].alias("distance_meters"),
        leg["duration"]["text"].alias("duration_text"),
        leg["duration"]["value"].alias("duration_seconds"),
        p["overview_polyline"]["points"].alias("polyline"),
        p["summary"].alias("summary"),
        leg["duration_in_traffic"]["text"].alias("duration_in_traffic_text"),
        leg["duration_in_traffic"]["value"].alias("duration_in_traffic_seconds"))
    return out.where(F.col("distance_text").isNotNull() & F.col("distance_meters").isNotNull()
                     & F.col("duration_text").isNotNull() & F.col("duration_seconds").isNotNull()
                     & F.col("polyline").isNotNull())


# S14 -------------------------------------------------------------------------------

def event_props(events: DataFrame, key: str = "k") -> DataFrame:
    """One property of the events' JSON ``props`` as a typed column."""
    return events.select("event_id", "event_type",
                         F.get_json_object("props", f"$.{key}").cast("bigint").alias(key))


# J4 --------------------------------------------------------------------------------

def freshest_weather(points: DataFrame, readings: DataFrame, max_age_minutes: int = MAX_AGE_MINUTES,
                     digits: int = GRID_DIGITS, parts: int | None = None) -> DataFrame:
    """Bounded as-of join: for each point, the newest reading in the same grid
    cell taken strictly before the point's time and at most
    ``max_age_minutes`` earlier; nulls when there is none.

    ``points``: (point_id, lat, lon, ts). ``readings``: (obs_id, lat, lon,
    obs_ts, <reading columns>). No candidate pairs are formed: points and
    readings are unioned, put in the order of (cell, time) by range partitions
    and scanned once, each point taking the last reading seen. A partition
    passes its newest reading on to the next ones, so a cell or a half hour with
    any share of all rows spans as many tasks as its rows need. ``parts`` is the
    number of ranges (default: the session's shuffle partitions).
    """
    val_cols = [c for c in readings.columns if c not in ("lat", "lon")]
    cell = [C.grid_key("lat", digits).alias("__clat"), C.grid_key("lon", digits).alias("__clon")]
    pt_type = T.StructType([points.schema[c] for c in points.columns])
    obs = F.struct(C.grid_key("lat", digits).alias("__olat"), C.grid_key("lon", digits).alias("__olon"), *val_cols)
    r = readings.select(*cell, F.col("obs_ts").alias("__t"), F.lit(1).alias("__kind"), F.col("obs_id").cast("long").alias("__id"),
                        F.lit(None).cast(pt_type).alias("__pt"), obs.alias("__obs"))
    p = points.select(*cell, F.col("ts").alias("__t"), F.lit(0).alias("__kind"), F.xxhash64(*points.columns).alias("__id"),
                      F.struct(*points.columns).alias("__pt"), F.lit(None).cast(r.schema["__obs"].dataType).alias("__obs"))
    # Points sort before readings at the same instant (strictly-earlier rule);
    # equal-time readings resolve by obs_id.
    order = ["__clat", "__clon", "__t", "__kind", "__id"]
    seen = running_last(r.unionByName(p), order, "__obs", "__last", parts).where(F.col("__kind") == 0)
    last = F.col("__last")
    fresh = ((last["__olat"] == F.col("__clat")) & (last["__olon"] == F.col("__clon"))
             & (last["obs_ts"] >= F.col("__t") - F.make_dt_interval(mins=F.lit(max_age_minutes))))
    return seen.select(*[F.col(f"__pt.{c}").alias(c) for c in points.columns],
                       *[F.when(fresh, last[c]).alias(c) for c in val_cols])


def point_weather(points: DataFrame, observations: DataFrame, **kw) -> DataFrame:
    """J4 + S12 on flat observations: each point's effective reading, with the
    defaults when no fresh reading exists (source 'observed' / 'default')."""
    j = freshest_weather(points, observations, **kw)
    d = DEFAULT_WEATHER
    found = F.col("obs_id").isNotNull()
    return j.select(
        *points.columns, "obs_id", "obs_ts",
        F.when(found, _r1(C.kelvin_to_f("temp_k"))).otherwise(d["temperature_f"]).alias("temperature_f"),
        F.when(found, C.weather_category("code")).otherwise(d["weather_condition"]).alias("weather_condition"),
        F.when(found, _r1(C.meters_to_miles("visibility_m"))).otherwise(d["visibility_mi"]).alias("visibility_mi"),
        F.when(found, F.col("humidity")).otherwise(d["humidity_pct"]).alias("humidity_pct"),
        F.when(found, _r1(C.ms_to_mph("wind_ms"))).otherwise(d["wind_speed_mph"]).alias("wind_speed_mph"),
        F.when(found, F.lower(C.weather_category("code"))).otherwise(d["description"]).alias("description"),
        F.when(found, "observed").otherwise("default").alias("source"))


# W7 / R8 ---------------------------------------------------------------------------

def route_sample_points(wp: DataFrame, k: int = ROUTE_WEATHER_SAMPLES) -> DataFrame:
    """Up to k evenly spaced waypoints incl. both ends: index round(i*(n-1)/(k-1))
    with half-to-even rounding; all points when n <= k."""
    n = wp.groupBy("route_id").agg(F.count(F.lit(1)).alias("__n"))
    j = wp.join(n, "route_id")
    step = (F.col("__n") - 1).cast("double") / (k - 1)
    idx = F.array(*[F.bround(F.lit(float(i)) * step, 0).cast("int") for i in range(k)])
    keep = (F.col("__n") <= k) | F.array_contains(idx, F.col("seq"))
    return j.where(keep).drop("__n")


def route_weather(samples_with_weather: DataFrame, key: str = "trip_id") -> DataFrame:
    """Average the sampled readings of each route and name the dominant
    condition (most frequent, first seen on ties), its description and a
    variation warning listing every condition by count.

    A route has at most ``ROUTE_WEATHER_SAMPLES`` samples, so they are
    gathered into one small array per route and reduced with array functions.
    """
    s = samples_with_weather
    g = s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.col("seq").alias("pos"), "weather_condition", "description", "temperature_f",
        "visibility_mi", "humidity_pct", "wind_speed_mph"))).alias("xs"))
    xs = F.col("xs")
    n = F.size(xs)
    cnt = lambda e: F.size(F.filter(xs, lambda y: y["weather_condition"] == e["weather_condition"]))
    first_pos = lambda e: F.array_min(F.transform(F.filter(
        xs, lambda y: y["weather_condition"] == e["weather_condition"]), lambda y: y["pos"]))
    firsts = F.filter(xs, lambda e: e["pos"] == first_pos(e))
    ranked = F.array_sort(F.transform(firsts, lambda e: F.struct(
        (-cnt(e)).alias("neg"), e["pos"].alias("pos"), e["weather_condition"].alias("c"),
        cnt(e).alias("k"), e["description"].alias("d"))))
    top = ranked[0]
    avg = lambda f: _r1(F.aggregate(xs, F.lit(0.0), lambda a, e: a + e[f]) / n)
    warning = F.when(F.size(ranked) > 1, F.concat(
        F.lit("Weather varies along route: "),
        F.array_join(F.transform(ranked, lambda r: F.format_string("%s (%d/%d points)", r["c"], r["k"], n)), ", ")))
    return g.select(key, avg("temperature_f").alias("temperature_f"),
                    top["c"].alias("weather_condition"), avg("visibility_mi").alias("visibility_mi"),
                    avg("humidity_pct").alias("humidity_pct"), avg("wind_speed_mph").alias("wind_speed_mph"),
                    top["d"].alias("description"), n.alias("samples"), warning.alias("weather_warning"))


# R9 --------------------------------------------------------------------------------

def effective_weather(requests: DataFrame, route_wx: DataFrame, key: str = "trip_id") -> DataFrame:
    """Weather used for scoring: the route's sampled weather when
    ``auto_fetch`` is set, else the request's values with Clear / 70 / 10
    defaults (an empty condition also means Clear); ``source`` says which."""
    j = requests.join(route_wx.select(key, F.col("weather_condition").alias("__wc"),
                                      F.col("temperature_f").alias("__t"),
                                      F.col("visibility_mi").alias("__v")), key, "left")
    auto = F.col("auto_fetch")
    return j.select(
        key, F.when(auto, "auto").otherwise("manual").alias("source"),
        F.when(auto, F.col("__wc"))
         .when(F.coalesce(F.col("weather_condition"), F.lit("")) == "", F.lit("Clear"))
         .otherwise(F.col("weather_condition")).alias("weather_condition"),
        F.when(auto, F.col("__t")).otherwise(F.coalesce(F.col("temperature_f").cast("double"), F.lit(70.0)))
         .alias("temperature_f"),
        F.when(auto, F.col("__v")).otherwise(F.coalesce(F.col("visibility_mi").cast("double"), F.lit(10.0)))
         .alias("visibility_mi"))
