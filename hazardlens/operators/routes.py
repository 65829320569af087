"""Route and departure-time analytics over whole tables of routes
(W3-W11, R1-R7, J2, J3, D3, R10, L5, L6, M15).

Routes arrive exploded: one row per waypoint ``(trip_id, route_id, seq,
lat, lon)`` with ``seq`` = 0..n-1. Everything is computed for all trips in
one plan.

Partitioning notes (1000-executor scale):
* W3 pairs each point with its predecessor through an equi-join on the
  unique key (route_id, seq) - no window partitioned by route, so a very
  long route never lands in one task.
* R1 (the resetting 1-mile sampler) is sequential per route: its output
  depends on the distance accumulated since the last kept point. Sorted rows
  stream through one linear pass; a task holds a batch, never a route.
* Candidate hours are generated with ``explode`` (no join), and scoring
  happens once per (route, hour, segment).
* Waypoints come from a generator, which the optimizer takes for as small as
  its input: joins with lengths, signatures and risks of routes carry a join
  hint, so that waypoints and routes are not sent whole to every executor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.functions import columns as C
from hazardlens.operators import scoring as SC
from hazardlens.session import checkpoint_dir

# Fixed values from the reference.
SAMPLE_INTERVAL_MI = 1.0
DANGER_THRESHOLD = 0.6
DEFAULT_HOURS = [6, 9, 12, 15, 18, 21]
WINDOW_MIN_HOUR, WINDOW_MAX_HOUR = 6, 22
SIMILAR_KM = 1.0
SIMILAR_FRACTIONS = (0.25, 0.5, 0.75)
MAX_ROUTES = 3
SEGMENT_DEFAULTS = {  # scorer parameters the route scorer never overrides
    "month": 6, "humidity_pct": 50.0, "pressure_in": 29.9, "wind_speed_mph": 5.0,
    "precipitation_in": 0.0, "state_encoded": 0, "city_encoded": 0, "distance_mi": 0.1,
}
ADVICE_BEST = "Recommended - Safest option"
ADVICE_SLIGHT = "Slightly higher risk"
ADVICE_SIMILAR = "Similar safety level"
ADVICE_HIGHER = "Higher risk - %.1f points less safe"
ADVICE_FAILED = "Scoring failed - use with caution"
FAILED_RISK, FAILED_LEVEL, FAILED_SAFETY = 0.5, "UNKNOWN", 50.0

CELLS_PER_DEGREE = 10                # grid of the incident history (about 11 km)
HISTORY_FLAGS = ["has_junction", "has_crossing", "has_traffic_signal", "has_stop"]


# W3 / C17 ------------------------------------------------------------------

def segment_distances(wp: DataFrame) -> DataFrame:
    """Each waypoint with the great-circle miles from its predecessor (null at seq 0)."""
    prev = wp.select(F.col("route_id").alias("__r"), (F.col("seq") + 1).alias("__s"),
                     F.col("lat").alias("__plat"), F.col("lon").alias("__plon"))
    j = wp.join(prev.hint("merge"), (wp.route_id == prev.__r) & (wp.seq == prev.__s), "left")
    return j.select(*wp.columns,
                    C.haversine_miles("__plat", "__plon", "lat", "lon").alias("dist_mi"))


def route_lengths(wp: DataFrame) -> DataFrame:
    """Points and total haversine miles per route (miles to 6 digits)."""
    d = segment_distances(wp)
    return (d.groupBy("trip_id", "route_id")
            .agg(F.count(F.lit(1)).alias("n_points"),
                 C.round_half_away(F.sum("dist_mi"), 6).alias("total_miles")))


# R1 / W4 / W5 --------------------------------------------------------------

_SAMPLED = ["trip_id", "route_id", "segment_index", "seq", "lat", "lon"]


def _sampler(interval: float):
    """Walks sorted waypoints batch by batch; only the state of the route at
    hand is carried on, whatever its length. The walk notes the positions to
    keep, and the rows there are taken from the batch at once."""
    def run(batches):
        first = last = None    # first point not yet kept; last point of the route, unless it was kept
        at_kept, index, travelled = (None, None), 0, 0.0
        for pdf in batches:
            nth, d = pdf["nth"].tolist(), pdf["d"].to_numpy(dtype="float64", na_value=np.nan).tolist()
            lat, lon = pdf["lat"].tolist(), pdf["lon"].tolist()
            head, kept, indices = [], [], []   # rows of earlier batches come before those of this one

            def keep(i):
                nonlocal index, at_kept
                if isinstance(i, tuple):
                    head.append((i[0], i[1], index, *i[2:]))
                    at_kept = i[3], i[4]
                else:
                    kept.append(i)
                    indices.append(index)
                    at_kept = lat[i], lon[i]
                index += 1

            def point(i):
                return (lat[i], lon[i]) if not isinstance(i, tuple) else i[3:]

            def close():
                if last is not None and not (point(last)[0] == at_kept[0] and point(last)[1] == at_kept[1]):
                    keep(last)

            for i in range(len(pdf)):
                if nth[i] == 1:
                    close()
                    first, last, index, travelled = i, None, 0, 0.0
                    continue
                if first is not None:
                    keep(first)
                    first = None
                travelled += d[i]
                if travelled >= interval:
                    keep(i)
                    travelled = 0.0
                last = i
            whole = lambda i: i if i is None or isinstance(i, tuple) else tuple(
                pdf[c].array[i] for c in ("trip_id", "route_id", "seq", "lat", "lon"))
            first, last = whole(first), whole(last)
            yield pd.DataFrame(head, columns=_SAMPLED)
            yield pdf.iloc[kept].assign(segment_index=indices)[_SAMPLED]
        if last is not None and not (last[3] == at_kept[0] and last[4] == at_kept[1]):
            yield pd.DataFrame([(last[0], last[1], index, *last[2:])], columns=_SAMPLED)

    return run


def sample_waypoints(wp: DataFrame, interval_mi: float = SAMPLE_INTERVAL_MI) -> DataFrame:
    """Keep the first point, every point where the distance accumulated since
    the last kept point reaches ``interval_mi`` (then reset), and the last
    point if its coordinates differ from the last kept one. Routes with
    fewer than two points produce no segments.

    One shuffle and one linear pass for routes of any length: the rows of a
    route meet in one partition, sorted, and stream through in Arrow batches;
    a task holds one batch and the distance since the last kept point. Step
    distances come from a ``lag`` window over the same partitioning. Sums are
    sequential, so results equal a plain loop bit for bit.

    Output: (trip_id, route_id, segment_index, seq, lat, lon).
    """
    keys = ["trip_id", "route_id"]
    w = Window.partitionBy(*keys).orderBy("seq")
    steps = (wp.repartition(*keys)
             .select(*keys, "seq", "lat", "lon", F.row_number().over(w).alias("nth"),
                     C.haversine_miles(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")).alias("d"))
             .sortWithinPartitions(*keys, "seq"))
    kinds = {f.name: f.dataType.simpleString() for f in wp.schema} | {"segment_index": "int"}
    return steps.mapInPandas(_sampler(interval_mi), ", ".join(f"{c} {kinds[c]}" for c in _SAMPLED))


# J6 ------------------------------------------------------------------------

def with_history(segments: DataFrame, staged: DataFrame, cells_per_degree: int = CELLS_PER_DEGREE,
                 flags=tuple(HISTORY_FLAGS)) -> DataFrame:
    """Segments with road flags (0 / 1) taken from past incidents: a flag is
    set where any incident of the segment's grid cell had it.

    Incidents are reduced to one row per cell before the equi-join, so a cell
    with any number of incidents costs one row.
    """
    cell = lambda c: F.floor(F.col(c) * float(cells_per_degree))
    past = (staged.groupBy(cell("latitude").alias("__cx"), cell("longitude").alias("__cy"))
            .agg(*[F.bool_or(f).alias(f"__{f}") for f in flags]))
    keyed = segments.select("*", cell("lat").alias("__cx"), cell("lon").alias("__cy"))
    return keyed.join(past, ["__cx", "__cy"], "left").select(
        *segments.columns, *[F.coalesce(F.col(f"__{f}"), F.lit(False)).cast("int").alias(f) for f in flags])


# M15 -----------------------------------------------------------------------

def segment_features(segments: DataFrame, hour, day_of_week_sun0, weather, temperature_f,
                     visibility_mi) -> DataFrame:
    """Route-scorer feature row for each sampled segment (33-feature layout).

    ``hour``/``day_of_week_sun0``/weather inputs are Columns (or literals),
    so the same projection serves one departure or many candidate hours.
    Road flags that ``segments`` does not have (see ``with_history``) stay 0
    and the never-passed parameters keep their defaults, as in the reference
    scorer.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    h, dow, w = lit(hour), lit(day_of_week_sun0), lit(weather)
    t, vis = lit(temperature_f).cast("double"), lit(visibility_mi).cast("double")
    d = SEGMENT_DEFAULTS
    known = set(segments.columns)
    flag = lambda f: F.col(f) if f in known else F.lit(0)
    count = flag(C.ROAD_FLAGS[0])
    for f in C.ROAD_FLAGS[1:]:
        count = count + flag(f)
    return segments.select(
        *[c for c in segments.columns if c not in C.ROAD_FLAGS],
        h.alias("hour"), dow.alias("day_of_week"),
        F.when(dow.isin(0, 6), 1).otherwise(0).alias("is_weekend"),
        F.lit(d["month"]).alias("month"),
        C.scorer_period_code(h).alias("time_period_encoded"),
        C.is_rush_hour(h, "scorer").alias("is_rush_hour"),
        F.lit(d["state_encoded"]).alias("state_encoded"), F.lit(d["city_encoded"]).alias("city_encoded"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        t.alias("temperature_f"), F.lit(d["humidity_pct"]).alias("humidity_pct"),
        F.lit(d["pressure_in"]).alias("pressure_in"), vis.alias("visibility_mi"),
        F.lit(d["wind_speed_mph"]).alias("wind_speed_mph"),
        F.lit(d["precipitation_in"]).alias("precipitation_in"),
        C.scorer_weather_code(w).alias("weather_encoded"),
        C.poor_weather_text(w).alias("poor_weather"), C.extreme_temp(t).alias("extreme_temp"),
        *[flag(f).alias(f) for f in C.ROAD_FLAGS],
        count.alias("road_feature_count"), F.lit(d["distance_mi"]).alias("distance_mi"),
        w.alias("weather_condition"),
        (dow.isin(0, 6)).alias("__weekend_flag"),
    )


def rule_segment_scorer(features: DataFrame) -> DataFrame:
    """The deterministic scorer applied to segment features."""
    f = features.withColumn("__junction", F.col("has_junction") == 1) \
                .withColumn("__crossing", F.col("has_crossing") == 1)
    return SC.rule_score(f, junction="__junction", crossing="__crossing",
                         weekend="__weekend_flag").drop("__junction", "__crossing")


def score_segments(segments: DataFrame, hour, day_of_week_sun0, weather="Clear",
                   temperature_f=70.0, visibility_mi=10.0, scorer=rule_segment_scorer) -> DataFrame:
    """Segments + risk_score, scorer risk level (4-way, MODERATE) and confidence.
    Segments without a score get 0.5 / UNKNOWN / 0 (M23)."""
    feats = segment_features(segments, hour, day_of_week_sun0, weather, temperature_f, visibility_mi)
    scored = scorer(feats)
    p = F.col("risk_score")
    return SC.with_fallback(scored.select(*segments.columns, "hour", "day_of_week", "risk_score",
                                          C.risk_level4(p, "MODERATE").alias("risk_level"),
                                          C.confidence_max(p).alias("confidence")))


# R2 / R3 -------------------------------------------------------------------

def route_risk(routes: DataFrame, seg_scores: DataFrame, keys=("trip_id", "route_id")) -> DataFrame:
    """Per route: mean / max / min risk, safety score, segments scored.

    ``routes`` lists every route (so routes with < 2 waypoints still get the
    default 0 / 0 / 0 / 100 / 0 row).
    """
    keys = list(keys)
    agg = (seg_scores.groupBy(*keys)
           .agg(F.avg("risk_score").alias("overall_risk"), F.max("risk_score").alias("max_risk"),
                F.min("risk_score").alias("min_risk"), F.count(F.lit(1)).alias("segments_scored"),
                F.count(F.when(F.col("risk_score") > DANGER_THRESHOLD, 1)).alias("danger_zones"),
                F.min_by("risk_level", F.when(F.col("risk_score") > DANGER_THRESHOLD,
                                              F.col("segment_index"))).alias("first_danger_level")))
    j = routes.select(*keys).distinct().join(agg.hint("merge"), keys, "left")
    r6 = lambda c: C.round_half_away(c, 6)  # noqa: E731  (mean of many floats: 6 digits)
    return j.select(*keys,
                    F.coalesce(r6("overall_risk"), F.lit(0.0)).alias("overall_risk"),
                    F.coalesce("max_risk", F.lit(0.0)).alias("max_risk"),
                    F.coalesce("min_risk", F.lit(0.0)).alias("min_risk"),
                    F.coalesce(r6(C.safety_score("overall_risk")), F.lit(100.0)).alias("safety_score"),
                    F.coalesce("segments_scored", F.lit(0)).alias("segments_scored"),
                    F.coalesce("danger_zones", F.lit(0)).alias("danger_zones"),
                    "first_danger_level")


def danger_zones(seg_scores: DataFrame, threshold: float = DANGER_THRESHOLD) -> DataFrame:
    """Segments riskier than ``threshold`` in API shape: index, risk (3 digits),
    location text and level."""
    return (seg_scores.where(F.col("risk_score") > threshold)
            .select("trip_id", "route_id", F.col("segment_index").alias("segment"),
                    C.round_half_up("risk_score", 3).alias("risk"),
                    C.location_string("lat", "lon").alias("location"), "risk_level"))


# M23 -----------------------------------------------------------------------

def checked_waypoints(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Waypoints that arrive as text, parsed: (waypoints of sound routes, failed
    routes with the error of their first bad point).

    Parsing uses ``try_cast``, so a broken route is a row with an error, not a
    failed job, and does not touch the other routes of its trip.
    """
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    named = lambda text: F.concat(F.lit("point "), F.col("seq").cast("string"), F.lit(f": {text}"))
    error = (F.when(F.col("lat").isNull() | F.col("lon").isNull(), named("coordinate missing"))
             .when(lat.isNull() | lon.isNull(), named("coordinate is no number"))
             .when((F.abs(lat) > 90) | (F.abs(lon) > 180), named("coordinate off the globe")))
    points = raw.select("trip_id", "route_id", "seq", lat.alias("lat"), lon.alias("lon"), error.alias("error"))
    failed = (points.where(F.col("error").isNotNull()).groupBy("trip_id", "route_id")
              .agg(F.min_by("error", "seq").alias("error")))
    sound = points.drop("error").join(failed.select("trip_id", "route_id"), ["trip_id", "route_id"], "left_anti")
    return sound, failed


# R4 / W10 / L5 -------------------------------------------------------------

def route_advice(risk: DataFrame, failed: DataFrame | None = None, overwrite_failed: bool = False) -> DataFrame:
    """Rank each trip's routes safest first and attach the advice text.

    ``failed`` routes (trip_id, route_id, error) take part with risk 0.5, level
    UNKNOWN, safety 50 and no segments. If one of them ranks first, the others
    get no advice. Failed routes keep their warning; the reference replaces it
    by a comparison when a sound route ranks first (``overwrite_failed=True``).
    """
    safety = C.round_half_up("safety_score", 1)
    ranked = risk.select("trip_id", "route_id",
                         C.round_half_up("overall_risk", 3).alias("risk_score"),
                         C.risk_level4("overall_risk", "MEDIUM").alias("risk_level"),
                         safety.alias("safety_score"),
                         C.round_half_up("max_risk", 3).alias("max_risk"),
                         C.round_half_up("min_risk", 3).alias("min_risk"),
                         F.col("segments_scored").alias("segments_analyzed"))
    if failed is not None:
        half = F.lit(FAILED_RISK)
        rows = failed.select("trip_id", "route_id", half.alias("risk_score"), F.lit(FAILED_LEVEL).alias("risk_level"),
                             F.lit(FAILED_SAFETY).alias("safety_score"), half.alias("max_risk"), half.alias("min_risk"),
                             F.lit(0).cast("long").alias("segments_analyzed"), "error")
        ranked = ranked.withColumn("error", F.lit(None).cast("string")).unionByName(rows)
    w = Window.partitionBy("trip_id").orderBy(F.desc("safety_score"), "route_id")
    best = F.max("safety_score").over(Window.partitionBy("trip_id"))
    best_level = F.first("risk_level").over(w.rowsBetween(Window.unboundedPreceding,
                                                          Window.unboundedFollowing))
    diff = best - F.col("safety_score")
    rank = F.row_number().over(w)
    warned = F.col("error").isNotNull() if failed is not None else F.lit(False)
    if overwrite_failed:
        warned = warned & (best_level == FAILED_LEVEL)
    advice = (F.when(warned, ADVICE_FAILED).when(best_level == "UNKNOWN", F.lit(None).cast("string"))
              .when(rank == 1, ADVICE_BEST)
              .when(diff > 10, F.format_string(ADVICE_HIGHER, F.bround(diff, 1)))
              .when(diff > 5, ADVICE_SLIGHT).otherwise(ADVICE_SIMILAR))
    return ranked.select("*", rank.alias("rank"), (best - F.col("safety_score")).alias("gap_to_best"),
                         advice.alias("recommendation"))


# J2 / R5 / W9 ----------------------------------------------------------------

def _level_from(first_danger, mean) -> Column:
    return F.coalesce(first_danger, C.risk_level4(mean, "MODERATE"))


def hourly_route_scores(first_routes: DataFrame | None, segments: DataFrame, date, hours,
                        weather="Clear", temperature_f=70.0, visibility_mi=10.0,
                        scorer=rule_segment_scorer) -> DataFrame:
    """Score each trip's route at every candidate hour of ``date`` (a day, or a
    date column of ``segments``). ``first_routes`` limits the segments to one
    route per trip unless they are already.

    Hours come from ``explode`` of a literal array (J2 without a join); the
    sampled geometry is reused for every hour.
    """
    dow = C.dow_sunday0(date if isinstance(date, Column) else F.lit(date).cast("date"))
    segs = segments
    if first_routes is not None:
        segs = segments.join(first_routes.select("trip_id", "route_id"), ["trip_id", "route_id"])
    with_h = segs.withColumn("__hour", F.explode(F.array(*[F.lit(int(h)) for h in hours])))
    scored = score_segments(with_h, F.col("__hour"), dow, weather, temperature_f, visibility_mi,
                            scorer)
    per = (scored.groupBy("trip_id", "route_id", F.col("__hour").alias("hour"))
           .agg(C.round_half_away(F.avg("risk_score"), 9).alias("overall_risk"),
                F.count(F.lit(1)).alias("segments_analyzed"),
                F.count(F.when(F.col("risk_score") > DANGER_THRESHOLD, 1)).alias("danger_zones_count"),
                F.min_by("risk_level", F.when(F.col("risk_score") > DANGER_THRESHOLD,
                                              F.col("segment_index"))).alias("__first_level")))
    return per.select("trip_id", "route_id", "hour", C.hour_label("hour").alias("time_label"),
                      C.round_half_up(C.safety_score("overall_risk"), 1).alias("safety_score"),
                      C.round_half_up("overall_risk", 3).alias("risk_score"),
                      _level_from(F.col("__first_level"), F.col("overall_risk")).alias("risk_level"),
                      "segments_analyzed", "danger_zones_count")


def first_routes(wp: DataFrame) -> DataFrame:
    """The first (primary) route of every trip: smallest route id."""
    return wp.groupBy("trip_id").agg(F.min("route_id").alias("route_id"))


def departure_analysis(hourly: DataFrame, hours=DEFAULT_HOURS) -> DataFrame:
    """Per trip best / worst hour and improvement %.

    Safest first with ties in the candidate-hour order: best is the earliest
    listed among the safest, worst the last listed among the least safe.
    """
    pos = F.array_position(F.array(*[F.lit(int(h)) for h in hours]), F.col("hour"))
    h = hourly.withColumn("__pos", pos)
    best = F.min_by(F.struct("time_label", "safety_score"), F.struct(-F.col("safety_score"), F.col("__pos")))
    worst = F.max_by(F.struct("time_label", "safety_score"), F.struct(-F.col("safety_score"), F.col("__pos")))
    agg = h.groupBy("trip_id").agg(best.alias("b"), worst.alias("w"))
    bs, ws = F.col("b.safety_score"), F.col("w.safety_score")
    return agg.select("trip_id", F.col("b.time_label").alias("best_time"),
                      F.col("w.time_label").alias("worst_time"),
                      bs.alias("best_safety_score"), ws.alias("worst_safety_score"),
                      F.when(ws > 0, C.round_half_up((bs - ws) / ws * 100, 1))
                      .otherwise(F.lit(0.0)).alias("improvement_pct"))


# R6 ------------------------------------------------------------------------------

def compare_departures(hourly: DataFrame, hour1, hour2) -> DataFrame:
    """Which of two departure hours is safer for each trip (pivot of two
    rows). The hours are numbers, or columns of ``hourly`` that are the same
    for all rows of a trip."""
    first, second = (h if isinstance(h, Column) else F.lit(h) for h in (hour1, hour2))
    p = hourly.withColumn("__h1", first).withColumn("__h2", second).where("hour in (__h1, __h2)")
    at = lambda h, c: F.max(F.when(F.col("hour") == F.col(h), F.col(c)))
    p = p.groupBy("trip_id").agg(
        F.min("__h1").alias("__h1"), F.min("__h2").alias("__h2"),
        at("__h1", "safety_score").alias("time1_safety"), at("__h2", "safety_score").alias("time2_safety"),
        at("__h1", "risk_score").alias("time1_risk"), at("__h2", "risk_score").alias("time2_risk"))
    s1, s2 = F.col("time1_safety"), F.col("time2_safety")
    l1, l2 = C.clock_label(F.col("__h1")), C.clock_label(F.col("__h2"))
    diff = C.round_half_up(F.abs(s1 - s2), 1)
    better = lambda a, b: F.concat(F.lit("Departing at "), a, F.lit(" is safer by "),
                                   diff.cast("string"), F.lit(" safety points compared to "), b, F.lit("."))
    text = (F.when(s1 > s2, better(l1, l2)).when(s2 > s1, better(l2, l1))
            .otherwise(F.concat(F.lit("Both departure times have the same safety score ("),
                                s1.cast("string"), F.lit(")."))))
    return p.select("trip_id", l1.alias("time1_label"), l2.alias("time2_label"),
                    "time1_safety", "time2_safety", "time1_risk", "time2_risk",
                    F.when(s1 > s2, "time1").when(s2 > s1, "time2").otherwise("equal").alias("safer"),
                    diff.alias("safety_difference"), text.alias("recommendation"))


# R7 / W6 ---------------------------------------------------------------------------

def best_window(hourly: DataFrame) -> DataFrame:
    """The consecutive hour pair with the best mean safety (earliest on ties)."""
    w = Window.partitionBy("trip_id").orderBy("hour")
    pairs = (hourly.select("trip_id", "hour", "safety_score",
                           F.lead("hour").over(w).alias("next_hour"),
                           F.lead("safety_score").over(w).alias("next_safety"))
             .where(F.col("next_hour").isNotNull())
             .withColumn("avg_safety", (F.col("safety_score") + F.col("next_safety")) / 2))
    best = F.min_by(F.struct("hour", "next_hour", "avg_safety"),
                    F.struct(-F.col("avg_safety"), F.col("hour")))
    agg = pairs.groupBy("trip_id").agg(best.alias("b"))
    start, end = F.col("b.hour"), F.col("b.next_hour") + 1
    avg = C.round_half_up("b.avg_safety", 1)
    text = F.concat(F.lit("The safest 2-hour departure window is "), C.hour_label(start),
                    F.lit(" \u2013 "), C.hour_label(end), F.lit(" (avg safety score "),
                    avg.cast("string"), F.lit("/100)."))
    return agg.select("trip_id", C.hour_label(start).alias("window_start"),
                      C.hour_label(end).alias("window_end"), start.alias("window_start_hour"),
                      end.alias("window_end_hour"), avg.alias("avg_safety_score"),
                      text.alias("recommendation"))


# W11 ---------------------------------------------------------------------------------

def extreme_segments(seg_scores: DataFrame, k: int = 3) -> DataFrame:
    """Top-k riskiest and k safest segments of each route (ties by index).

    Both ranks come from one pass over the scored segments: two windows over
    one partitioning by route.
    """
    hi = Window.partitionBy("route_id").orderBy(F.desc("risk_score"), "segment_index")
    lo = Window.partitionBy("route_id").orderBy("risk_score", "segment_index")
    top, bottom = F.col("top_rank"), F.col("bottom_rank")
    return (seg_scores.select("trip_id", "route_id", "segment_index", "risk_score",
                              F.row_number().over(hi).alias("top_rank"), F.row_number().over(lo).alias("bottom_rank"))
            .where((top <= k) | (bottom <= k))
            .withColumn("top_rank", F.when(top <= k, top)).withColumn("bottom_rank", F.when(bottom <= k, bottom)))


# J3 / W8 / C18 / D3 / R10 / L6 ----------------------------------------------------------

def route_signatures(wp: DataFrame) -> DataFrame:
    """Per route: point count, an order-independent polyline fingerprint
    (``bit_xor`` of per-point hashes, a partial aggregate - the route is
    never gathered) and the waypoints at 25 / 50 / 75 % (index = int(n*f))."""
    n = wp.groupBy("trip_id", "route_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("seq", "lat", "lon")).alias("polyline_hash"))
    j = wp.join(n.hint("merge"), ["trip_id", "route_id"])
    idx = {f: F.floor(F.col("n") * f).cast("int") for f in SIMILAR_FRACTIONS}
    pick = lambda f, c: F.max(F.when(F.col("seq") == idx[f], F.col(c)))
    return j.where(F.col("seq").isin(*idx.values())).groupBy(
        "trip_id", "route_id", "n", "polyline_hash").agg(
        *[pick(f, c).alias(f"{c}_{int(f * 100)}") for f in SIMILAR_FRACTIONS for c in ("lat", "lon")])


def identical_polylines(sig: DataFrame, wp: DataFrame) -> DataFrame:
    """Pairs (a < b) of the same trip with exactly the same waypoint list.

    Candidates share (n, fingerprint); each candidate is verified point by
    point with an equi-join on (pair, seq), so a fingerprint collision can
    never produce a false pair. Only the points of candidates are paired."""
    a = sig.select("trip_id", F.col("route_id").alias("route_a"), "n", "polyline_hash")
    b = sig.select("trip_id", F.col("route_id").alias("route_b"), "n", "polyline_hash")
    cand = a.join(b.hint("merge"), ["trip_id", "n", "polyline_hash"]).where(F.col("route_a") < F.col("route_b"))
    either = cand.select(F.explode(F.array("route_a", "route_b")).alias("route_id")).distinct()
    points = wp.join(either.hint("merge"), "route_id", "left_semi")
    pa = points.select(F.col("route_id").alias("route_a"), "seq", F.col("lat").alias("la"), F.col("lon").alias("oa"))
    pb = points.select(F.col("route_id").alias("route_b"), "seq", F.col("lat").alias("lb"), F.col("lon").alias("ob"))
    same = (cand.join(pa.hint("merge"), "route_a").join(pb.hint("merge"), ["route_b", "seq"])
            .where((F.col("la") == F.col("lb")) & (F.col("oa") == F.col("ob")))
            .groupBy("trip_id", "route_a", "route_b", "n").agg(F.count(F.lit(1)).alias("m")))
    return same.where(F.col("m") == F.col("n")).select("trip_id", "route_a", "route_b")


def similar_pairs(sig: DataFrame, threshold_km: float = SIMILAR_KM, wp: DataFrame | None = None) -> DataFrame:
    """Pairs (a < b) of the same trip that are similar: same polyline, or
    all three sample points within ``threshold_km`` (planar, 111 km/degree).

    Candidates come from an equi-join on (trip, grid cell of the 50 % point)
    over the 3 x 3 neighbouring cells, cells being at least ``threshold_km``
    wide, so any pair within the threshold shares a key; identical
    polylines come from ``identical_polylines`` when the waypoints ``wp``
    are given (otherwise by fingerprint alone). The signatures are read by all
    of these joins and written once, cut by a checkpoint.
    """
    checkpoint_dir(sig.sparkSession)
    sig = sig.checkpoint()
    cell = threshold_km / C.KM_PER_DEGREE
    base = sig.withColumn("__cx", F.floor(F.col("lat_50") / cell).cast("long")) \
              .withColumn("__cy", F.floor(F.col("lon_50") / cell).cast("long"))
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                     for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    probe = (base.select("*", F.explode(offs).alias("o"))
             .select(*[F.col(c).alias(f"b_{c}") for c in base.columns],
                     (F.col("__cx") + F.col("o.dx")).alias("__kx"),
                     (F.col("__cy") + F.col("o.dy")).alias("__ky")))
    a = base.select(*[F.col(c).alias(f"a_{c}") for c in base.columns])
    cand = a.join(probe.hint("merge"), (F.col("a_trip_id") == F.col("b_trip_id"))
                  & (F.col("a___cx") == F.col("__kx")) & (F.col("a___cy") == F.col("__ky"))
                  & (F.col("a_route_id") < F.col("b_route_id")))
    near = None
    for f in SIMILAR_FRACTIONS:
        s = int(f * 100)
        d = C.planar_km(f"a_lat_{s}", f"a_lon_{s}", f"b_lat_{s}", f"b_lon_{s}") <= threshold_km
        near = d if near is None else near & d
    by_shape = cand.where(near).select(F.col("a_trip_id").alias("trip_id"),
                                       F.col("a_route_id").alias("route_a"),
                                       F.col("b_route_id").alias("route_b"))
    if wp is not None:
        by_line = identical_polylines(sig, wp)
    else:
        pa = sig.select("trip_id", F.col("route_id").alias("route_a"), "n", "polyline_hash")
        pb = sig.select("trip_id", F.col("route_id").alias("route_b"), "n", "polyline_hash")
        by_line = (pa.join(pb.hint("merge"), ["trip_id", "n", "polyline_hash"])
                   .where(F.col("route_a") < F.col("route_b")).select("trip_id", "route_a", "route_b"))
    return by_shape.unionByName(by_line).distinct()


def keep_distinct_routes(sig: DataFrame, threshold_km: float = SIMILAR_KM, initial_count: int = 1,
                         max_routes: int = MAX_ROUTES) -> DataFrame:
    """D3/R10/L6 straight from route signatures, without a table of similar
    pairs: the result of ``dedup_routes``.

    Each round keeps the next route of every trip and compares the routes
    still in play with that one route only: an equi-join on the trip whose
    right side has one row per trip. A trip of n alike routes costs n rows a
    round, not n * n. (Identical polylines have identical sample points, so
    the distance test covers them.) Rounds are cut by checkpoints.
    """
    checkpoint_dir(sig.sparkSession)
    points = [f"{c}_{int(f * 100)}" for f in SIMILAR_FRACTIONS for c in ("lat", "lon")]
    left = sig.select("trip_id", "route_id", *points, F.lit(False).alias("similar")).checkpoint()
    kept = None
    for rank in range(1, max_routes + 1):
        # The first routes are kept as they come; later ones only if unlike all kept.
        first = (left.groupBy("trip_id").agg(F.min_by(F.struct("route_id", *points), "route_id").alias("__k"))
                 .select("trip_id", *[F.col(f"__k.{c}").alias(f"__{c}") for c in ("route_id", *points)]))
        chosen = first.select("trip_id", F.lit(rank).alias("route_rank"), F.col("__route_id").alias("route_id"))
        kept = chosen if kept is None else kept.unionByName(chosen)
        if rank == max_routes:
            break
        near = F.lit(True)
        for f in SIMILAR_FRACTIONS:
            s = int(f * 100)
            near = near & (C.planar_km(f"lat_{s}", f"lon_{s}", f"__lat_{s}", f"__lon_{s}") <= threshold_km)
        left = (left.join(first.hint("merge"), "trip_id").where(F.col("route_id") > F.col("__route_id"))
                .select("trip_id", "route_id", *points, (F.col("similar") | F.coalesce(near, F.lit(False))).alias("similar")))
        if rank >= initial_count:
            left = left.where(~F.col("similar"))
        left = left.checkpoint()
    return kept.select("trip_id", F.col("route_rank").cast("int").alias("route_rank"), "route_id")


def dedup_routes(sig: DataFrame, pairs: DataFrame, initial_count: int = 1,
                 max_routes: int = MAX_ROUTES) -> DataFrame:
    """The first ``initial_count`` routes of a trip (by id) are kept
    as returned; each later alternative is added, in order, only while fewer
    than ``max_routes`` are kept and if it is not similar to a kept route.

    A route rejected once stays rejected (kept routes never leave), so the
    next kept route is always min{r > max(kept) : r similar to no kept
    route}. That makes the greedy keep ``max_routes`` rounds of an anti-join
    plus a per-trip ``min`` - no trip is ever gathered into one task.
    """
    # Every round reads the same routes and pairs: materialise them once in
    # the shared checkpoint folder instead of re-deriving them per round.
    checkpoint_dir(sig.sparkSession)
    routes = sig.select("trip_id", "route_id").checkpoint()
    pairs = pairs.select("trip_id", "route_a", "route_b").checkpoint()
    kept = None
    for rank in range(1, max_routes + 1):
        if kept is None:
            cand = routes
        else:
            last = kept.groupBy("trip_id").agg(F.max("route_id").alias("__last"))
            cand = routes.join(last, "trip_id").where(F.col("route_id") > F.col("__last")).drop("__last")
            if rank > initial_count:
                blocked = (pairs.join(kept.select("trip_id", F.col("route_id").alias("route_a")),
                                      ["trip_id", "route_a"])
                           .select("trip_id", F.col("route_b").alias("route_id")))
                cand = cand.join(blocked, ["trip_id", "route_id"], "left_anti")
        nxt = cand.groupBy("trip_id").agg(F.min("route_id").alias("route_id")) \
                  .withColumn("route_rank", F.lit(rank))
        kept = (nxt if kept is None else kept.unionByName(nxt)).checkpoint()
    return kept.select("trip_id", F.col("route_rank").cast("int").alias("route_rank"), "route_id")
