"""Query catalogue: name -> callable(spark, sf_dir) -> DataFrame.

Each entry wires fixture builders to operators with the reference's default
thresholds. The SQL twin of each entry (when SQL can express it) is in
``hazardlens.plans.oracle.ORACLE`` under the same name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.operators import analytics as A
from hazardlens.operators import staging as S
from hazardlens.operators import summaries as SM
from hazardlens.sources import fixtures as FX
from hazardlens.functions import columns as C
from hazardlens.operators import enrich as EN
from hazardlens.operators import features as FE
from hazardlens.operators import model as ML
from hazardlens.operators import quality as Q
from hazardlens.operators import requests as RQ
from hazardlens.operators import routes as R
from hazardlens.operators import scoring as SC
from hazardlens.operators import serving as SV
from hazardlens.session import scratch_path
from hazardlens.sources import io as IO
from hazardlens.sources.tables import load_table
from hazardlens.plans import warehouse as WH
from hazardlens.streaming import stream as ST

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stage_incidents(FX.incidents(spark, sf_dir))


def _rows_out(df: DataFrame) -> DataFrame:
    """Row-level outputs: the nullable minute count is emitted as double so a
    missing end time compares as NaN in every engine."""
    return df.withColumn("duration_minutes", F.col("duration_minutes").cast("double"))


# --- staging and summaries ------------------------------------------------

@query("staging_incidents")
def q_staging(spark, sf_dir):
    return _rows_out(staged(spark, sf_dir))


@query("point_lookup")
def q_point_lookup(spark, sf_dir):
    """The warehouse smoke lookup on the raw table. The two nullable raw
    flags are emitted as text so a missing value compares equal everywhere."""
    out = S.point_lookup(FX.incidents(spark, sf_dir), severity=3, state="NATION_1", limit=1000)
    return (out.withColumn("Junction", F.col("Junction").cast("string"))
               .withColumn("Traffic_Signal", F.col("Traffic_Signal").cast("string")))


@query("location_summary")
def q_location_summary(spark, sf_dir):
    return SM.location_summary(staged(spark, sf_dir), min_count=10)


@query("temporal_patterns")
def q_temporal_patterns(spark, sf_dir):
    return SM.temporal_patterns(staged(spark, sf_dir))


@query("weather_impact")
def q_weather_impact(spark, sf_dir):
    return SM.weather_impact(staged(spark, sf_dir), min_count=100)


# --- analytics views ------------------------------------------------------

@query("top_risk_locations")
def q_top_risk_locations(spark, sf_dir):
    return A.top_risk_locations(SM.location_summary(staged(spark, sf_dir), 10), min_total=100)


@query("hourly_risk_profile")
def q_hourly(spark, sf_dir):
    return A.hourly_risk_profile(SM.temporal_patterns(staged(spark, sf_dir)))


@query("day_of_week_analysis")
def q_dow(spark, sf_dir):
    return A.day_of_week_analysis(SM.temporal_patterns(staged(spark, sf_dir)))


@query("weather_risk_ranking")
def q_weather_rank(spark, sf_dir):
    return A.weather_risk_ranking(SM.weather_impact(staged(spark, sf_dir), 100))


@query("top_weather_by_rate")
def q_top_weather(spark, sf_dir):
    return A.volume_filtered_ranking(
        A.weather_risk_ranking(SM.weather_impact(staged(spark, sf_dir), 100)), min_count=1000, k=5)


@query("state_summary")
def q_state_summary(spark, sf_dir):
    return A.state_summary(SM.location_summary(staged(spark, sf_dir), 10))


@query("rush_hour_impact")
def q_rush(spark, sf_dir):
    return A.rush_hour_impact(SM.temporal_patterns(staged(spark, sf_dir)))


@query("high_risk_segments")
def q_high_risk_segments(spark, sf_dir):
    return A.high_risk_segments(staged(spark, sf_dir), min_severity=2, min_count=50)


@query("severity_distribution")
def q_severity_distribution(spark, sf_dir):
    return A.value_distribution(FX.incidents(spark, sf_dir), "Severity", digits=2)


@query("top_states")
def q_top_states(spark, sf_dir):
    return A.top_categories(FX.incidents(spark, sf_dir), "State", k=10)


@query("time_part_counts")
def q_time_parts(spark, sf_dir):
    return A.time_part_counts(staged(spark, sf_dir))


@query("coverage_kpis")
def q_coverage(spark, sf_dir):
    return A.coverage_kpis(staged(spark, sf_dir))


@query("city_centroids")
def q_centroids(spark, sf_dir):
    return A.city_centroids(staged(spark, sf_dir))


NUMERIC_COLS = ["temperature_f", "humidity_pct", "visibility_mi", "distance_mi", "duration_minutes"]


@query("numeric_summary")
def q_numeric_summary(spark, sf_dir):
    return A.numeric_summary(staged(spark, sf_dir), NUMERIC_COLS)


@query("hour_dow_matrix")
def q_matrix(spark, sf_dir):
    return A.hour_dow_matrix(staged(spark, sf_dir))


@query("relative_weather_risk")
def q_relative(spark, sf_dir):
    return A.relative_risk(staged(spark, sf_dir), "weather_condition", "Clear")


@query("grid_density")
def q_grid(spark, sf_dir):
    return A.grid_density(staged(spark, sf_dir))


@query("road_feature_lift")
def q_lift(spark, sf_dir):
    return A.road_feature_lift(staged(spark, sf_dir))


@query("explorer_filter")
def q_explorer(spark, sf_dir):
    return _rows_out(A.explorer_filter(staged(spark, sf_dir), severity=3, time_band="night",
                                       weather="Fog", year=2024))


@query("random_sample")
def q_sample(spark, sf_dir):
    return A.random_sample(staged(spark, sf_dir).select("ID", "latitude", "longitude", "Severity"),
                           n=500, key="ID", seed=42)


@query("cities_per_state")
def q_cities(spark, sf_dir):
    return A.cities_per_state(staged(spark, sf_dir))


# --- data quality (on the raw incident table) -------------------------------


@query("null_profile")
def q_null_profile(spark, sf_dir):
    return Q.null_counts(FX.incidents(spark, sf_dir), nonzero_only=True)


@query("critical_nulls")
def q_critical_nulls(spark, sf_dir):
    return Q.null_counts(FX.incidents(spark, sf_dir), Q.CRITICAL_COLUMNS)


@query("value_set_check")
def q_value_set(spark, sf_dir):
    return Q.value_set_check(FX.dirty_incidents(spark, sf_dir), "Severity", Q.SEVERITY_LEVELS)


@query("range_check")
def q_range(spark, sf_dir):
    return Q.range_check(FX.dirty_incidents(spark, sf_dir))


@query("duplicate_keys")
def q_dups(spark, sf_dir):
    return Q.duplicate_summary(FX.dirty_incidents(spark, sf_dir), "ID")


@query("date_check")
def q_dates(spark, sf_dir):
    return Q.date_check(FX.dirty_incidents(spark, sf_dir), "Start_Time", as_of="2026-01-01 00:00:00")


@query("quality_report")
def q_quality(spark, sf_dir):
    return Q.quality_report(FX.dirty_incidents(spark, sf_dir), as_of="2026-01-01 00:00:00")


# --- features -------------------------------------------------------------------

def _imputed(spark, sf_dir):
    return FE.impute(FE.feature_source(staged(spark, sf_dir)))


@query("imputed_features")
def q_imputed(spark, sf_dir):
    return _imputed(spark, sf_dir)


@query("label_encoding")
def q_label_enc(spark, sf_dir):
    imp = _imputed(spark, sf_dir)
    return (FE.label_codes(imp, "state").select(F.lit("state").alias("column"), "value", "code")
            .unionByName(FE.label_codes(imp, "weather_condition")
                         .select(F.lit("weather_condition").alias("column"), "value", "code")))


@query("frequency_encoding")
def q_freq_enc(spark, sf_dir):
    return FE.frequency_codes(_imputed(spark, sf_dir), "city")


@query("feature_table")
def q_feature_table(spark, sf_dir):
    return FE.feature_table(staged(spark, sf_dir))


@query("hash_split")
def q_hash_split(spark, sf_dir):
    ids = staged(spark, sf_dir).select(F.col("ID").alias("accident_id"))
    return FE.hash_split(ids, "accident_id", seed=42, train_pct=80)


@query("class_balance")
def q_class_balance(spark, sf_dir):
    return A.class_balance(FE.feature_source(staged(spark, sf_dir)), "is_high_severity")


# --- rule scoring and evaluation ------------------------------------------------

def _scored(spark, sf_dir):
    return SC.rule_score(staged(spark, sf_dir))


@query("rule_scores")
def q_rule_scores(spark, sf_dir):
    return SC.describe_scores(_scored(spark, sf_dir)).select(
        "ID", "risk_score", "risk_level", "confidence", "safety_score")


@query("eval_metrics")
def q_eval(spark, sf_dir):
    return SC.eval_metrics(_scored(spark, sf_dir))


@query("confusion_matrix")
def q_confusion(spark, sf_dir):
    return SC.confusion_matrix(_scored(spark, sf_dir))


@query("class_report")
def q_class_report(spark, sf_dir):
    return SC.class_report(_scored(spark, sf_dir))


@query("roc_points")
def q_roc(spark, sf_dir):
    return SC.roc_points(_scored(spark, sf_dir))


# --- routes ------------------------------------------------------------------------


# Reference mock departure: Friday 2024-01-05 17:00, manual weather Clear / 70 F / 10 mi.
ROUTE_HOUR, ROUTE_DOW = 17, 5


def _samples(spark, sf_dir):
    return R.sample_waypoints(FX.waypoints(spark, sf_dir))


def _segments(spark, sf_dir, wp=None):
    """Sampled segments with the road flags of past incidents around them."""
    wp = FX.waypoints(spark, sf_dir) if wp is None else wp
    return R.with_history(R.sample_waypoints(wp), staged(spark, sf_dir))


def _seg_scores(spark, sf_dir, weather="Clear", temp=70.0, vis=10.0, wp=None):
    return R.score_segments(_segments(spark, sf_dir, wp), ROUTE_HOUR, ROUTE_DOW, weather, temp, vis)


@query("waypoint_distance")
def q_wp_distance(spark, sf_dir):
    return R.route_lengths(FX.waypoints(spark, sf_dir))


@query("waypoint_sampling")
def q_wp_sampling(spark, sf_dir):
    return _samples(spark, sf_dir)


@query("route_risk")
def q_route_risk(spark, sf_dir):
    return R.route_risk(FX.waypoints(spark, sf_dir), _seg_scores(spark, sf_dir))


@query("danger_zones")
def q_danger(spark, sf_dir):
    """In poor visibility, segments past a junction or crossing are dangerous."""
    return R.danger_zones(_seg_scores(spark, sf_dir, "Clear", 70.0, 3.0))


@query("route_advice")
def q_advice(spark, sf_dir):
    return R.route_advice(R.route_risk(FX.waypoints(spark, sf_dir), _seg_scores(spark, sf_dir)))


@query("route_outcomes")
def q_outcomes(spark, sf_dir):
    """Routes as they arrive, some broken: sound ones are ranked by
    their risk, broken ones take part with the fallback and a warning."""
    sound, failed = R.checked_waypoints(FX.raw_waypoints(spark, sf_dir))
    return R.route_advice(R.route_risk(sound, _seg_scores(spark, sf_dir, wp=sound)), failed)


def _hourly(spark, sf_dir, hours):
    """Scores of each trip's first route at ``hours`` of the day it asks for,
    with the columns of its request."""
    wp = FX.waypoints(spark, sf_dir)
    first = wp.join(R.first_routes(wp), ["trip_id", "route_id"])
    asked = FX.trip_requests(spark, sf_dir)
    segments = _segments(spark, sf_dir, first).join(asked.select("trip_id", "date"), "trip_id")
    return R.hourly_route_scores(None, segments, F.col("date"), hours).join(asked, "trip_id")


@query("departure_hours")
def q_departure_hours(spark, sf_dir):
    """Each trip's candidate hours with safety, risk, level and danger count."""
    asked = FX.trip_requests(spark, sf_dir).columns[1:]
    return _hourly(spark, sf_dir, R.DEFAULT_HOURS).where("hour between earliest and latest").drop(*asked)


@query("departure_times")
def q_departures(spark, sf_dir):
    hourly = _hourly(spark, sf_dir, R.DEFAULT_HOURS).where("hour between earliest and latest")
    return R.departure_analysis(hourly, R.DEFAULT_HOURS)


@query("compare_times")
def q_compare(spark, sf_dir):
    return R.compare_departures(_hourly(spark, sf_dir, [8, 12, 17, 21]), F.col("time1"), F.col("time2"))


@query("best_window")
def q_best_window(spark, sf_dir):
    hours = list(range(R.WINDOW_MIN_HOUR, R.WINDOW_MAX_HOUR + 1))
    return R.best_window(_hourly(spark, sf_dir, hours).where("hour >= window_from"))


@query("extreme_segments")
def q_extremes(spark, sf_dir):
    return R.extreme_segments(_seg_scores(spark, sf_dir), 3)


@query("similar_routes")
def q_similar(spark, sf_dir):
    wp = FX.waypoints(spark, sf_dir)
    return R.similar_pairs(R.route_signatures(wp), wp=wp)


@query("dedup_routes")
def q_dedup(spark, sf_dir):
    return R.keep_distinct_routes(R.route_signatures(FX.waypoints(spark, sf_dir)))


# --- enrichment -------------------------------------------------------------------


@query("unit_conversion")
def q_units(spark, sf_dir):
    return EN.parse_weather_payloads(EN.weather_payloads(FX.observations(spark, sf_dir)))


@query("weather_asof")
def q_asof(spark, sf_dir):
    out = EN.point_weather(FX.query_points(spark, sf_dir), FX.observations(spark, sf_dir))
    return out.withColumn("obs_id", F.col("obs_id").cast("double"))  # nullable id, compared as double


def _route_sample_weather(spark, sf_dir):
    wp = FX.corridor_waypoints(spark, sf_dir)
    firsts = R.first_routes(wp)
    pts = (EN.route_sample_points(wp.join(firsts, ["trip_id", "route_id"]))
           .join(FX.trip_departures(spark, sf_dir), "trip_id")
           .select((F.col("route_id") * 1000 + F.col("seq")).alias("point_id"), "trip_id", "seq",
                   "lat", "lon", F.col("departure_ts").alias("ts")))
    return EN.point_weather(pts, FX.observations(spark, sf_dir))


@query("route_weather")
def q_route_weather(spark, sf_dir):
    return EN.route_weather(_route_sample_weather(spark, sf_dir))


@query("effective_weather")
def q_effective(spark, sf_dir):
    trips = FX.trip_departures(spark, sf_dir)
    req = trips.select("trip_id", (F.col("trip_id") % 2 == 0).alias("auto_fetch"),
                       F.when(F.col("trip_id") % 5 == 0, "Rain").alias("weather_condition"),
                       F.when(F.col("trip_id") % 5 == 0, F.lit(45.0)).alias("temperature_f"),
                       F.lit(None).cast("double").alias("visibility_mi"))
    return EN.effective_weather(req, EN.route_weather(_route_sample_weather(spark, sf_dir)))


@query("event_props")
def q_props(spark, sf_dir):
    return EN.event_props(load_table(spark, sf_dir, "events"))


@query("weather_codes")
def q_codes(spark, sf_dir):
    codes = FX.observations(spark, sf_dir).select("code").distinct()
    cat = C.weather_category("code")
    return codes.select("code", cat.alias("category"),
                        C.scorer_weather_code(cat).alias("scorer_code"),
                        C.api_weather_code(cat).alias("api_code"),
                        C.poor_weather_text(cat).alias("poor_weather"))


# --- the trained model ------------------------------------------------------------------


def _model_path(spark, sf_dir):
    """Folder of the pipeline trained on ``sf_dir`` in this application. It is
    trained, saved with its metrics and feature table once, and loaded from
    there by every query."""
    app = spark.conf.get("spark.app.id", None) or str(id(spark))
    base = scratch_path(spark, f"risk-{app}-{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}")
    try:
        spark.read.text(f"{base}/done")
    except AnalysisException:  # not trained yet
        model, feats = SV.fit_risk_pipeline(staged(spark, sf_dir), features_path=f"{base}/features")
        SV.save_risk_pipeline(spark, model, feats, f"{base}/model")
        spark.createDataFrame([("trained",)], "value string").write.mode("overwrite").text(f"{base}/done")
    return base


def _model(spark, sf_dir):
    base = _model_path(spark, sf_dir)
    return SV.load_risk_pipeline(f"{base}/model"), spark.read.parquet(f"{base}/features")


@query("gbt_scores")
def q_gbt_scores(spark, sf_dir):
    model, feats = _model(spark, sf_dir)
    return ML.score_model(SV.booster(model), feats).select("accident_id", "is_high_severity", "risk_score",
                                                           "prediction", "risk_level", "confidence")


@query("gbt_checks")
def q_gbt_checks(spark, sf_dir):
    """What must hold for every scored incident, whatever was learned:
    a probability; level, prediction and confidence as functions of it; and the
    same score from raw fields through the whole pipeline."""
    model, feats = _model(spark, sf_dir)
    a = ML.score_model(SV.booster(model), feats)
    b = SV.score_incidents(model, staged(spark, sf_dir)).select("accident_id", F.col("risk_score").alias("again"))
    return a.join(b, "accident_id").select(
        "accident_id", "split", F.col("risk_score").between(0, 1).alias("is_probability"),
        (F.col("risk_level") == C.risk_level3("risk_score")).alias("level_follows"),
        ((F.col("risk_score") > 0.5).cast("double") == F.col("prediction")).alias("prediction_follows"),
        (F.abs(F.col("confidence") - F.abs(F.col("risk_score") - 0.5) * 2) < 1e-4).alias("confidence_follows"),
        (F.abs(F.col("risk_score") - F.col("again")) < 1e-9).alias("same_from_raw"))


@query("gbt_metrics")
def q_gbt_metrics(spark, sf_dir):
    model, feats = _model(spark, sf_dir)
    return ML.evaluate(SV.booster(model), feats)


@query("gbt_metrics_check")
def q_gbt_metrics_check(spark, sf_dir):
    """Sizes of the held-out rows, and that the metrics saved with the
    model are those of the loaded model on these rows."""
    base = _model_path(spark, sf_dir)
    now = ML.evaluate(SV.booster(SV.load_risk_pipeline(f"{base}/model")), spark.read.parquet(f"{base}/features"))
    then = ML.model_metadata(spark, f"{base}/model").first()  # one small row
    same = F.lit(True)
    for c in now.columns:
        same = same & (F.abs(F.col(c) - F.lit(then.metrics[c])) < 1e-9)
    return now.select("test_samples", "positive_samples", "negative_samples", F.lit(then.model_type).alias("model_type"),
                      F.lit(then.feature_count).alias("feature_count"), same.alias("metrics_as_saved"),
                      F.lit(then.saved_at is not None).alias("has_time"), F.col("roc_auc").between(0, 1).alias("auc_in_range"))


@query("feature_importance")
def q_importance(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    return ML.feature_importance(spark, SV.booster(model), SV.feature_names(model))


@query("importance_check")
def q_importance_check(spark, sf_dir):
    """Every feature has one importance, they sum to 1 and rank downwards."""
    model, _ = _model(spark, sf_dir)
    names = SV.feature_names(model)
    imp = ML.feature_importance(spark, SV.booster(model), names, top=len(names))
    total = imp.agg(F.sum("importance")).first()[0]
    later = imp.select((F.col("rank") - 1).alias("rank"), F.col("importance").alias("__next"))
    return imp.join(later, "rank", "left").select(
        "feature", "display_name", (F.col("importance") >= F.coalesce("__next", F.lit(0.0))).alias("ranked"),
        F.lit(abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("contributing_factors")
def q_factors(spark, sf_dir):
    model, feats = _model(spark, sf_dir)
    names = SV.feature_names(model)
    return SC.contributing_factors(feats.select("accident_id", *names),
                                   ML.feature_importance(spark, SV.booster(model), names, top=len(names)), top_n=5)


@query("model_metadata")
def q_model_meta(spark, sf_dir):
    return ML.model_metadata(spark, f"{_model_path(spark, sf_dir)}/model")


@query("model_request_scores")
def q_model_requests(spark, sf_dir):
    """Every request through the saved pipeline; rejected ones get the fallback."""
    model, _ = _model(spark, sf_dir)
    return SV.predict_requests(model, _validated(spark, sf_dir))


@query("model_request_checks")
def q_model_request_checks(spark, sf_dir):
    """Ids and validity of all requests, and that level, confidence, fallback
    and factors follow from the score."""
    scored = q_model_requests(spark, sf_dir)
    p, known = F.col("risk_score"), F.col("risk_level") != SC.FALLBACK_LEVEL
    fallback = (p == SC.FALLBACK_RISK) & (F.col("confidence") == 0) & F.col("contributing_factors").isNull()
    return scored.select(
        "request_id", "valid", (known == F.col("valid")).alias("scored_if_valid"), p.between(0, 1).alias("is_probability"),
        F.when(known, F.abs(F.col("confidence") - F.abs(p - 0.5) * 2) < 2e-4).otherwise(fallback).alias("confidence_follows"),
        F.when(known, (F.col("risk_level") == C.risk_level3(p)) | (F.abs(p - 0.3) < 1e-4) | (F.abs(p - 0.6) < 1e-4))
        .otherwise(fallback).alias("level_follows"),
        F.when(known, F.size("contributing_factors") == 5).otherwise(fallback).alias("factors_follow"))


def _model_segments(spark, sf_dir):
    """Segments of all routes, scored by the model at the departure, in the
    weather and past the road features that belong to them."""
    model, _ = _model(spark, sf_dir)
    asked = FX.trip_requests(spark, sf_dir).select("trip_id", "date", "earliest")
    segments = _segments(spark, sf_dir).join(asked, "trip_id")
    foggy = F.col("trip_id") % 4 == 0
    return R.score_segments(segments, F.col("earliest"), C.dow_sunday0(F.col("date")),
                            F.when(foggy, "Fog").otherwise("Clear"), F.when(foggy, 45.0).otherwise(70.0),
                            F.when(foggy, 2.0).otherwise(10.0), scorer=SV.segment_scorer(model)).drop("date", "earliest")


@query("model_route_risk")
def q_model_route_risk(spark, sf_dir):
    """Route risk from the trained model."""
    return R.route_risk(FX.waypoints(spark, sf_dir), _model_segments(spark, sf_dir))


@query("model_route_checks")
def q_model_route_checks(spark, sf_dir):
    """Routes with their sampled segments, and that the risks are in order and
    safety, danger zones and first danger level follow from them."""
    risk = q_model_route_risk(spark, sf_dir)
    low, mid, high = F.col("min_risk"), F.col("overall_risk"), F.col("max_risk")
    danger = F.col("danger_zones") > 0
    return risk.select(
        "trip_id", "route_id", "segments_scored", (low.between(0, 1) & high.between(0, 1)).alias("are_probabilities"),
        ((low <= mid + 1e-6) & (mid <= high + 1e-6)).alias("in_order"),
        (F.abs(F.col("safety_score") - (100 - 100 * mid)) < 1e-3).alias("safety_follows"),
        ((high > R.DANGER_THRESHOLD) == danger).alias("danger_follows"),
        (F.col("first_danger_level").isNotNull() == danger).alias("level_follows"),
        (F.col("danger_zones") <= F.col("segments_scored")).alias("danger_counted"))


@query("stratified_split")
def q_stratified(spark, sf_dir):
    rows = FE.feature_source(staged(spark, sf_dir)).select("accident_id", F.col("is_high_severity").cast("int").alias("is_high_severity"))
    return FE.stratified_split(rows)


# --- streaming ------------------------------------------------------------------------


@query("streaming_rule_scores")
def q_stream_scores(spark, sf_dir):
    return ST.streaming_rule_scores(spark, sf_dir)


@query("streaming_request_scores")
def q_stream_requests(spark, sf_dir):
    return ST.streaming_request_scores(spark, sf_dir)


@query("streaming_model_scores")
def q_stream_model(spark, sf_dir):
    """The saved pipeline on a stream of requests, two sinks read back."""
    model, _ = _model(spark, sf_dir)
    return ST.streaming_model_scores(spark, sf_dir, model)


@query("streaming_model_checks")
def q_stream_model_checks(spark, sf_dir):
    """Every streamed request with its validity and errors, and that the stream
    gave it what the batch query gives."""
    model, _ = _model(spark, sf_dir)
    batch = SV.predict_requests(model, _validated(spark, sf_dir)).select(
        "request_id", *[F.col(c).alias(f"__{c}") for c in ("risk_score", "risk_level", "confidence")])
    both = ST.streaming_model_scores(spark, sf_dir, model).join(batch, "request_id", "full")
    same = F.lit(True)
    for c in ("risk_score", "risk_level", "confidence"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return both.select("request_id", "valid", "errors", same.alias("same_as_batch"))


@query("hourly_incident_window")
def q_hourly_incidents(spark, sf_dir):
    return ST.hourly_incident_window(spark, sf_dir)


@query("hourly_event_window")
def q_hourly_events(spark, sf_dir):
    return ST.hourly_event_window(spark, sf_dir)


# --- sources and sinks ------------------------------------------------------------


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    base = _scratch(spark, "csv")
    IO.write_csv(FX.incidents(spark, sf_dir), f"{base}/raw_csv")
    typed = IO.read_typed_csv(spark, f"{base}/raw_csv")
    IO.write_parquet(typed, f"{base}/raw_parquet")
    return IO.verify_write(spark, typed, f"{base}/raw_parquet", source_path=f"{base}/raw_csv")


@query("prefix_sample")
def q_prefix(spark, sf_dir):
    return IO.prefix_sample(FX.incidents(spark, sf_dir), 1000, order=[F.col("ID").cast("bigint")]).select(
        "ID", "Severity", "Start_Time", "State", "City")


@query("csv_mixed_headers")
def q_csv_mixed(spark, sf_dir):
    """Two folders of files with the 46 columns in different orders, some
    rows not parseable; sound and rejected rows per State and in all."""
    base = _scratch(spark, "csv-mixed")
    wide = FX.wide_incidents(spark, sf_dir)
    half = F.col("ID").cast("bigint") % 2 == 0
    IO.write_csv(wide.where(half), f"{base}/a")
    IO.write_csv(wide.where(~half).select(*[f"`{c}`" for c in reversed(wide.columns)]), f"{base}/b")
    rows, rejected = IO.read_csv_folder(spark, base)
    counts = rows.groupBy("State").agg(F.count(F.lit(1)).alias("rows"), F.sum("Severity").alias("severity"),
                                       F.count_if("Crossing").alias("crossings"), F.count("Start_Lat").alias("places"))
    bad = rejected.agg(F.lit("rejected").alias("State"), F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("severity"),
                       F.count_if(F.col("line").contains("north")).alias("crossings"), F.lit(0).cast("long").alias("places"))
    return counts.unionByName(bad)


@query("analytics_views")
def q_analytics_views(spark, sf_dir):
    """The warehouse published to the catalog; rows and a total of each
    of the seven views, read by name with SQL."""
    prefix = f"hl_{uuid.uuid4().hex[:8]}_"
    WH.publish_warehouse(spark, FX.incidents(spark, sf_dir), _scratch(spark, "warehouse"), prefix)
    total = {"top_risk_locations": "total_accidents", "hourly_risk_profile": "total_accidents", "day_of_week_analysis": "total_accidents",
             "weather_risk_ranking": "accident_count", "state_summary": "total_accidents", "rush_hour_impact": "total_accidents",
             "high_risk_segments": "accident_count"}
    parts = [f"SELECT '{v}' AS view, count(*) AS rows, sum({c}) AS total FROM {prefix}analytics.{v}" for v, c in total.items()]
    return spark.sql(" UNION ALL ".join(parts))


@query("schema_listing")
def q_schema(spark, sf_dir):
    """Staging's columns with their types and null counts (nullability flags
    are engine-specific, so they stay out of the compared output)."""
    return IO.schema_listing(spark, staged(spark, sf_dir)).drop("nullable")


@query("layer_sizes")
def q_layers(spark, sf_dir):
    base = _scratch(spark, "layers")
    st = staged(spark, sf_dir)
    paths = IO.write_layers(base, {
        "raw.accidents": FX.incidents(spark, sf_dir), "staging.accidents": st,
        "staging.location_summary": SM.location_summary(st, 10),
        "staging.temporal_patterns": SM.temporal_patterns(st),
        "staging.weather_impact": SM.weather_impact(st, 100)})
    return IO.table_sizes({name: spark.read.parquet(p) for name, p in paths.items()})


# --- requests, shares, history, payloads, modes ------------------------------------


def _validated(spark, sf_dir):
    return RQ.validate_requests(FX.prediction_requests(staged(spark, sf_dir)))


@query("request_validation")
def q_req_validation(spark, sf_dir):
    # hour may be missing (that is what is being validated): compared as double
    return _validated(spark, sf_dir).select("request_id", "latitude", F.col("hour").cast("double").alias("hour"),
                                            "day_of_week", "month", "errors", "n_errors", "valid")


@query("request_features")
def q_req_features(spark, sf_dir):
    imp = _imputed(spark, sf_dir)
    valid = _validated(spark, sf_dir).where("valid")
    return RQ.request_features(valid, FE.label_codes(imp, "state"), FE.frequency_codes(imp, "city"))


@query("time_shares")
def q_shares(spark, sf_dir):
    """The views' shares by hour, weekday and state, counted in one pass."""
    return A.shares(staged(spark, sf_dir), {"hour": "hour", "day_of_week": "day_of_week", "state": "State"})


@query("segment_history")
def q_seg_history(spark, sf_dir):
    """Each sampled route segment joined to the incident history of its
    grid cell (equi-join on the rounded coordinates; no cell -> zeros)."""
    segs = _samples(spark, sf_dir)
    dens = A.grid_density(staged(spark, sf_dir))
    keyed = segs.select("*", C.grid_key("lat").alias("lat_cell"), C.grid_key("lon").alias("lon_cell"))
    j = keyed.join(dens, ["lat_cell", "lon_cell"], "left")
    return j.select("trip_id", "route_id", "segment_index", "lat_cell", "lon_cell",
                    F.coalesce("n", F.lit(0)).alias("incidents"),
                    F.coalesce("high_severity_count", F.lit(0)).alias("high_severity"),
                    (F.coalesce("junction_count", F.lit(0)) > 0).alias("has_junction"),
                    (F.coalesce("crossing_count", F.lit(0)) > 0).alias("has_crossing"))


def route_payload_json(lengths):
    """Directions-style JSON per route (first leg, polyline, summary); every
    11th route lacks its legs, which the parser must drop."""
    miles = F.col("total_miles")
    secs = (miles * 60).cast("int")
    leg = F.struct(
        F.struct(F.concat(F.format_string("%.1f", F.bround(miles, 1)), F.lit(" mi")).alias("text"),
                 F.floor(miles * 1609.34 + 0.5).cast("int").alias("value")).alias("distance"),
        F.struct(F.concat((secs / 60).cast("int").cast("string"), F.lit(" mins")).alias("text"),
                 secs.alias("value")).alias("duration"))
    body = F.struct(
        F.concat(F.lit("Route "), F.col("route_id").cast("string")).alias("summary"),
        F.struct(F.concat(F.lit("pl"), F.col("route_id").cast("string"), F.lit("-"),
                          F.col("n_points").cast("string")).alias("points")).alias("overview_polyline"),
        F.when(F.col("route_id") % 11 != 0, F.array(leg)).alias("legs"))
    return lengths.select("trip_id", "route_id", F.to_json(body).alias("payload"))


@query("route_payloads")
def q_route_payloads(spark, sf_dir):
    parsed = EN.parse_route_payloads(route_payload_json(R.route_lengths(FX.waypoints(spark, sf_dir))))
    return parsed.drop("duration_in_traffic_text", "duration_in_traffic_seconds")


@query("mode_values")
def q_modes(spark, sf_dir):
    return A.mode_of(staged(spark, sf_dir), ["weather_condition", "State", "City", "hour"])


@query("feature_summary")
def q_feature_summary(spark, sf_dir):
    """M9: type and nulls of every feature, and the share of each class."""
    ft = FE.feature_table(staged(spark, sf_dir))
    return FE.feature_summary(ft)


@query("request_scores")
def q_request_scores(spark, sf_dir):
    return SC.score_requests(_validated(spark, sf_dir)).select(
        "request_id", "valid", "risk_score", "risk_level", "confidence")


@query("rule_factors")
def q_rule_factors(spark, sf_dir):
    """J5/M21 with the rule scorer's fixed importance table: each incident's
    five factors with its own values (weather text has no numeric value)."""
    st = staged(spark, sf_dir).select(
        F.col("ID").alias("accident_id"), "visibility_mi", F.col("hour").cast("double").alias("hour"),
        "precipitation_in", F.col("has_junction").cast("double").alias("has_junction"),
        F.lit(None).cast("double").alias("weather_condition"))
    return SC.contributing_factors(st, SC.rule_factor_table(spark), top_n=5)


@query("cities_for_state")
def q_cities_for_state(spark, sf_dir):
    return A.cities_for_state(staged(spark, sf_dir), "NATION_1")


@query("top_weather")
def q_top_weather(spark, sf_dir):
    return A.top_categories(FX.incidents(spark, sf_dir), "Weather_Condition", k=10)


@query("top_cities")
def q_top_cities(spark, sf_dir):
    return A.top_categories(FX.incidents(spark, sf_dir), "City", k=10)
