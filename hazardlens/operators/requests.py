"""Prediction requests as a table: defaults, range validation, weekday
words, and request -> model features (F16, F17, M14, T5).

A batch of requests is one DataFrame; invalid rows are not dropped but
carry their error list, so callers can split valid / rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions import columns as C

# Request defaults and bounds of the reference's request model.
REQUEST_DEFAULTS = {
    "month": 1, "is_weekend": False, "temperature_f": 70.0, "humidity_pct": 50.0,
    "pressure_in": 29.92, "visibility_mi": 10.0, "wind_speed_mph": 5.0,
    "precipitation_in": 0.0, "distance_mi": 0.0,
}
REQUIRED = ["latitude", "longitude", "hour", "day_of_week"]
BOUNDS = {  # column: (min, max); None = unbounded side
    "latitude": (-90, 90), "longitude": (-180, 180), "hour": (0, 23), "day_of_week": (0, 6),
    "month": (1, 12), "humidity_pct": (0, 100), "visibility_mi": (0, None),
    "wind_speed_mph": (0, None), "precipitation_in": (0, None), "distance_mi": (0, None),
}


def apply_defaults(req: DataFrame) -> DataFrame:
    """Fill optional fields (and every road flag) with the request defaults;
    ``day_of_week`` may be a weekday word (Monday = 0)."""
    out = req
    if "day_of_week" in out.columns:
        out = out.withColumn("day_of_week", C.request_weekday("day_of_week"))
    for c, v in REQUEST_DEFAULTS.items():
        col = F.col(c) if c in out.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(col.cast("boolean" if isinstance(v, bool) else
                                                    ("int" if isinstance(v, int) else "double")),
                                           F.lit(v)))
    for f in C.ROAD_FLAGS:
        col = F.col(f) if f in out.columns else F.lit(None)
        out = out.withColumn(f, F.coalesce(col.cast("boolean"), F.lit(False)))
    return out


def validation_errors(req: DataFrame) -> Column:
    """array<string> of violated constraints (empty when valid)."""
    checks = []
    for c in REQUIRED:
        checks.append(F.when(F.col(c).isNull(), F.lit(f"{c}: field required")))
    for c, (lo, hi) in BOUNDS.items():
        v = F.col(c)
        if lo is not None:
            checks.append(F.when(v < lo, F.lit(f"{c}: must be >= {lo}")))
        if hi is not None:
            checks.append(F.when(v > hi, F.lit(f"{c}: must be <= {hi}")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate_requests(req: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Defaulted requests with ``errors`` (text), ``n_errors``, ``valid``."""
    d = apply_defaults(req)
    errs = validation_errors(d)
    return (d.withColumn("__e", errs)
             .withColumn("errors", F.array_join("__e", "; "))
             .withColumn("n_errors", F.size("__e"))
             .withColumn("valid", F.size("__e") == 0).drop("__e"))


def request_features(valid: DataFrame, state_codes: DataFrame | None = None,
                     city_codes: DataFrame | None = None, unknown: int = -1, keep: list | None = None) -> DataFrame:
    """Request -> the 33 model features.

    Requests count weekdays from Monday = 0, the model's layout from Sunday = 0.

    Period from an explicit label (training map) else from the hour (request
    bands); rush hour 7-9 / 16-19; poor weather and extreme temperature from
    the numbers; weather code by two-way containment. State and city use the
    code tables fitted at training time (J1 joins); unseen values get
    ``unknown`` instead of a per-process hash. ``keep`` names further columns
    to carry along.
    """
    out = valid
    tp = (C.period_label_code("time_period", compat=True) if "time_period" in out.columns
          else None)
    period = F.coalesce(F.when(F.col("time_period").isNotNull(), tp), C.api_period_code("hour")) \
        if tp is not None else C.api_period_code("hour")
    for name, codes in (("state", state_codes), ("city", city_codes)):
        if codes is not None and name in out.columns:
            out = out.join(codes.select(F.col("value").alias(name), F.col("code").alias(f"{name}_encoded")),
                           name, "left")
        out = out.withColumn(f"{name}_encoded",
                             F.coalesce(F.col(f"{name}_encoded") if f"{name}_encoded" in out.columns
                                        else F.lit(None), F.lit(unknown)).cast("int"))
    return out.select(
        *[c for c in ("request_id", *(keep or [])) if c in out.columns],
        "hour", C.monday0_to_sunday0("day_of_week").alias("day_of_week"), F.col("is_weekend").cast("int").alias("is_weekend"), "month",
        period.cast("int").alias("time_period_encoded"), C.is_rush_hour("hour").alias("is_rush_hour"),
        "state_encoded", "city_encoded", "latitude", "longitude", "temperature_f", "humidity_pct",
        "pressure_in", "visibility_mi", "wind_speed_mph", "precipitation_in",
        C.api_weather_code("weather_condition").alias("weather_encoded"),
        C.poor_weather_numeric("visibility_mi", "precipitation_in").alias("poor_weather"),
        C.extreme_temp("temperature_f").alias("extreme_temp"),
        *[F.col(f).cast("int").alias(f) for f in C.ROAD_FLAGS],
        C.flag_count(C.ROAD_FLAGS).alias("road_feature_count"), "distance_mi")
