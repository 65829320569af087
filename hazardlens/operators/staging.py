"""Raw -> staging: typed, renamed, defaulted incident rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions import columns as C

# Raw road-flag column -> staged name (Turning_Loop is typed in raw but not staged).
RAW_ROAD_FLAGS = [
    ("Amenity", "has_amenity"), ("Bump", "has_bump"), ("Crossing", "has_crossing"),
    ("Give_Way", "has_give_way"), ("Junction", "has_junction"), ("No_Exit", "has_no_exit"),
    ("Railway", "has_railway"), ("Roundabout", "has_roundabout"), ("Station", "has_station"),
    ("Stop", "has_stop"), ("Traffic_Calming", "has_traffic_calming"),
    ("Traffic_Signal", "has_traffic_signal"),
]

# Raw weather reading -> (staged name, default when null).
RAW_WEATHER = [
    ("Temperature(F)", "temperature_f", 0.0),
    ("Humidity(%)", "humidity_pct", 0.0),
    ("Pressure(in)", "pressure_in", 0.0),
    ("Visibility(mi)", "visibility_mi", 10.0),
    ("Wind_Speed(mph)", "wind_speed_mph", 0.0),
    ("Precipitation(in)", "precipitation_in", 0.0),
]

PASS_THROUGH_LOCATION = ["Street", "City", "County", "State", "Zipcode", "Country"]


def safe_timestamp(c) -> Column:
    """TRY_CAST to a wall-clock timestamp: unparseable text becomes null.

    Spark 4 runs with ANSI on, where a plain cast raises on bad input.
    """
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("string").try_cast("timestamp_ntz")


def _opt(df: DataFrame, name: str, dtype: str) -> Column:
    """The column if present, else a typed null (the existing-columns path)."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(dtype)


def stage_incidents(raw: DataFrame, keep_weather_nulls: bool = False) -> DataFrame:
    """Staging projection + validity filter.

    Rows whose start time does not parse or lack coordinates are dropped.
    Missing optional columns are produced as null / default so the same
    operator runs on any subset of the raw columns. ``keep_weather_nulls``
    leaves weather readings null (so median imputation can act) instead of
    the reference's 0/10 defaults.
    """
    # Parse once; every temporal field derives from these two columns and
    # the validity filter on start_time is pushed below the projection.
    parsed = (raw
              .withColumn("__start", safe_timestamp(_opt(raw, "Start_Time", "string")))
              .withColumn("__end", safe_timestamp(_opt(raw, "End_Time", "string")))
              .where(F.col("__start").isNotNull()
                     & _opt(raw, "Start_Lat", "double").isNotNull()
                     & _opt(raw, "Start_Lng", "double").isNotNull()))

    st, en = F.col("__start"), F.col("__end")
    hour = F.hour(st)
    dow = C.dow_sunday0(st)
    cols = [
        _opt(raw, "ID", "string").alias("ID"),
        _opt(raw, "Source", "string").alias("Source"),
        _opt(raw, "Severity", "int").cast("int").alias("Severity"),
        st.alias("start_time"),
        en.alias("end_time"),
        F.year(st).alias("year"),
        F.month(st).alias("month"),
        F.dayofmonth(st).alias("day"),
        hour.alias("hour"),
        dow.alias("day_of_week"),
        F.coalesce(dow.isin(0, 6), F.lit(False)).alias("is_weekend"),
        C.staging_time_period(hour).alias("time_period"),
        _opt(raw, "Start_Lat", "double").cast("double").alias("latitude"),
        _opt(raw, "Start_Lng", "double").cast("double").alias("longitude"),
        _opt(raw, "Distance(mi)", "double").cast("double").alias("distance_mi"),
    ]
    cols += [_opt(raw, c, "string").alias(c) for c in PASS_THROUGH_LOCATION]
    for src, dst, default in RAW_WEATHER:
        v = _opt(raw, src, "double").cast("double")
        cols.append((v if keep_weather_nulls else F.coalesce(v, F.lit(default))).alias(dst))
    cols.append(_opt(raw, "Weather_Condition", "string").alias("weather_condition"))
    for src, dst in RAW_ROAD_FLAGS:
        cols.append(F.coalesce(_opt(raw, src, "boolean").cast("boolean"), F.lit(False)).alias(dst))
    sev = _opt(raw, "Severity", "int")
    cols += [
        C.minute_boundaries(st, en).alias("duration_minutes"),
        F.coalesce(sev >= 3, F.lit(False)).alias("is_high_severity"),
    ]
    return parsed.select(*cols)


def point_lookup(staged: DataFrame, severity: int = 3, state=None, limit: int = 1000,
                 state_col: str = "State") -> DataFrame:
    """``Severity = s AND State = x LIMIT n`` with a total order for determinism.

    The equality filters reach the Parquet scan; the limit becomes a
    TakeOrderedAndProject (per-partition top-n, then merge), never a sort of
    the whole table.
    """
    df = staged.where(F.col("Severity") == severity)
    if state is not None:
        df = df.where(F.col(state_col) == state)
    return df.orderBy("ID").limit(limit)
