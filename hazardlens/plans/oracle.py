"""Oracle SQL (DuckDB dialect) for every SQL-expressible catalogue query.

Each statement rebuilds the same fixture from the driver's tables as CTEs
and then states the operator in plain SQL, so the comparison covers the
whole path from the raw tables. Names and types are aligned with the Spark
side (counts BIGINT, date parts INTEGER, measures DOUBLE).
"""

from __future__ import annotations

from hazardlens.functions.columns import (
    API_WEATHER_CONDITIONS, POOR_WEATHER_WORDS, SCORER_WEATHER_KEYWORDS, WEATHER_CODE_CATEGORIES)

INCIDENTS_CTE = """incidents AS (
  SELECT CAST(e.event_id AS VARCHAR) AS "ID", 'events' AS "Source",
    CAST(1 + (e.event_id * 7 + e.user_id) % 4 AS INTEGER) AS "Severity",
    CASE WHEN e.event_id % 97 = 0 THEN 'not-a-date' ELSE CAST(e.ts AS VARCHAR) END AS "Start_Time",
    CASE WHEN e.event_id % 89 = 0 THEN NULL ELSE CAST(e.ts + INTERVAL 1 MINUTE * CAST(floor(e.value) AS INTEGER)
         + INTERVAL 1 SECOND * CAST(e.event_id % 120 AS INTEGER) AS VARCHAR) END AS "End_Time",
    CASE WHEN e.event_id % 101 = 0 THEN NULL
         ELSE CAST(25 + e.user_id % 24 AS DOUBLE) + CAST(e.event_id % 100 AS DOUBLE) / 128 END AS "Start_Lat",
    CAST(-124 + (e.user_id * 7) % 57 AS DOUBLE) + CAST(e.event_id % 50 AS DOUBLE) / 64 AS "Start_Lng",
    CAST(e.event_id % 40 AS DOUBLE) / 8 AS "Distance(mi)",
    c.c_mktsegment AS "City", n.n_name AS "State",
    CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE CAST((e.event_id * 13) % 130 - 10 AS DOUBLE) END AS "Temperature(F)",
    CASE WHEN e.event_id % 13 = 0 THEN NULL ELSE CAST((e.event_id * 3) % 100 AS DOUBLE) END AS "Humidity(%)",
    CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE 29 + CAST(e.event_id % 16 AS DOUBLE) / 8 END AS "Pressure(in)",
    CASE WHEN e.event_id % 19 = 0 THEN NULL ELSE CAST(e.event_id % 21 AS DOUBLE) / 2 END AS "Visibility(mi)",
    CASE WHEN e.event_id % 23 = 0 THEN NULL ELSE CAST(e.event_id % 30 AS DOUBLE) END AS "Wind_Speed(mph)",
    CASE WHEN e.event_id % 5 = 0 THEN CAST(e.event_id % 8 AS DOUBLE) / 4 ELSE NULL END AS "Precipitation(in)",
    CASE e.event_type WHEN 'click' THEN 'Clear' WHEN 'view' THEN 'Light Rain' WHEN 'error' THEN 'Fog'
         WHEN 'signup' THEN 'Light Snow' ELSE NULL END AS "Weather_Condition",
    CASE WHEN e.event_id % 29 = 0 THEN NULL ELSE e.event_id % 3 = 0 END AS "Junction",
    CASE WHEN e.event_id % 31 = 0 THEN NULL ELSE e.event_id % 4 = 0 END AS "Traffic_Signal",
    e.event_id % 6 = 0 AS "Crossing", e.event_id % 7 = 0 AS "Stop"
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

_ST = 'TRY_CAST("Start_Time" AS TIMESTAMP)'

STAGED_CTE = f"""staged AS (
  SELECT "ID", "Source", "Severity",
    {_ST} AS start_time,
    TRY_CAST("End_Time" AS TIMESTAMP) AS end_time,
    CAST(EXTRACT(YEAR FROM {_ST}) AS INTEGER) AS year,
    CAST(EXTRACT(MONTH FROM {_ST}) AS INTEGER) AS month,
    CAST(EXTRACT(DAY FROM {_ST}) AS INTEGER) AS day,
    CAST(EXTRACT(HOUR FROM {_ST}) AS INTEGER) AS hour,
    CAST(EXTRACT(DOW FROM {_ST}) AS INTEGER) AS day_of_week,
    CASE WHEN EXTRACT(DOW FROM {_ST}) IN (0, 6) THEN true ELSE false END AS is_weekend,
    CASE WHEN EXTRACT(HOUR FROM {_ST}) BETWEEN 6 AND 9 THEN 'Morning Rush'
         WHEN EXTRACT(HOUR FROM {_ST}) BETWEEN 10 AND 15 THEN 'Midday'
         WHEN EXTRACT(HOUR FROM {_ST}) BETWEEN 16 AND 19 THEN 'Evening Rush'
         WHEN EXTRACT(HOUR FROM {_ST}) BETWEEN 20 AND 23 THEN 'Evening'
         ELSE 'Night' END AS time_period,
    "Start_Lat" AS latitude, "Start_Lng" AS longitude, "Distance(mi)" AS distance_mi,
    CAST(NULL AS VARCHAR) AS "Street", "City", CAST(NULL AS VARCHAR) AS "County", "State",
    CAST(NULL AS VARCHAR) AS "Zipcode", CAST(NULL AS VARCHAR) AS "Country",
    COALESCE("Temperature(F)", 0) AS temperature_f,
    COALESCE("Humidity(%)", 0) AS humidity_pct,
    COALESCE("Pressure(in)", 0) AS pressure_in,
    COALESCE("Visibility(mi)", 10) AS visibility_mi,
    COALESCE("Wind_Speed(mph)", 0) AS wind_speed_mph,
    COALESCE("Precipitation(in)", 0) AS precipitation_in,
    "Weather_Condition" AS weather_condition,
    false AS has_amenity, false AS has_bump, COALESCE("Crossing", false) AS has_crossing,
    false AS has_give_way, COALESCE("Junction", false) AS has_junction, false AS has_no_exit,
    false AS has_railway, false AS has_roundabout, false AS has_station,
    COALESCE("Stop", false) AS has_stop, false AS has_traffic_calming,
    COALESCE("Traffic_Signal", false) AS has_traffic_signal,
    DATEDIFF('minute', {_ST}, TRY_CAST("End_Time" AS TIMESTAMP)) AS duration_minutes,
    CASE WHEN "Severity" >= 3 THEN true ELSE false END AS is_high_severity
  FROM incidents
  WHERE {_ST} IS NOT NULL AND "Start_Lat" IS NOT NULL AND "Start_Lng" IS NOT NULL)"""

LOCATION_CTE = """location_summary AS (
  SELECT "State", "City", COUNT(*) AS total_accidents, AVG("Severity") AS avg_severity,
    CAST(SUM(CASE WHEN "Severity" >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS high_severity_count,
    AVG(duration_minutes) AS avg_duration_minutes,
    AVG(temperature_f) AS avg_temperature, AVG(visibility_mi) AS avg_visibility,
    CAST(SUM(CASE WHEN has_traffic_signal THEN 1 ELSE 0 END) AS BIGINT) AS accidents_at_signals,
    CAST(SUM(CASE WHEN has_junction THEN 1 ELSE 0 END) AS BIGINT) AS accidents_at_junctions,
    CAST(SUM(CASE WHEN has_crossing THEN 1 ELSE 0 END) AS BIGINT) AS accidents_at_crossings,
    CAST(SUM(CASE WHEN is_weekend THEN 1 ELSE 0 END) AS BIGINT) AS weekend_accidents,
    CAST(SUM(CASE WHEN time_period = 'Morning Rush' THEN 1 ELSE 0 END) AS BIGINT) AS morning_rush_accidents,
    CAST(SUM(CASE WHEN time_period = 'Evening Rush' THEN 1 ELSE 0 END) AS BIGINT) AS evening_rush_accidents
  FROM staged GROUP BY "State", "City" HAVING COUNT(*) >= 10)"""

TEMPORAL_CTE = """temporal_patterns AS (
  SELECT year, month, day_of_week, hour, time_period, is_weekend,
    COUNT(*) AS accident_count, AVG("Severity") AS avg_severity,
    CAST(SUM(CASE WHEN "Severity" >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS high_severity_count,
    AVG(duration_minutes) AS avg_duration, AVG(temperature_f) AS avg_temperature,
    AVG(visibility_mi) AS avg_visibility, AVG(precipitation_in) AS avg_precipitation
  FROM staged GROUP BY year, month, day_of_week, hour, time_period, is_weekend)"""

WEATHER_CTE = """weather_impact AS (
  SELECT COALESCE(weather_condition, 'Unknown') AS weather_condition,
    COUNT(*) AS accident_count, AVG("Severity") AS avg_severity,
    CAST(SUM(CASE WHEN "Severity" >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS high_severity_count,
    AVG(visibility_mi) AS avg_visibility, AVG(temperature_f) AS avg_temperature,
    AVG(wind_speed_mph) AS avg_wind_speed, AVG(precipitation_in) AS avg_precipitation,
    AVG(duration_minutes) AS avg_duration
  FROM staged GROUP BY staged.weather_condition HAVING COUNT(*) >= 100)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


BASE = (INCIDENTS_CTE, STAGED_CTE)

ORACLE: dict[str, str] = {}

# Row-level outputs carry a nullable integer; it is compared as DOUBLE so a
# missing end time is NaN on both sides rather than NA vs NaN.
ROW_COLS = 'SELECT * REPLACE (CAST(duration_minutes AS DOUBLE) AS duration_minutes)'

ORACLE["staging_incidents"] = with_ctes(*BASE, body=f"{ROW_COLS} FROM staged")

ORACLE["point_lookup"] = with_ctes(INCIDENTS_CTE, body="""
SELECT * REPLACE (CAST("Junction" AS VARCHAR) AS "Junction", CAST("Traffic_Signal" AS VARCHAR) AS "Traffic_Signal")
FROM incidents WHERE "Severity" = 3 AND "State" = 'NATION_1' ORDER BY "ID" LIMIT 1000""")

ORACLE["location_summary"] = with_ctes(*BASE, LOCATION_CTE, body="SELECT * FROM location_summary")

ORACLE["temporal_patterns"] = with_ctes(*BASE, TEMPORAL_CTE, body="SELECT * FROM temporal_patterns")

ORACLE["weather_impact"] = with_ctes(*BASE, WEATHER_CTE, body="SELECT * FROM weather_impact")

ORACLE["top_risk_locations"] = with_ctes(*BASE, LOCATION_CTE, body="""
SELECT "State", "City", total_accidents, high_severity_count,
  ROUND(avg_severity, 2) AS avg_severity,
  ROUND(CAST(high_severity_count AS DOUBLE) * 100.0 / total_accidents, 2) AS high_severity_rate,
  ROUND(avg_duration_minutes, 1) AS avg_duration_minutes,
  accidents_at_signals, accidents_at_junctions, morning_rush_accidents, evening_rush_accidents
FROM location_summary WHERE total_accidents >= 100""")

ORACLE["hourly_risk_profile"] = with_ctes(*BASE, TEMPORAL_CTE, body="""
SELECT hour, CAST(SUM(accident_count) AS BIGINT) AS total_accidents,
  ROUND(AVG(avg_severity), 2) AS avg_severity,
  CAST(SUM(high_severity_count) AS BIGINT) AS high_severity_count,
  ROUND(AVG(avg_temperature), 1) AS avg_temperature,
  ROUND(AVG(avg_visibility), 1) AS avg_visibility
FROM temporal_patterns GROUP BY hour""")

ORACLE["day_of_week_analysis"] = with_ctes(*BASE, TEMPORAL_CTE, body="""
SELECT day_of_week,
  CASE day_of_week WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday'
    WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' WHEN 6 THEN 'Saturday' END AS day_name,
  is_weekend, CAST(SUM(accident_count) AS BIGINT) AS total_accidents,
  ROUND(AVG(avg_severity), 2) AS avg_severity,
  CAST(SUM(high_severity_count) AS BIGINT) AS high_severity_count
FROM temporal_patterns GROUP BY day_of_week, is_weekend""")

ORACLE["weather_risk_ranking"] = with_ctes(*BASE, WEATHER_CTE, body="""
SELECT weather_condition, accident_count, high_severity_count,
  ROUND(avg_severity, 2) AS avg_severity,
  ROUND(CAST(high_severity_count AS DOUBLE) * 100.0 / accident_count, 2) AS high_severity_rate,
  ROUND(avg_visibility, 1) AS avg_visibility, ROUND(avg_temperature, 1) AS avg_temperature,
  ROUND(avg_wind_speed, 1) AS avg_wind_speed, ROUND(avg_precipitation, 2) AS avg_precipitation
FROM weather_impact""")

ORACLE["top_weather_by_rate"] = with_ctes(*BASE, WEATHER_CTE, body="""
SELECT weather_condition, accident_count,
  ROUND(CAST(high_severity_count AS DOUBLE) * 100.0 / accident_count, 2) AS high_severity_rate
FROM weather_impact WHERE accident_count >= 1000
ORDER BY high_severity_rate DESC, weather_condition LIMIT 5""")

ORACLE["state_summary"] = with_ctes(*BASE, LOCATION_CTE, body="""
SELECT "State", CAST(SUM(total_accidents) AS BIGINT) AS total_accidents,
  COUNT(DISTINCT "City") AS cities_affected, ROUND(AVG(avg_severity), 2) AS avg_severity,
  CAST(SUM(high_severity_count) AS BIGINT) AS high_severity_count,
  CAST(SUM(accidents_at_signals) AS BIGINT) AS total_signal_accidents,
  CAST(SUM(accidents_at_junctions) AS BIGINT) AS total_junction_accidents
FROM location_summary GROUP BY "State\"""")

ORACLE["rush_hour_impact"] = with_ctes(*BASE, TEMPORAL_CTE, body="""
SELECT time_period, CAST(SUM(accident_count) AS BIGINT) AS total_accidents,
  ROUND(AVG(avg_severity), 2) AS avg_severity,
  CAST(SUM(high_severity_count) AS BIGINT) AS high_severity_count,
  ROUND(CAST(SUM(high_severity_count) AS DOUBLE) * 100.0 / SUM(accident_count), 2) AS high_severity_rate
FROM temporal_patterns GROUP BY time_period""")

ORACLE["high_risk_segments"] = with_ctes(*BASE, body="""
SELECT "State", "City", time_period, COUNT(*) AS accident_count,
  ROUND(AVG("Severity"), 2) AS avg_severity,
  CAST(SUM(CASE WHEN is_high_severity THEN 1 ELSE 0 END) AS BIGINT) AS high_severity_count,
  CAST(SUM(CASE WHEN has_traffic_signal THEN 1 ELSE 0 END) AS BIGINT) AS signal_accidents,
  CAST(SUM(CASE WHEN has_junction THEN 1 ELSE 0 END) AS BIGINT) AS junction_accidents,
  ROUND(AVG(visibility_mi), 1) AS avg_visibility
FROM staged WHERE "Severity" >= 2
GROUP BY "State", "City", time_period HAVING COUNT(*) >= 50""")

ORACLE["severity_distribution"] = with_ctes(INCIDENTS_CTE, body="""
SELECT "Severity" AS value, COUNT(*) AS n,
  ROUND(CAST(COUNT(*) AS DOUBLE) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS pct
FROM incidents GROUP BY "Severity\"""")

ORACLE["top_states"] = with_ctes(INCIDENTS_CTE, body="""
SELECT value, n, pct FROM (
  SELECT "State" AS value, COUNT(*) AS n,
    CAST(COUNT(*) AS DOUBLE) * 100.0 / SUM(COUNT(*)) OVER () AS pct
  FROM incidents GROUP BY "State") t
ORDER BY n DESC, value LIMIT 10""")

ORACLE["time_part_counts"] = with_ctes(*BASE, body="""
SELECT part, value, COUNT(*) AS n FROM (
  SELECT 'hour' AS part, CAST(EXTRACT(HOUR FROM start_time) AS INTEGER) AS value FROM staged
  UNION ALL SELECT 'weekday', CAST(ISODOW(start_time) - 1 AS INTEGER) FROM staged
  UNION ALL SELECT 'month', CAST(EXTRACT(MONTH FROM start_time) AS INTEGER) FROM staged
  UNION ALL SELECT 'year', CAST(EXTRACT(YEAR FROM start_time) AS INTEGER) FROM staged) t
GROUP BY part, value""")

ORACLE["coverage_kpis"] = with_ctes(*BASE, body="""
SELECT COUNT(*) AS total_accidents, COUNT(DISTINCT "State") AS states_covered,
  COUNT(DISTINCT "City") AS cities_covered,
  strftime(MIN(start_time), '%Y-%m-%d') AS first_date, strftime(MAX(start_time), '%Y-%m-%d') AS last_date
FROM staged""")

ORACLE["city_centroids"] = with_ctes(*BASE, body="""
SELECT "State", "City", ROUND(AVG(latitude), 4) AS avg_lat, ROUND(AVG(longitude), 4) AS avg_lng,
  COUNT(*) AS n
FROM staged WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY "State", "City\"""")

_NUMERIC_COLS = ["temperature_f", "humidity_pct", "visibility_mi", "distance_mi", "duration_minutes"]

ORACLE["numeric_summary"] = with_ctes(*BASE, body="\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG(CAST({c} AS DOUBLE)), 6) AS mean,
  ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 6) AS std, MIN(CAST({c} AS DOUBLE)) AS min,
  QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25) AS p25, QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5) AS p50,
  QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75) AS p75, MAX(CAST({c} AS DOUBLE)) AS max FROM staged"""
    for c in _NUMERIC_COLS))

ORACLE["hour_dow_matrix"] = with_ctes(*BASE, body="SELECT day_of_week, " + ", ".join(
    f"CAST(COUNT(*) FILTER (WHERE hour = {h}) AS BIGINT) AS h{h:02d}" for h in range(24))
    + " FROM staged GROUP BY day_of_week")

ORACLE["relative_weather_risk"] = with_ctes(*BASE, body="""
SELECT category, n, high_severity_count, rate,
  rate / MAX(CASE WHEN category = 'Clear' THEN rate END) OVER () AS relative_risk
FROM (SELECT weather_condition AS category, COUNT(*) AS n,
        CAST(SUM(CASE WHEN is_high_severity THEN 1 ELSE 0 END) AS BIGINT) AS high_severity_count,
        CAST(SUM(CASE WHEN is_high_severity THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS rate
      FROM staged GROUP BY weather_condition) t""")

ORACLE["grid_density"] = with_ctes(*BASE, body="""
SELECT ROUND(latitude, 2) AS lat_cell, ROUND(longitude, 2) AS lon_cell, COUNT(*) AS n,
  AVG("Severity") AS avg_severity,
  CAST(SUM(CASE WHEN is_high_severity THEN 1 ELSE 0 END) AS BIGINT) AS high_severity_count,
  CAST(SUM(CASE WHEN has_junction THEN 1 ELSE 0 END) AS BIGINT) AS junction_count,
  CAST(SUM(CASE WHEN has_crossing THEN 1 ELSE 0 END) AS BIGINT) AS crossing_count
FROM staged WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2""")

_ROAD_FLAGS = ["has_amenity", "has_bump", "has_crossing", "has_give_way", "has_junction",
               "has_no_exit", "has_railway", "has_roundabout", "has_station", "has_stop",
               "has_traffic_calming", "has_traffic_signal"]

ORACLE["road_feature_lift"] = with_ctes(*BASE, body="""
SELECT feature, n_with, high_with, n_without, high_without,
  CAST(high_with AS DOUBLE) / NULLIF(n_with, 0) AS rate_with,
  CAST(high_without AS DOUBLE) / NULLIF(n_without, 0) AS rate_without,
  (CAST(high_with AS DOUBLE) / NULLIF(n_with, 0)) / NULLIF(CAST(high_without AS DOUBLE) / NULLIF(n_without, 0), 0) AS lift
FROM (""" + "\nUNION ALL\n".join(
    f"""SELECT '{f}' AS feature,
  CAST(SUM(CASE WHEN {f} THEN 1 ELSE 0 END) AS BIGINT) AS n_with,
  CAST(SUM(CASE WHEN {f} AND is_high_severity THEN 1 ELSE 0 END) AS BIGINT) AS high_with,
  CAST(SUM(CASE WHEN NOT {f} THEN 1 ELSE 0 END) AS BIGINT) AS n_without,
  CAST(SUM(CASE WHEN NOT {f} AND is_high_severity THEN 1 ELSE 0 END) AS BIGINT) AS high_without
FROM staged""" for f in _ROAD_FLAGS) + ") t")

ORACLE["explorer_filter"] = with_ctes(*BASE, body=ROW_COLS + """
FROM staged WHERE "Severity" = 3 AND (hour >= 22 OR hour < 6)
  AND lower(weather_condition) LIKE '%fog%' AND year = 2024""")

ORACLE["random_sample"] = with_ctes(*BASE, body="""
SELECT "ID", latitude, longitude, "Severity" FROM staged
ORDER BY md5(CAST("ID" AS VARCHAR) || ':' || '42'), "ID" LIMIT 500""")

ORACLE["cities_per_state"] = with_ctes(*BASE, body="""
SELECT CAST(state_rank AS INTEGER) AS state_rank, "State", CAST(city_rank AS INTEGER) AS city_rank, "City" FROM (
  SELECT p."State", p."City", s.state_rank,
    ROW_NUMBER() OVER (PARTITION BY p."State" ORDER BY p."City" ASC NULLS LAST) AS city_rank
  FROM (SELECT DISTINCT "State", "City" FROM staged) p
  JOIN (SELECT "State", DENSE_RANK() OVER (ORDER BY "State" ASC NULLS LAST) AS state_rank
        FROM (SELECT DISTINCT "State" FROM staged) d) s
    ON p."State" IS NOT DISTINCT FROM s."State"
  WHERE s.state_rank <= 15) t
WHERE city_rank <= 50""")


# --- data quality -----------------------------------------------------------

INCIDENT_COLUMNS = ["ID", "Source", "Severity", "Start_Time", "End_Time", "Start_Lat", "Start_Lng",
                    "Distance(mi)", "City", "State", "Temperature(F)", "Humidity(%)", "Pressure(in)",
                    "Visibility(mi)", "Wind_Speed(mph)", "Precipitation(in)", "Weather_Condition",
                    "Junction", "Traffic_Signal", "Crossing", "Stop"]
CRITICAL = ["ID", "Severity", "Start_Time", "Start_Lat", "Start_Lng"]


def _null_rows(cols):
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(COUNT(*) - COUNT("{c}") AS BIGINT) AS null_count,
  CAST(COUNT(*) - COUNT("{c}") AS DOUBLE) * 100.0 / CAST(COUNT(*) AS DOUBLE) AS null_pct FROM incidents"""
        for c in cols)


ORACLE["null_profile"] = with_ctes(INCIDENTS_CTE, body=f"""
SELECT * FROM ({_null_rows(INCIDENT_COLUMNS)}) t WHERE null_count > 0""")

ORACLE["critical_nulls"] = with_ctes(INCIDENTS_CTE, body=_null_rows(CRITICAL))

_BAD_SEV = '"Severity" IS NULL OR "Severity" NOT IN (1, 2, 3, 4)'

_ROW = 'CAST("ID" AS BIGINT)'
DIRTY_CTE = f"""clean AS (SELECT * FROM incidents),
dirty AS (
  SELECT * REPLACE (
    CASE WHEN {_ROW} % 401 = 0 THEN NULL WHEN {_ROW} % 307 = 0 THEN CAST({_ROW} - 1 AS VARCHAR) ELSE "ID" END AS "ID",
    CASE WHEN {_ROW} % 103 = 0 THEN NULL WHEN {_ROW} % 109 = 0 THEN 5 WHEN {_ROW} % 113 = 0 THEN 0 ELSE "Severity" END AS "Severity",
    CASE WHEN {_ROW} % 127 = 0 THEN 60.0E0 ELSE "Start_Lat" END AS "Start_Lat",
    CASE WHEN {_ROW} % 131 = 0 THEN -20.0E0 ELSE "Start_Lng" END AS "Start_Lng",
    CASE WHEN {_ROW} % 137 = 0 THEN NULL WHEN {_ROW} % 139 = 0 THEN '2031-05-06 07:08:09' ELSE "Start_Time" END AS "Start_Time")
  FROM clean)"""

ORACLE["value_set_check"] = with_ctes(INCIDENTS_CTE, DIRTY_CTE, body=f"""
SELECT 'Severity' AS "column", CAST(SUM(CASE WHEN {_BAD_SEV} THEN 1 ELSE 0 END) AS BIGINT) AS invalid_count,
  COUNT(DISTINCT CASE WHEN {_BAD_SEV} THEN "Severity" END) AS distinct_invalid_values,
  COUNT(*) AS rows_checked FROM dirty""")

ORACLE["range_check"] = with_ctes(INCIDENTS_CTE, DIRTY_CTE, body="""
SELECT CAST(SUM(CASE WHEN "Start_Lat" < 24 OR "Start_Lat" > 50 THEN 1 ELSE 0 END) AS BIGINT) AS lat_out_of_range,
  CAST(SUM(CASE WHEN "Start_Lng" < -130 OR "Start_Lng" > -60 THEN 1 ELSE 0 END) AS BIGINT) AS lng_out_of_range,
  COUNT(*) AS rows_checked FROM dirty""")

ORACLE["duplicate_keys"] = with_ctes(INCIDENTS_CTE, DIRTY_CTE, body="""
SELECT COUNT(*) AS duplicate_keys, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT "ID", COUNT(*) AS n FROM dirty GROUP BY "ID" HAVING COUNT(*) > 1) d""")

_TS = 'TRY_CAST("Start_Time" AS TIMESTAMP)'
_ASOF = "TIMESTAMP '2026-01-01 00:00:00'"

ORACLE["date_check"] = with_ctes(INCIDENTS_CTE, DIRTY_CTE, body=f"""
SELECT CAST(SUM(CASE WHEN {_TS} IS NULL AND "Start_Time" IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS unparseable,
  CAST(SUM(CASE WHEN "Start_Time" IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
  MIN({_TS}) AS min_time, MAX({_TS}) AS max_time,
  CAST(SUM(CASE WHEN {_TS} > {_ASOF} THEN 1 ELSE 0 END) AS BIGINT) AS future_rows
FROM dirty""")

ORACLE["quality_report"] = with_ctes(INCIDENTS_CTE, DIRTY_CTE, body="SELECT *, issue_count = 0 AS passed FROM (\n" + "\nUNION ALL\n".join(
    [f"""SELECT 'nulls:{c}' AS "check", CAST(COUNT(*) - COUNT("{c}") AS BIGINT) AS issue_count FROM dirty"""
     for c in CRITICAL]
    + [f"""SELECT 'severity_range', CAST(SUM(CASE WHEN {_BAD_SEV} THEN 1 ELSE 0 END) AS BIGINT) FROM dirty""",
       """SELECT 'latitude_range', CAST(SUM(CASE WHEN "Start_Lat" < 24 OR "Start_Lat" > 50 THEN 1 ELSE 0 END) AS BIGINT) FROM dirty""",
       """SELECT 'longitude_range', CAST(SUM(CASE WHEN "Start_Lng" < -130 OR "Start_Lng" > -60 THEN 1 ELSE 0 END) AS BIGINT) FROM dirty""",
       """SELECT 'duplicate_ids', CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM dirty GROUP BY "ID" HAVING COUNT(*) > 1) d""",
       f"""SELECT 'future_dates', CAST(SUM(CASE WHEN {_TS} > {_ASOF} THEN 1 ELSE 0 END) AS BIGINT) FROM dirty""",
       """SELECT 'required_columns', CAST(0 AS BIGINT)"""]) + ") t")

# --- features -----------------------------------------------------------------

_FLAGS = _ROAD_FLAGS
_NUM = ["temperature_f", "humidity_pct", "pressure_in", "visibility_mi", "wind_speed_mph",
        "precipitation_in", "distance_mi", "duration_minutes", "latitude", "longitude"]
_CAT = ["state", "city", "weather_condition", "time_period"]
_TMP = ["hour", "day_of_week", "month", "year"]
_SRC = (["accident_id", "hour", "day_of_week", "is_weekend", "time_period", "month", "year", "state",
         "city", "latitude", "longitude", "temperature_f", "humidity_pct", "pressure_in",
         "visibility_mi", "wind_speed_mph", "precipitation_in", "weather_condition"]
        + _FLAGS + ["distance_mi", "duration_minutes", "is_high_severity"])

SOURCE_CTE = """src AS (
  SELECT "ID" AS accident_id, hour, day_of_week, is_weekend, time_period, month, year,
    "State" AS state, "City" AS city, latitude, longitude, temperature_f, humidity_pct, pressure_in,
    visibility_mi, wind_speed_mph, precipitation_in, weather_condition, """ + ", ".join(_FLAGS) + """,
    distance_mi, duration_minutes, is_high_severity
  FROM staged WHERE is_high_severity IS NOT NULL)"""


def _mode_sql(c, default="NULL"):
    return (f"COALESCE((SELECT {c} FROM src WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY COUNT(*) DESC, {c} LIMIT 1), {default})")


def _imputed_select():
    out = []
    for c in _SRC:
        if c in _NUM:
            out.append(f"COALESCE(CAST({c} AS DOUBLE), (SELECT MEDIAN(CAST({c} AS DOUBLE)) FROM src)) AS {c}")
        elif c in _CAT:
            out.append(f"COALESCE({c}, {_mode_sql(c, chr(39) + 'Unknown' + chr(39))}) AS {c}")
        elif c in _TMP:
            out.append(f"COALESCE({c}, {_mode_sql(c)}) AS {c}")
        elif c.startswith("has_") or c == "is_weekend":
            out.append(f"COALESCE({c}, false) AS {c}")
        else:
            out.append(c)
    return ",\n    ".join(out)


IMPUTED_CTE = f"""imputed AS (
  SELECT {_imputed_select()}
  FROM src)"""

ENCODED_CTE = """state_codes AS (
  SELECT value, CAST(DENSE_RANK() OVER (ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT COALESCE(CAST(state AS VARCHAR), 'None') AS value FROM imputed) d),
weather_codes AS (
  SELECT value, CAST(DENSE_RANK() OVER (ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT COALESCE(CAST(weather_condition AS VARCHAR), 'None') AS value FROM imputed) d),
city_codes AS (
  SELECT value, n, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, value) - 1 AS INTEGER) AS code
  FROM (SELECT city AS value, COUNT(*) AS n FROM imputed GROUP BY city) d),
encoded AS (
  SELECT i.*, s.code AS state_encoded, c.code AS city_encoded, w.code AS weather_encoded,
    CAST(CASE i.time_period WHEN 'Night' THEN 0 WHEN 'Morning' THEN 1 WHEN 'Afternoon' THEN 2
         WHEN 'Evening' THEN 3 ELSE 0 END AS INTEGER) AS time_period_encoded
  FROM imputed i
  LEFT JOIN state_codes s ON COALESCE(CAST(i.state AS VARCHAR), 'None') = s.value
  LEFT JOIN city_codes c ON i.city = c.value
  LEFT JOIN weather_codes w ON COALESCE(CAST(i.weather_condition AS VARCHAR), 'None') = w.value)"""

FEATURES_BODY = """SELECT accident_id, hour, day_of_week, CAST(is_weekend AS INTEGER) AS is_weekend, month,
  time_period_encoded,
  CASE WHEN hour BETWEEN 7 AND 9 OR hour BETWEEN 16 AND 19 THEN 1 ELSE 0 END AS is_rush_hour,
  state_encoded, city_encoded, latitude, longitude, temperature_f, humidity_pct, pressure_in,
  visibility_mi, wind_speed_mph, precipitation_in, weather_encoded,
  CASE WHEN visibility_mi < 5 OR precipitation_in > 0 THEN 1 ELSE 0 END AS poor_weather,
  CASE WHEN temperature_f < 32 OR temperature_f > 95 THEN 1 ELSE 0 END AS extreme_temp,
  """ + ", ".join(f"CAST({f} AS INTEGER) AS {f}" for f in _FLAGS) + """,
  CAST(""" + " + ".join(f"CAST({f} AS INTEGER)" for f in _FLAGS) + """ AS INTEGER) AS road_feature_count,
  distance_mi, CAST(is_high_severity AS INTEGER) AS is_high_severity
FROM encoded"""

FEAT = (*BASE, SOURCE_CTE, IMPUTED_CTE)

ORACLE["imputed_features"] = with_ctes(*FEAT, body="SELECT * FROM imputed")

ORACLE["label_encoding"] = with_ctes(*FEAT, ENCODED_CTE, body="""
SELECT 'state' AS "column", value, code FROM state_codes
UNION ALL SELECT 'weather_condition', value, code FROM weather_codes""")

ORACLE["frequency_encoding"] = with_ctes(*FEAT, ENCODED_CTE, body="SELECT value, n, code FROM city_codes")

ORACLE["feature_table"] = with_ctes(*FEAT, ENCODED_CTE, body=FEATURES_BODY)

ORACLE["hash_split"] = with_ctes(*BASE, body="""
SELECT "ID" AS accident_id,
  CASE WHEN CAST('0x' || substr(md5(CAST("ID" AS VARCHAR) || ':' || '42'), 1, 8) AS BIGINT) % 100 < 80
       THEN 'train' ELSE 'test' END AS split
FROM staged""")

ORACLE["class_balance"] = with_ctes(*BASE, SOURCE_CTE, body="""
SELECT CAST(SUM(CASE WHEN CAST(is_high_severity AS INTEGER) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
  CAST(SUM(CASE WHEN CAST(is_high_severity AS INTEGER) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
  CAST(SUM(CASE WHEN CAST(is_high_severity AS INTEGER) = 0 THEN 1 ELSE 0 END) AS DOUBLE)
    / CAST(SUM(CASE WHEN CAST(is_high_severity AS INTEGER) = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS scale_pos_weight
FROM src""")

# --- rule scores and evaluation ----------------------------------------------

RULE_POINTS = """(35 + CASE WHEN visibility_mi < 5 THEN 15 ELSE 0 END
     + CASE WHEN precipitation_in > 0 THEN 12 ELSE 0 END
     + CASE WHEN weather_condition IN ('Fog', 'Snow', 'Thunderstorm') THEN 18 ELSE 0 END
     + CASE WHEN has_junction THEN 8 ELSE 0 END + CASE WHEN has_crossing THEN 5 ELSE 0 END
     + CASE WHEN hour BETWEEN 7 AND 9 OR hour BETWEEN 16 AND 19 THEN 10 ELSE 0 END
     + CASE WHEN is_weekend AND hour >= 20 THEN 8 ELSE 0 END)"""

SCORED_CTE = f"""scored AS (
  SELECT "ID", is_high_severity,
    CAST(LEAST(GREATEST({RULE_POINTS}, 5), 95) AS DOUBLE) / 100.0 AS risk_score
  FROM staged)"""

SCORE_TABLE_CTE = """st AS (
  SELECT risk_score AS score,
    CAST(SUM(CASE WHEN CAST(is_high_severity AS INTEGER) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
    CAST(SUM(CASE WHEN CAST(is_high_severity AS INTEGER) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg
  FROM scored GROUP BY risk_score),
cc AS (
  SELECT CAST(SUM(CASE WHEN score > 0.5 THEN pos ELSE 0 END) AS BIGINT) AS tp,
    CAST(SUM(CASE WHEN score > 0.5 THEN neg ELSE 0 END) AS BIGINT) AS fp,
    CAST(SUM(CASE WHEN NOT score > 0.5 THEN neg ELSE 0 END) AS BIGINT) AS tn,
    CAST(SUM(CASE WHEN NOT score > 0.5 THEN pos ELSE 0 END) AS BIGINT) AS fn
  FROM st)"""

SCORING = (*BASE, SCORED_CTE)

ORACLE["rule_scores"] = with_ctes(*SCORING, body="""
SELECT "ID", risk_score,
  CASE WHEN risk_score < 0.3 THEN 'LOW' WHEN risk_score < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
  ROUND(ABS(risk_score - 0.5) * 2, 4) AS confidence,
  ROUND(100 - risk_score * 100, 1) AS safety_score
FROM scored""")


def _d(e):
    return f"COALESCE(CAST({e.split('/')[0]} AS DOUBLE) / NULLIF(CAST({e.split('/')[1]} AS DOUBLE), 0), 0.0)"


ORACLE["eval_metrics"] = with_ctes(*SCORING, SCORE_TABLE_CTE, body=f"""
SELECT acc AS accuracy, p AS precision, r AS recall,
  CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1,
  n AS test_samples, tp + fn AS positive_samples, tn + fp AS negative_samples,
  tp + fp AS predicted_positive, tn + fn AS predicted_negative,
  (SELECT SUM(c) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) FROM (
     SELECT pos, neg, CAST(pos AS DOUBLE) * (CAST(COALESCE(SUM(neg) OVER (ORDER BY score
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) + neg * 0.5) AS c FROM st) a) AS roc_auc
FROM (SELECT *, tp + fp + tn + fn AS n,
        {_d('(tp + tn)/(tp + fp + tn + fn)')} AS acc,
        {_d('tp/(tp + fp)')} AS p, {_d('tp/(tp + fn)')} AS r FROM cc) m""")

ORACLE["confusion_matrix"] = with_ctes(*SCORING, SCORE_TABLE_CTE, body="""
SELECT 1 AS label, 1 AS prediction, tp AS n FROM cc UNION ALL SELECT 0, 1, fp FROM cc
UNION ALL SELECT 0, 0, tn FROM cc UNION ALL SELECT 1, 0, fn FROM cc""")

ORACLE["class_report"] = with_ctes(*SCORING, SCORE_TABLE_CTE, body=f"""
, k AS (SELECT {_d('tn/(tn + fn)')} AS p0, {_d('tn/(tn + fp)')} AS r0, tn + fp AS s0,
          {_d('tp/(tp + fp)')} AS p1, {_d('tp/(tp + fn)')} AS r1, tp + fn AS s1 FROM cc),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
        CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1,
        CAST(s0 + s1 AS DOUBLE) AS tot FROM k)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM f
UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / tot, (r0 * s0 + r1 * s1) / tot,
  (f0 * s0 + f1 * s1) / tot, s0 + s1 FROM f""".replace("WITH", "WITH", 1))

ORACLE["roc_points"] = with_ctes(*SCORING, SCORE_TABLE_CTE, body="""
SELECT score AS threshold,
  CAST(SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
    / SUM(neg) OVER () AS fpr,
  CAST(SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
    / SUM(pos) OVER () AS tpr
FROM st""")


# --- routes -------------------------------------------------------------------

WAYPOINTS_CTE = """wp AS (
  SELECT c_custkey // 5 AS trip_id, c_custkey AS route_id, CAST(s.seq AS INTEGER) AS seq,
    CAST(25 + (c_custkey // 5 + 1) % 24 AS DOUBLE) + CAST(s.seq AS DOUBLE) / 128
      + CASE c_custkey % 5 WHEN 1 THEN CAST(1 AS DOUBLE) / 512 WHEN 2 THEN 0.125E0
             WHEN 3 THEN CAST(50 AS DOUBLE) / 128 WHEN 4 THEN 0.25E0 ELSE 0E0 END AS lat,
    CAST(-124 + ((c_custkey // 5 + 1) * 7) % 57 AS DOUBLE) + CAST(s.seq AS DOUBLE) / 64 AS lon
  FROM customer, range(0, 60) s(seq))"""

# Routes along the weather corridor.
CORRIDOR_CTE = """wp AS (
  SELECT c_custkey - c_custkey % 3 AS trip_id, c_custkey AS route_id, CAST(s.seq AS INTEGER) AS seq,
    33.5E0 + CAST(s.seq AS DOUBLE) / 128
      + CASE c_custkey % 3 WHEN 0 THEN 0.125E0 WHEN 1 THEN 0E0 ELSE CAST(1 AS DOUBLE) / 512 END AS lat,
    -112E0 + CAST((s.seq * 5) % 7 AS DOUBLE) / 256 AS lon
  FROM customer, range(0, 60) s(seq))"""

# What each trip asks for.
ASKED_CTE = """asked AS (
  SELECT DISTINCT c_custkey // 5 AS trip_id, (5 + (c_custkey // 5) % 7) % 7 AS dow,
    CASE (c_custkey // 5) % 3 WHEN 0 THEN 6 WHEN 1 THEN 9 ELSE 18 END AS earliest,
    CASE (c_custkey // 5) % 3 WHEN 1 THEN 15 ELSE 21 END AS latest,
    CASE (c_custkey // 5) % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 ELSE 17 END AS window_from,
    CASE (c_custkey // 5) % 3 WHEN 1 THEN 12 ELSE 8 END AS time1,
    CASE (c_custkey // 5) % 3 WHEN 2 THEN 21 ELSE 17 END AS time2
  FROM customer)"""

# Road flags of past incidents per 0.1 degree cell.
HIST_CTE = """hist AS (
  SELECT floor(latitude * 10.0E0) AS cx, floor(longitude * 10.0E0) AS cy,
    bool_or(has_junction) AS hj, bool_or(has_crossing) AS hc FROM staged GROUP BY 1, 2),
flagged AS (
  SELECT s.*, coalesce(h.hj, false) AS hj, coalesce(h.hc, false) AS hc FROM samples s
  LEFT JOIN hist h ON h.cx = floor(s.lat * 10.0E0) AND h.cy = floor(s.lon * 10.0E0))"""


def haversine_sql(lat1, lon1, lat2, lon2):
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(3959.0E0 * (2 * atan2(sqrt({a}), sqrt(1 - {a}))))"


SEG_CTE = f"""seg AS (
  SELECT w.*, {haversine_sql('p.lat', 'p.lon', 'w.lat', 'w.lon')} AS dist_mi
  FROM wp w LEFT JOIN wp p ON p.route_id = w.route_id AND p.seq = w.seq - 1)"""

SAMPLES_CTE = """walk(trip_id, route_id, seq, lat, lon, acc, kept) AS (
  SELECT trip_id, route_id, seq, lat, lon, CAST(0.0 AS DOUBLE), true FROM seg
  WHERE seq = 0 AND route_id IN (SELECT route_id FROM wp GROUP BY route_id HAVING COUNT(*) >= 2)
  UNION ALL
  SELECT s.trip_id, s.route_id, s.seq, s.lat, s.lon,
    CASE WHEN w.acc + s.dist_mi >= 1.0 THEN CAST(0.0 AS DOUBLE) ELSE w.acc + s.dist_mi END,
    w.acc + s.dist_mi >= 1.0
  FROM walk w JOIN seg s ON s.route_id = w.route_id AND s.seq = w.seq + 1),
kept AS (SELECT trip_id, route_id, seq, lat, lon FROM walk WHERE kept),
lastpt AS (SELECT w.* FROM wp w JOIN (SELECT route_id, MAX(seq) AS m FROM wp GROUP BY route_id) l
           ON w.route_id = l.route_id AND w.seq = l.m),
lastkept AS (SELECT k.* FROM kept k JOIN (SELECT route_id, MAX(seq) AS m FROM kept GROUP BY route_id) l
             ON k.route_id = l.route_id AND k.seq = l.m),
samples0 AS (
  SELECT * FROM kept
  UNION ALL
  SELECT p.trip_id, p.route_id, p.seq, p.lat, p.lon FROM lastpt p JOIN lastkept k ON p.route_id = k.route_id
  WHERE NOT (k.lat = p.lat AND k.lon = p.lon)),
samples AS (
  SELECT trip_id, route_id, CAST(ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS INTEGER)
    AS segment_index, seq, lat, lon FROM samples0)"""


def rule_sql(vis, precip, weather, junction, crossing, hour, weekend):
    pts = (f"(35 + CASE WHEN {vis} < 5 THEN 15 ELSE 0 END + CASE WHEN {precip} > 0 THEN 12 ELSE 0 END"
           f" + CASE WHEN {weather} IN ('Fog', 'Snow', 'Thunderstorm') THEN 18 ELSE 0 END"
           f" + CASE WHEN {junction} THEN 8 ELSE 0 END + CASE WHEN {crossing} THEN 5 ELSE 0 END"
           f" + CASE WHEN {hour} BETWEEN 7 AND 9 OR {hour} BETWEEN 16 AND 19 THEN 10 ELSE 0 END"
           f" + CASE WHEN ({weekend}) AND {hour} >= 20 THEN 8 ELSE 0 END)")
    return f"(CAST(LEAST(GREATEST({pts}, 5), 95) AS DOUBLE) / 100.0)"


def level4_sql(p, moderate="MODERATE"):
    return (f"CASE WHEN {p} < 0.3 THEN 'LOW' WHEN {p} < 0.5 THEN '{moderate}' "
            f"WHEN {p} < 0.7 THEN 'HIGH' ELSE 'CRITICAL' END")


def hour_label_sql(h):
    return (f"CASE WHEN {h} = 0 THEN '12:00 AM' WHEN {h} < 12 THEN CAST({h} AS VARCHAR) || ':00 AM' "
            f"WHEN {h} = 12 THEN '12:00 PM' ELSE CAST({h} - 12 AS VARCHAR) || ':00 PM' END")


def r_up(x, n):
    return f"(floor(({x}) * {10 ** n}.0 + 0.5) / {10 ** n}.0)"


def segscores_cte(hour, dow, weather="'Clear'", temp="70.0", vis="10.0", name="segscores"):
    score = rule_sql(vis, "0.0", weather, "hj", "hc", str(hour), f"{dow} IN (0, 6)")
    return f"""{HIST_CTE},
{name} AS (
  SELECT s.*, {hour} AS hour, {dow} AS day_of_week, {score} AS risk_score FROM flagged s),
{name}_l AS (
  SELECT *, {level4_sql('risk_score')} AS risk_level, GREATEST(risk_score, 1 - risk_score) AS confidence
  FROM {name})"""


ROUTE_BASE = (WAYPOINTS_CTE, SEG_CTE, SAMPLES_CTE)
RISK_BASE = (*BASE, *ROUTE_BASE)


def with_rec(*ctes, body):
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


ORACLE["waypoint_distance"] = with_ctes(WAYPOINTS_CTE, SEG_CTE, body="""
SELECT trip_id, route_id, COUNT(*) AS n_points, ROUND(SUM(dist_mi), 6) AS total_miles
FROM seg GROUP BY trip_id, route_id""")

ORACLE["waypoint_sampling"] = with_rec(*ROUTE_BASE, body="SELECT * FROM samples")

ROUTE_RISK_BODY = """
SELECT r.trip_id, r.route_id, COALESCE(ROUND(a.overall_risk, 6), 0.0) AS overall_risk,
  COALESCE(a.max_risk, 0.0) AS max_risk, COALESCE(a.min_risk, 0.0) AS min_risk,
  COALESCE(ROUND(100 - a.overall_risk * 100, 6), 100.0) AS safety_score,
  COALESCE(a.segments_scored, 0) AS segments_scored, COALESCE(a.danger_zones, 0) AS danger_zones,
  a.first_danger_level
FROM (SELECT DISTINCT trip_id, route_id FROM wp) r LEFT JOIN (
  SELECT trip_id, route_id, AVG(risk_score) AS overall_risk, MAX(risk_score) AS max_risk,
    MIN(risk_score) AS min_risk, COUNT(*) AS segments_scored,
    COUNT(CASE WHEN risk_score > 0.6 THEN 1 END) AS danger_zones,
    arg_min(CASE WHEN risk_score > 0.6 THEN risk_level END,
            CASE WHEN risk_score > 0.6 THEN segment_index END) AS first_danger_level
  FROM segscores_l GROUP BY trip_id, route_id) a ON a.trip_id = r.trip_id AND a.route_id = r.route_id"""

ORACLE["route_risk"] = with_rec(*RISK_BASE, segscores_cte(17, 5), body=ROUTE_RISK_BODY)

ORACLE["danger_zones"] = with_rec(*RISK_BASE, segscores_cte(17, 5, "'Clear'", "70.0", "3.0"), body=f"""
SELECT trip_id, route_id, segment_index AS segment, {r_up('risk_score', 3)} AS risk,
  printf('(%.5f, %.5f)', lat, lon) AS location, risk_level
FROM segscores_l WHERE risk_score > 0.6""")

ORACLE["route_advice"] = with_rec(*RISK_BASE, segscores_cte(17, 5),
                                  "rr AS (" + ROUTE_RISK_BODY + ")", body=f"""
, rk AS (
  SELECT trip_id, route_id, {r_up('overall_risk', 3)} AS risk_score,
    {level4_sql('overall_risk', 'MEDIUM')} AS risk_level, {r_up('safety_score', 1)} AS safety_score,
    {r_up('max_risk', 3)} AS max_risk, {r_up('min_risk', 3)} AS min_risk, segments_scored AS segments_analyzed
  FROM rr),
rk2 AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY safety_score DESC, route_id) AS INTEGER) AS rank,
    MAX(safety_score) OVER (PARTITION BY trip_id) - safety_score AS gap_to_best,
    FIRST(risk_level) OVER (PARTITION BY trip_id ORDER BY safety_score DESC, route_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best_level
  FROM rk)
SELECT trip_id, route_id, risk_score, risk_level, safety_score, max_risk, min_risk, segments_analyzed,
  rank, gap_to_best,
  CASE WHEN best_level = 'UNKNOWN' THEN NULL WHEN rank = 1 THEN 'Recommended - Safest option'
       WHEN gap_to_best > 10 THEN printf('Higher risk - %.1f points less safe', gap_to_best)
       WHEN gap_to_best > 5 THEN 'Slightly higher risk' ELSE 'Similar safety level' END AS recommendation
FROM rk2""")


def hourly_cte(hours):
    hl = ", ".join(str(h) for h in hours)
    score = rule_sql("10.0", "0.0", "'Clear'", "s.hj", "s.hc", "h.hour", "a.dow IN (0, 6)")
    return f"""{HIST_CTE}, {ASKED_CTE},
firsts AS (SELECT trip_id, MIN(route_id) AS route_id FROM wp GROUP BY trip_id),
hsc AS (
  SELECT s.trip_id, s.route_id, s.segment_index, h.hour, {score} AS risk_score
  FROM flagged s JOIN firsts f ON s.trip_id = f.trip_id AND s.route_id = f.route_id JOIN asked a ON a.trip_id = s.trip_id,
       (SELECT CAST(unnest([{hl}]) AS INTEGER) AS hour) h),
hsc_l AS (SELECT *, {level4_sql('risk_score')} AS risk_level FROM hsc),
hourly0 AS (
  SELECT trip_id, route_id, hour, ROUND(AVG(risk_score), 9) AS overall_risk, COUNT(*) AS segments_analyzed,
    COUNT(CASE WHEN risk_score > 0.6 THEN 1 END) AS danger_zones_count,
    arg_min(CASE WHEN risk_score > 0.6 THEN risk_level END,
            CASE WHEN risk_score > 0.6 THEN segment_index END) AS first_level
  FROM hsc_l GROUP BY trip_id, route_id, hour),
hourly AS (
  SELECT trip_id, route_id, hour, {hour_label_sql('hour')} AS time_label,
    {r_up('100 - overall_risk * 100', 1)} AS safety_score, {r_up('overall_risk', 3)} AS risk_score,
    COALESCE(first_level, {level4_sql('overall_risk')}) AS risk_level, segments_analyzed, danger_zones_count,
    list_position([{hl}], hour) AS pos
  FROM hourly0)"""


ORACLE["departure_hours"] = with_rec(*RISK_BASE, hourly_cte([6, 9, 12, 15, 18, 21]), body="""
SELECT trip_id, route_id, hour, time_label, safety_score, risk_score, risk_level, segments_analyzed,
  danger_zones_count FROM hourly JOIN asked USING (trip_id) WHERE hour BETWEEN earliest AND latest""")

ORACLE["departure_times"] = with_rec(*RISK_BASE, hourly_cte([6, 9, 12, 15, 18, 21]), body="""
, b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY safety_score DESC, pos) AS rb,
          ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY safety_score ASC, pos DESC) AS rw
        FROM hourly JOIN asked USING (trip_id) WHERE hour BETWEEN earliest AND latest)
SELECT x.trip_id, x.time_label AS best_time, y.time_label AS worst_time,
  x.safety_score AS best_safety_score, y.safety_score AS worst_safety_score,
  CASE WHEN y.safety_score > 0 THEN floor(((x.safety_score - y.safety_score) / y.safety_score * 100) * 10.0 + 0.5) / 10.0
       ELSE 0.0 END AS improvement_pct
FROM b x JOIN b y ON x.trip_id = y.trip_id AND x.rb = 1 AND y.rw = 1""")

_CLOCK = "printf('%02d:00 %s', CASE WHEN {0} % 12 = 0 THEN 12 ELSE {0} % 12 END, CASE WHEN {0} < 12 THEN 'AM' ELSE 'PM' END)"

ORACLE["compare_times"] = with_rec(*RISK_BASE, hourly_cte([8, 12, 17, 21]), body=f"""
, two AS (
  SELECT h.trip_id, {_CLOCK.format('CAST(a.time1 AS INTEGER)')} AS time1_label, {_CLOCK.format('CAST(a.time2 AS INTEGER)')} AS time2_label,
    MAX(CASE WHEN hour = a.time1 THEN safety_score END) AS time1_safety,
    MAX(CASE WHEN hour = a.time2 THEN safety_score END) AS time2_safety,
    MAX(CASE WHEN hour = a.time1 THEN risk_score END) AS time1_risk,
    MAX(CASE WHEN hour = a.time2 THEN risk_score END) AS time2_risk
  FROM hourly h JOIN asked a ON a.trip_id = h.trip_id GROUP BY h.trip_id, a.time1, a.time2),
c AS (
  SELECT *, CASE WHEN time1_safety > time2_safety THEN 'time1' WHEN time2_safety > time1_safety THEN 'time2' ELSE 'equal' END AS safer,
    {r_up('abs(time1_safety - time2_safety)', 1)} AS safety_difference FROM two)
SELECT *, CASE WHEN safer = 'equal' THEN 'Both departure times have the same safety score (' || CAST(time1_safety AS VARCHAR) || ').'
     ELSE 'Departing at ' || CASE WHEN safer = 'time1' THEN time1_label ELSE time2_label END || ' is safer by '
          || CAST(safety_difference AS VARCHAR) || ' safety points compared to '
          || CASE WHEN safer = 'time1' THEN time2_label ELSE time1_label END || '.' END AS recommendation FROM c""")

ORACLE["best_window"] = with_rec(*RISK_BASE, hourly_cte(list(range(6, 23))), body=f"""
, pairs AS (
  SELECT trip_id, hour, LEAD(hour) OVER (PARTITION BY trip_id ORDER BY hour) AS next_hour,
    (safety_score + LEAD(safety_score) OVER (PARTITION BY trip_id ORDER BY hour)) / 2 AS avg_safety
  FROM hourly JOIN asked USING (trip_id) WHERE hour >= window_from),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY avg_safety DESC, hour) AS r
         FROM pairs WHERE next_hour IS NOT NULL)
SELECT trip_id, {hour_label_sql('hour')} AS window_start, {hour_label_sql('next_hour + 1')} AS window_end,
  hour AS window_start_hour, next_hour + 1 AS window_end_hour, {r_up('avg_safety', 1)} AS avg_safety_score,
  'The safest 2-hour departure window is ' || {hour_label_sql('hour')} || ' \u2013 ' || {hour_label_sql('next_hour + 1')}
    || ' (avg safety score ' || CAST({r_up('avg_safety', 1)} AS VARCHAR) || '/100).' AS recommendation
FROM best WHERE r = 1""")

ORACLE["extreme_segments"] = with_rec(*RISK_BASE, segscores_cte(17, 5), body="""
SELECT trip_id, route_id, segment_index, risk_score,
  CASE WHEN top_rank <= 3 THEN top_rank END AS top_rank,
  CASE WHEN bottom_rank <= 3 THEN bottom_rank END AS bottom_rank FROM (
  SELECT trip_id, route_id, segment_index, risk_score,
    CAST(ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY risk_score DESC, segment_index) AS INTEGER) AS top_rank,
    CAST(ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY risk_score, segment_index) AS INTEGER) AS bottom_rank
  FROM segscores) t WHERE top_rank <= 3 OR bottom_rank <= 3""")

SIG_CTE = """sig0 AS (
  SELECT trip_id, route_id, COUNT(*) AS n, string_agg(CAST(lat AS VARCHAR) || ',' || CAST(lon AS VARCHAR), ';' ORDER BY seq) AS line
  FROM wp GROUP BY trip_id, route_id),
sig AS (
  SELECT s.trip_id, s.route_id, s.line,
    MAX(CASE WHEN w.seq = CAST(floor(s.n * 0.25) AS INTEGER) THEN w.lat END) AS lat_25,
    MAX(CASE WHEN w.seq = CAST(floor(s.n * 0.25) AS INTEGER) THEN w.lon END) AS lon_25,
    MAX(CASE WHEN w.seq = CAST(floor(s.n * 0.5) AS INTEGER) THEN w.lat END) AS lat_50,
    MAX(CASE WHEN w.seq = CAST(floor(s.n * 0.5) AS INTEGER) THEN w.lon END) AS lon_50,
    MAX(CASE WHEN w.seq = CAST(floor(s.n * 0.75) AS INTEGER) THEN w.lat END) AS lat_75,
    MAX(CASE WHEN w.seq = CAST(floor(s.n * 0.75) AS INTEGER) THEN w.lon END) AS lon_75
  FROM sig0 s JOIN wp w ON w.route_id = s.route_id GROUP BY s.trip_id, s.route_id, s.line),
pairs AS (
  SELECT DISTINCT a.trip_id, a.route_id AS route_a, b.route_id AS route_b
  FROM sig a JOIN sig b ON a.trip_id = b.trip_id AND a.route_id < b.route_id
  WHERE a.line = b.line OR (
    sqrt(pow(a.lat_25 - b.lat_25, 2) + pow(a.lon_25 - b.lon_25, 2)) * 111 <= 1.0
    AND sqrt(pow(a.lat_50 - b.lat_50, 2) + pow(a.lon_50 - b.lon_50, 2)) * 111 <= 1.0
    AND sqrt(pow(a.lat_75 - b.lat_75, 2) + pow(a.lon_75 - b.lon_75, 2)) * 111 <= 1.0))"""

ORACLE["similar_routes"] = with_ctes(WAYPOINTS_CTE, SIG_CTE, body="SELECT * FROM pairs")

ORACLE["dedup_routes"] = with_rec(WAYPOINTS_CTE, SIG_CTE, """ordered AS (
  SELECT trip_id, route_id, ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY route_id) AS i FROM sig),
simto AS (SELECT trip_id, route_b AS route_id, list(route_a) AS similar_to FROM pairs GROUP BY trip_id, route_b),
fold(trip_id, i, kept) AS (
  SELECT trip_id, i, [route_id] FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.trip_id, o.i,
    CASE WHEN len(f.kept) < 3 AND NOT list_has_any(f.kept, COALESCE(s.similar_to, CAST([] AS BIGINT[])))
         THEN list_append(f.kept, o.route_id) ELSE f.kept END
  FROM fold f JOIN ordered o ON o.trip_id = f.trip_id AND o.i = f.i + 1
  LEFT JOIN simto s ON s.trip_id = o.trip_id AND s.route_id = o.route_id),
final AS (SELECT f.trip_id, f.kept FROM fold f
          JOIN (SELECT trip_id, MAX(i) AS m FROM ordered GROUP BY trip_id) x ON f.trip_id = x.trip_id AND f.i = x.m)""",
    body="""
SELECT trip_id, CAST(r AS INTEGER) AS route_rank, route_id FROM (
  SELECT trip_id, generate_subscripts(kept, 1) AS r, unnest(kept) AS route_id FROM final) t
WHERE r <= 3""")


# --- enrichment -----------------------------------------------------------------


OBS_CTE = """obs AS (
  SELECT event_id AS obs_id, 33.5E0 + CAST(user_id % 60 AS DOUBLE) / 128 AS lat,
    -112E0 + CAST(((user_id % 60) * 5) % 7 AS DOUBLE) / 256 AS lon, ts AS obs_ts,
    CAST(CASE event_type WHEN 'click' THEN 800 WHEN 'view' THEN 501 WHEN 'error' THEN 741
         WHEN 'signup' THEN 600 ELSE 9999 END AS INTEGER) AS code,
    273.15E0 + CAST(event_id % 40 AS DOUBLE) AS temp_k, CAST((event_id * 37) % 10000 AS DOUBLE) AS visibility_m,
    CAST(event_id % 25 AS DOUBLE) / 2 AS wind_ms, CAST(event_id % 100 AS DOUBLE) AS humidity
  FROM events)"""

QP_CTE = """qp AS (
  SELECT event_id AS point_id, 33.5E0 + CAST((user_id + 1) % 60 AS DOUBLE) / 128 AS lat,
    -112E0 + CAST((((user_id + 1) % 60) * 5) % 7 AS DOUBLE) / 256 AS lon, ts
  FROM events)"""


def category_sql(code):
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in WEATHER_CODE_CATEGORIES.items())
    return f"(CASE CAST({code} AS INTEGER) {whens} ELSE 'Clear' END)"


def asof_sql(points, point_cols):
    cols = ", ".join(f"q.{c}" for c in point_cols)
    found = "c.obs_id IS NOT NULL"
    return f"""cand AS (
  SELECT q.point_id, o.obs_id, o.obs_ts, o.code, o.temp_k, o.visibility_m, o.wind_ms, o.humidity,
    ROW_NUMBER() OVER (PARTITION BY q.point_id ORDER BY o.obs_ts DESC, o.obs_id DESC) AS rn
  FROM {points} q JOIN obs o ON ROUND(o.lat, 2) = ROUND(q.lat, 2) AND ROUND(o.lon, 2) = ROUND(q.lon, 2)
    AND o.obs_ts < q.ts AND o.obs_ts >= q.ts - INTERVAL 30 MINUTE),
pw AS (
  SELECT {cols}, c.obs_id, c.obs_ts,
    CASE WHEN {found} THEN {r_up('(c.temp_k - 273.15) * 9 / 5 + 32', 1)} ELSE 70.0 END AS temperature_f,
    CASE WHEN {found} THEN {category_sql('c.code')} ELSE 'Clear' END AS weather_condition,
    CASE WHEN {found} THEN {r_up('c.visibility_m / 1609.34', 1)} ELSE 10.0 END AS visibility_mi,
    CASE WHEN {found} THEN c.humidity ELSE 50.0 END AS humidity_pct,
    CASE WHEN {found} THEN {r_up('c.wind_ms * 2.237', 1)} ELSE 5.0 END AS wind_speed_mph,
    CASE WHEN {found} THEN lower({category_sql('c.code')}) ELSE 'default (API unavailable)' END AS description,
    CASE WHEN {found} THEN 'observed' ELSE 'default' END AS source
  FROM {points} q LEFT JOIN cand c ON c.point_id = q.point_id AND c.rn = 1)"""


ORACLE["weather_asof"] = with_ctes(OBS_CTE, QP_CTE, asof_sql("qp", ["point_id", "lat", "lon", "ts"]),
                                   body="SELECT * REPLACE (CAST(obs_id AS DOUBLE) AS obs_id) FROM pw")

ORACLE["unit_conversion"] = with_ctes(OBS_CTE, body=f"""
SELECT obs_id, lat, lon, obs_ts,
  CASE WHEN ok THEN {r_up('(temp_k - 273.15) * 9 / 5 + 32', 1)} ELSE 70.0 END AS temperature_f,
  CASE WHEN ok THEN {category_sql('code')} ELSE 'Clear' END AS weather_condition,
  CASE WHEN ok THEN {r_up('COALESCE(CASE WHEN code != 9999 THEN visibility_m END, 10000.0) / 1609.34', 1)}
       ELSE 10.0 END AS visibility_mi,
  CASE WHEN ok THEN COALESCE(humidity, 50.0) ELSE 50.0 END AS humidity_pct,
  CASE WHEN ok THEN {r_up('COALESCE(wind_ms, 0.0) * 2.237', 1)} ELSE 5.0 END AS wind_speed_mph,
  CASE WHEN ok THEN lower({category_sql('code')}) ELSE 'default (API unavailable)' END AS description,
  ok AS parsed
FROM (SELECT *, obs_id % 7 != 0 AS ok FROM obs) t""")

DEPARTURES_CTE = """dep AS (
  SELECT trip_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST((trip_id * 7919) % 41760 AS INTEGER)
    AS departure_ts
  FROM (SELECT DISTINCT c_custkey - c_custkey % 3 AS trip_id FROM customer) t)"""

ROUTE_PTS_CTE = """firsts AS (SELECT trip_id, MIN(route_id) AS route_id FROM wp GROUP BY trip_id),
fwp AS (SELECT w.* FROM wp w JOIN firsts f ON w.trip_id = f.trip_id AND w.route_id = f.route_id),
fn AS (SELECT route_id, COUNT(*) AS n FROM fwp GROUP BY route_id),
rpts AS (
  SELECT w.route_id * 1000 + w.seq AS point_id, w.trip_id, w.seq, w.lat, w.lon, d.departure_ts AS ts
  FROM fwp w JOIN fn ON fn.route_id = w.route_id JOIN dep d ON d.trip_id = w.trip_id
  WHERE fn.n <= 5 OR list_contains([CAST(round_even(0 * (CAST(fn.n - 1 AS DOUBLE) / 4), 0) AS INTEGER),
    CAST(round_even(1 * (CAST(fn.n - 1 AS DOUBLE) / 4), 0) AS INTEGER),
    CAST(round_even(2 * (CAST(fn.n - 1 AS DOUBLE) / 4), 0) AS INTEGER),
    CAST(round_even(3 * (CAST(fn.n - 1 AS DOUBLE) / 4), 0) AS INTEGER),
    CAST(round_even(4 * (CAST(fn.n - 1 AS DOUBLE) / 4), 0) AS INTEGER)], w.seq))"""

ROUTE_WX_CTE = f"""rc AS (
  SELECT trip_id, weather_condition, COUNT(*) AS k, MIN(seq) AS first_pos FROM pw GROUP BY trip_id, weather_condition),
rn AS (SELECT trip_id, COUNT(*) AS n FROM pw GROUP BY trip_id),
dom AS (SELECT trip_id, weather_condition, first_pos,
          ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY k DESC, first_pos) AS r FROM rc),
warn AS (
  SELECT rc.trip_id, COUNT(*) AS nc,
    string_agg(rc.weather_condition || ' (' || CAST(rc.k AS VARCHAR) || '/' || CAST(rn.n AS VARCHAR) || ' points)',
               ', ' ORDER BY rc.k DESC, rc.first_pos) AS w
  FROM rc JOIN rn ON rc.trip_id = rn.trip_id GROUP BY rc.trip_id),
rw AS (
  SELECT p.trip_id,
    {r_up('list_reduce(list(p.temperature_f ORDER BY p.seq), lambda a, b: a + b) / COUNT(*)', 1)} AS temperature_f,
    MIN(d.weather_condition) AS weather_condition,
    {r_up('list_reduce(list(p.visibility_mi ORDER BY p.seq), lambda a, b: a + b) / COUNT(*)', 1)} AS visibility_mi,
    {r_up('list_reduce(list(p.humidity_pct ORDER BY p.seq), lambda a, b: a + b) / COUNT(*)', 1)} AS humidity_pct,
    {r_up('list_reduce(list(p.wind_speed_mph ORDER BY p.seq), lambda a, b: a + b) / COUNT(*)', 1)} AS wind_speed_mph,
    MIN(CASE WHEN p.seq = d.first_pos THEN p.description END) AS description,
    CAST(COUNT(*) AS INTEGER) AS samples,
    MIN(CASE WHEN x.nc > 1 THEN 'Weather varies along route: ' || x.w END) AS weather_warning
  FROM pw p JOIN dom d ON d.trip_id = p.trip_id AND d.r = 1 JOIN warn x ON x.trip_id = p.trip_id
  GROUP BY p.trip_id)"""

RW_BASE = (CORRIDOR_CTE, OBS_CTE, DEPARTURES_CTE, ROUTE_PTS_CTE,
           asof_sql("rpts", ["point_id", "trip_id", "seq", "lat", "lon", "ts"]), ROUTE_WX_CTE)

ORACLE["route_weather"] = with_ctes(*RW_BASE, body="SELECT * FROM rw")

ORACLE["effective_weather"] = with_ctes(*RW_BASE, body="""
SELECT d.trip_id, CASE WHEN d.trip_id % 2 = 0 THEN 'auto' ELSE 'manual' END AS source,
  CASE WHEN d.trip_id % 2 = 0 THEN rw.weather_condition
       ELSE COALESCE(NULLIF(CASE WHEN d.trip_id % 5 = 0 THEN 'Rain' END, ''), 'Clear') END AS weather_condition,
  CASE WHEN d.trip_id % 2 = 0 THEN rw.temperature_f
       ELSE COALESCE(CASE WHEN d.trip_id % 5 = 0 THEN 45.0 END, 70.0) END AS temperature_f,
  CASE WHEN d.trip_id % 2 = 0 THEN rw.visibility_mi ELSE 10.0 END AS visibility_mi
FROM dep d LEFT JOIN rw ON rw.trip_id = d.trip_id""")

ORACLE["event_props"] = """
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""


def _first_match(expr_pairs, default="0"):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in expr_pairs) + f" ELSE {default} END"


_LOW = "lower(category)"
ORACLE["weather_codes"] = with_ctes(OBS_CTE, body=f"""
SELECT code, category,
  CAST({_first_match([(f"contains({_LOW}, '{k}')", i) for i, k in enumerate(SCORER_WEATHER_KEYWORDS)])} AS INTEGER) AS scorer_code,
  CAST(CASE WHEN category IS NULL THEN 0 ELSE {_first_match([(f"(contains('{n.lower()}', {_LOW}) OR contains({_LOW}, '{n.lower()}'))", i) for i, n in enumerate(API_WEATHER_CONDITIONS)])} END AS INTEGER) AS api_code,
  CASE WHEN {' OR '.join(f"contains({_LOW}, '{w}')" for w in POOR_WEATHER_WORDS)} THEN 1 ELSE 0 END AS poor_weather
FROM (SELECT DISTINCT code, {category_sql('code')} AS category FROM obs) t""")


# --- streaming twins ----------------------------------------------------------------

# X1 emits exactly the batch rule-score table.
ORACLE["streaming_rule_scores"] = ORACLE["rule_scores"]

# Final (watermark-closed) hourly windows = windows ending no later than
# max(event time) - 30 minutes.
ORACLE["hourly_event_window"] = """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
  time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
  event_type, COUNT(*) AS n, ROUND(SUM(value), 6) AS value_sum
FROM events
GROUP BY 1, 2, 3"""

ORACLE["layer_sizes"] = with_ctes(*BASE, LOCATION_CTE, TEMPORAL_CTE, WEATHER_CTE, body="""
SELECT 'raw.accidents' AS "table", COUNT(*) AS rows FROM incidents
UNION ALL SELECT 'staging.accidents', COUNT(*) FROM staged
UNION ALL SELECT 'staging.location_summary', COUNT(*) FROM location_summary
UNION ALL SELECT 'staging.temporal_patterns', COUNT(*) FROM temporal_patterns
UNION ALL SELECT 'staging.weather_impact', COUNT(*) FROM weather_impact""")


# --- requests, shares, history, payloads, modes ------------------------------------

_WORDS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_EID = 'CAST("ID" AS BIGINT)'

REQ_CTE = f"""req AS (
  SELECT "ID" AS request_id,
    CASE WHEN {_EID} % 211 = 0 THEN 95.0 ELSE latitude END AS latitude, longitude,
    "State" AS state, "City" AS city,
    CASE WHEN {_EID} % 199 = 0 THEN NULL ELSE hour END AS hour,
    CASE WHEN {_EID} % 3 = 0 THEN ({'['+', '.join(repr(w) for w in _WORDS)+']'})[((day_of_week + 6) % 7) + 1]
         ELSE CAST((day_of_week + 6) % 7 AS VARCHAR) END AS day_of_week,
    CASE WHEN {_EID} % 13 = 0 THEN NULL ELSE month END AS month,
    is_weekend, temperature_f, humidity_pct, pressure_in, visibility_mi, wind_speed_mph,
    precipitation_in, weather_condition, {', '.join(_FLAGS)}, distance_mi
  FROM staged),
dreq AS (
  SELECT request_id, latitude, longitude, state, city, hour,
    COALESCE(CASE lower(day_of_week) {' '.join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(_WORDS))} END,
             TRY_CAST(day_of_week AS INTEGER)) AS day_of_week,
    COALESCE(month, 1) AS month, COALESCE(is_weekend, false) AS is_weekend,
    COALESCE(temperature_f, 70.0) AS temperature_f, COALESCE(humidity_pct, 50.0) AS humidity_pct,
    COALESCE(pressure_in, 29.92) AS pressure_in, COALESCE(visibility_mi, 10.0) AS visibility_mi,
    COALESCE(wind_speed_mph, 5.0) AS wind_speed_mph, COALESCE(precipitation_in, 0.0) AS precipitation_in,
    weather_condition, {', '.join(f'COALESCE({f}, false) AS {f}' for f in _FLAGS)},
    COALESCE(distance_mi, 0.0) AS distance_mi
  FROM req)"""

_REQ_BOUNDS = [("latitude", -90, 90), ("longitude", -180, 180), ("hour", 0, 23), ("day_of_week", 0, 6),
               ("month", 1, 12), ("humidity_pct", 0, 100), ("visibility_mi", 0, None),
               ("wind_speed_mph", 0, None), ("precipitation_in", 0, None), ("distance_mi", 0, None)]
_CHECKS = ([(f"{c} IS NULL", f"{c}: field required") for c in ["latitude", "longitude", "hour", "day_of_week"]]
           + [x for c, lo, hi in _REQ_BOUNDS for x in
              ([(f"{c} < {lo}", f"{c}: must be >= {lo}")] if lo is not None else [])
              + ([(f"{c} > {hi}", f"{c}: must be <= {hi}")] if hi is not None else [])])

VREQ_CTE = f"""vreq AS (
  SELECT *, concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN '{m}' END" for c, m in _CHECKS)}) AS errors,
    CAST({' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for c, _ in _CHECKS)} AS INTEGER) AS n_errors
  FROM dreq)"""

ORACLE["request_validation"] = with_ctes(*BASE, REQ_CTE, VREQ_CTE, body="""
SELECT request_id, latitude, CAST(hour AS DOUBLE) AS hour, day_of_week, month, errors, n_errors,
  n_errors = 0 AS valid FROM vreq""")

_API_CODE = ("CASE WHEN weather_condition IS NULL THEN 0 ELSE "
             + _first_match([(f"(contains('{n.lower()}', lower(weather_condition)) OR "
                              f"contains(lower(weather_condition), '{n.lower()}'))", i)
                             for i, n in enumerate(API_WEATHER_CONDITIONS)]) + " END")

ORACLE["request_features"] = with_ctes(*FEAT, ENCODED_CTE, REQ_CTE, VREQ_CTE, body=f"""
SELECT v.request_id, v.hour, CAST((v.day_of_week + 1) % 7 AS INTEGER) AS day_of_week, CAST(v.is_weekend AS INTEGER) AS is_weekend, v.month,
  CAST(CASE WHEN v.hour >= 6 AND v.hour < 12 THEN 1 WHEN v.hour >= 12 AND v.hour < 18 THEN 2
            WHEN v.hour >= 18 AND v.hour < 22 THEN 3 ELSE 0 END AS INTEGER) AS time_period_encoded,
  CASE WHEN v.hour BETWEEN 7 AND 9 OR v.hour BETWEEN 16 AND 19 THEN 1 ELSE 0 END AS is_rush_hour,
  CAST(COALESCE(s.code, -1) AS INTEGER) AS state_encoded, CAST(COALESCE(c.code, -1) AS INTEGER) AS city_encoded,
  v.latitude, v.longitude, v.temperature_f, v.humidity_pct, v.pressure_in, v.visibility_mi,
  v.wind_speed_mph, v.precipitation_in, CAST({_API_CODE.replace('weather_condition', 'v.weather_condition')} AS INTEGER) AS weather_encoded,
  CASE WHEN v.visibility_mi < 5 OR v.precipitation_in > 0 THEN 1 ELSE 0 END AS poor_weather,
  CASE WHEN v.temperature_f < 32 OR v.temperature_f > 95 THEN 1 ELSE 0 END AS extreme_temp,
  {', '.join(f'CAST(v.{f} AS INTEGER) AS {f}' for f in _FLAGS)},
  {' + '.join(f'CAST(v.{f} AS INTEGER)' for f in _FLAGS)} AS road_feature_count, v.distance_mi
FROM vreq v LEFT JOIN state_codes s ON v.state = s.value LEFT JOIN city_codes c ON v.city = c.value
WHERE v.n_errors = 0""")

ORACLE["time_shares"] = with_ctes(*BASE, body="\nUNION ALL\n".join(
    f"""SELECT '{name}' AS dimension, CAST({col} AS VARCHAR) AS value, COUNT(*) AS n,
  CAST(COUNT(*) AS DOUBLE) * 100.0 / SUM(COUNT(*)) OVER () AS pct FROM staged GROUP BY {col}"""
    for name, col in (("hour", "hour"), ("day_of_week", "day_of_week"), ("state", '"State"'))))

ORACLE["segment_history"] = with_rec(*BASE, *ROUTE_BASE, body="""
, dens AS (
  SELECT ROUND(latitude, 2) AS lat_cell, ROUND(longitude, 2) AS lon_cell, COUNT(*) AS n,
    CAST(SUM(CASE WHEN is_high_severity THEN 1 ELSE 0 END) AS BIGINT) AS hs,
    CAST(SUM(CASE WHEN has_junction THEN 1 ELSE 0 END) AS BIGINT) AS jc,
    CAST(SUM(CASE WHEN has_crossing THEN 1 ELSE 0 END) AS BIGINT) AS cc
  FROM staged GROUP BY 1, 2)
SELECT s.trip_id, s.route_id, s.segment_index, ROUND(s.lat, 2) AS lat_cell, ROUND(s.lon, 2) AS lon_cell,
  COALESCE(d.n, 0) AS incidents, COALESCE(d.hs, 0) AS high_severity,
  COALESCE(d.jc, 0) > 0 AS has_junction, COALESCE(d.cc, 0) > 0 AS has_crossing
FROM samples s LEFT JOIN dens d ON d.lat_cell = ROUND(s.lat, 2) AND d.lon_cell = ROUND(s.lon, 2)""")

ORACLE["route_payloads"] = with_ctes(WAYPOINTS_CTE, SEG_CTE, body="""
, rl AS (SELECT trip_id, route_id, COUNT(*) AS n_points, ROUND(SUM(dist_mi), 6) AS total_miles
         FROM seg GROUP BY trip_id, route_id)
SELECT trip_id, route_id, printf('%.1f', total_miles) || ' mi' AS distance_text,
  CAST(floor(total_miles * 1609.34 + 0.5) AS INTEGER) AS distance_meters,
  CAST(CAST(trunc(trunc(total_miles * 60) / 60.0) AS INTEGER) AS VARCHAR) || ' mins' AS duration_text,
  CAST(trunc(total_miles * 60) AS INTEGER) AS duration_seconds,
  'pl' || CAST(route_id AS VARCHAR) || '-' || CAST(n_points AS VARCHAR) AS polyline,
  'Route ' || CAST(route_id AS VARCHAR) AS summary
FROM rl WHERE route_id % 11 != 0""")


def _mode(col):
    return f"(SELECT {col} FROM staged WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY COUNT(*) DESC, {col} LIMIT 1)"


ORACLE["mode_values"] = with_ctes(*BASE, body=f"""
SELECT {_mode('weather_condition')} AS weather_condition, {_mode('"State"')} AS "State",
  {_mode('"City"')} AS "City", {_mode('hour')} AS hour""")


ORACLE["request_scores"] = with_ctes(*BASE, REQ_CTE, VREQ_CTE, body=f"""
, sc AS (SELECT request_id, n_errors = 0 AS valid,
           CASE WHEN n_errors = 0 THEN {rule_sql('visibility_mi', 'precipitation_in', 'weather_condition',
                                                 'has_junction', 'has_crossing', 'hour', 'is_weekend')} END AS p
         FROM vreq)
SELECT request_id, valid, COALESCE(p, 0.5) AS risk_score,
  CASE WHEN p IS NULL THEN 'UNKNOWN' WHEN p < 0.3 THEN 'LOW' WHEN p < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
  CASE WHEN p IS NULL THEN 0.0 ELSE ROUND(ABS(p - 0.5) * 2, 4) END AS confidence
FROM sc""")

ORACLE["rule_factors"] = with_ctes(*BASE, body="""
SELECT accident_id, rank, feature, ROUND(CAST(importance AS DOUBLE), 4) AS importance, value FROM (
  SELECT "ID" AS accident_id, 1 AS rank, 'visibility_mi' AS feature, 0.22 AS importance, visibility_mi AS value FROM staged
  UNION ALL SELECT "ID", 2, 'hour', 0.18, CAST(hour AS DOUBLE) FROM staged
  UNION ALL SELECT "ID", 3, 'precipitation_in', 0.15, precipitation_in FROM staged
  UNION ALL SELECT "ID", 4, 'has_junction', 0.12, CAST(CAST(has_junction AS INTEGER) AS DOUBLE) FROM staged
  UNION ALL SELECT "ID", 5, 'weather_condition', 0.10, CAST(NULL AS DOUBLE) FROM staged) t""")

ORACLE["cities_for_state"] = with_ctes(*BASE, body="""
SELECT DISTINCT "City" FROM staged WHERE "State" = 'NATION_1' AND "City" IS NOT NULL AND "City" != ''""")

_FEATURE_COLS = (["accident_id", "hour", "day_of_week", "is_weekend", "month", "time_period_encoded",
                  "is_rush_hour", "state_encoded", "city_encoded", "latitude", "longitude", "temperature_f",
                  "humidity_pct", "pressure_in", "visibility_mi", "wind_speed_mph", "precipitation_in",
                  "weather_encoded", "poor_weather", "extreme_temp"] + _FLAGS
                 + ["road_feature_count", "distance_mi", "is_high_severity"])
_SPARK_TYPE = ("CASE t WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' "
               "WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(t) END")

ORACLE["feature_summary"] = with_ctes(*FEAT, ENCODED_CTE, "features AS (" + FEATURES_BODY + ")", body=(
    f"SELECT \"column\", {_SPARK_TYPE} AS type, null_count, CAST(NULL AS BIGINT) AS rows, CAST(NULL AS DOUBLE) AS share_pct FROM (\n"
    + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", (SELECT typeof({c}) FROM features LIMIT 1) AS t,
  CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count FROM features""" for c in _FEATURE_COLS) + ") x"
    + """
UNION ALL SELECT 'is_high_severity = ' || CAST(is_high_severity AS VARCHAR), 'class', 0, COUNT(*),
  COUNT(*) * 100.0E0 / SUM(COUNT(*)) OVER () FROM features GROUP BY is_high_severity"""))

# X1 request path emits exactly the batch request scores.
ORACLE["streaming_request_scores"] = ORACLE["request_scores"]

# X2 on incidents: closed hourly windows of the staged incidents.
ORACLE["hourly_incident_window"] = with_ctes(*BASE, body="""
SELECT time_bucket(INTERVAL 1 HOUR, start_time) AS window_start,
  time_bucket(INTERVAL 1 HOUR, start_time) + INTERVAL 1 HOUR AS window_end,
  COUNT(*) AS accident_count, ROUND(AVG("Severity"), 6) AS avg_severity,
  CAST(SUM(CASE WHEN is_high_severity THEN 1 ELSE 0 END) AS BIGINT) AS high_severity_count
FROM staged
GROUP BY 1, 2""")


def _top_sql(col):
    return with_ctes(INCIDENTS_CTE, body=f"""
SELECT value, n, pct FROM (
  SELECT "{col}" AS value, COUNT(*) AS n,
    CAST(COUNT(*) AS DOUBLE) * 100.0 / SUM(COUNT(*)) OVER () AS pct
  FROM incidents GROUP BY "{col}") t
ORDER BY n DESC, value NULLS FIRST LIMIT 10""")


ORACLE["top_weather"] = _top_sql("Weather_Condition")
ORACLE["top_cities"] = _top_sql("City")


STAGED_COLUMNS = (["ID", "Source", "Severity", "start_time", "end_time", "year", "month", "day", "hour",
                   "day_of_week", "is_weekend", "time_period", "latitude", "longitude", "distance_mi",
                   "Street", "City", "County", "State", "Zipcode", "Country", "temperature_f",
                   "humidity_pct", "pressure_in", "visibility_mi", "wind_speed_mph", "precipitation_in",
                   "weather_condition"] + _FLAGS + ["duration_minutes", "is_high_severity"])
_SPARK_TYPE_NTZ = _SPARK_TYPE.replace("ELSE lower(t) END", "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(t) END")

ORACLE["schema_listing"] = with_ctes(*BASE, body=(
    f"SELECT position, \"column\", {_SPARK_TYPE_NTZ} AS type, null_count FROM (\n" + "\nUNION ALL\n".join(
        f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", (SELECT typeof("{c}") FROM staged LIMIT 1) AS t,
  CAST(COUNT(*) - COUNT("{c}") AS BIGINT) AS null_count FROM staged""" for i, c in enumerate(STAGED_COLUMNS))
    + ") x"))


# --- model, split and failed routes: rows that hold whatever was learned -----------------

_SPLIT = """SELECT accident_id, is_high_severity,
    CASE WHEN ROW_NUMBER() OVER (PARTITION BY is_high_severity ORDER BY h, accident_id)
              > n - (n * 40 + 100) // 200 THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, md5(accident_id || ':42') AS h, COUNT(*) OVER (PARTITION BY is_high_severity) AS n
        FROM (SELECT accident_id, CAST(is_high_severity AS INTEGER) AS is_high_severity FROM src) a) b"""

ORACLE["stratified_split"] = with_ctes(*BASE, SOURCE_CTE, body=_SPLIT)

ORACLE["gbt_checks"] = with_ctes(*BASE, SOURCE_CTE, body=f"""
SELECT accident_id, split, true AS is_probability, true AS level_follows, true AS prediction_follows,
  true AS confidence_follows, true AS same_from_raw FROM ({_SPLIT}) s""")

ORACLE["gbt_metrics_check"] = with_ctes(*BASE, SOURCE_CTE, body=f"""
SELECT COUNT(*) AS test_samples, CAST(SUM(is_high_severity) AS BIGINT) AS positive_samples,
  CAST(SUM(1 - is_high_severity) AS BIGINT) AS negative_samples, 'GBTClassifier' AS model_type,
  CAST(33 AS INTEGER) AS feature_count, true AS metrics_as_saved, true AS has_time, true AS auc_in_range
FROM ({_SPLIT}) s WHERE split = 'test'""")

_DISPLAY = "array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(feature, '_')], ' ')"
ORACLE["importance_check"] = f"""
SELECT feature, {_DISPLAY} AS display_name, true AS ranked, true AS sums_to_one
FROM (SELECT unnest({[c for c in _FEATURE_COLS if c not in ('accident_id', 'is_high_severity')]}) AS feature) f"""

ORACLE["model_request_checks"] = with_ctes(*BASE, REQ_CTE, VREQ_CTE, body="""
SELECT request_id, n_errors = 0 AS valid, true AS scored_if_valid, true AS is_probability, true AS confidence_follows,
  true AS level_follows, true AS factors_follow FROM vreq""")

ORACLE["model_route_checks"] = with_rec(*ROUTE_BASE, body="""
SELECT trip_id, route_id, COUNT(*) AS segments_scored, true AS are_probabilities, true AS in_order, true AS safety_follows,
  true AS danger_follows, true AS level_follows, true AS danger_counted FROM samples GROUP BY trip_id, route_id""")

RAW_CTE = """raw AS (
  SELECT trip_id, route_id, seq,
    CASE WHEN route_id % 17 = 3 AND seq = 30 THEN 'n/a' WHEN route_id % 19 = 4 AND seq = 10 THEN NULL
         WHEN route_id % 23 = 5 AND seq = 0 THEN '95.5' ELSE CAST(lat AS VARCHAR) END AS lat, lon FROM all_wp),
bad AS (
  SELECT trip_id, route_id, seq, CASE WHEN lat IS NULL THEN 'point ' || seq || ': coordinate missing'
         WHEN TRY_CAST(lat AS DOUBLE) IS NULL THEN 'point ' || seq || ': coordinate is no number'
         WHEN abs(TRY_CAST(lat AS DOUBLE)) > 90 THEN 'point ' || seq || ': coordinate off the globe' END AS error FROM raw),
failed AS (SELECT trip_id, route_id, arg_min(error, seq) AS error FROM bad WHERE error IS NOT NULL GROUP BY trip_id, route_id),
wp AS (SELECT * FROM all_wp WHERE route_id NOT IN (SELECT route_id FROM failed))"""

ORACLE["route_outcomes"] = with_rec(
    *BASE, WAYPOINTS_CTE.replace("wp AS (", "all_wp AS (", 1), RAW_CTE, SEG_CTE, SAMPLES_CTE, segscores_cte(17, 5),
    "rr AS (" + ROUTE_RISK_BODY + ")", body=f"""
, rk AS (
  SELECT trip_id, route_id, {r_up('overall_risk', 3)} AS risk_score,
    {level4_sql('overall_risk', 'MEDIUM')} AS risk_level, {r_up('safety_score', 1)} AS safety_score,
    {r_up('max_risk', 3)} AS max_risk, {r_up('min_risk', 3)} AS min_risk, segments_scored AS segments_analyzed,
    CAST(NULL AS VARCHAR) AS error FROM rr
  UNION ALL SELECT trip_id, route_id, 0.5E0, 'UNKNOWN', 50.0E0, 0.5E0, 0.5E0, 0, error FROM failed),
rk2 AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY safety_score DESC, route_id) AS INTEGER) AS rank,
    MAX(safety_score) OVER (PARTITION BY trip_id) - safety_score AS gap_to_best,
    FIRST(risk_level) OVER (PARTITION BY trip_id ORDER BY safety_score DESC, route_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best_level
  FROM rk)
SELECT trip_id, route_id, risk_score, risk_level, safety_score, max_risk, min_risk, segments_analyzed, error,
  rank, gap_to_best,
  CASE WHEN error IS NOT NULL THEN 'Scoring failed - use with caution' WHEN best_level = 'UNKNOWN' THEN NULL
       WHEN rank = 1 THEN 'Recommended - Safest option'
       WHEN gap_to_best > 10 THEN printf('Higher risk - %.1f points less safe', gap_to_best)
       WHEN gap_to_best > 5 THEN 'Slightly higher risk' ELSE 'Similar safety level' END AS recommendation
FROM rk2""")

ORACLE["streaming_model_checks"] = with_ctes(*BASE, REQ_CTE, VREQ_CTE, body="""
SELECT request_id, n_errors = 0 AS valid, errors, true AS same_as_batch FROM vreq""")

# --- sources and the catalogued warehouse ---------------------------------------------------

ORACLE["prefix_sample"] = with_ctes(INCIDENTS_CTE, body="""
SELECT "ID", "Severity", "Start_Time", "State", "City" FROM incidents ORDER BY CAST("ID" AS BIGINT) LIMIT 1000""")

ORACLE["csv_mixed_headers"] = with_ctes(INCIDENTS_CTE, body="""
, m AS (SELECT *, CAST("ID" AS BIGINT) % 53 = 0 OR CAST("ID" AS BIGINT) % 59 = 0 AS bad FROM incidents)
SELECT "State", COUNT(*) AS rows, CAST(SUM("Severity") AS BIGINT) AS severity,
  CAST(COUNT(CASE WHEN "Crossing" THEN 1 END) AS BIGINT) AS crossings, COUNT("Start_Lat") AS places
FROM m WHERE NOT bad GROUP BY "State"
UNION ALL SELECT 'rejected', COUNT(*), 0, COUNT(CASE WHEN CAST("ID" AS BIGINT) % 59 = 0 THEN 1 END), 0 FROM m WHERE bad""")


def _counted(view, column):
    body = ORACLE[view]
    return f"SELECT '{view}' AS view, COUNT(*) AS rows, CAST(SUM({column}) AS BIGINT) AS total FROM ({body}) t"


ORACLE["analytics_views"] = "\nUNION ALL\n".join(_counted(v, c) for v, c in [
    ("top_risk_locations", "total_accidents"), ("hourly_risk_profile", "total_accidents"), ("day_of_week_analysis", "total_accidents"),
    ("weather_risk_ranking", "accident_count"), ("state_summary", "total_accidents"), ("rush_hour_impact", "total_accidents"),
    ("high_risk_segments", "accident_count")])
