"""Staging summaries: location, temporal, weather (A1-A3).

Hash aggregates with partial (map-side) aggregation, so a hot State/City
is pre-combined on every mapper before the shuffle and the shuffle carries
one row per key per task. Conditional counts are ``count_if``-style sums
computed in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count_when(cond) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as bigint (0 for an all-null group)."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def location_summary(staged: DataFrame, min_count: int = 10) -> DataFrame:
    """Per (State, City): counts, averages and flag counts; HAVING count >= min_count."""
    return (staged.groupBy("State", "City")
            .agg(F.count(F.lit(1)).alias("total_accidents"),
                 F.avg("Severity").alias("avg_severity"),
                 _count_when(F.col("Severity") >= 3).alias("high_severity_count"),
                 F.avg("duration_minutes").alias("avg_duration_minutes"),
                 F.avg("temperature_f").alias("avg_temperature"),
                 F.avg("visibility_mi").alias("avg_visibility"),
                 _count_when(F.col("has_traffic_signal")).alias("accidents_at_signals"),
                 _count_when(F.col("has_junction")).alias("accidents_at_junctions"),
                 _count_when(F.col("has_crossing")).alias("accidents_at_crossings"),
                 _count_when(F.col("is_weekend")).alias("weekend_accidents"),
                 _count_when(F.col("time_period") == "Morning Rush").alias("morning_rush_accidents"),
                 _count_when(F.col("time_period") == "Evening Rush").alias("evening_rush_accidents"))
            .where(F.col("total_accidents") >= min_count))


TEMPORAL_KEYS = ["year", "month", "day_of_week", "hour", "time_period", "is_weekend"]


def temporal_patterns(staged: DataFrame) -> DataFrame:
    """Per (year, month, dow, hour, period, weekend): counts and averages."""
    return (staged.groupBy(*TEMPORAL_KEYS)
            .agg(F.count(F.lit(1)).alias("accident_count"),
                 F.avg("Severity").alias("avg_severity"),
                 _count_when(F.col("Severity") >= 3).alias("high_severity_count"),
                 F.avg("duration_minutes").alias("avg_duration"),
                 F.avg("temperature_f").alias("avg_temperature"),
                 F.avg("visibility_mi").alias("avg_visibility"),
                 F.avg("precipitation_in").alias("avg_precipitation")))


def weather_impact(staged: DataFrame, min_count: int = 100) -> DataFrame:
    """Per raw weather condition (null shown as 'Unknown'); HAVING count >= min_count.

    Grouping is on the raw column, so a literal 'Unknown' condition and the
    null group stay two rows, as in the SQL original.
    """
    return (staged.groupBy("weather_condition")
            .agg(F.count(F.lit(1)).alias("accident_count"),
                 F.avg("Severity").alias("avg_severity"),
                 _count_when(F.col("Severity") >= 3).alias("high_severity_count"),
                 F.avg("visibility_mi").alias("avg_visibility"),
                 F.avg("temperature_f").alias("avg_temperature"),
                 F.avg("wind_speed_mph").alias("avg_wind_speed"),
                 F.avg("precipitation_in").alias("avg_precipitation"),
                 F.avg("duration_minutes").alias("avg_duration"))
            .where(F.col("accident_count") >= min_count)
            .select(F.coalesce("weather_condition", F.lit("Unknown")).alias("weather_condition"),
                    "accident_count", "avg_severity", "high_severity_count", "avg_visibility",
                    "avg_temperature", "avg_wind_speed", "avg_precipitation", "avg_duration")
            .orderBy(F.desc("accident_count"), "weather_condition"))
