"""The catalogued warehouse: raw, staging and analytics layers as databases of
the session's catalog, each table published as a version behind a view (S6-S8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazardlens.operators import analytics as A
from hazardlens.operators import staging as S
from hazardlens.operators import summaries as SM
from hazardlens.sources import io as IO

SUMMARIES = {"staging.location_summary": SM.location_summary, "staging.temporal_patterns": SM.temporal_patterns,
             "staging.weather_impact": SM.weather_impact}
# Analytics view -> (the table it reads, the operator).
VIEWS = {
    "top_risk_locations": ("staging.location_summary", A.top_risk_locations),
    "hourly_risk_profile": ("staging.temporal_patterns", A.hourly_risk_profile),
    "day_of_week_analysis": ("staging.temporal_patterns", A.day_of_week_analysis),
    "weather_risk_ranking": ("staging.weather_impact", A.weather_risk_ranking),
    "state_summary": ("staging.location_summary", A.state_summary),
    "rush_hour_impact": ("staging.temporal_patterns", A.rush_hour_impact),
    "high_risk_segments": ("staging.accidents", A.high_risk_segments),
}


def publish_warehouse(spark: SparkSession, raw: DataFrame, base: str, prefix: str = "") -> dict:
    """Publish all layers from raw incidents; returns name -> path of the new
    version. Each layer is written once and the next one reads it by name."""
    IO.create_layers(spark, base, prefix=prefix)
    table = lambda name: spark.table(f"{prefix}{name}")
    paths = {"raw.accidents": IO.publish(spark, base, "raw.accidents", raw, prefix)}
    paths["staging.accidents"] = IO.publish(spark, base, "staging.accidents", S.stage_incidents(table("raw.accidents")), prefix,
                                            sort_within=["State", "start_time"])
    for name, summary in SUMMARIES.items():
        paths[name] = IO.publish(spark, base, name, summary(table("staging.accidents")), prefix)
    for view, (source, operator) in VIEWS.items():
        paths[f"analytics.{view}"] = IO.publish(spark, base, f"analytics.{view}", operator(table(source)), prefix)
    return paths
