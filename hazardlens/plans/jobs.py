"""End-to-end warehouse job: raw -> quality -> staging -> summaries ->
analytics views -> features -> model, writing each layer once.

Layers are written as Parquet under ``base`` (shared storage on a cluster)
and read back, which both persists them for other jobs and cuts the lineage
so a lost executor only recomputes from the last written layer.

Usage: python -m hazardlens.plans.jobs <sf_dir> <output_base> [gbt_iterations]
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from hazardlens.operators import analytics as A
from hazardlens.operators import features as FE
from hazardlens.operators import model as ML
from hazardlens.operators import serving as SV
from hazardlens.operators import quality as Q
from hazardlens.operators import staging as S
from hazardlens.operators import summaries as SM
from hazardlens.sources import fixtures as FX
from hazardlens.sources import io as IO


def run_warehouse(spark: SparkSession, sf_dir: str, base: str, gbt_iter: int = 100) -> dict:
    raw_path = f"{base}/raw/accidents"
    IO.write_parquet(FX.incidents(spark, sf_dir), raw_path)
    raw = spark.read.parquet(raw_path)
    report = Q.quality_report(raw).collect()          # one row per check (~12 rows)
    IO.write_parquet(S.stage_incidents(raw), f"{base}/staging/accidents",
                     sort_within=["State", "start_time"])
    staged = spark.read.parquet(f"{base}/staging/accidents")
    paths = IO.write_layers(base, {
        "staging.location_summary": SM.location_summary(staged),
        "staging.temporal_patterns": SM.temporal_patterns(staged),
        "staging.weather_impact": SM.weather_impact(staged),
    })
    IO.register_layers(spark, paths)
    loc = spark.read.parquet(paths["staging.location_summary"])
    tmp = spark.read.parquet(paths["staging.temporal_patterns"])
    wx = spark.read.parquet(paths["staging.weather_impact"])
    views = {
        "top_risk_locations": A.top_risk_locations(loc), "hourly_risk_profile": A.hourly_risk_profile(tmp),
        "day_of_week_analysis": A.day_of_week_analysis(tmp), "weather_risk_ranking": A.weather_risk_ranking(wx),
        "state_summary": A.state_summary(loc), "rush_hour_impact": A.rush_hour_impact(tmp),
        "high_risk_segments": A.high_risk_segments(staged),
    }
    for name, v in views.items():
        v.createOrReplaceTempView(f"analytics_{name}")
    model, split = SV.fit_risk_pipeline(staged, gbt_iter)
    IO.write_parquet(split, f"{base}/features/accident_features")
    feats = spark.read.parquet(f"{base}/features/accident_features")
    SV.save_risk_pipeline(spark, model, feats, f"{base}/models/risk_model")
    metrics = ML.model_metadata(spark, f"{base}/models/risk_model").first().metrics
    return {"quality": [r.asDict() for r in report], "metrics": metrics, "layers": paths}


if __name__ == "__main__":
    from hazardlens.session import get_session
    sf, out = sys.argv[1], sys.argv[2]
    iters = int(sys.argv[3]) if len(sys.argv) > 3 else 100
    s = get_session("hazardlens-warehouse")
    print(json.dumps(run_warehouse(s, sf, out, iters), default=str))
