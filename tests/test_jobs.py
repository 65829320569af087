"""The end-to-end warehouse job writes every layer once and registers the views."""

import os
import tempfile

from paths import SMALL


def test_warehouse_job(spark):
    from hazardlens.plans.jobs import run_warehouse
    base = tempfile.mkdtemp(prefix="hl-wh-")
    out = run_warehouse(spark, SMALL, base, gbt_iter=2)
    for layer in ("raw/accidents", "staging/accidents", "staging/location_summary",
                  "staging/temporal_patterns", "staging/weather_impact",
                  "features/accident_features", "models/risk_model"):
        assert os.path.isdir(os.path.join(base, layer)), layer
    checks = {q["check"]: q["issue_count"] for q in out["quality"]}
    assert checks["required_columns"] == 0 and checks["nulls:Start_Lat"] > 0
    feats = spark.read.parquet(os.path.join(base, "features/accident_features"))
    assert out["metrics"]["test_samples"] == feats.where("split = 'test'").count() > 0
    assert out["metrics"]["positive_samples"] == feats.where("split = 'test' and is_high_severity = 1").count()
    raw_n = spark.read.parquet(os.path.join(base, "raw/accidents")).count()
    staged_n = spark.read.parquet(os.path.join(base, "staging/accidents")).count()
    assert 0 < staged_n < raw_n
    assert spark.sql("SELECT COUNT(*) AS c FROM analytics_hourly_risk_profile").first().c > 0
