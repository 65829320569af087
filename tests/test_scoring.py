"""Metrics against brute-force Python on a small scored table with ties."""

from itertools import product

from hazardlens.operators import scoring as SC

SCORED = [(1, 0.9), (1, 0.7), (0, 0.7), (1, 0.4), (0, 0.4), (0, 0.4), (0, 0.2), (1, 0.55), (0, 0.55)]


def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in product(pos, neg))
    return wins / (len(pos) * len(neg))


def test_metrics_match_brute_force(spark):
    df = spark.createDataFrame(SCORED, "is_high_severity int, risk_score double")
    m = SC.eval_metrics(df).first()
    tp = sum(1 for y, s in SCORED if y == 1 and s > 0.5)
    fp = sum(1 for y, s in SCORED if y == 0 and s > 0.5)
    fn = sum(1 for y, s in SCORED if y == 1 and s <= 0.5)
    tn = sum(1 for y, s in SCORED if y == 0 and s <= 0.5)
    p, r = tp / (tp + fp), tp / (tp + fn)
    assert abs(m.roc_auc - _brute_auc(SCORED)) < 1e-12
    assert abs(m.accuracy - (tp + tn) / len(SCORED)) < 1e-12
    assert abs(m.f1 - 2 * p * r / (p + r)) < 1e-12
    assert (m.predicted_positive, m.predicted_negative) == (tp + fp, tn + fn)
    cm = {(r.label, r.prediction): r.n for r in SC.confusion_matrix(df).collect()}
    assert cm == {(1, 1): tp, (0, 1): fp, (0, 0): tn, (1, 0): fn}
    rep = {r["class"]: r for r in SC.class_report(df).collect()}
    assert rep["1"].support == tp + fn and abs(rep["1"].precision - p) < 1e-12
    roc = SC.roc_points(df).collect()
    assert roc[-1].fpr == 1.0 and roc[-1].tpr == 1.0 and roc[0].threshold == 0.9


def test_rule_score_and_fallback(spark):
    rows = [(3.0, 0.5, "Fog", True, True, 8, False),      # 35+15+12+18+8+5+10 = 103 -> 95
            (10.0, 0.0, "Clear", False, False, 21, True),  # 35+8 = 43
            (10.0, 0.0, "Light Snow", False, False, 3, False)]  # 35
    df = spark.createDataFrame(rows, "visibility_mi double, precipitation_in double, weather_condition string, "
                                     "has_junction boolean, has_crossing boolean, hour int, is_weekend boolean")
    got = [r.risk_score for r in SC.rule_score(df).collect()]
    assert got == [0.95, 0.43, 0.35]
    v = spark.createDataFrame([(True,) + rows[1], (False,) + rows[0]],
                              "valid boolean, visibility_mi double, precipitation_in double, weather_condition string, "
                              "has_junction boolean, has_crossing boolean, hour int, is_weekend boolean")
    out = [(r.risk_score, r.risk_level, r.confidence) for r in SC.score_requests(v).collect()]
    assert out == [(0.43, "MEDIUM", 0.14), (0.5, "UNKNOWN", 0.0)]


def test_request_defaults_and_validation(spark):
    from hazardlens.operators.requests import validate_requests
    rows = [("ok", 34.05, -118.24, 8, "Monday", None, None),
            ("words", 34.05, -118.24, 17, "sunday", 12, 40.0),
            ("bad", 95.0, -200.0, 24, "funday", 13, 150.0),
            ("missing", None, -118.24, None, "3", 1, None)]
    df = spark.createDataFrame(rows, "request_id string, latitude double, longitude double, hour int, "
                                     "day_of_week string, month int, humidity_pct double")
    r = {x.request_id: x for x in validate_requests(df).collect()}
    assert r["ok"].valid and r["ok"].day_of_week == 0 and r["ok"].month == 1 and r["ok"].humidity_pct == 50.0
    assert r["ok"].pressure_in == 29.92 and r["ok"].has_junction is False and r["ok"].distance_mi == 0.0
    assert r["words"].valid and r["words"].day_of_week == 6
    assert not r["bad"].valid and r["bad"].n_errors == 6
    assert r["bad"].errors == ("day_of_week: field required; latitude: must be <= 90; longitude: must be >= -180; "
                               "hour: must be <= 23; month: must be <= 12; humidity_pct: must be <= 100")
    assert r["missing"].errors == "latitude: field required; hour: field required" and r["missing"].day_of_week == 3


def test_hash_split_and_sample_are_deterministic(spark):
    from pyspark.sql import functions as F
    from hazardlens.operators.analytics import random_sample
    from hazardlens.operators.features import hash_split
    ids = spark.range(0, 20000).select(F.col("id").cast("string").alias("accident_id"))
    a = {r.accident_id: r.split for r in hash_split(ids).collect()}
    b = {r.accident_id: r.split for r in hash_split(ids.repartition(7)).collect()}
    assert a == b
    share = sum(v == "train" for v in a.values()) / len(a)
    assert 0.78 < share < 0.82
    s1 = [r.accident_id for r in random_sample(ids, 50, key="accident_id").collect()]
    s2 = [r.accident_id for r in random_sample(ids.repartition(5), 50, key="accident_id").collect()]
    assert s1 == s2 and len(set(s1)) == 50
