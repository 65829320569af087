"""The risk pipeline saved, loaded and applied to requests, segments and a stream."""

import os
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from hazardlens.operators import features as FE
from hazardlens.operators import model as ML
from hazardlens.operators import requests as RQ
from hazardlens.operators import routes as R
from hazardlens.operators import serving as SV
from hazardlens.plans import catalog
from hazardlens.sources import fixtures as FX
from hazardlens.streaming import stream as ST
from paths import SMALL


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    model, feats = SV.fit_risk_pipeline(catalog.staged(spark, SMALL), max_iter=3)
    path = str(tmp_path_factory.mktemp("model") / "risk")
    SV.save_risk_pipeline(spark, model, feats, path)
    return model, feats, path


def _validated(spark):
    return RQ.validate_requests(FX.prediction_requests(catalog.staged(spark, SMALL)))


def _by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def test_loaded_pipeline_scores_like_the_one_in_memory(spark, trained):
    model, _, path = trained
    again = SV.load_risk_pipeline(path)
    assert [type(s) for s in again.stages] == [type(s) for s in model.stages]
    for score in (lambda m: _by_id(SV.score_incidents(m, catalog.staged(spark, SMALL)), "accident_id", "risk_score"),
                  lambda m: _by_id(SV.predict_requests(m, _validated(spark)), "request_id", "risk_score", "risk_level", "confidence", "contributing_factors")):
        first = score(model)
        assert first == score(again) and len({v[0] for v in first.values()}) > 20


def test_scores_follow_the_request(spark, trained):
    model, _, _ = trained
    rows = SV.predict_requests(model, _validated(spark)).collect()
    assert {r.valid for r in rows} == {True, False}
    for r in rows:
        if r.valid:
            assert r.risk_level == ("LOW" if r.risk_score < 0.3 else "MEDIUM" if r.risk_score < 0.6 else "HIGH")
            assert [f.importance for f in r.contributing_factors] == sorted((f.importance for f in r.contributing_factors), reverse=True)
        else:
            assert (r.risk_score, r.risk_level, r.confidence, r.contributing_factors) == (0.5, "UNKNOWN", 0.0, None) and r.errors


def test_unseen_places_get_a_score(spark, trained):
    one = _validated(spark).where("valid").limit(1).withColumn("state", F.lit("Nowhere")).withColumn("city", F.lit(None).cast("string"))
    r = SV.predict_requests(trained[0], one).first()
    assert 0 < r.risk_score < 1 and r.risk_level != "UNKNOWN"


def test_metadata_is_read_back_with_its_time(spark, trained):
    _, feats, path = trained
    m = ML.model_metadata(spark, path).first()
    assert m.feature_count == 33 and m.saved_at is not None
    held_out = feats.where("split = 'test'").count()
    assert m.metrics["test_samples"] == held_out and m.metrics["accuracy"] >= 0.0


def test_code_tables_are_saved_as_tables(spark, trained):
    model, _, path = trained
    again = SV.code_tables(SV.load_risk_pipeline(path))
    for name, codes in SV.code_tables(model).items():
        assert sorted(map(tuple, again[name].collect())) == sorted(map(tuple, codes.collect()))


def test_model_scores_segments(spark, trained):
    wp = FX.waypoints(spark, SMALL)
    segments = R.with_history(R.sample_waypoints(wp), catalog.staged(spark, SMALL))
    seg = R.score_segments(segments, 17, 5, scorer=SV.segment_scorer(trained[0]))
    risk = R.route_risk(wp, seg).collect()
    assert len({r.overall_risk for r in risk}) > 30
    assert all(0 <= r.min_risk <= r.max_risk <= 1 for r in risk)


def test_segments_without_a_place_get_the_fallback(spark, trained):
    seg = spark.createDataFrame([(1, 1, 0, None, -112.0), (1, 1, 1, 33.5, -112.0)],
                                "trip_id long, route_id long, segment_index int, lat double, lon double")
    a, b = R.score_segments(seg, 17, 5, scorer=SV.segment_scorer(trained[0])).orderBy("segment_index").collect()
    assert (a.risk_score, a.risk_level, a.confidence) == (0.5, "UNKNOWN", 0.0)
    assert b.risk_level != "UNKNOWN"


def test_history_flags_come_from_the_cell(spark):
    seg = spark.createDataFrame([(1, 30.01, -100.0), (2, 30.19, -100.0), (3, -30.01, -100.05)], "segment_index int, lat double, lon double")
    past = spark.createDataFrame([(30.09, -100.0, True, False), (30.05, -99.95, False, True), (-30.01, -100.01, False, True)],
                                 "latitude double, longitude double, has_junction boolean, has_crossing boolean")
    got = _by_id(R.with_history(seg, past, flags=("has_junction", "has_crossing")), "segment_index", "has_junction", "has_crossing")
    assert got == {1: (1, 1), 2: (0, 0), 3: (0, 1)}


def _split_events(spark, tmp_path):
    """The small tables, with the events in four files."""
    for name in ("customer", "nation"):
        shutil.copy(os.path.join(SMALL, f"{name}.parquet"), tmp_path)
    spark.read.parquet(os.path.join(SMALL, "events.parquet")).repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_stream_killed_between_its_sinks_ends_like_the_batch(spark, trained, tmp_path, monkeypatch):
    model, folder = trained[0], _split_events(spark, tmp_path)
    write, calls = ST.write_rejected, []

    def dies_once(rows, base, batch):
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("killed")
        write(rows, base, batch)

    monkeypatch.setattr(ST, "write_rejected", dies_once)
    run = f"killed-{uuid.uuid4().hex}"
    with pytest.raises(Exception, match="killed"):
        ST.streaming_model_scores(spark, folder, model, run_id=run, max_files_per_trigger=1)
    got = ST.streaming_model_scores(spark, folder, model, run_id=run, max_files_per_trigger=1)
    assert calls == [0, 1, 1, 2, 3]  # the batch cut off between its sinks ran again
    want = SV.predict_requests(model, _validated(spark))
    columns = ["request_id", "valid", "errors", "risk_score", "risk_level", "confidence"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


@pytest.mark.parametrize("sizes", [{0: 10, 1: 5}, {0: 1, 1: 2, None: 7}, {0: 997, 1: 3}, {}])
def test_split_takes_the_same_share_of_every_class(spark, sizes):
    rows = [(f"{k}-{i}", k) for k, n in sizes.items() for i in range(n)]
    got = FE.stratified_split(spark.createDataFrame(rows, "accident_id string, is_high_severity int")).collect()
    assert len(got) == len(rows)
    for k, n in sizes.items():
        test = sum(r.split == "test" for r in got if r.is_high_severity == k)
        assert test == int(n * 0.2 + 0.5), (k, n)


def test_split_does_not_depend_on_partitions(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("accident_id"), (F.col("id") % 3 == 0).cast("int").alias("is_high_severity"))
    a, b = (_by_id(FE.stratified_split(rows.repartition(n)), "accident_id", "split") for n in (1, 13))
    assert a == b


def test_failed_routes_keep_their_warning(spark):
    raw = spark.createDataFrame(
        [(1, r, s, str(30 + r + s / 50), "-100.0") for r in (1, 2) for s in range(3)]
        + [(1, 3, 0, "30", "-100"), (1, 3, 1, "north", "-100"), (1, 3, 2, None, "-100"), (2, 4, 0, "91", "0"), (2, 5, 0, "10", "180.5"), (2, 5, 1, "10", None)],
        "trip_id long, route_id long, seq int, lat string, lon string")
    sound, failed = R.checked_waypoints(raw)
    assert _by_id(failed, "route_id", "error") == {3: ("point 1: coordinate is no number",), 4: ("point 0: coordinate off the globe",),
                                                   5: ("point 0: coordinate off the globe",)}
    assert {r.route_id for r in sound.collect()} == {1, 2}
    # At noon the sound routes are 15 points safer than a failed one, at 17:00 just 5.
    for hour, text in ((12, R.ADVICE_HIGHER % 15.0), (17, R.ADVICE_SIMILAR)):
        risk = R.route_risk(sound, R.score_segments(R.sample_waypoints(sound), hour, 5))
        for overwrite in (False, True):
            got = _by_id(R.route_advice(risk, failed, overwrite), "route_id", "risk_score", "risk_level", "safety_score", "rank", "recommendation")
            assert got[4][:3] == got[5][:3] == (0.5, "UNKNOWN", 50.0)
            assert got[4][4] == got[5][4] == R.ADVICE_FAILED  # a trip of failed routes only
            assert got[1][3:] == (1, R.ADVICE_BEST)
            assert got[3][4] == (text if overwrite else R.ADVICE_FAILED)


def test_no_advice_when_a_failed_route_ranks_first(spark):
    risk = spark.createDataFrame([(1, 1, 0.8, 0.9, 0.7, 20.0, 5, 5, "CRITICAL")],
                                 "trip_id long, route_id long, overall_risk double, max_risk double, min_risk double, "
                                 "safety_score double, segments_scored long, danger_zones long, first_danger_level string")
    failed = spark.createDataFrame([(1, 2, "broken")], "trip_id long, route_id long, error string")
    got = _by_id(R.route_advice(risk, failed), "route_id", "rank", "recommendation", "segments_analyzed")
    assert got == {2: (1, R.ADVICE_FAILED, 0), 1: (2, None, 5)}


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    """Rows that come in one partition reach the learner spread over all cores."""
    rows = (spark.range(400).coalesce(1).selectExpr(
        "CAST(id AS STRING) AS accident_id", "CAST(id % 24 AS INT) AS hour", "CAST(id % 7 AS DOUBLE) AS distance_mi",
        "CAST(id % 2 AS INT) AS is_high_severity", "IF(id % 5 = 0, 'test', 'train') AS split"))
    sizes, fit = [], ML.Pipeline.fit

    def seen(pipe, train, *args):
        sizes.extend(train.groupBy(F.spark_partition_id()).count().toPandas()["count"])
        return fit(pipe, train, *args)

    monkeypatch.setattr(ML.Pipeline, "fit", seen)
    ML.train_gbt(rows, max_iter=1)
    cores = spark.sparkContext.defaultParallelism
    assert sum(sizes) == 320 and len(sizes) == cores and max(sizes) <= 320 / cores + 1
