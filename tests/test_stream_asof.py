"""As-of join against brute force (and invariance to the range split), and
late-data handling of the watermarked hourly stream."""

import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hazardlens.operators import enrich as EN
from hazardlens.sources import fixtures as FX
from hazardlens.streaming import stream as ST
from paths import SMALL


def _brute(points, obs, max_age=timedelta(minutes=30)):
    out = {}
    for p in points:
        cands = [o for o in obs if round(o["lat"], 2) == round(p["lat"], 2)
                 and round(o["lon"], 2) == round(p["lon"], 2)
                 and p["ts"] - max_age <= o["obs_ts"] < p["ts"]]
        best = max(cands, key=lambda o: (o["obs_ts"], o["obs_id"]), default=None)
        out[p["point_id"]] = best["obs_id"] if best else None
    return out


def test_asof_matches_brute_force_and_range_split(spark):
    pts = FX.query_points(spark, SMALL)
    obs = FX.observations(spark, SMALL)
    want = _brute([r.asDict() for r in pts.collect()], [r.asDict() for r in obs.collect()])
    for parts in (None, 1, 23):
        got = {r.point_id: r.obs_id for r in
               EN.freshest_weather(pts, obs, parts=parts).select("point_id", "obs_id").collect()}
        assert got == want, parts
    assert any(v is not None for v in want.values()) and any(v is None for v in want.values())


def test_watermark_drops_late_rows(spark):
    """Batch 0 moves the watermark to 11:30; batch 1 closes the 8:00 window
    (emitted once, n=1); a row for 8:10 arriving in batch 2 is older than the
    watermark that batch checks lateness against and is dropped."""
    base = datetime(2024, 1, 1, 8, 0, 0)
    d = tempfile.mkdtemp(prefix="hl-stream-")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    batches = [[(1, base, 1, "click", 1.0, "{}"), (2, base + timedelta(hours=4), 1, "click", 1.0, "{}")],
               [(3, base + timedelta(hours=4, minutes=5), 1, "click", 1.0, "{}")],
               [(4, base + timedelta(minutes=10), 1, "click", 1.0, "{}")]]
    src = os.path.join(d, "src")
    os.makedirs(src)
    for i, rows in enumerate(batches):  # one file per micro-batch, in this order
        tmp = os.path.join(d, f"t{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(tmp)
        f = [x for x in os.listdir(tmp) if x.endswith(".parquet")][0]
        dst = os.path.join(src, f"part-{i}.parquet")
        with open(os.path.join(tmp, f), "rb") as fi, open(dst, "wb") as fo:
            fo.write(fi.read())
        os.utime(dst, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = ST._run(ST.hourly_event_profile_stream(ev), "late-test")
    rows = spark.read.parquet(out).collect()
    eight = [r for r in rows if r.window_start == base]
    assert len(eight) == 1 and eight[0].n == 1      # closed once, late row dropped
    assert all(r.window_start != base + timedelta(hours=4) for r in rows)  # 12:00 still open


def test_route_sample_indices_follow_python_round(spark):
    from hazardlens.operators.enrich import route_sample_points
    rows = [(1, i, 0.0, 0.0) for i in range(60)] + [(2, i, 0.0, 0.0) for i in range(4)] \
        + [(3, i, 0.0, 0.0) for i in range(7)]
    wp = spark.createDataFrame(rows, "route_id long, seq int, lat double, lon double")
    got = {}
    for r in route_sample_points(wp).collect():
        got.setdefault(r.route_id, []).append(r.seq)
    for rid, n in ((1, 60), (2, 4), (3, 7)):
        want = list(range(n)) if n <= 5 else [round(i * (n - 1) / 4) for i in range(5)]
        assert sorted(got[rid]) == want, rid


def test_asof_excludes_same_instant_and_stale(spark):
    t0 = datetime(2024, 1, 1, 12, 0, 0)
    obs = spark.createDataFrame(
        [(1, 30.0, -100.0, t0 - timedelta(minutes=31), 800, 280.0, 5000.0, 1.0, 40.0),   # too old
         (2, 30.0, -100.0, t0 - timedelta(minutes=30), 501, 281.0, 5000.0, 1.0, 40.0),   # exactly 30 min: valid
         (3, 30.0, -100.0, t0, 741, 282.0, 5000.0, 1.0, 40.0),                            # same instant: excluded
         (4, 30.001, -100.0, t0 - timedelta(minutes=1), 600, 283.0, 5000.0, 1.0, 40.0)],  # same 2-digit cell
        "obs_id long, lat double, lon double, obs_ts timestamp_ntz, code int, temp_k double, "
        "visibility_m double, wind_ms double, humidity double")
    pts = spark.createDataFrame([(10, 30.0, -100.0, t0), (11, 30.0, -100.0, t0 - timedelta(minutes=31))],
                                "point_id long, lat double, lon double, ts timestamp_ntz")
    got = {r.point_id: r.obs_id for r in EN.freshest_weather(pts, obs).collect()}
    assert got == {10: 4, 11: None}


def test_asof_spreads_a_hot_cell(spark):
    """Nine tenths of all rows in one cell and half an hour: no range holds
    more than a twentieth of them, and readings are carried over the ranges."""
    from hazardlens.operators import running
    t0 = datetime(2024, 1, 1, 12, 0, 0)
    at = lambda i: F.lit(t0) + F.make_dt_interval(secs=i)
    rows = spark.range(20_000)
    i = F.col("id")
    lat = F.when(i % 10 == 0, (40 + i % 50).cast("double")).otherwise(F.lit(30.0))
    # In the hot cell a single early reading serves points for half an hour.
    obs = spark.createDataFrame([(1, 30.0, 0.0, t0, 9.0)], "obs_id long, lat double, lon double, obs_ts timestamp_ntz, temp_k double") \
        .union(rows.where("id % 10 = 0").select(i + 2, lat, F.lit(0.0), at((i % 1700).cast("int")).cast("timestamp_ntz"), F.lit(1.0)))
    pts = rows.where("id % 10 <> 0").select(i.alias("point_id"), lat.alias("lat"), F.lit(0.0).alias("lon"),
                                            at((1 + i % 1799).cast("int")).cast("timestamp_ntz").alias("ts"))
    kept = {}
    whole = running._ranged

    def ranged(df, order, parts=None):
        kept["sizes"] = whole(df, order, parts)
        return kept["sizes"]

    running._ranged = ranged
    try:
        got = EN.freshest_weather(pts, obs, parts=64)
        assert got.where("obs_id = 1").count() == 18_000 == got.count()
    finally:
        running._ranged = whole
    assert max(r["count"] for r in kept["sizes"].groupBy("__pid").count().collect()) < 0.05 * 20_001


def test_windows_hold_every_event(spark, tmp_path):
    """Open windows are read back too, and a window fed by several batches
    keeps its newest state."""
    import datetime as dt
    from hazardlens.streaming import stream as ST
    src = str(tmp_path / "in")
    at = dt.datetime(2024, 1, 1, 8, 0)
    for part in range(3):
        rows = [(at + dt.timedelta(minutes=10 * i + part), "click", 1.0) for i in range(12)]
        spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").coalesce(1) \
            .write.mode("append").parquet(src)
    ev = (spark.readStream.schema("ts timestamp_ntz, event_type string, value double")
          .option("maxFilesPerTrigger", 1).parquet(src))
    got = ST._run_windows(ST.hourly_event_profile_stream(ev, watermark="1 day"), "whole-test",
                          ["window_start", "window_end", "event_type"]).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.n, r.value_sum) for r in got] == [(8, 18, 18.0), (9, 18, 18.0)]
