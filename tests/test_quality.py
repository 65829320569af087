"""Quality checks on a literal raw table with every kind of problem planted."""

from hazardlens.operators import quality as Q

ROWS = [
    # ID, Severity, Start_Time, Start_Lat, Start_Lng, State
    ("a", 1, "2024-01-01 10:00:00", 30.0, -100.0, "TX"),
    ("a", 2, "2024-01-01 11:00:00", 30.0, -100.0, "TX"),        # duplicate id
    ("b", 5, "2024-01-02 10:00:00", 51.0, -100.0, "CA"),        # bad severity, lat > 50
    ("c", None, "not-a-date", 23.0, -131.0, "CA"),              # null severity, bad date, lat < 24, lng < -130
    ("d", 3, "2031-05-05 00:00:00", None, -59.0, None),         # future, null lat, lng > -60
    (None, 4, None, 40.0, -90.0, "NY"),                         # null id, missing time
    (None, 4, "2024-01-03 00:00:00", 40.0, -90.0, "NY"),        # second null id (nulls group together)
]
SCHEMA = "ID string, Severity int, Start_Time string, Start_Lat double, Start_Lng double, State string"


def _df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_null_counts_and_profile(spark):
    got = {r.column: (r.null_count, r.null_pct) for r in Q.null_counts(_df(spark), Q.CRITICAL_COLUMNS).collect()}
    assert got["ID"][0] == 2 and got["Severity"][0] == 1 and got["Start_Time"][0] == 1
    assert abs(got["ID"][1] - 200 / 7) < 1e-12
    prof = [r.column for r in Q.null_counts(_df(spark), nonzero_only=True).collect()]
    assert prof[0] == "ID" and "Start_Lng" not in prof


def test_value_set_range_duplicates_dates(spark):
    df = _df(spark)
    v = Q.value_set_check(df).first()
    assert (v.invalid_count, v.distinct_invalid_values, v.rows_checked) == (2, 1, 7)
    assert {(r.value, r.n) for r in Q.invalid_values(df).collect()} == {("5", 1), (None, 1)}
    r = Q.range_check(df).first()
    assert (r.lat_out_of_range, r.lng_out_of_range) == (2, 2)
    d = Q.duplicate_summary(df).first()
    assert (d.duplicate_keys, d.duplicate_rows) == (2, 4)
    dc = Q.date_check(df, as_of="2026-01-01 00:00:00").first()
    assert (dc.unparseable, dc.missing, dc.future_rows) == (1, 1, 1)
    assert str(dc.min_time) == "2024-01-01 10:00:00"


def test_report_flags_failures(spark):
    rep = {r.check: (r.issue_count, r.passed) for r in Q.quality_report(_df(spark)).collect()}
    assert rep["duplicate_ids"] == (4, False)
    assert rep["severity_range"] == (2, False)
    assert rep["latitude_range"] == (2, False) and rep["longitude_range"] == (2, False)
    assert rep["future_dates"] == (1, False) and rep["nulls:Start_Lat"] == (1, False)
    assert rep["required_columns"] == (0, True)
    partial = {r.check: r.issue_count for r in Q.quality_report(_df(spark).drop("State")).collect()}
    assert partial["required_columns"] == 1


def test_route_payload_parser(spark):
    from hazardlens.operators.enrich import parse_route_payloads
    full = ('{"summary": "I-17 N", "overview_polyline": {"points": "abc"}, "legs": [{"distance": '
            '{"text": "116 mi", "value": 186000}, "duration": {"text": "1 hour 52 mins", "value": 6720}, '
            '"duration_in_traffic": {"text": "2 hours", "value": 7200}}]}')
    no_traffic = full.replace(', "duration_in_traffic": {"text": "2 hours", "value": 7200}', "")
    no_legs = '{"summary": "x", "overview_polyline": {"points": "abc"}}'
    no_poly = full.replace('"overview_polyline": {"points": "abc"}, ', "")
    broken = full[:30]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([full, no_traffic, no_legs, no_poly, broken])],
                               "route_id int, payload string")
    rows = {r.route_id: r for r in parse_route_payloads(df).collect()}
    assert set(rows) == {0, 1}
    assert rows[0].distance_meters == 186000 and rows[0].duration_in_traffic_seconds == 7200
    assert rows[1].duration_in_traffic_text is None and rows[1].summary == "I-17 N"


def test_weather_payload_parser(spark):
    from hazardlens.operators.enrich import parse_weather_payloads
    full = ('{"main": {"temp": 300.15, "humidity": 61}, "weather": [{"id": 502, "description": "heavy rain"}], '
            '"visibility": 3218.68, "wind": {"speed": 4.0}}')
    sparse = '{"main": {"temp": 273.15}, "weather": [{"id": 9999}]}'
    bad = full[:25]
    df = spark.createDataFrame([(0, full), (1, sparse), (2, bad)], "obs_id int, payload string")
    r = {x.obs_id: x for x in parse_weather_payloads(df).collect()}
    assert (r[0].temperature_f, r[0].weather_condition, r[0].visibility_mi, r[0].humidity_pct,
            r[0].wind_speed_mph, r[0].description) == (80.6, "Heavy Rain", 2.0, 61.0, 8.9, "heavy rain")
    # absent visibility -> 10 000 m, humidity -> 50, wind -> 0; unknown code -> Clear
    assert (r[1].temperature_f, r[1].weather_condition, r[1].visibility_mi, r[1].humidity_pct,
            r[1].wind_speed_mph, r[1].description) == (32.0, "Clear", 6.2, 50.0, 0.0, "Clear")
    assert (r[2].parsed, r[2].weather_condition, r[2].temperature_f, r[2].wind_speed_mph) == (False, "Clear", 70.0, 5.0)
