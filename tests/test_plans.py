"""Plan guards: no catalogue query may contain a Cartesian product or a
nested-loop join, and fixture scans must read pruned columns."""

import pytest

import __spark_entry__ as E
from hazardlens.operators import analytics as A
from paths import SMALL

# These queries execute eagerly (training, streaming, file writes) before
# returning a DataFrame over their output; their plans are scans.
EAGER = {"gbt_scores", "gbt_metrics", "feature_importance", "contributing_factors", "model_metadata",
         "streaming_rule_scores", "hourly_event_window", "csv_roundtrip", "layer_sizes",
         "feature_summary"}
QUERIES = {k: v for k, v in E.queries().items() if k not in E.LLM_QUERIES}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_events_scan_is_pruned(spark):
    plan = _plan(QUERIES["high_risk_segments"](spark, SMALL))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "events" in line]
    assert scans and all("props" not in s for s in scans)


def test_point_lookup_pushes_state_filter(spark):
    plan = _plan(QUERIES["point_lookup"](spark, SMALL))
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(n_name,NATION_1)" in plan


def test_payloads_are_parsed_once(spark):
    assert _plan(QUERIES["route_payloads"](spark, SMALL)).split("Initial Plan")[0].count("from_json") == 1


def test_shares_count_staging_once(spark):
    df = QUERIES["time_shares"](spark, SMALL)
    df.collect()
    plan = _plan(df).split("Initial Plan")[0]
    assert "ReusedExchange" in plan and "Union" not in plan


def test_shares_by_hand(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (None, "b")], "h int, s string")
    got = {(r["dimension"], r["value"]): (r["n"], r["pct"]) for r in A.shares(df, {"hour": "h", "state": "s"}).collect()}
    assert got == {("hour", "1"): (2, 50.0), ("hour", "2"): (1, 25.0), ("hour", None): (1, 25.0),
                   ("state", "a"): (2, 50.0), ("state", "b"): (1, 25.0), ("state", None): (1, 25.0)}
    assert A.shares(df.where("false"), {"hour": "h"}).count() == 0
