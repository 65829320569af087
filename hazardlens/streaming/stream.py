"""Structured Streaming versions of scoring and hourly profiles.

Both run the *same* DataFrame transforms as the batch operators on a
``readStream`` source. Sinks are Parquet folders with their checkpoint in
the shared ``spark.checkpoint.dir``, so a restarted query resumes exactly
once; ``availableNow`` processes everything present and stops (a
back-fill), while a processing-time trigger keeps the query running.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlens.functions import columns as C
from hazardlens.operators import scoring as SC
from hazardlens.operators import staging as S
from hazardlens.session import checkpoint_dir
from hazardlens.sources import fixtures as FX
from hazardlens.sources.tables import load_table, table_path

WATERMARK = "30 minutes"
WINDOW = "1 hour"


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a stream (schema taken from the table, no inference).

    Event time is cast from wall-clock to TIMESTAMP, which watermarks need.
    """
    schema = load_table(spark, sf_dir, "events").schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    path = table_path(sf_dir, "events")
    if not os.path.isdir(path):
        # A single-file table: the file source watches folders, so point it at
        # the file through a one-file glob in its folder.
        path = os.path.join(os.path.dirname(path), "[e]" + os.path.basename(path)[1:])
    return r.parquet(path)


def _run(df: DataFrame, name: str, mode: str = "append", trigger: dict | None = None,
         partition_by: list | None = None, run_id: str | None = None) -> str:
    """Start a Parquet sink under the shared checkpoint folder and wait for
    the available data to be processed. Returns the output path.

    With a ``run_id`` the sink and checkpoint paths are stable, so a rerun
    (or a restart after a failure) resumes where the last one committed;
    without one every call is a fresh back-fill."""
    tag = run_id or uuid.uuid4().hex[:12]
    base = os.path.join(checkpoint_dir(df.sparkSession), "streams", f"{name}-{tag}")
    w = (df.writeStream.outputMode(mode).format("parquet")
         .option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "checkpoint")))
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    return os.path.join(base, "out")


def _run_windows(df: DataFrame, name: str, keys: list, run_id: str | None = None) -> DataFrame:
    """Run a windowed aggregation in update mode and read back the newest
    state of every window, the still open ones included. Each micro-batch
    writes the windows it changed under its own number, so a replayed batch
    overwrites itself; the watermark bounds the state as in append mode."""
    tag = run_id or uuid.uuid4().hex[:12]
    base = os.path.join(checkpoint_dir(df.sparkSession), "streams", f"{name}-{tag}")
    out = os.path.join(base, "out")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch}"))

    q = (df.writeStream.outputMode("update").option("checkpointLocation", os.path.join(base, "checkpoint"))
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    values = [c for c in df.columns if c not in keys]
    stored = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    return (stored.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
            .select(*keys, *[F.col(f"v.{c}").alias(c) for c in values]))


def streaming_rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents arriving as a stream are staged and rule-scored.

    The stream is joined to the static customer/nation dimensions (a
    stream-static join) exactly as the batch fixture does, so the output
    equals the batch ``rule_scores`` table.
    """
    ev = events_stream(spark, sf_dir)
    raw = FX.incidents_from_events(spark, sf_dir, ev)
    scored = SC.describe_scores(SC.rule_score(S.stage_incidents(raw)))
    out = _run(scored.select("ID", "risk_score", "risk_level", "confidence", "safety_score"),
               "rule-scores")
    return spark.read.parquet(out)


def streaming_request_scores(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """X1 (request path): requests arriving as a stream are defaulted,
    validated and rule-scored; invalid ones get the fallback score. Every
    step is a stateless projection, so the batch functions run unchanged."""
    from hazardlens.operators import requests as RQ
    ev = events_stream(spark, sf_dir)
    reqs = FX.prediction_requests(S.stage_incidents(FX.incidents_from_events(spark, sf_dir, ev)))
    scored = SC.score_requests(RQ.validate_requests(reqs))
    out = _run(scored.select("request_id", "valid", "risk_score", "risk_level", "confidence"),
               "request-scores", run_id=run_id)
    return spark.read.parquet(out)


SCORED = ["request_id", "risk_score", "risk_level", "confidence", "contributing_factors"]
REJECTED = ["request_id", "errors", "risk_score", "risk_level", "confidence"]


def write_scored(rows: DataFrame, base: str, batch: int) -> None:
    """The valid requests of one micro-batch, under its own number."""
    rows.where("valid").select(*SCORED).write.mode("overwrite").parquet(os.path.join(base, "scored", f"batch={batch}"))


def write_rejected(rows: DataFrame, base: str, batch: int) -> None:
    """The rejected requests of one micro-batch, with their errors."""
    rows.where("not valid").select(*REJECTED).write.mode("overwrite").parquet(os.path.join(base, "rejected", f"batch={batch}"))


def score_request_stream(requests: DataFrame, model, base: str, trigger: dict | None = None) -> None:
    """X1 with the trained model: requests arriving as a stream are defaulted,
    validated and scored by the loaded pipeline; valid and rejected ones go to
    two sinks, ``base/scored`` and ``base/rejected``.

    One function writes both sinks of a micro-batch. Each writes under the
    batch's number and replaces what is there, so a batch that is replayed
    after a failure between the two leaves the same files as one that was not.
    """
    from hazardlens.operators import requests as RQ
    from hazardlens.operators import serving as SV

    def write(rows: DataFrame, batch: int) -> None:
        done = SV.predict_requests(model, RQ.validate_requests(rows)).persist()
        try:
            write_scored(done, base, batch)
            write_rejected(done, base, batch)
        finally:
            done.unpersist()

    q = (requests.writeStream.option("checkpointLocation", os.path.join(base, "checkpoint"))
         .foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()


def streaming_model_scores(spark: SparkSession, sf_dir: str, model, run_id: str | None = None,
                           max_files_per_trigger: int | None = None) -> DataFrame:
    """Run ``score_request_stream`` over all requests and read both sinks back:
    request_id, valid, errors, risk_score, risk_level, confidence. With a
    ``run_id`` a rerun goes on where the last one stopped."""
    base = os.path.join(checkpoint_dir(spark), "streams", f"model-scores-{run_id or uuid.uuid4().hex[:12]}")
    ev = events_stream(spark, sf_dir, max_files_per_trigger)
    score_request_stream(FX.prediction_requests(S.stage_incidents(FX.incidents_from_events(spark, sf_dir, ev))), model, base)
    columns = ["request_id", "risk_score", "risk_level", "confidence"]
    scored = spark.read.parquet(os.path.join(base, "scored")).select(*columns, F.lit(True).alias("valid"), F.lit("").alias("errors"))
    rejected = spark.read.parquet(os.path.join(base, "rejected")).select(*columns, F.lit(False).alias("valid"), "errors")
    return scored.unionByName(rejected).select("request_id", "valid", "errors", "risk_score", "risk_level", "confidence")


def hourly_event_profile_stream(events: DataFrame, watermark: str = WATERMARK,
                                window: str = WINDOW) -> DataFrame:
    """X2 transform: per (hour window, event type) count and value sum, with a
    watermark so state is dropped once a window can no longer change and
    rows later than the watermark are ignored."""
    ts = F.col("ts").cast("timestamp")
    return (events.withColumn("event_time", ts)
            .withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", window).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "event_type", "n", C.round_half_away("value_sum", 6).alias("value_sum")))


def hourly_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the windowed aggregation as a stream over all available events
    and read every window back."""
    return _run_windows(hourly_event_profile_stream(events_stream(spark, sf_dir)), "hourly-events",
                        ["window_start", "window_end", "event_type"])


def hourly_incident_profile_stream(staged: DataFrame, watermark: str = WATERMARK,
                                   window: str = WINDOW) -> DataFrame:
    """X2 on incidents (the hourly risk profile over event time): per hour
    window, incident count, mean severity and high-severity count; state is
    dropped once the watermark passes a window."""
    return (staged.withColumn("event_time", F.col("start_time").cast("timestamp"))
            .withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("accident_count"),
                 F.avg("Severity").alias("avg_severity"),
                 F.sum(F.when(F.col("is_high_severity"), 1).otherwise(0)).cast("bigint")
                 .alias("high_severity_count"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "accident_count", C.round_half_away("avg_severity", 6).alias("avg_severity"),
                    "high_severity_count"))


def hourly_incident_window(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """Incidents streamed through staging into watermarked hourly windows."""
    staged = S.stage_incidents(FX.incidents_from_events(spark, sf_dir, events_stream(spark, sf_dir)))
    return _run_windows(hourly_incident_profile_stream(staged), "hourly-incidents",
                        ["window_start", "window_end"], run_id=run_id)
