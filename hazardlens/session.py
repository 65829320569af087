"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

# Settings that matter at 100 TB as much as on a laptop: AQE re-plans joins
# and partition counts from runtime statistics, splits skewed join
# partitions, and keeps the automatic broadcast behind a size check.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app_name: str = "hazardlens", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the scale defaults above.

    ``master`` is only applied when given, so on a cluster the launcher's
    master wins. ``shuffle_partitions`` should be sized to the data: about
    one partition per 128 MB of shuffled data (AQE coalesces the rest).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read.
    It is set here (to a fresh local folder) only when unset and the master
    is ``local[*]``, as in tests; any other master needs the setting. Sessions
    without a local SparkContext (Spark Connect) keep whatever the server is
    configured with.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: no driver-side context)
        sc = None
    if not current and sc is not None and hasattr(sc, "getCheckpointDir"):
        current = sc.getCheckpointDir()
    if not current:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder (master is {master!r})")
        import tempfile
        current = tempfile.mkdtemp(prefix="hazardlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name)
