"""Data-quality checks (Q1-Q8, D2). Every check emits rows, not prints.

All per-column counts are computed in a single aggregation pass over the
table (one job, partial aggregation per task) and reshaped with ``stack``
into one row per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values from the reference configuration.
REQUIRED_COLUMNS = ["ID", "Severity", "Start_Time", "Start_Lat", "Start_Lng", "State"]
CRITICAL_COLUMNS = ["ID", "Severity", "Start_Time", "Start_Lat", "Start_Lng"]
SEVERITY_LEVELS = [1, 2, 3, 4]
LAT_RANGE = (24.0, 50.0)
LNG_RANGE = (-130.0, -60.0)


def _q(name: str) -> str:
    return f"`{name}`"


def _count_when(cond) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def required_columns(spark: SparkSession, df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """Q1: one row per required column with a ``present`` flag (schema only, no scan)."""
    present = set(df.columns)
    return spark.createDataFrame([(c, c in present) for c in required],
                                 "column string, present boolean")


def null_counts(df: DataFrame, cols: list | None = None, nonzero_only: bool = False) -> DataFrame:
    """Q2/Q3: null count and percent of rows for each column, one pass.

    ``cols=None`` profiles every column (Q3); ``nonzero_only`` keeps columns
    with nulls, largest first.
    """
    cols = [c for c in (cols or df.columns) if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [_count_when(F.col(_q(c)).isNull()).alias(f"__null_{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    args = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', `__null_{i}`" for i, c in enumerate(cols))
    long = one.selectExpr("__n", f"stack({len(cols)}, {args}) as (column, null_count)")
    out = long.select("column", "null_count",
                      F.try_divide(F.col("null_count").cast("double") * 100.0,
                                   F.col("__n").cast("double")).alias("null_pct"))
    if nonzero_only:
        out = out.where(F.col("null_count") > 0).orderBy(F.desc("null_count"), "column")
    return out


def value_set_check(df: DataFrame, col: str = "Severity", valid=SEVERITY_LEVELS) -> DataFrame:
    """Q4: rows whose value is outside the valid set (null counts as invalid)."""
    c = F.col(_q(col))
    bad = c.isNull() | ~c.isin(*valid)
    return df.agg(F.lit(col).alias("column"),
                  _count_when(bad).alias("invalid_count"),
                  F.count_distinct(F.when(bad, c)).alias("distinct_invalid_values"),
                  F.count(F.lit(1)).alias("rows_checked"))


def invalid_values(df: DataFrame, col: str = "Severity", valid=SEVERITY_LEVELS) -> DataFrame:
    """Q4 detail: each invalid value with its count (a distributed group-by)."""
    c = F.col(_q(col))
    return (df.where(c.isNull() | ~c.isin(*valid))
            .groupBy(c.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")))


def range_check(df: DataFrame, lat_col: str = "Start_Lat", lng_col: str = "Start_Lng",
                lat_range=LAT_RANGE, lng_range=LNG_RANGE) -> DataFrame:
    """Q5: out-of-range coordinate counts (nulls are not flagged)."""
    la, lo = F.col(_q(lat_col)), F.col(_q(lng_col))
    return df.agg(_count_when((la < lat_range[0]) | (la > lat_range[1])).alias("lat_out_of_range"),
                  _count_when((lo < lng_range[0]) | (lo > lng_range[1])).alias("lng_out_of_range"),
                  F.count(F.lit(1)).alias("rows_checked"))


def duplicate_keys(df: DataFrame, key: str = "ID") -> DataFrame:
    """Keys occurring more than once and how many rows they cover.

    Null keys are grouped together (counted as equal), as a keep-all
    duplicate report does. Partial aggregation keeps a hot key cheap.
    """
    return (df.groupBy(F.col(_q(key)).alias("key")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def duplicate_summary(df: DataFrame, key: str = "ID") -> DataFrame:
    d = duplicate_keys(df, key)
    return d.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                 F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def date_check(df: DataFrame, col: str = "Start_Time", as_of: str = "2026-01-01 00:00:00") -> DataFrame:
    """Q7: unparseable timestamps, min/max parsed value, rows after ``as_of``.

    ``as_of`` replaces the wall-clock "now" so the check is reproducible.
    """
    raw = F.col(_q(col))
    ts = raw.cast("string").try_cast("timestamp_ntz")
    limit = F.lit(as_of).cast("timestamp_ntz")
    return df.agg(_count_when(ts.isNull() & raw.isNotNull()).alias("unparseable"),
                  _count_when(raw.isNull()).alias("missing"),
                  F.min(ts).alias("min_time"), F.max(ts).alias("max_time"),
                  _count_when(ts > limit).alias("future_rows"))


def quality_report(df: DataFrame, as_of: str = "2026-01-01 00:00:00") -> DataFrame:
    """Q8: one row per check with its issue count and pass/fail.

    All measurements come from one aggregation over the table plus one
    grouped pass for duplicate keys.
    """
    present = set(df.columns)
    missing_req = [c for c in REQUIRED_COLUMNS if c not in present]
    crit = [c for c in CRITICAL_COLUMNS if c in present]
    sev, lat, lng, st = F.col("Severity"), F.col("Start_Lat"), F.col("Start_Lng"), F.col("Start_Time")
    ts = st.cast("string").try_cast("timestamp_ntz")
    aggs = [_count_when(F.col(_q(c)).isNull()).alias(f"null_{c}") for c in crit]
    aggs += [
        _count_when(sev.isNull() | ~sev.isin(*SEVERITY_LEVELS)).alias("invalid_severity"),
        _count_when((lat < LAT_RANGE[0]) | (lat > LAT_RANGE[1])).alias("lat_out_of_range"),
        _count_when((lng < LNG_RANGE[0]) | (lng > LNG_RANGE[1])).alias("lng_out_of_range"),
        _count_when(ts > F.lit(as_of).cast("timestamp_ntz")).alias("future_dates"),
    ]
    one = df.agg(*aggs)
    checks = [(f"nulls:{c}", f"null_{c}") for c in crit]
    checks += [("severity_range", "invalid_severity"), ("latitude_range", "lat_out_of_range"),
               ("longitude_range", "lng_out_of_range"), ("future_dates", "future_dates")]
    args = ", ".join(f"'{name}', CAST(`{col}` AS BIGINT)" for name, col in checks)
    long = one.selectExpr(f"stack({len(checks)}, {args}) as (check, issue_count)")
    dups = duplicate_summary(df).select(F.lit("duplicate_ids").alias("check"),
                                        F.col("duplicate_rows").alias("issue_count"))
    long = long.unionByName(dups).unionByName(
        long.sparkSession.createDataFrame([("required_columns", len(missing_req))],
                                          "check string, issue_count bigint"))
    return long.withColumn("passed", F.col("issue_count") == 0).orderBy("check")
