"""Feature engineering: source projection, imputation, encodings, derived
features, the fixed 33-feature layout and the hash split (F11-F13, M1-M10).

Fitting (medians, modes, encodings) is a distributed aggregation whose
result is small and bounded: one row of fill values, or one row per
distinct category. Applying them is a projection or an equi-join that AQE
broadcasts when the category table is under the size threshold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.functions import columns as C
from hazardlens.operators.running import running_sums
from hazardlens.session import scratch_path

# Column groups and the 33-feature order used at training
# and scoring time.
SOURCE_COLUMNS = [
    ("ID", "accident_id"), ("hour", "hour"), ("day_of_week", "day_of_week"),
    ("is_weekend", "is_weekend"), ("time_period", "time_period"), ("month", "month"),
    ("year", "year"), ("State", "state"), ("City", "city"), ("latitude", "latitude"),
    ("longitude", "longitude"), ("temperature_f", "temperature_f"),
    ("humidity_pct", "humidity_pct"), ("pressure_in", "pressure_in"),
    ("visibility_mi", "visibility_mi"), ("wind_speed_mph", "wind_speed_mph"),
    ("precipitation_in", "precipitation_in"), ("weather_condition", "weather_condition"),
] + [(f, f) for f in C.ROAD_FLAGS] + [
    ("distance_mi", "distance_mi"), ("duration_minutes", "duration_minutes"),
    ("is_high_severity", "is_high_severity"),
]
NUMERIC_IMPUTE = ["temperature_f", "humidity_pct", "pressure_in", "visibility_mi",
                  "wind_speed_mph", "precipitation_in", "distance_mi", "duration_minutes",
                  "latitude", "longitude"]
CATEGORICAL_IMPUTE = ["state", "city", "weather_condition", "time_period"]
TEMPORAL_IMPUTE = ["hour", "day_of_week", "month", "year"]
FEATURE_ORDER = [
    "hour", "day_of_week", "is_weekend", "month", "time_period_encoded",
    "is_rush_hour", "state_encoded", "city_encoded", "latitude", "longitude",
    "temperature_f", "humidity_pct", "pressure_in", "visibility_mi",
    "wind_speed_mph", "precipitation_in", "weather_encoded", "poor_weather",
    "extreme_temp", "has_amenity", "has_bump", "has_crossing", "has_give_way",
    "has_junction", "has_no_exit", "has_railway", "has_roundabout", "has_station",
    "has_stop", "has_traffic_calming", "has_traffic_signal", "road_feature_count",
    "distance_mi",
]
ID_COL, LABEL_COL = "accident_id", "is_high_severity"


def feature_source(staged: DataFrame) -> DataFrame:
    """the feature columns of staging, labelled rows only."""
    present = set(staged.columns)
    return (staged.where(F.col("is_high_severity").isNotNull())
            .select(*[F.col(src).alias(dst) for src, dst in SOURCE_COLUMNS if src in present]))


def written_source(staged: DataFrame) -> DataFrame:
    """F11, written once to the shared checkpoint folder and read back."""
    spark = staged.sparkSession
    path = scratch_path(spark, f"feature-source-{uuid.uuid4().hex[:12]}")
    feature_source(staged).write.parquet(path)
    return spark.read.parquet(path)


# M1-M4 -----------------------------------------------------------------------

def _modes(df: DataFrame, cols: list) -> dict:
    """Most frequent non-null value of each column (lowest value on ties).

    One distributed pass for all columns: every row emits (column, value)
    pairs, a group-by counts them (partial aggregation absorbs hot values),
    and a second group-by per column keeps the best pair with ``min_by`` -
    a bounded aggregate, never a map of all distinct values in one task.
    """
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    counts = (df.select(F.explode(pairs).alias("p")).where(F.col("p.value").isNotNull())
              .groupBy("p.col", "p.value").agg(F.count(F.lit(1)).alias("n")))
    types = dict(df.dtypes)
    order_key = F.struct(-F.col("n"), *[F.when(F.col("col") == c, F.col("value").cast(types[c]))
                                        .alias(f"k{i}") for i, c in enumerate(cols)])
    best = counts.groupBy("col").agg(F.min_by("value", order_key).alias("value"))
    return {r["col"]: r["value"] for r in best.collect()}  # one row per column


def fit_imputer(df: DataFrame, exact: bool = True, distributed: bool = True) -> dict:
    """Fill values for the columns that contain nulls: medians (numeric),
    modes (categorical -> 'Unknown' when a column is all null, temporal),
    False for booleans. Returns a small dict (one value per column).

    Pass 1 counts nulls of every candidate column in one aggregation; only
    columns with nulls are then summarised, as the reference does. Medians
    are exact - by rank selection over ranges (default) or Spark's
    ``percentile`` aggregate (``distributed=False``) - or sketch-based with
    ``exact=False``.
    """
    num = [c for c in NUMERIC_IMPUTE if c in df.columns]
    cat = [c for c in CATEGORICAL_IMPUTE if c in df.columns]
    tmp = [c for c in TEMPORAL_IMPUTE if c in df.columns]
    cand = num + cat + tmp
    fills = {c: False for c in df.columns if c.startswith("has_") or c == "is_weekend"}
    if not cand:
        return fills
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cand]).first().asDict()
    need = [c for c in cand if nulls[c] > 0]
    med_cols = [c for c in num if c in need]
    if med_cols and exact and distributed:
        from hazardlens.operators.quantiles import exact_quantiles_multi
        qs = exact_quantiles_multi(df, med_cols, [0.5])
        fills.update({c: float(qs[c][0]) for c in med_cols if qs[c][0] is not None})
    elif med_cols:
        med = (lambda c: F.median(F.col(c).cast("double"))) if exact else \
              (lambda c: F.percentile_approx(F.col(c).cast("double"), 0.5, 10000))
        row = df.agg(*[med(c).alias(c) for c in med_cols]).first().asDict()
        fills.update({c: float(row[c]) for c in med_cols if row[c] is not None})
    modes = _modes(df, [c for c in cat + tmp if c in need])
    types = dict(df.dtypes)
    for c in cat:
        if c in need:
            fills[c] = modes.get(c, "Unknown")
    for c in tmp:
        if c in need and c in modes:
            fills[c] = int(modes[c]) if types[c] in ("int", "bigint", "smallint", "tinyint") else modes[c]
    return fills


def apply_imputer(df: DataFrame, fills: dict) -> DataFrame:
    """coalesce each column with its fill value.

    Median-filled numeric columns become double (a median of integers can
    be fractional); the other columns keep their type.
    """
    out = []
    dtypes = dict(df.dtypes)
    for c in df.columns:
        if c in NUMERIC_IMPUTE:
            v = F.col(c).cast("double")
            out.append((F.coalesce(v, F.lit(fills[c])) if c in fills else v).alias(c))
        elif c in fills:
            out.append(F.coalesce(F.col(c), F.lit(fills[c]).cast(dtypes[c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def impute(df: DataFrame, exact: bool = True) -> DataFrame:
    return apply_imputer(df, fit_imputer(df, exact))


# M5 / M6 / W2 / J1 -----------------------------------------------------------

def ordinal(df: DataFrame, order: list, out: str = "code") -> DataFrame:
    """0-based position of every row in a total order, computed without a
    single-partition window.

    Made of running sums; the order must be total (unique keys), as it is for
    distinct values.
    """
    placed = running_sums(df.withColumn("__one", F.lit(1)), order, {"__at": "__one"})
    return placed.withColumn(out, (F.col("__at") - 1).cast("int")).drop("__one", "__at")


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """Alphabetical 0-based code per distinct value (a label encoder)."""
    v = F.coalesce(F.col(col).cast("string"), F.lit("None"))
    return ordinal(df.select(v.alias("value")).distinct(), [F.col("value")]).select("value", "code")


def frequency_codes(df: DataFrame, col: str) -> DataFrame:
    """0-based rank by descending frequency, ties alphabetical."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return ordinal(counts, [F.desc("n"), F.asc_nulls_first("value")]).select("value", "n", "code")


def encode(df: DataFrame, col: str, codes: DataFrame, out: str,
           null_as_text: bool = True) -> DataFrame:
    """Attach a code by an equi left join on the value.

    The code table has one row per distinct category; AQE broadcasts it
    when it is below the broadcast threshold and otherwise uses a
    sort-merge join whose skewed partitions it splits.
    """
    key = F.coalesce(F.col(col).cast("string"), F.lit("None")) if null_as_text else F.col(col)
    j = df.withColumn("__k", key)
    c = codes.select(F.col("value").alias("__k"), F.col("code").alias(out))
    return j.join(c, "__k", "left").drop("__k")


def encode_categoricals(df: DataFrame, compat_periods: bool = True) -> DataFrame:
    out = df
    if "state" in df.columns:
        out = encode(out, "state", label_codes(df, "state"), "state_encoded")
    if "city" in df.columns:
        out = encode(out, "city", frequency_codes(df, "city"), "city_encoded",
                     null_as_text=False)
    if "weather_condition" in df.columns:
        out = encode(out, "weather_condition", label_codes(df, "weather_condition"), "weather_encoded")
    if "time_period" in df.columns:
        out = out.withColumn("time_period_encoded",
                             C.period_label_code("time_period", compat=compat_periods))
    return out


# M7 ----------------------------------------------------------------------------

def add_derived(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    out = df
    flags = [f for f in C.ROAD_FLAGS if f in cols]
    if flags:
        out = out.withColumn("road_feature_count", C.flag_count(flags))
    if "hour" in cols:
        out = out.withColumn("is_rush_hour", C.is_rush_hour("hour", "training"))
    if {"visibility_mi", "precipitation_in"} <= cols:
        out = out.withColumn("poor_weather", C.poor_weather_numeric("visibility_mi", "precipitation_in"))
    if "temperature_f" in cols:
        out = out.withColumn("extreme_temp", C.extreme_temp("temperature_f"))
    return out


# M8 / F12 / F13 ------------------------------------------------------------------

def select_final(df: DataFrame) -> DataFrame:
    """Fixed order id + 33 features + label; missing ones are skipped
    (F12) and booleans become ints (F13)."""
    wanted = [ID_COL] + FEATURE_ORDER + [LABEL_COL]
    present = [c for c in wanted if c in df.columns]
    types = dict(df.dtypes)
    return df.select(*[F.col(c).cast("int").alias(c) if types[c] == "boolean" else F.col(c)
                       for c in present])


def feature_table(staged: DataFrame, exact: bool = True, compat_periods: bool = True) -> DataFrame:
    """staging -> F11 -> M1-M4 -> M5/M6/C8 -> M7 -> M8. The source is written
    once, since every fitting pass reads it."""
    src = impute(written_source(staged), exact)
    return select_final(add_derived(encode_categoricals(src, compat_periods)))


# M9 -----------------------------------------------------------------------------

def feature_summary(features: DataFrame, label: str = LABEL_COL) -> DataFrame:
    """(column, type, null_count) of every column, then a row per class of the
    label: (label = class, 'class', rows, share of labelled rows in percent).

    One aggregation counts nulls, one the classes of the label.
    """
    null = [F.sum(F.col(c).isNull().cast("int")).cast("bigint").alias(c) for c in features.columns]
    entry = lambda f: F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                               F.coalesce(F.col(f.name), F.lit(0)).alias("null_count"))
    columns = features.agg(*null).select(F.inline(F.array(*[entry(f) for f in features.schema])))
    classes = features.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per class
    shares = classes.select(F.concat(F.lit(f"{label} = "), F.col(label).cast("string")).alias("column"), F.lit("class").alias("type"),
                            F.lit(0).cast("bigint").alias("null_count"), F.col("n").alias("rows"), (F.col("n") * 100.0 / total).alias("share_pct"))
    return (columns.withColumn("rows", F.lit(None).cast("bigint")).withColumn("share_pct", F.lit(None).cast("double"))
            .unionByName(shares))


# M10 ----------------------------------------------------------------------------

def hash_bucket(id_col, seed: int = 42) -> Column:
    """0..99 bucket from the first 32 bits of md5(id ':' seed): stable across
    engines, re-runs and executor loss (no RNG state)."""
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def hash_split(df: DataFrame, id_col: str = ID_COL, seed: int = 42, train_pct: int = 80) -> DataFrame:
    """Adds ``split`` = 'train' (about train_pct %) or 'test'."""
    return df.withColumn("split", F.when(hash_bucket(id_col, seed) < train_pct, "train")
                         .otherwise("test"))


def stratified_split(df: DataFrame, label: str = LABEL_COL, id_col: str = ID_COL, seed: int = 42,
                     test_pct: int = 20) -> DataFrame:
    """Adds ``split`` with an exact share of every class: of n rows of a class,
    the round(n * test_pct / 100) with the highest hash of their id are 'test'.

    Rows are counted by class and the first four digits of their hash, at most
    65,536 counts a class, which say behind which digits the training rows of a
    class end. Only rows with these digits are ranked; no other row is shuffled.
    Null labels are a class of their own; ids must be unique.
    """
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    keyed = df.withColumn("__h", h).withColumn("__digits", F.substring("__h", 1, 4))
    counts = keyed.groupBy(F.col(label).alias("__label"), "__digits").agg(F.count(F.lit(1)).alias("__c"))
    of_class = Window.partitionBy("__label")  # counts, not rows
    counts = (counts.withColumn("__n", F.sum("__c").over(of_class))
              .withColumn("__before", F.sum("__c").over(of_class.orderBy("__digits")) - F.col("__c")))
    train = F.col("__n") - F.floor((F.col("__n") * test_pct * 2 + 100) / 200)
    ends = (counts.where((F.col("__before") < train) & (train <= F.col("__before") + F.col("__c")))
            .select("__label", F.col("__digits").alias("__end"), (train - F.col("__before")).alias("__train")))  # one row per class
    placed = keyed.join(F.broadcast(ends), F.col(label).eqNullSafe(F.col("__label")), "left")
    at_end = F.col("__digits").eqNullSafe(F.col("__end"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("__h", id_col))
    split = lambda is_train: F.when(is_train, "train").otherwise("test").alias("split")
    return (placed.where(~at_end).select(*df.columns, split(F.col("__digits") < F.col("__end")))
            .unionAll(placed.where(at_end).withColumn("__rank", rank).select(*df.columns, split(F.col("__rank") <= F.col("__train")))))
