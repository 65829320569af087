"""Analytics over staging and its summaries.

Views over the small summaries stay small: A5/A6/A9 read the temporal
summary, A4/A8 the location summary, A7 the weather summary. Anything that
needs a global total (percent of total, baselines) aggregates first and
applies the unpartitioned window to the aggregated rows only.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.functions import columns as C


def _rnd(c, n) -> Column:
    return C.round_half_away(c, n)


def _count_when(cond) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _avg_or_weighted(avg_col: str, weight_col: str, weighted: bool) -> Column:
    """Average of group averages (the reference) or the count-weighted mean."""
    if weighted:
        return F.sum(F.col(avg_col) * F.col(weight_col)) / F.sum(weight_col)
    return F.avg(avg_col)


# A4 ------------------------------------------------------------------------

def top_risk_locations(loc_summary: DataFrame, min_total: int = 100) -> DataFrame:
    return (loc_summary.where(F.col("total_accidents") >= min_total)
            .select("State", "City", "total_accidents", "high_severity_count",
                    _rnd("avg_severity", 2).alias("avg_severity"),
                    _rnd(C.rate_pct("high_severity_count", "total_accidents"), 2)
                    .alias("high_severity_rate"),
                    _rnd("avg_duration_minutes", 1).alias("avg_duration_minutes"),
                    "accidents_at_signals", "accidents_at_junctions",
                    "morning_rush_accidents", "evening_rush_accidents")
            .orderBy(F.desc("high_severity_count"), "State", "City"))


# A5 / A6 / A9 --------------------------------------------------------------

def hourly_risk_profile(temporal: DataFrame, weighted: bool = False) -> DataFrame:
    return (temporal.groupBy("hour")
            .agg(F.sum("accident_count").cast("bigint").alias("total_accidents"),
                 _rnd(_avg_or_weighted("avg_severity", "accident_count", weighted), 2).alias("avg_severity"),
                 F.sum("high_severity_count").cast("bigint").alias("high_severity_count"),
                 _rnd(_avg_or_weighted("avg_temperature", "accident_count", weighted), 1).alias("avg_temperature"),
                 _rnd(_avg_or_weighted("avg_visibility", "accident_count", weighted), 1).alias("avg_visibility"))
            .orderBy("hour"))


def day_of_week_analysis(temporal: DataFrame, weighted: bool = False) -> DataFrame:
    return (temporal.groupBy("day_of_week", "is_weekend")
            .agg(F.sum("accident_count").cast("bigint").alias("total_accidents"),
                 _rnd(_avg_or_weighted("avg_severity", "accident_count", weighted), 2).alias("avg_severity"),
                 F.sum("high_severity_count").cast("bigint").alias("high_severity_count"))
            .select("day_of_week", C.weekday_name("day_of_week").alias("day_name"), "is_weekend",
                    "total_accidents", "avg_severity", "high_severity_count")
            .orderBy("day_of_week", "is_weekend"))


def rush_hour_impact(temporal: DataFrame, weighted: bool = False) -> DataFrame:
    return (temporal.groupBy("time_period")
            .agg(F.sum("accident_count").cast("bigint").alias("total_accidents"),
                 _rnd(_avg_or_weighted("avg_severity", "accident_count", weighted), 2).alias("avg_severity"),
                 F.sum("high_severity_count").cast("bigint").alias("high_severity_count"))
            .withColumn("high_severity_rate",
                        _rnd(C.rate_pct("high_severity_count", "total_accidents"), 2))
            .orderBy(F.desc("total_accidents"), "time_period"))


# A7 / F10 ------------------------------------------------------------------

def weather_risk_ranking(weather: DataFrame) -> DataFrame:
    return (weather.select(
                "weather_condition", "accident_count", "high_severity_count",
                _rnd("avg_severity", 2).alias("avg_severity"),
                _rnd(C.rate_pct("high_severity_count", "accident_count"), 2).alias("high_severity_rate"),
                _rnd("avg_visibility", 1).alias("avg_visibility"),
                _rnd("avg_temperature", 1).alias("avg_temperature"),
                _rnd("avg_wind_speed", 1).alias("avg_wind_speed"),
                _rnd("avg_precipitation", 2).alias("avg_precipitation"))
            .orderBy(F.desc("high_severity_rate"), "weather_condition"))


def volume_filtered_ranking(ranking: DataFrame, min_count: int = 1000, k: int = 5) -> DataFrame:
    """Top-k by rate among conditions with enough volume (a top-k report)."""
    return (ranking.where(F.col("accident_count") >= min_count)
            .select("weather_condition", "accident_count", "high_severity_rate")
            .orderBy(F.desc("high_severity_rate"), "weather_condition").limit(k))


# A8 ------------------------------------------------------------------------

def state_summary(loc_summary: DataFrame, weighted: bool = False) -> DataFrame:
    return (loc_summary.groupBy("State")
            .agg(F.sum("total_accidents").cast("bigint").alias("total_accidents"),
                 F.countDistinct("City").alias("cities_affected"),
                 _rnd(_avg_or_weighted("avg_severity", "total_accidents", weighted), 2).alias("avg_severity"),
                 F.sum("high_severity_count").cast("bigint").alias("high_severity_count"),
                 F.sum("accidents_at_signals").cast("bigint").alias("total_signal_accidents"),
                 F.sum("accidents_at_junctions").cast("bigint").alias("total_junction_accidents"))
            .orderBy(F.desc("total_accidents"), "State"))


# A10 -----------------------------------------------------------------------

def high_risk_segments(staged: DataFrame, min_severity: int = 2, min_count: int = 50) -> DataFrame:
    """(State, City, period) with severity >= floor; HAVING count >= min_count."""
    return (staged.where(F.col("Severity") >= min_severity)
            .groupBy("State", "City", "time_period")
            .agg(F.count(F.lit(1)).alias("accident_count"),
                 _rnd(F.avg("Severity"), 2).alias("avg_severity"),
                 _count_when(F.col("is_high_severity")).alias("high_severity_count"),
                 _count_when(F.col("has_traffic_signal")).alias("signal_accidents"),
                 _count_when(F.col("has_junction")).alias("junction_accidents"),
                 _rnd(F.avg("visibility_mi"), 1).alias("avg_visibility"))
            .where(F.col("accident_count") >= min_count)
            .orderBy(F.desc("high_severity_count"), "State", "City", "time_period"))


# A11 / W1 / A23 ------------------------------------------------------------

def value_distribution(df: DataFrame, col: str, value_alias: str = "value",
                       digits: int | None = None) -> DataFrame:
    """count and percent of total per value (``digits`` rounds the percent).

    The grand total is a scalar subquery over the aggregated rows: one
    number reaches every task, no row does.
    """
    agg = df.groupBy(F.col(col).alias(value_alias)).agg(F.count(F.lit(1)).alias("n"))
    total = agg.agg(F.sum("n")).scalar()
    pct = F.col("n").cast("double") * 100.0 / total
    return (agg.withColumn("pct", _rnd(pct, digits) if digits is not None else pct)
            .orderBy(value_alias))


def shares(df: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """count and percent of all rows per value of each dimension (name -> column),
    values as text. One pass over ``df``: every row is counted once a dimension,
    combined before the shuffle; each dimension's counts sum to the number of rows.
    """
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("dimension"), F.col(c).cast("string").alias("value"))
                              for name, c in dimensions.items()]))
    agg = df.select(each).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    total = agg.agg((F.sum("n") / len(dimensions)).alias("n")).scalar()
    return agg.withColumn("pct", F.col("n").cast("double") * 100.0 / total)


# A12 -----------------------------------------------------------------------

def top_categories(df: DataFrame, col: str, k: int = 10, value_alias: str = "value") -> DataFrame:
    """Top-k values by count (ties by value); also the share of all rows."""
    agg = df.groupBy(F.col(col).alias(value_alias)).agg(F.count(F.lit(1)).alias("n"))
    total = agg.agg(F.sum("n")).scalar()
    return (agg.withColumn("pct", F.col("n").cast("double") * 100.0 / total)
            .orderBy(F.desc("n"), value_alias).limit(k))


# A13 -----------------------------------------------------------------------

def time_part_counts(staged: DataFrame, ts_col: str = "start_time") -> DataFrame:
    """Counts by hour, weekday (Monday = 0), month and year in one scan.

    Each row emits four (part, value) pairs and a single aggregation counts
    them all, instead of four scans and four shuffles.
    """
    ts = F.col(ts_col)
    parts = F.array(
        F.struct(F.lit("hour").alias("part"), F.hour(ts).alias("value")),
        F.struct(F.lit("weekday").alias("part"), C.dow_monday0(ts).alias("value")),
        F.struct(F.lit("month").alias("part"), F.month(ts).alias("value")),
        F.struct(F.lit("year").alias("part"), F.year(ts).alias("value")),
    )
    return (staged.select(F.inline(parts))
            .groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("part", "value"))


# A14 -----------------------------------------------------------------------

def coverage_kpis(staged: DataFrame, exact: bool = True) -> DataFrame:
    """Totals, distinct states/cities and date range in one aggregation.

    ``exact=False`` swaps the distinct counts for HyperLogLog sketches,
    which merge map-side and never shuffle the raw values.
    """
    dc = (lambda c: F.countDistinct(c)) if exact else (lambda c: F.approx_count_distinct(c))
    return staged.agg(F.count(F.lit(1)).alias("total_accidents"),
                      dc("State").alias("states_covered"),
                      dc("City").alias("cities_covered"),
                      F.date_format(F.min("start_time"), "yyyy-MM-dd").alias("first_date"),
                      F.date_format(F.max("start_time"), "yyyy-MM-dd").alias("last_date"))


# A15 -----------------------------------------------------------------------

def city_centroids(staged: DataFrame) -> DataFrame:
    """Average coordinates of every (State, City), rounded to 4 digits."""
    return (staged.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
            .groupBy("State", "City")
            .agg(_rnd(F.avg("latitude"), 4).alias("avg_lat"),
                 _rnd(F.avg("longitude"), 4).alias("avg_lng"),
                 F.count(F.lit(1)).alias("n")))


# A16 / A17 -----------------------------------------------------------------

def numeric_summary(df: DataFrame, cols: list, exact: bool = True, distributed: bool = True,
                    accuracy: int = 10000) -> DataFrame:
    """count, mean, std (both to 6 digits), min, quartiles, max per numeric column.

    One aggregation computes every column's moments (partial aggregates
    merge per task, nothing is collected) and ``stack`` turns the single row
    into one row per column. Quartiles are exact: by default through
    ``quantiles.exact_quantiles_multi`` (rank selection over one range-
    partitioned write, no per-value counters in one task); ``distributed=False`` uses Spark's
    ``percentile`` aggregate (fine for low-cardinality columns) and
    ``exact=False`` the bounded ``percentile_approx`` sketch.
    """
    probs = [0.25, 0.5, 0.75]
    qs = None
    if exact and distributed:
        from hazardlens.operators.quantiles import exact_quantiles_multi
        qs = exact_quantiles_multi(df, cols, probs)
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        if qs is not None:
            q = F.array(*[F.lit(x).cast("double") for x in qs[c]])
        elif exact:
            q = F.percentile(v, probs)
        else:
            q = F.percentile_approx(v, probs, accuracy)
        aggs += [F.count(v).alias(f"{c}__count"), F.avg(v).alias(f"{c}__mean"),
                 F.stddev_samp(v).alias(f"{c}__std"), F.min(v).alias(f"{c}__min"),
                 (F.first(q) if qs is not None else q).alias(f"{c}__q"), F.max(v).alias(f"{c}__max")]
    one = df.agg(*aggs)
    stack_args = ", ".join(
        f"'{c}', `{c}__count`, `{c}__mean`, `{c}__std`, `{c}__min`, `{c}__q`, `{c}__max`"
        for c in cols)
    long = one.selectExpr(
        f"stack({len(cols)}, {stack_args}) as (column, count, mean, std, min, q, max)")
    return long.select("column", "count", _rnd("mean", 6).alias("mean"),
                       _rnd("std", 6).alias("std"), "min",
                       F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
                       F.col("q")[2].alias("p75"), "max")


# A18 -----------------------------------------------------------------------

def mode_of(df: DataFrame, cols: list) -> DataFrame:
    """Most frequent value per column, lowest value on ties (null ignored).

    Distributed: (column, value) pairs are counted by a group-by and each
    column keeps its best pair with a bounded ``min_by``; the result is
    pivoted to one row with the original column types.
    """
    types = dict(df.dtypes)
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                      for c in cols])
    counts = (df.select(F.explode(pairs).alias("p")).where(F.col("p.value").isNotNull())
              .groupBy("p.col", "p.value").agg(F.count(F.lit(1)).alias("n")))
    # Ties go to the lowest value in the column's own type (numbers numerically).
    order_key = F.struct(-F.col("n"), *[F.when(F.col("col") == c, F.col("value").cast(types[c]))
                                        .alias(f"k{i}") for i, c in enumerate(cols)])
    best = counts.groupBy("col").agg(F.min_by("value", order_key).alias("value"))
    wide = best.groupBy().pivot("col", cols).agg(F.first("value"))
    return wide.select(*[F.col(c).cast(types[c]).alias(c) for c in cols])


# A19 -----------------------------------------------------------------------

def class_balance(df: DataFrame, label: str = "is_high_severity") -> DataFrame:
    """Positive / negative counts and the positive-class weight neg / pos."""
    y = F.col(label).cast("int")
    return (df.agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("positives"),
                   F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("negatives"))
            .withColumn("scale_pos_weight",
                        F.try_divide(F.col("negatives").cast("double"),
                                     F.col("positives").cast("double"))))


# A20 -----------------------------------------------------------------------

def hour_dow_matrix(staged: DataFrame) -> DataFrame:
    """Incident counts, one row per weekday (Sunday = 0), one column per hour.

    The pivot values are given, so Spark does not run a distinct job first.
    """
    return (staged.groupBy("day_of_week").pivot("hour", list(range(24))).count()
            .fillna(0)
            .select("day_of_week", *[F.col(str(h)).cast("bigint").alias(f"h{h:02d}")
                                     for h in range(24)])
            .orderBy("day_of_week"))


# A21 -----------------------------------------------------------------------

def relative_risk(staged: DataFrame, by: str = "weather_condition", baseline: str = "Clear",
                  min_count: int = 1) -> DataFrame:
    """High-severity rate per category divided by the baseline category's rate."""
    agg = (staged.groupBy(F.col(by).alias("category"))
           .agg(F.count(F.lit(1)).alias("n"),
                _count_when(F.col("is_high_severity")).alias("high_severity_count"))
           .where(F.col("n") >= min_count)
           .withColumn("rate", F.col("high_severity_count").cast("double") / F.col("n")))
    base = agg.where(F.col("category") == baseline).agg(F.max("rate")).scalar()
    return (agg.withColumn("relative_risk", F.try_divide(F.col("rate"), base))
            .orderBy("category"))


# A22 -----------------------------------------------------------------------

def grid_density(staged: DataFrame, digits: int = 2) -> DataFrame:
    """Incident count and mean severity per coordinate grid cell (heat map data)."""
    return (staged.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
            .groupBy(C.grid_key("latitude", digits).alias("lat_cell"),
                     C.grid_key("longitude", digits).alias("lon_cell"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.avg("Severity").alias("avg_severity"),
                 _count_when(F.col("is_high_severity")).alias("high_severity_count"),
                 _count_when(F.col("has_junction")).alias("junction_count"),
                 _count_when(F.col("has_crossing")).alias("crossing_count")))


# A24 -----------------------------------------------------------------------

def road_feature_lift(staged: DataFrame, flags: list | None = None) -> DataFrame:
    """High-severity rate with vs without each road flag, and their ratio.

    All flags are measured in one aggregation pass; ``stack`` reshapes the
    single result row into one row per flag.
    """
    flags = [f for f in (flags or C.ROAD_FLAGS) if f in staged.columns]
    hi = F.col("is_high_severity")
    aggs = []
    for f in flags:
        on = F.col(f)
        aggs += [_count_when(on).alias(f"{f}__n1"), _count_when(on & hi).alias(f"{f}__h1"),
                 _count_when(~on).alias(f"{f}__n0"), _count_when(~on & hi).alias(f"{f}__h0")]
    one = staged.agg(*aggs)
    args = ", ".join(f"'{f}', `{f}__n1`, `{f}__h1`, `{f}__n0`, `{f}__h0`" for f in flags)
    long = one.selectExpr(f"stack({len(flags)}, {args}) as (feature, n_with, high_with, n_without, high_without)")
    rate_w = F.try_divide(F.col("high_with").cast("double"), F.col("n_with").cast("double"))
    rate_wo = F.try_divide(F.col("high_without").cast("double"), F.col("n_without").cast("double"))
    return (long.withColumn("rate_with", rate_w).withColumn("rate_without", rate_wo)
            .withColumn("lift", F.try_divide(F.col("rate_with"), F.col("rate_without")))
            .orderBy("feature"))


# L3 ------------------------------------------------------------------------

def random_sample(df: DataFrame, n: int, key: str = "ID", seed: int = 42) -> DataFrame:
    """n rows in a seeded pseudo-random order (a sampling operator).

    Ordering by a hash of (key, seed) is reproducible in any engine and on
    re-execution after executor loss, unlike ``rand()``; the limit is a
    per-partition top-n plus a merge.
    """
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


# L4 / D1 / F14 -------------------------------------------------------------

def cities_per_state(staged: DataFrame, max_states: int = 15, max_cities: int = 50) -> DataFrame:
    """First ``max_cities`` cities (alphabetical) of the first ``max_states`` states (L4).

    One distinct, a distributed ordinal over the distinct states and a
    per-state top-k window (limited map-side) instead of one query per
    state. Nulls sort last, as in SQL, and a null state is matched
    null-safely.
    """
    pairs = staged.select("State", "City").distinct()
    from hazardlens.operators.features import ordinal
    states = (ordinal(pairs.select("State").distinct(), [F.asc_nulls_last("State")], "state_rank")
              .withColumn("state_rank", F.col("state_rank") + 1)
              .where(F.col("state_rank") <= max_states)
              .withColumnRenamed("State", "__s"))
    ranked = (pairs.join(states, pairs.State.eqNullSafe(states.__s)).drop("__s")
              .withColumn("city_rank", F.row_number().over(
                  Window.partitionBy("State").orderBy(F.asc_nulls_last("City")))))
    return (ranked.where(F.col("city_rank") <= max_cities)
            .select("state_rank", "State", "city_rank", "City")
            .orderBy("state_rank", "city_rank"))


def cities_for_state(staged: DataFrame, state: str, state_col: str = "State",
                     city_col: str = "City") -> DataFrame:
    """Distinct non-empty cities of one state, alphabetical. The
    state equality reaches the scan as a pushed filter."""
    return distinct_values(staged.where(F.col(state_col) == state), city_col, non_empty=True)


def distinct_values(df: DataFrame, col: str, non_empty: bool = True) -> DataFrame:
    out = df.select(col)
    if non_empty:
        out = out.where(F.col(col).isNotNull() & (F.col(col) != ""))
    return out.distinct().orderBy(col)


# F15 -----------------------------------------------------------------------

# Explorer time bands (start hour inclusive, end exclusive; 22-6 wraps).
TIME_BANDS = {"morning": (6, 12), "afternoon": (12, 18), "evening": (18, 22), "night": (22, 6)}


def explorer_filter(staged: DataFrame, severity: int | None = None, time_band: str | None = None,
                    weather: str | None = None, year: int | None = None) -> DataFrame:
    """Optional chained filters (each one pushed to the scan when possible)."""
    df = staged
    if severity is not None:
        df = df.where(F.col("Severity") == severity)
    if time_band is not None:
        lo, hi = TIME_BANDS[time_band]
        h = F.col("hour")
        df = df.where((h >= lo) & (h < hi) if lo < hi else (h >= lo) | (h < hi))
    if weather is not None:
        df = df.where(F.lower(F.col("weather_condition")).contains(weather.lower()))
    if year is not None:
        df = df.where(F.col("year") == year)
    return df
