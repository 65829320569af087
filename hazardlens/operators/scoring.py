"""Scoring and evaluation.

The scorer protocol is ``score(df) -> df + risk_score``: the deterministic
rule scorer below or a fitted Spark ML model (``hazardlens.operators.model``).
Evaluation reduces the scored table to one row per distinct score first;
every metric (confusion counts, AUC, ROC) is then computed from that small
table, so the raw rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions import columns as C
from hazardlens.operators.running import running_sums

# Rule-scorer weights in hundredths (0.35 base, clamp .05-.95).
RULE_BASE = 35
RULE_VIS = 15           # visibility < 5
RULE_PRECIP = 12        # precipitation > 0
RULE_WEATHER = 18       # condition is Fog, Snow or Thunderstorm
RULE_WEATHER_SET = ["Fog", "Snow", "Thunderstorm"]
RULE_JUNCTION = 8
RULE_CROSSING = 5
RULE_RUSH = 10          # 7-9 or 16-19
RULE_WEEKEND_NIGHT = 8  # weekend and hour >= 20
RULE_MIN, RULE_MAX = 5, 95

FALLBACK_RISK, FALLBACK_LEVEL, FALLBACK_CONFIDENCE = 0.5, "UNKNOWN", 0.0


def _pts(cond, pts: int) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), pts).otherwise(0)


def rule_points(visibility="visibility_mi", precipitation="precipitation_in",
                weather="weather_condition", junction="has_junction", crossing="has_crossing",
                hour="hour", weekend="is_weekend") -> Column:
    """Integer rule points; every weight is a whole number of hundredths so the
    sum is exact in any engine."""
    h = F.col(hour)
    return (F.lit(RULE_BASE)
            + _pts(F.col(visibility) < 5, RULE_VIS)
            + _pts(F.col(precipitation) > 0, RULE_PRECIP)
            + _pts(F.col(weather).isin(*RULE_WEATHER_SET), RULE_WEATHER)
            + _pts(F.col(junction), RULE_JUNCTION)
            + _pts(F.col(crossing), RULE_CROSSING)
            + _pts(h.between(7, 9) | h.between(16, 19), RULE_RUSH)
            + _pts(F.col(weekend) & (h >= 20), RULE_WEEKEND_NIGHT))


def rule_score(df: DataFrame, out: str = "risk_score", **cols) -> DataFrame:
    """Deterministic rule scorer (the reference's random jitter left out)."""
    pts = F.least(F.greatest(rule_points(**cols), F.lit(RULE_MIN)), F.lit(RULE_MAX))
    return df.withColumn(out, pts.cast("double") / 100.0)


def describe_scores(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """Level, confidence and safety score next to the score."""
    p = F.col(score)
    return (df.withColumn("risk_level", C.risk_level3(p))
              .withColumn("confidence", C.round_half_away(C.confidence_distance(p), 4))
              .withColumn("safety_score", C.round_half_away(C.safety_score(p), 1)))


def with_fallback(df: DataFrame, score: str = "risk_score", level: str = "risk_level",
                  confidence: str = "confidence") -> DataFrame:
    """Rows whose score could not be computed (null) get 0.5 / UNKNOWN / 0."""
    failed = F.col(score).isNull()
    return (df.withColumn(level, F.when(failed, FALLBACK_LEVEL).otherwise(F.col(level)))
              .withColumn(confidence, F.when(failed, F.lit(FALLBACK_CONFIDENCE))
                          .otherwise(F.col(confidence)))
              .withColumn(score, F.coalesce(F.col(score), F.lit(FALLBACK_RISK))))


# Evaluation --------------------------------------------------------------------

def score_table(scored: DataFrame, label: str = "is_high_severity",
                score: str = "risk_score") -> DataFrame:
    """One row per distinct score: positives and negatives at that score.

    For continuous model scores pass a rounded score column so the table
    stays small; partial aggregation means a hot score costs nothing extra.
    """
    y = F.col(label).cast("int")
    return (scored.groupBy(F.col(score).alias("score"))
            .agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                 F.sum(F.when(y == 0, 1).otherwise(0)).cast("bigint").alias("neg")))


def _div(a, b) -> Column:
    """a / b, 0 when b is 0 (zero-division -> 0 as in the reference)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(st: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn from the score table; predicted positive = score > threshold."""
    hi = F.col("score") > threshold
    return st.agg(F.sum(F.when(hi, F.col("pos")).otherwise(0)).cast("bigint").alias("tp"),
                  F.sum(F.when(hi, F.col("neg")).otherwise(0)).cast("bigint").alias("fp"),
                  F.sum(F.when(~hi, F.col("neg")).otherwise(0)).cast("bigint").alias("tn"),
                  F.sum(F.when(~hi, F.col("pos")).otherwise(0)).cast("bigint").alias("fn"))


def _with_auc_terms(st: DataFrame) -> DataFrame:
    """Per distinct score, its rank-sum AUC term pos * (negatives below + neg / 2).

    Negatives below are running sums over the range-partitioned scores."""
    run = running_sums(st, [F.asc("score")], {"__upto": "neg"})
    below = (F.col("__upto") - F.col("neg")).cast("double")
    return run.withColumn("c", F.col("pos").cast("double") * (below + F.col("neg") * 0.5)).drop("__upto")


def eval_metrics(scored: DataFrame, label: str = "is_high_severity", score: str = "risk_score",
                 threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, ROC-AUC and sample counts (one row).

    Confusion counts and the AUC sum come out of ONE aggregation over the
    distinct-score table (no join of partial results)."""
    st = _with_auc_terms(score_table(scored, label, score))
    hi = F.col("score") > threshold
    one = st.agg(F.sum(F.when(hi, F.col("pos")).otherwise(0)).cast("bigint").alias("tp"),
                 F.sum(F.when(hi, F.col("neg")).otherwise(0)).cast("bigint").alias("fp"),
                 F.sum(F.when(~hi, F.col("neg")).otherwise(0)).cast("bigint").alias("tn"),
                 F.sum(F.when(~hi, F.col("pos")).otherwise(0)).cast("bigint").alias("fn"),
                 F.try_divide(F.sum("c"), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    return one.select(
        _div(tp + tn, n).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
        F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"),
        n.alias("test_samples"), (tp + fn).alias("positive_samples"),
        (tn + fp).alias("negative_samples"), (tp + fp).alias("predicted_positive"),
        (tn + fn).alias("predicted_negative"), "roc_auc")


def confusion_matrix(scored: DataFrame, label: str = "is_high_severity", score: str = "risk_score",
                     threshold: float = 0.5) -> DataFrame:
    """(label, prediction, n) for all four cells (zero cells included)."""
    st = score_table(scored, label, score)
    cc = confusion_counts(st, threshold)
    return cc.selectExpr("stack(4, 1, 1, tp, 0, 1, fp, 0, 0, tn, 1, 0, fn) as (label, prediction, n)")


def class_report(scored: DataFrame, label: str = "is_high_severity", score: str = "risk_score",
                 threshold: float = 0.5) -> DataFrame:
    """Precision / recall / F1 / support per class plus macro and weighted averages."""
    cc = confusion_counts(score_table(scored, label, score), threshold)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def prf(t, f_p, f_n):
        p, r = _div(t, t + f_p), _div(t, t + f_n)
        f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        return p, r, f1

    p1, r1, f11 = prf(tp, fp, fn)
    p0, r0, f10 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    tot = (s0 + s1).cast("double")
    wide = cc.select(
        p0.alias("p0"), r0.alias("r0"), f10.alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f11.alias("f1"), s1.alias("s1"),
        ((p0 + p1) / 2).alias("pm"), ((r0 + r1) / 2).alias("rm"), ((f10 + f11) / 2).alias("fm"),
        ((p0 * s0 + p1 * s1) / tot).alias("pw"), ((r0 * s0 + r1 * s1) / tot).alias("rw"),
        ((f10 * s0 + f11 * s1) / tot).alias("fw"), (s0 + s1).alias("st"))
    return wide.selectExpr(
        "stack(4, '0', p0, r0, f0, s0, '1', p1, r1, f1, s1, "
        "'macro avg', pm, rm, fm, st, 'weighted avg', pw, rw, fw, st) "
        "as (class, precision, recall, f1_score, support)")


def roc_points(scored: DataFrame, label: str = "is_high_severity",
               score: str = "risk_score") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first."""
    st = score_table(scored, label, score)
    run = running_sums(st, [F.desc("score")], {"__neg": "neg", "__pos": "pos"})
    neg, pos = st.agg(F.sum("neg").cast("double")).scalar(), st.agg(F.sum("pos").cast("double")).scalar()
    return (run.select(F.col("score").alias("threshold"),
                       F.try_divide(F.col("__neg").cast("double"), neg).alias("fpr"),
                       F.try_divide(F.col("__pos").cast("double"), pos).alias("tpr"))
            .orderBy(F.desc("threshold")))


# M21 ----------------------------------------------------------------------------

def contributing_factors(features: DataFrame, importances: DataFrame, id_col: str = "accident_id",
                         top_n: int = 5) -> DataFrame:
    """The top-n features by importance with each row's value.

    ``importances`` is (feature, importance), one row per model feature.
    Its top-n rows (at most n, read once) decide which columns matter, so
    each row is unpivoted into just those n (rank, feature, importance,
    value) rows with ``stack`` - no join and no row per model feature. A
    top feature missing from ``features`` gets a null value.
    """
    top = importances.orderBy(F.desc("importance"), "feature").limit(top_n).collect()
    if not top:
        return features.select(F.col(id_col), F.lit(None).cast("int").alias("rank"),
                               F.lit(None).cast("string").alias("feature"),
                               F.lit(None).cast("double").alias("importance"),
                               F.lit(None).cast("double").alias("value")).where(F.lit(False))
    have = set(features.columns)
    parts = []
    for rank, r in enumerate(top, start=1):
        name = r["feature"].replace("'", "''")
        value = f"CAST(`{r['feature']}` AS DOUBLE)" if r["feature"] in have else "CAST(NULL AS DOUBLE)"
        parts.append(f"{rank}, '{name}', CAST({float(r['importance'])!r} AS DOUBLE), {value}")
    long = features.selectExpr(f"`{id_col}`", f"stack({len(parts)}, {', '.join(parts)}) "
                                              "as (rank, feature, importance, value)")
    return long.select(id_col, F.col("rank").cast("int").alias("rank"), "feature",
                       C.round_half_away("importance", 4).alias("importance"), "value")


# The factor importances the dashboard reports next to a rule score.
RULE_FACTOR_IMPORTANCES = [("visibility_mi", 0.22), ("hour", 0.18), ("precipitation_in", 0.15),
                           ("has_junction", 0.12), ("weather_condition", 0.10)]


def rule_factor_table(spark) -> DataFrame:
    """The rule scorer's (feature, importance) table: 5 fixed rows."""
    return spark.createDataFrame(RULE_FACTOR_IMPORTANCES, "feature string, importance double")


def score_requests(validated: DataFrame) -> DataFrame:
    """M13 + M23 on validated requests: valid rows get the rule score, invalid
    rows the fallback 0.5 / UNKNOWN / 0."""
    ok = F.col("valid")
    s = rule_score(validated)
    s = (s.withColumn("risk_score", F.when(ok, F.col("risk_score")))
          .withColumn("risk_level", F.when(ok, C.risk_level3("risk_score")))
          .withColumn("confidence", F.when(ok, C.round_half_away(C.confidence_distance("risk_score"), 4))))
    return with_fallback(s)
