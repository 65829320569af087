"""Exact quantiles without gathering a column in one task.

``percentile``/``median`` keep one counter per distinct value and merge them
all in a single final task. Here equal values are counted first (a hot value
is one row), the (column, value, count) rows are written once by ranges, and
their running counts say which value holds which rank: one job writes, one
reads, whatever the data. All columns take part in the same two.

Interpolation matches Spark's ``percentile``: position (n-1)p between the
values at the lower and upper ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.operators.running import running_sums


def rank_values(df: DataFrame, cols: list, probs: list) -> DataFrame:
    """(g, p, lower, upper, position): per column number and probability, the
    values at the ranks around position (n-1)p and that position."""
    pairs = F.array(*[F.struct(F.lit(i).alias("g"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    counts = (df.select(F.inline(pairs)).where(F.col("v").isNotNull() & ~F.isnan("v"))
              .groupBy("g", "v").agg(F.count(F.lit(1)).alias("c")))
    placed = running_sums(counts, [F.col("g"), F.col("v")], {"upto": "c"})
    # Running counts start with the columns before: subtract what they hold.
    sizes = placed.groupBy("g").agg(F.min(F.col("upto") - F.col("c")).alias("start"), F.max("upto").alias("end"))
    asked = sizes.select("g", "start", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"),
                         (F.col("end") - F.col("start")).alias("n"))
    asked = asked.withColumn("position", (F.col("n") - 1) * F.col("p"))
    found = placed.join(asked, "g")  # a handful of rows per column on the right
    holds = lambda rank: (F.col("start") + rank >= F.col("upto") - F.col("c")) & (F.col("start") + rank < F.col("upto"))
    low, high = holds(F.floor("position")), holds(F.ceil("position"))
    return (found.where(low | high).groupBy("g", "p", "position")
            .agg(F.min(F.when(low, F.col("v"))).alias("lower"), F.max(F.when(high, F.col("v"))).alias("upper")))


def exact_quantiles_multi(df: DataFrame, cols: list, probs: list) -> dict:
    """{column: [quantile per prob]} (nulls and NaN ignored; None if empty)."""
    out = {c: [None] * len(probs) for c in cols}
    for r in rank_values(df, cols, sorted(set(probs))).collect():  # columns x probs rows
        low = int(r["position"])
        part = r["position"] - low
        value = r["lower"] if part == 0 else (low + 1 - r["position"]) * r["lower"] + part * r["upper"]
        for i, p in enumerate(probs):
            if p == r["p"]:
                out[cols[r["g"]]][i] = value
    return out


def exact_quantiles(df: DataFrame, col: str, probs: list) -> list:
    """Exact quantiles of one column (nulls ignored); None for an empty column."""
    return exact_quantiles_multi(df, [col], probs)[col]
