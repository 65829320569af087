"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies (target
over source size). The expected copies are prefix-summed within the source,
one random offset is added, and a document is taken once for every integer
boundary that its own share of the sum crosses. Documents are summed in the
order of size classes, so the copies spread evenly over short and long texts
and the words taken stay near the target.

Prefix sums are hierarchical: counts per (source, size class, slot) give the
offset of each group; inside a group a window counts rows. A source with any
share of all rows is thereby split over many groups.

Null and empty texts have size 0. Null is a source of its own, sorted last.
A document id may be null or repeat: every row counts for itself; rows with
the same id and size are alike, so their order does not matter. A source of
size 0 takes nothing. Reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, WORD, stored, table

WEIGHTS = (3.0, 1.0, 2.0)  # repeating, by the sources' order
SHARE = 1.5                # all targets together, as a share of all words
LIMIT = 2.0                # a target's limit, as a multiple of its source's size
SLOTS = 64                 # groups that one size class of a source is split into


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """Targets for rows (source, source_size): one row per source.

    Resharing the excess by weight until no target is above its limit ends at
    target = min(limit * size, level * weight) with one common level. Sources
    are ordered by the level at which they reach their limit; prefix sums over
    that order give the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("weight", pick).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    w = w.withColumn("full_at", F.col("cap") / F.col("weight"))
    by = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", left / open_weight)
    # The first source that does not fill up sets the level of all later ones.
    found = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)
    w = w.withColumn("level", found["level"])
    return w.select("source", "source_size", "weight",
                    F.when(F.col("level").isNull(), F.col("cap"))
                    .otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, keys: list[str], weights=WEIGHTS, share=SHARE, limit=LIMIT, seed: int = 17) -> DataFrame:
    """``keys`` (identifying columns, first the id), source and size of each
    row, with source_size, target and copies: how often the mix takes it."""
    cut = F.floor(F.log2(F.col("size") + F.lit(1.0)) * 8).cast("int")
    mark = F.xxhash64(F.lit(seed), F.col(keys[0]))
    d = docs.select(*keys, "source", "size").withColumn("_class", cut).withColumn("_mark", mark)
    d = d.withColumn("_slot", F.pmod(F.col("_mark"), F.lit(SLOTS)).cast("int"))
    group = ["source", "_class", "_slot"]
    counts = stored(d.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words")), "mix-counts")
    targets = source_targets(counts.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, limit)
    before = Window.partitionBy("source").orderBy("_class", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_words", "_n")
    t = targets.withColumnRenamed("source", "_source").withColumn(
        "_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    starts = starts.join(t, starts["source"].eqNullSafe(t["_source"])).select(
        F.col("source").alias("_g0"), F.col("_class").alias("_g1"), F.col("_slot").alias("_g2"),
        "_before", "source_size", "target", "_rate")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_mark", "size", *keys))
    d = d.withColumn("_rank", rank)
    d = d.join(starts, d["source"].eqNullSafe(F.col("_g0")) & (d["_class"] == F.col("_g1")) & (d["_slot"] == F.col("_g2")))
    offset = (F.pmod(F.xxhash64(F.lit(seed + 1), F.col("source")), F.lit(1 << 52)) / F.lit(float(1 << 52)))
    upto = lambda i: F.floor(F.col("_rate") * i + offset)
    place = F.col("_before") + F.col("_rank")
    d = d.withColumn("copies", (upto(place) - upto(place - 1)).cast("long"))
    return d.select(*keys, "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """All columns of ``docs``, each row as often as the mix takes it.

    A row whose id no other has is found by its id: up to ``BROADCAST_KEYS``
    such ids, by count, are broadcast, so texts are not shuffled. Only rows that
    share an id, or have none, are numbered; those alike in id, source and size
    may share copies in any order.
    """
    # The whole row travels in one column, so no name can clash with its own.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), word_count().alias("words"))
    taken = stored(mix(rows.select(F.col("id").alias("doc_id"), F.col("of").alias("source"), F.col("words").alias("size")),
                       ["doc_id"], **parameters), "mix-taken")
    by_id = taken.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.count(F.lit(1)).alias("times"), F.max("copies").alias("copies"))
    single = stored(by_id.where("times = 1").select("id", "copies"), "mix-single")
    side = F.broadcast(single) if single.count() <= BROADCAST_KEYS else single
    out = rows.join(side, "id").select("row", "copies")
    rest = taken.join(side, taken["doc_id"] == side["id"], "left_anti").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.col("size").alias("_words"), "copies")
    rest = rest.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_of", "_words").orderBy("copies")))
    again = rows.join(side, "id", "left_anti")
    again = again.withColumn("nth", F.row_number().over(Window.partitionBy("id", "of", "words").orderBy(F.xxhash64("row"))))
    same = (F.col("id").eqNullSafe(F.col("_id")) & F.col("of").eqNullSafe(F.col("_of"))
            & (F.col("words") == F.col("_words")) & (F.col("nth") == F.col("_nth")))
    out = out.unionByName(again.join(rest, same).select("row", "copies"))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mix(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target",
                                        (F.col("copies") * F.col("size")).alias("taken"))
