"""Document fingerprints by SpotSigs.

A text's signatures are chains: the next ``CHAIN`` content words behind each
occurrence of a common word (the anchor), the text's start being an anchor
too. Where more than ``GAP`` content words follow an anchor before the next
one or the text's end, each of them is an anchor as well, so texts without
common words (tables, lists, other languages) are covered to their end, and
the rule for a passage does not depend on the rest of its text. The fingerprint is the sorted set of the signatures' hashes. Sets are
partitioned by their length, and the likeness of two sets is their Jaccard
similarity; sets whose lengths alone rule a threshold out are not compared.

Null text counts as empty. A text without content words has one signature,
the hash of the whole text. Two empty texts are alike (1.0).
Very long texts are used whole. Documents are ordered by doc_id descending,
null last; rows with equal ids by text descending; copies follow each other.
An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

CHAIN = 3
GAP = 12  # content words in a row that the chain behind one anchor may stand for
THRESHOLD = 0.75

# The anchors, the commonest function words of four languages.
ANCHORS = tuple(("""
the of and to a in is it that for was on are as with he be at by this from or an not but which they
der die das und in den von zu mit ist des auf für im dem nicht ein eine als auch es an
le la les de et des un une du que qui est dans en pour pas sur au avec il ce
el los las y que de del un una por con para es su al lo como más
""").split())


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signature_set(text: Column) -> Column:
    """Sorted distinct signature hashes (array<bigint>) of a text column."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    # Anchors become empty strings; one stands for the text's start.
    words = F.split(F.concat(F.lit(" "), plain), " ")
    marked = F.transform(words, lambda w: F.when(w.isin(*ANCHORS), F.lit("")).otherwise(w))
    spots = lambda m: F.array_compact(F.transform(m, lambda w, i: F.when(w == "", i)))
    # Of the words before spot p, j are anchors: p - j content words come first.
    firsts = lambda b: F.transform(b["spots"], lambda p, j: p - j)
    ends = lambda b: F.concat(F.slice(firsts(b), F.lit(2), F.size(b["spots"])), F.array(F.size(b["content"])))
    starts = lambda b: F.flatten(F.zip_with(firsts(b), ends(b), lambda k, end: (
        F.when(end - k > GAP, F.sequence(k, end - 1)).when(k < F.size(b["content"]), F.array(k)).otherwise(F.array().cast("array<int>")))))
    chains = lambda b: F.transform(starts(b), lambda k: F.xxhash64(F.slice(b["content"], k + 1, F.lit(CHAIN))))
    each = _let(marked, lambda m: F.struct(spots(m).alias("spots"), F.array_remove(m, "").alias("content")))
    found = _let(each, lambda b: F.sort_array(F.array_distinct(chains(b))))
    # Nothing but common words or other characters: the whole text is the signature.
    return _let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.xxhash64(text))))


def length_partition(sigs: Column, threshold: float = THRESHOLD) -> Column:
    """Partition of a set's length: sets that reach the threshold lie in the
    same partition or in neighbouring ones."""
    return F.floor(F.log(F.size(sigs).cast("double")) / F.lit(-math.log(threshold))).cast("int")


def likeness(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def similar_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, likeness) of rows (id, sigs) whose sets reach ``threshold``.

    Equal sets are joined once, by representative: ids stand for their class
    (smallest id). Candidates share one of the set's first signatures in
    hash order, as many as the threshold leaves open, and lie in the same or
    neighbouring length partitions; lengths prune before sets are compared.
    """
    one = sets.groupBy("sigs").agg(F.min("id").alias("id")).withColumn("part", length_partition(F.col("sigs"), threshold))
    one = stored(one, "spotsigs-sets")
    n = F.size("sigs")
    open_part = F.slice("sigs", F.lit(1), (n - F.ceil(n * threshold) + 1).cast("int"))
    left = one.select("id", "sigs", "part", F.explode(open_part).alias("h"))
    near = F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1))
    right = (one.withColumn("part", near)
             .select(F.col("id").alias("id2"), F.col("sigs").alias("sigs2"), "part", F.explode(open_part).alias("h")))
    pairs = left.join(right, ["part", "h"]).where("id < id2")
    bound = F.least(F.size("sigs"), F.size("sigs2")) / F.greatest(F.size("sigs"), F.size("sigs2"))
    return (pairs.where(bound >= threshold).withColumn("likeness", likeness(F.col("sigs"), F.col("sigs2")))
            .where(F.col("likeness") >= threshold)
            .select(F.col("id").alias("a"), F.col("id2").alias("b"), "likeness").distinct())


def _bucket(bounds: list[int]) -> Column:
    """Position of a key among fixed bounds: a pure function of the key."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("_key")))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with ``next_text``, the text of the next row by
    descending id (the first row's, behind the last).

    Rows are dealt into ranges by bounds that are fixed first (approximate
    quantiles of the ids); a window looks ahead inside a range, and each
    range's last row takes the first row of the next range that has rows.
    The tables of ranges have a fixed number of rows and are broadcast.
    """
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.withColumn("_key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    cuts = d.agg(F.percentile_approx("_key", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    d = d.withColumn("_range", _bucket(sorted(set(cuts or []))))
    tops = d.groupBy("_range").agg(F.max("_key").alias("_top"))
    first = (d.join(F.broadcast(tops), "_range").where("_key = _top").groupBy("_range").agg(F.max("text").alias("_f")))
    ahead = Window.orderBy(F.col("_range").desc())
    everyone = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select("_range", F.coalesce(F.lead("_f").over(ahead), F.first("_f").over(everyone)).alias("_f"))
    inside = Window.partitionBy("_range").orderBy(F.col("_key").desc(), F.col("text").desc())
    d = d.withColumn("_lead", F.lead("text").over(inside)).join(first, "_range")
    return d.select("doc_id", "text", F.coalesce("_lead", "_f").alias("next_text"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    d = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    for name, text in (("sigs", "text"), ("edited_sigs", "edited"), ("next_sigs", "next_text")):
        d = d.withColumn(name, signature_set(F.col(text)))
    return d.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
                    fingerprint(F.col("sigs")).alias("fingerprint"),
                    fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
                    likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                    likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
                    length_partition(F.col("sigs")).alias("length_partition"))
