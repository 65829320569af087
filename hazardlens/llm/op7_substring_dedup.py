"""Substring dedup by content-cut blocks, after relative Lempel-Ziv parsing.

The reference is every text, cut into blocks by content: a window of
``WINDOW`` words belongs to its smallest ``SEED``-word hash, and the windows
of one such hash in a row cover one block, so equal passages are cut alike
wherever they stand. Blocks are indexed by hash; a block that the index also
holds elsewhere is a copy, and neighbouring copies join into one span. Where a
passage begins or ends inside a block, the block itself is found nowhere
else: at these span boundaries the windows of the
block are looked up one by one, against the windows of every other block with
the same smallest hash, each distinct block being indexed once.

No factors (source, position, length) are formed: the spans removed say where
a text repeats, not what it repeats. The result is exact: a word goes when a window that covers it has the same
words as a window that starts elsewhere, in any text or the same one. Equal
64-bit hashes stand for equal words.

Null text counts as empty. Texts below ``WINDOW`` words keep everything.
Equal rows remove each other's words like any two texts. An empty table
gives an empty result. Very long texts are parsed whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, narrowed, range_hashes, stored, table, window_hashes, word_hashes

WINDOW = 35
SEED = 8
_STEP = 1 << 16


def smallest_seeds(seeds: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` seeds the position of the smallest (the first of equals)."""
    n = len(seeds) - span + 1
    out = np.empty(n, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(seeds, span)
    for at in range(0, n, _STEP):
        out[at:at + _STEP] = view[at:at + _STEP].argmin(axis=1)
    return out + np.arange(n)


def blocks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, block hash, first window, windows) of a text's blocks, in order."""
    if len(words) < WINDOW:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    seeds = window_hashes(words, SEED)
    at = smallest_seeds(seeds, WINDOW - SEED + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return seeds[at[first]], range_hashes(words, first, last + WINDOW), first, last - first + 1


_BLOCK = T.StructType([T.StructField("seed", T.LongType()), T.StructField("block", T.LongType()),
                       T.StructField("t", T.LongType()), T.StructField("doc_id", T.LongType()),
                       T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])
_RANGE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()),
                                   T.StructField("block", T.LongType())]))
_WINDOW = T.StructType([T.StructField("w", T.LongType()), T.StructField("block", T.LongType()),
                        T.StructField("t", T.LongType()), T.StructField("start", T.IntegerType())])
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_PARSED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
                        T.StructField("removed", _SPANS)])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t"))


def _cut(texts: DataFrame) -> DataFrame:
    def make():
        def run(cols):
            parts = [blocks(word_hashes(x.encode())) for x in cols["text"]]
            sizes = [len(p[0]) for p in parts]
            ids = np.repeat(np.array([-1 if i is None else i for i in cols["doc_id"]], np.int64), sizes)
            join = lambda k: np.concatenate([p[k] for p in parts])
            return {"seed": _column(join(0).view(np.int64), _BLOCK[0]), "block": _column(join(1).view(np.int64), _BLOCK[1]),
                    "t": _column(np.repeat(np.array(cols["t"], np.int64), sizes), _BLOCK[2]), "doc_id": _column(ids, _BLOCK[3]),
                    "start": _column(join(2).astype(np.int32), _BLOCK[4]), "n": _column(join(3).astype(np.int32), _BLOCK[5])}
        return run

    return map_batches(texts, make, _BLOCK)


def _column(values: np.ndarray, _field):
    import pyarrow as pa
    return pa.array(values)


def _boundary_windows(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(w, block, t, start) for the windows of the asked blocks."""
    one = asked.groupBy("t").agg(F.min("doc_id").alias("owner"), F.collect_set(F.struct("start", "n", "block")).alias("ranges"))
    owned = F.coalesce(F.col("doc_id"), F.lit(-1))
    one = stored(one, "rlz-asked")
    rows = narrowed(texts.withColumn("owner", owned), one.select("owner", "t"), ["owner", "t"])
    rows = rows.join(one, ["owner", "t"]).select("t", "text", "ranges")

    def make():
        def run(cols):
            w, b, t, s = [], [], [], []
            for key, text, ranges in zip(cols["t"], cols["text"], cols["ranges"]):
                hashes = window_hashes(word_hashes(text.encode()), WINDOW).view(np.int64)
                for r in ranges:
                    w.append(hashes[r["start"]:r["start"] + r["n"]])
                    s.append(np.arange(r["start"], r["start"] + r["n"], dtype=np.int32))
                    b.append(np.full(r["n"], r["block"], np.int64))
                    t.append(np.full(r["n"], key, np.int64))
            join = lambda x, kind: _column(np.concatenate(x) if x else np.zeros(0, kind), None)
            return {"w": join(w, np.int64), "block": join(b, np.int64), "t": join(t, np.int64), "start": join(s, np.int32)}
        return run

    return map_batches(rows, make, _WINDOW)


def matches(docs: DataFrame) -> DataFrame:
    """(t, ranges): for each text (by hash) the windows that start elsewhere
    too, as ranges (start, n)."""
    texts = _texts(docs)
    cut = _cut(texts)
    common = cut.groupBy("seed").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("seed")
    cut = stored(cut.join(common, "seed"), "rlz-blocks")
    index = cut.groupBy("seed", "block").agg(F.count(F.lit(1)).alias("copies"), F.min("t").alias("canon"))
    index = stored(index, "rlz-index")
    kinds = index.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"))
    found = cut.join(index, ["seed", "block"])
    whole = found.where("copies > 1").select("t", "start", "n")
    asked = (found.join(kinds.where("kinds > 1").select("seed"), "seed").where("copies = 1 or t = canon")
             .select("t", "doc_id", "start", "n", "block", "copies"))
    windows = stored(_boundary_windows(texts, asked), "rlz-windows")
    twice = (windows.groupBy("w").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
             .where("lo <> hi").select("w"))
    single = windows.join(twice, "w").select("t", "start", F.lit(1).alias("n"))
    return whole.union(single).groupBy("t").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))


def covered(n_words: int, ranges) -> np.ndarray:
    """Which words the windows of the ranges cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for r in ranges or ():
        edge[r["start"]] += 1
        edge[r["start"] + r["n"] - 1 + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per row: words, words removed, the text of the words kept, joined by
    blanks, and the spans of words removed, [start, end) in order; digest of
    the text kept, number of spans."""
    rows = _texts(docs).join(matches(docs), "t", "left").select("doc_id", "text", "ranges")

    def make():
        def run(cols):
            out = {f.name: [] for f in _PARSED}
            for i, text, ranges in zip(cols["doc_id"], cols["text"], cols["ranges"]):
                words = text.encode().split()
                spans, removed, kept = [], 0, words
                if ranges:
                    gone = covered(len(words), ranges)
                    removed = int(gone.sum())
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).tolist()
                    spans = [{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2])]
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                for k, v in zip(out, (i, len(words), removed, b" ".join(kept).decode(), spans)):
                    out[k].append(v)
            return out
        return run

    return map_batches(rows, make, _PARSED).withColumns({"kept_sha256": F.sha2("kept", 256),
                                                         "n_factors": F.size("removed").cast("long")})


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_factors")


# DuckDB twin: all 35-word windows, those that start twice, the words they cover.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT id, unnest([md5(array_to_string(w[i:i + 34], ' ')) FOR i IN range(1, len(w) - 33)]) AS h,
         generate_subscripts(range(1, len(w) - 33), 1) AS i FROM d WHERE len(w) >= 35),
dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT id, unnest(range(i, i + 35)) AS j FROM win SEMI JOIN dup ON win.h = dup.h),
words AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
marked AS (SELECT words.id, words.j, word, cov.j IS NOT NULL AS gone FROM words LEFT JOIN cov ON cov.id = words.id AND cov.j = words.j),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY id ORDER BY j), false) AS starts FROM marked),
out AS (
  SELECT id, count(CASE WHEN gone THEN 1 END) AS n_removed, count(CASE WHEN starts THEN 1 END) AS n_factors,
         string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY j) AS kept
  FROM runs GROUP BY id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
       coalesce(n_factors, 0)::BIGINT AS n_factors
FROM d LEFT JOIN out ON out.id = d.id
"""
