"""Near-duplicate documents by circulant MinHash.

A document's set holds its distinct 5-word shingles. Two permutations make
the whole signature: the first spreads the set over a universe of
``UNIVERSE`` places, the second, shifted circularly by k places, ranks them
for coordinate k. The universe has at least 16 places per shingle of the longest text. Bands of ``ROWS`` coordinates are bucketed; buckets give
candidates, and candidates are confirmed by the exact Jaccard similarity of
their full sets.

Equal sets are one class and are compared once. Within a bucket every class
is compared with two leaders, the smallest set and one chosen by a hash; that
joins groups of near copies without expanding them into pairs. Only classes
that still stand outside their bucket's main component are compared with the
rest of the bucket, each pair once, if it shares a second band; where more
than ``SPLIT`` classes stand outside, the bucket is split by that second band.
Where the main component has more than ``SPLIT`` classes in a bucket, no pairs
are made: classes outside and classes of the component meet in a grid of
bounded blocks, which compares the full sets of those that share two bands and
returns one link per outside class and block, since only components are asked for.
Shingles that no other candidate holds bound what two sets can share; pairs
that cannot reach the threshold by this bound are not made. A pair at the threshold misses all bands with a chance below 2e-6, and shares
fewer than two with one below 3e-5; at 0.8 both are below 2e-7.

Documents without words have empty sets and link with nothing; fewer than
five words are one shingle. Null text counts as empty. Rows with equal ids
are separate texts of one document and share its component; rows without an
id link with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_KEYS, WORD, map_batches, mix64, narrowed, range_hashes, stored, table, window_hashes, word_hashes
from .graph import components

SHINGLE = 5
THRESHOLD = 0.75
ROWS, BANDS = 5, 50
UNIVERSE = 1 << 20       # places at least
SPLIT = 64
BLOCK = 512              # classes of a block of the grid
BLOCK_SHINGLES = 1 << 20  # and their shingles together, on average
SEED = 20240229


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = word_hashes((text or "").encode().lower())
    if 0 < len(words) < SHINGLE:
        return range_hashes(words, np.array([0]), np.array([len(words)]))
    return np.unique(window_hashes(words, SHINGLE))


class Circulant:
    """Signatures from two permutations."""

    def __init__(self, universe: int = UNIVERSE, rows: int = ROWS, bands: int = BANDS):
        rng = np.random.default_rng(SEED)
        self.universe, self.shift = universe, np.uint64(64 - (universe.bit_length() - 1))
        self.first = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        self.length = rows * bands
        second = rng.permutation(universe).astype(np.int32)
        ring = np.concatenate([second, second[:self.length]])
        # Row i holds the ranks of place i under all shifts.
        self.shifted = np.lib.stride_tricks.sliding_window_view(ring, self.length)
        self.bands, self.rows = bands, rows
        self.weights = rng.integers(1 << 62, size=rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = mix64(shingles * self.first) >> self.shift
        out = np.full(self.length, self.universe, np.int32)
        for at in range(0, len(places), 2048):
            np.minimum(out, self.shifted[places[at:at + 2048].astype(np.int64)].min(axis=0), out=out)
        return out

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        sig = self.signature(shingles).astype(np.uint64).reshape(self.bands, self.rows)
        number = np.arange(1, self.bands + 1, dtype=np.uint64) << np.uint64(40)
        return mix64((mix64(sig + number[:, None]) * self.weights).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _class_key(shingles: np.ndarray) -> int:
    return int(mix64(np.array([shingles.sum(dtype=np.uint64) + np.uint64(len(shingles))])).view(np.int64)[0])


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
                        T.StructField("c", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_SET = T.StructType([T.StructField("c", T.LongType()), T.StructField("set", T.BinaryType())])


def universe_of(docs: DataFrame) -> int:
    """A power of two of at least 16 times the shingles that a text can have,
    by the longest text's bytes: every word but the last takes two or more."""
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0] or 0
    return max(UNIVERSE, 1 << (8 * longest).bit_length())


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, c, bands): set size, class of equal sets, band keys."""
    universe = universe_of(docs)

    def make():
        hasher = Circulant(universe)
        none = np.zeros(0, np.int64)

        def run(cols):
            out = {"doc_id": cols["doc_id"], "n": [], "c": [], "bands": []}
            for i, text in zip(cols["doc_id"], cols["text"]):
                s = shingle_set(text)
                out["n"].append(len(s))
                out["c"].append(_class_key(s) if len(s) else None)
                out["bands"].append(hasher.band_keys(s) if len(s) and i is not None else none)
            out["bands"] = pa.array(out["bands"], pa.list_(pa.field("element", pa.int64())))
            return out
        return run

    return map_batches(docs.select("doc_id", "text"), make, _SIGNED)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, set) of the classes in ``wanted`` (c, rep), read from one text each."""
    wanted = stored(wanted.select(F.col("rep").alias("doc_id"), F.col("c").alias("want")), "minhash-wanted")
    texts = narrowed(docs.select("doc_id", "text"), wanted.select("doc_id"), ["doc_id"]).join(wanted, "doc_id")

    def make():
        def run(cols):
            out = {"c": [], "set": []}
            for want, text in zip(cols["want"], cols["text"]):
                s = shingle_set(text)
                if len(s) and _class_key(s) == want:
                    out["c"].append(want)
                    out["set"].append(s.tobytes())
            return out
        return run

    return map_batches(texts, make, _SET)


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    p = (pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("x")), "a")
         .join(sets.select(F.col("c").alias("b"), F.col("set").alias("y")), "b"))

    def make():
        def run(cols):
            out = {"a": [], "b": []}
            for a, b, x, y in zip(cols["a"], cols["b"], cols["x"], cols["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= 75 * (len(x) + len(y) - shared):
                    out["a"].append(a)
                    out["b"].append(b)
            return out
        return run

    return map_batches(p, make, _LINK)


def _fits(n: str, m: str):
    """Set sizes between which the threshold can be reached."""
    return (100 * F.col(n) >= 75 * F.col(m)) & (100 * F.col(m) >= 75 * F.col(n))


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


_OWN = T.StructType([T.StructField("c", T.LongType()), T.StructField("h", T.LongType())])


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(c, own): how many shingles of a class no other class of ``sets`` holds."""
    def make():
        def run(cols):
            found = [np.frombuffer(x, np.int64) for x in cols["set"]]
            owner = np.repeat(np.array(cols["c"], np.int64), [len(x) for x in found])
            return {"c": pa.array(owner), "h": pa.array(np.concatenate(found) if found else owner)}
        return run

    held = map_batches(sets, make, _OWN).groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c"))
    return held.where("k = 1").groupBy("c").agg(F.count(F.lit(1)).alias("own"))


def _rest(members: DataFrame, label: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of classes that share a bucket, are not in one component, and were
    not compared with each other as leaders; and the classes left for the grid."""
    m = members.join(label.withColumnRenamed("node", "c"), "c", "left")
    m = m.withColumn("component", F.coalesce("component", "c"))
    sizes = m.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"),
                                    F.max("k").alias("in_main"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k"))
    main = main.where("parts > 1 and k > 2").select("key", "main", F.col("in_main").alias("in_main"))
    m = m.join(main, "key").select("key", "c", "n", "lead", "any", "component", (F.col("component") != F.col("main")).alias("out"),
                                   "main", (F.col("in_main") > SPLIT).alias("big"))
    m = stored(m, "minhash-mixed")
    some = sets.join(m.select("c").distinct(), "c", "left_semi")
    m = m.join(_own_shingles(some), "c", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    m = m.where("100 * common >= 75 * n").join(classes.select("c", "bands"), "c")
    crowd = m.groupBy("key").agg(F.count_if("out").alias("outside"))
    m = stored(m.join(crowd, "key"), "minhash-mixed")
    shared = F.array_intersect("x.bands", "y.bands")
    most = F.least("x.common", "y.common")
    new = (F.expr("x.component <> y.component and (not y.out or x.c < y.c) and x.c not in (y.lead, y.`any`) and y.c not in (x.lead, x.`any`)")
           & (100 * most >= 75 * (F.col("x.n") + F.col("y.n") - most)))

    def pairs(rows: DataFrame, first) -> DataFrame:
        met = rows.where("out").alias("x").join(rows.where("out or not big").alias("y"), "key").where(new & first)
        return met.select(*_ordered("x.c", "y.c"))

    once = pairs(m.where(F.col("outside") <= SPLIT), (F.element_at(shared, 1) == F.col("key")) & (F.size(shared) > 1))
    # The classes of a crowded bucket meet where a later band agrees.
    later = F.slice("bands", F.array_position("bands", F.col("key")).cast("int") + 1, F.lit(BANDS))
    second = (m.where(F.col("outside") > SPLIT).withColumn("band", F.explode(later))
              .withColumn("first", F.col("key")).withColumn("key", F.xxhash64("key", "band")))
    twice = pairs(second, (F.element_at(shared, 1) == F.col("x.first")) & (F.get(shared, F.lit(1)) == F.col("x.band")))
    grid = m.where("big").select(F.col("main").alias("g"), "c", "n", "out", "bands").distinct()
    return once.union(twice).distinct(), grid


def _compare(xs: pa.Table, ys: pa.Table) -> pa.Table:
    """Of two blocks, one link for each class of the first that has any."""
    out: list[list] = [[], []]
    if xs.num_rows and ys.num_rows:
        order = np.argsort(ys["c"].to_numpy(), kind="stable")
        ids, n = ys["c"].to_numpy()[order], ys["n"].to_numpy()[order]
        found = [np.frombuffer(b, np.uint64) for b in ys["set"].to_pylist()]
        found = [found[i] for i in order]
        bands = lambda t: np.array(t["bands"].to_pylist(), np.int64)
        theirs = bands(ys)[order]
        for c, k, own, data in zip(xs["c"].to_pylist(), xs["n"].to_pylist(), bands(xs), xs["set"].to_pylist()):
            fits = ((theirs == own).sum(1) > 1) & (100 * n >= 75 * k) & (100 * k >= 75 * n) & (ids != c)
            mine = np.frombuffer(data, np.uint64)
            for j in np.flatnonzero(fits):
                at = np.searchsorted(mine, found[j])
                at[at == len(mine)] = 0
                shared = int((mine[at] == found[j]).sum())
                if 100 * shared >= 75 * (k + int(n[j]) - shared):
                    out[0].append(min(c, int(ids[j])))
                    out[1].append(max(c, int(ids[j])))
                    break
    return pa.table([pa.array(o, pa.int64()) for o in out], names=["a", "b"])


def _grid_links(grid: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the classes outside a large component ``g`` and its own."""
    rows = grid.join(sets, "c")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = grid.groupBy("g").agg(blocks.alias("_b"))  # for both sides alike: large enough for the larger one
    rows = rows.join(sizes, "g")
    own = F.pmod(F.xxhash64("c"), F.col("_b")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    columns = [F.col(c).alias(c) for c in ("g", "c", "n", "bands", "set")]
    xs = rows.where("out").select(*columns, own.alias("i"), every.alias("j"))
    ys = rows.where("not out").select(*columns, every.alias("i"), own.alias("j"))
    keys = ["g", "i", "j"]
    return xs.groupBy(*keys).cogroup(ys.groupBy(*keys)).applyInArrow(_compare, _LINK)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    rows = stored(signed(docs), "minhash-signed")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("c").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = stored(classes, "minhash-classes")
    spread = classes.select("c", "n", F.explode("bands").alias("key"))
    mark = F.xxhash64("c")  # the same order in all buckets: few leaders stand for many
    shared = (spread.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("n", "c")).alias("low"),
                                        F.min(F.struct(mark.alias("mark"), "c", "n")).alias("some"))
              .where("k > 1").select("key", F.col("low.c").alias("lead"), F.col("low.n").alias("lead_n"),
                                     F.col("some.c").alias("any"), F.col("some.n").alias("any_n")))
    members = stored(spread.join(shared, "key"), "minhash-members")
    led = members.select("c", "n", F.inline(F.array(F.struct(F.col("lead").alias("other"), F.col("lead_n").alias("other_n")),
                                                    F.struct(F.col("any").alias("other"), F.col("any_n").alias("other_n")))))
    first = led.where("c <> other").where(_fits("n", "other_n")).select(*_ordered("c", "other")).distinct()
    first = stored(first, "minhash-first")
    reps = classes.select("c", "rep")
    wanted = reps.join(members.select("c").distinct(), "c")
    sets = stored(_sets(docs, wanted).dropDuplicates(["c"]), "minhash-sets")
    # Texts under one id are one document: their classes are linked as well.
    own = rows.where("n > 0 and doc_id is not null").select("doc_id", "c")
    several = stored(own.groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("doc_id", "a"), "minhash-several")
    alike = narrowed(own, several.select("doc_id"), ["doc_id"]).join(several, "doc_id").where("a <> c").select("a", F.col("c").alias("b"))
    links = stored(confirmed(first, sets).union(alike), "minhash-links")
    label = components(links)
    pairs, grid = _rest(members, label, classes, sets)
    more = stored(confirmed(pairs, sets).union(_grid_links(grid, sets)), "minhash-links")
    if not more.isEmpty():
        label = components(links.union(more))
    # A component's id is its smallest document id; classes stand for all their rows.
    ids = classes.select(F.col("c").alias("node"), "rep").join(label, "node")
    least = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
    labelled = ids.join(least, "component").select(F.col("node").alias("c"), "component_id")
    named = classes.join(labelled, "c", "left").select(F.col("c").alias("_c"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "c").join(named, F.col("c") == F.col("_c"), "left")
    own = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """All columns of the rows that stay: of each component the row of its
    smallest id, of rows that repeat this id the longest. Rows without an id
    or without words stay."""
    # The whole row travels in one column, so no name can clash with its own.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    linked = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("text"), linked.alias("linked"))
    found = near_duplicates(docs).where("doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias("id"))
    found = stored(found.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times")), "minhash-verdict")
    # Texts are not shuffled for ids that occur once: few ids, by count, are dropped by a broadcast.
    other = found.where("not kept or times > 1").select("id")
    side = F.broadcast(other) if other.count() <= BROADCAST_KEYS else other
    once = rows.where("linked").join(side, "id", "left_anti").select("row")
    again = narrowed(rows.where("linked"), found.where("kept and times > 1").select("id"), ["id"])
    again = again.groupBy("id").agg(F.max_by("row", F.struct(F.length("text"), "text")).alias("row")).select("row")
    return rows.where("not linked").select("row").union(once).union(again).select("row.*")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# DuckDB twin: all shared shingles, links at the threshold, smallest id reachable.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS shingles FROM d),
e AS (SELECT doc_id, unnest(shingles) AS h, len(shingles) AS n FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, x FROM sides UNION SELECT r.x, b.y FROM reach r JOIN sides b ON b.x = r.y),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(least.c, s.doc_id) AS component_id,
       coalesce(least.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN least ON least.x = s.doc_id
"""
