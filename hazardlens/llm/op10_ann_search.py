"""Approximate nearest neighbours by learned partitions.

A bounded sample (``SAMPLE`` vectors, chosen by a hash of the id) gives a
neighbour graph, which is split into balanced parts by recursive bisection.
A small network learns to tell a vector's part, its targets being the parts
of its neighbours. Every row is filed under its ``FILED_UNDER`` most probable
parts; a query visits its ``VISITS`` most probable parts, at any size of the
table, and is reranked there by the inner product in double precision. Parts are
held in blocks of bounded size, and queries in slices, so no task holds a whole
part.

The search goes in rounds: first one block of a query's likeliest part, then
eight times as many blocks of it until the part is done, then all other visits.
The worst of the best so far is a floor; later rounds return only rows at or
above it, ties included, so the rows returned per query do not grow with the table.

Vectors that are null or zero, hold a null or non-finite component, or have
another length than most take no part, as queries or as candidates; rows
without an id neither. A query's own id is no candidate. Equal scores go by
smaller id. Tables so small that they have no more than
``VISITS`` parts are searched exactly. An
empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, stored, table

SAMPLE = 8192
PART_ROWS = 64       # rows a part should have, up to the largest number of parts
MIN_PARTS, MAX_PARTS = 8, 64
NEIGHBOURS = 12
HIDDEN = 128
FILED_UNDER = 3      # parts that hold a row
VISITS = 18          # parts that a query visits
WIDER = 8            # blocks of one round for each block of the round before
BLOCK = 8192         # rows of one block of a part
SLICE = 4096         # queries of one slice
SEED = 11


@dataclass(frozen=True)
class Router:
    """Two-layer network: vector -> log-odds of the parts."""
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest others of each vector by inner product, in blocks."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for at in range(0, n, 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at:at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """Recursive bisection: smooth a random vector over the graph until it
    follows its weakest cut, split at the median, then swap pairs that gain."""
    rng = np.random.default_rng(seed)
    label = np.zeros(len(near), np.int64)
    for level in range(int(round(math.log2(parts)))):
        halved = np.zeros(len(near), np.int64)
        for p in range(1 << level):
            rows = np.flatnonzero(label == p)
            if len(rows) < 2:
                halved[rows] = 2 * p
                continue
            place = np.full(len(near), -1)
            place[rows] = np.arange(len(rows))
            to = place[near[rows]]
            ok = to >= 0
            a = np.repeat(np.arange(len(rows)), ok.sum(1))
            b = to[ok]
            a, b = np.r_[a, b], np.r_[b, a]
            degree = np.bincount(a, minlength=len(rows)) + 1e-9
            v = rng.standard_normal(len(rows))
            for _ in range(60):
                v = 0.5 * v + 0.5 * np.bincount(a, weights=v[b], minlength=len(rows)) / degree
                v -= (v * degree).sum() / degree.sum()
                v /= np.linalg.norm(v) + 1e-300
            side = np.zeros(len(rows), bool)
            side[np.argsort(v, kind="stable")[len(rows) // 2:]] = True
            for _ in range(5):
                away = np.bincount(a, weights=(side[b] != side[a]).astype(float), minlength=len(rows))
                gain = 2 * away - np.bincount(a, minlength=len(rows))
                up = np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")]
                down = np.flatnonzero(~side)[np.argsort(-gain[~side], kind="stable")]
                m = min(len(up), len(down))
                good = int((gain[up[:m]] + gain[down[:m]] > 0).sum()) // 4
                if not good:
                    break
                side[up[:good]], side[down[:good]] = False, True
            halved[rows] = 2 * p + side
        label = halved
    return label


def train_router(x: np.ndarray, near: np.ndarray, label: np.ndarray, parts: int, epochs: int = 40) -> Router:
    """Cross-entropy against the parts of a vector and its neighbours, by Adam."""
    rng = np.random.default_rng(SEED)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = np.zeros((len(x), parts))
    for k in range(near.shape[1]):
        y[np.arange(len(x)), label[near[:, k]]] += 1.0
    y[np.arange(len(x)), label] += near.shape[1] / 2
    y /= y.sum(1, keepdims=True)
    p = [rng.standard_normal((x.shape[1], HIDDEN)) * math.sqrt(2 / x.shape[1]), np.zeros(HIDDEN),
         rng.standard_normal((HIDDEN, parts)) * math.sqrt(1 / HIDDEN), np.zeros(parts)]
    m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            r = order[at:at + 256]
            h = np.maximum(x[r] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            q = np.exp(z - z.max(1, keepdims=True))
            d = (q / q.sum(1, keepdims=True) - y[r]) / len(r)
            dh = (d @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[r].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.999 ** t)) + 1e-8)
    return Router(*p)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, their vectors as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    d = rows.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
                                                  & F.exists("v", lambda c: c != 0.0))
    size = d.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return d.where(F.size("v") == (size["d"] if size else 0))


def train(rows: DataFrame, sample: int = SAMPLE) -> tuple[Router | None, int]:
    """Router and number of parts for usable rows, from the sample alone."""
    n = rows.count()
    if n < 4 * MIN_PARTS * NEIGHBOURS:
        return None, 1
    parts = min(MAX_PARTS, max(MIN_PARTS, 1 << int(math.log2(max(1, n / PART_ROWS)))))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    x = np.array(picked.column("v").to_pylist(), dtype=float)
    near = neighbour_graph(x)
    return train_router(x, near, balanced_parts(near, parts), parts), parts


_FILED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("v", T.BinaryType()),
                       T.StructField("parts", T.ArrayType(T.IntegerType()))])
_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
                       T.StructField("score", T.DoubleType())])


def filed(rows: DataFrame, router: Router | None, visits: int, kind: str = "<f8") -> DataFrame:
    """Rows with their vectors as bytes (numbers of ``kind``, which must hold
    them exactly) and their ``visits`` likeliest parts, likeliest first."""
    def make():
        def run(cols):
            x = np.array(cols["v"], dtype=float)
            if router is None or not len(x):
                parts = [[0]] * len(x)
            else:
                parts = np.argsort(-router.logits(x), axis=1, kind="stable")[:, :visits].tolist()
            return {"vec_id": cols["vec_id"], "v": [r.tobytes() for r in x.astype(kind)], "parts": parts}
        return run

    return map_batches(rows, make, _FILED)


def _matrix(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).astype(float).reshape(len(column), -1)


def _cell(top: int, kind: str):
    """Of a slice of queries and a block of rows, the rows that are among the
    ``top`` of the block and not below the query's floor."""
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if q.num_rows and c.num_rows:
            ids = c.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, y = ids[order], _matrix(c.column("v"), kind)[order]
            queries, x = q.column("query_id").to_numpy(), _matrix(q.column("v"), kind)
            floors = q.column("floor").to_numpy()  # nan: none yet
            for at in range(0, len(x), 512):
                s = x[at:at + 512] @ y.T
                s[queries[at:at + 512, None] == ids[None, :]] = -np.inf
                floor = floors[at:at + 512].copy()
                none = np.isnan(floor)
                if none.any():
                    k = min(top, s.shape[1])
                    floor[none] = -np.partition(-s[none], k - 1, axis=1)[:, k - 1]
                # Ties and rounding of the block product: everything near the floor is scored again.
                least = np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), floor)
                for i in np.flatnonzero((s >= least[:, None]).any(axis=1)):
                    near = np.flatnonzero((s[i] >= least[i]) & (s[i] > -np.inf))
                    exact = (y[near] * x[at + i]).sum(axis=1)
                    best = np.lexsort((ids[near], -exact))[:top]
                    out[0].append(np.full(len(best), queries[at + i], np.int64))
                    out[1].append(ids[near][best])
                    out[2].append(exact[best])
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(o) if o else np.zeros(0, k)) for o, k in zip(out, kinds)],
                        names=["query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each query; a row met in two parts counts once."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def search(rows: DataFrame, is_query, top: int, visits: int = VISITS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` nearest."""
    kind = "<f4" if rows.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    good = stored(usable(rows), "ann-usable")
    router, parts = train(good)
    index = filed(good, router, FILED_UNDER, kind).select("vec_id", "v", F.explode("parts").alias("part"))
    index = stored(index, "ann-index")
    asked = filed(good.where(is_query), router, min(parts, visits), kind).select(
        F.col("vec_id").alias("query_id"), "v", F.posexplode("parts").alias("visit", "part"))
    asked = stored(asked, "ann-queries")
    # A part is a grid of blocks by slices; a cell meets in one task.
    sizes = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    shares = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    grid = stored(sizes.join(shares, "part"), "ann-grid")
    own = lambda key, n: F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(grid, "part").select("query_id", "v", "visit", "part", own("query_id", "slices").alias("slice"), every("blocks").alias("block"))
    right = index.join(grid, "part").select("vec_id", "v", "part", own("vec_id", "blocks").alias("block"), every("slices").alias("slice"))
    keys = ["part", "block", "slice"]
    widest = grid.agg(F.max("blocks")).first()[0] or 0
    done, upto, best = 0, 1, None
    while True:
        last = done >= widest
        part = left.where((F.col("visit") > 0) if last else (F.col("visit") == 0) & F.col("block").between(done, upto - 1))
        block = right if last else right.where(F.col("block").between(done, upto - 1))
        if best is None:
            part = part.withColumn("floor", F.lit(float("nan")))
        else:
            floors = best.where(F.col("rank") == top).select(F.col("query_id").alias("_q"), F.col("score").alias("_floor"))
            part = (part.join(floors, F.col("query_id") == F.col("_q"), "left")
                    .withColumn("floor", F.coalesce("_floor", F.lit(float("nan")))).drop("_q", "_floor"))
        found = part.groupBy(*keys).cogroup(block.groupBy(*keys)).applyInArrow(_cell(top, kind), _FOUND)
        if best is not None:
            found = found.unionByName(best.select("query_id", "vec_id", "score"))
        if last:
            return _best(found, top).select("query_id", "rank", "vec_id", "score")
        best = stored(_best(found, top), "ann-best")
        done, upto = upto, upto * WIDER


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, top=20)
