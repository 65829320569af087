"""Boosted trees grown from histograms (M11), for many rows.

``HistogramGBTClassifier`` takes the parameters of ``GBTClassifier``, follows
the same steps (thresholds, logistic loss, variance splits, shrinkage) and
returns its model class. What differs is how rows are held: each partition
keeps its rows as blocks of bin numbers, with features of few bins sharing a
byte, and a pass over them adds up weights and residuals by (node, byte) in
numpy. Sums per (node, bin) follow from these; only they, of a size that does
not depend on the rows, leave a task.
"""

from __future__ import annotations

import gc
import json
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.session import scratch_path

BLOCK_ROWS = 65_536  # rows of a block: its work arrays stay in a core's cache
SAMPLE_ROWS = 10_000  # as in GBTClassifier, thresholds come from about so many rows
CODES = 256  # values of a byte
DIRECT = 64  # counts of at most so many partitions are added up on the driver at once
EPSILON = float(np.finfo(float).eps)


# Thresholds and blocks ------------------------------------------------------------

def thresholds(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds between the values, of about equal weight apart."""
    known = ~np.isnan(values)
    distinct, at = np.unique(values[known], return_inverse=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) <= most:
        return middles
    weight = np.bincount(at, weights[known])
    stride = weights.sum() / (most + 1)
    found, upto, target = [], weight[0], stride
    for i, more in enumerate(weight[1:]):
        before, upto = upto, upto + more
        if abs(before - target) < abs(upto - target):
            found.append(middles[i])
            target += stride
    return np.array(found[:most])


class _Layout:
    """Which byte holds a feature's bin: byte ``at[f]`` is the sum of bin * unit
    over its features, whose numbers of bins have a product of 256 at most."""

    def __init__(self, points: list):
        self.points, self.sizes = points, [len(p) + 1 for p in points]
        self.at, self.unit, full = [0] * len(points), [1] * len(points), []
        for f in sorted(range(len(points)), key=lambda f: -self.sizes[f]):
            fits = [g for g, n in enumerate(full) if n * self.sizes[f] <= CODES]
            if not fits:
                full.append(1)
            self.at[f] = g = fits[0] if fits else len(full) - 1
            self.unit[f] = full[g]
            full[g] *= self.sizes[f]
        self.width = len(full)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """The bytes [byte, row] of the values [row, feature]."""
        out = np.zeros((self.width, len(x)), np.uint8)
        for f, (points, values) in enumerate(zip(self.points, np.ascontiguousarray(x.T))):
            out[self.at[f]] += (np.searchsorted(points, values) * self.unit[f]).astype(np.uint8)
        return out

    def bins(self, f: int) -> np.ndarray:
        """The feature's bin by value of its byte."""
        return np.arange(CODES) // self.unit[f] % self.sizes[f]

    def spread(self, sums: np.ndarray, most: int) -> np.ndarray:
        """Sums [byte, 2, node, value] as sums [feature, 2, node, bin]."""
        out = np.zeros((len(self.at), *sums.shape[1:3], most))
        for f, (g, unit, size) in enumerate(zip(self.at, self.unit, self.sizes)):
            used = CODES // (unit * size) * unit * size
            out[f, ..., :size] = sums[g, ..., :used].reshape(*sums.shape[1:3], -1, size, unit).sum((2, 4))
        return out


def _blocks(batches: Iterator[pa.RecordBatch], layout: _Layout) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (x, y, w) as one row per block: packed bins, labels, weights."""
    def block(held):
        t = pa.Table.from_batches(held)
        x = pa.concat_arrays(t["x"].chunks).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        y, w = (t[c].to_numpy().astype(float) for c in ("y", "w"))
        return pa.RecordBatch.from_pydict({"bins": [layout.packed(x).tobytes()], "y": [(2 * y - 1).astype(np.int8).tobytes()], "w": [w.tobytes()]})

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= BLOCK_ROWS:
            yield block(held)
            held, n = [], 0
    if held:
        yield block(held)


def _settle() -> None:
    """Take what a worker has loaded out of its garbage collection, once: Spark's
    workers look through all of it after every task, for longer than a pass computes."""
    if not gc.get_freeze_count():
        gc.freeze()


def _residuals(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The negative gradient of the logistic loss 2 log(1 + exp(-2 y margin))."""
    return 4.0 * y / (1 + np.exp(2 * y * margin))


# Trees ------------------------------------------------------------------------------

class _Tree:
    """A tree as arrays: feature (-1: a leaf), bin (rows above it go right), left
    child (the right one follows), value, gain, totals (rows, weight, sum, squares);
    ``byte`` holds the feature's bin and ``right`` says by its value who goes right."""

    def __init__(self, layout: _Layout):
        self.layout, self.byte, self.right = layout, np.array([0]), np.zeros((1, CODES), bool)
        self.feature, self.bin, self.left = np.array([-1]), np.array([0]), np.array([0])
        self.value, self.gain, self.totals = np.zeros(1), np.full(1, -1.0), np.zeros((4, 1))

    def find(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row, ``depth`` levels down at most."""
        n = bins.shape[1]
        node, rows, flat, right = np.zeros(n, np.intp), np.arange(n), bins.reshape(-1), self.right.reshape(-1)
        for _ in range(depth):
            value = flat.take(self.byte[node] * n + rows)
            node = self.left[node] + right.take(node * CODES + value)
        return node

    def split(self, node: int, feature: int, at: int, gain: float, values: tuple) -> list:
        """Give ``node`` two children; returns their numbers."""
        left = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, at, left, gain
        self.byte[node], self.right[node] = self.layout.at[feature], self.layout.bins(feature) > at
        more = lambda a, v: np.concatenate([a, v])
        self.feature, self.bin, self.byte = more(self.feature, [-1, -1]), more(self.bin, [0, 0]), more(self.byte, [0, 0])
        self.left = more(self.left, [left, left + 1])  # a leaf leads to itself
        self.right = more(self.right, np.zeros((2, CODES), bool))
        self.value, self.gain = more(self.value, values), more(self.gain, [-1.0, -1.0])
        self.totals = np.concatenate([self.totals, np.zeros((4, 2))], axis=1)
        return [left, left + 1]

    def impurity(self, node) -> np.ndarray:
        """Variance of the residuals."""
        _, w, s, q = self.totals[:, node]
        return np.where(w > 0, (q - s * s / np.where(w > 0, w, 1)) / np.where(w > 0, w, 1), 0.0)


def _totals(node: np.ndarray, n: int, w: np.ndarray, r: np.ndarray) -> np.ndarray:
    wr = w * r
    return np.stack([np.bincount(node, minlength=n), *(np.bincount(node, v, n) for v in (w, wr, wr * r))])


def _counted(state: RDD, tree: _Tree, depth: int, level: list, width: int) -> tuple:
    """One pass: (weights and residual sums [feature, 2, node of the level, bin],
    totals of these nodes, totals of the tree before)."""
    slots = np.full(len(tree.feature), -1, np.intp)
    slots[level] = np.arange(len(level))

    def count(blocks):
        _settle()
        hist = totals = last = None
        for bins, _, w, _, r, before in blocks:
            slot = slots[tree.find(bins, depth)]
            if (slot < 0).any():
                kept = slot >= 0
                bins, w, r, slot = bins[:, kept], w[kept], r[kept], slot[kept]
            wr, base, size = w * r, slot * CODES, len(level) * CODES
            at = np.empty_like(base)
            got = np.empty((len(bins), 2, size))
            for f, b in enumerate(bins):
                np.add(base, b, out=at)
                got[f, 0], got[f, 1] = np.bincount(at, w, size), np.bincount(at, wr, size)
            here = _totals(slot, len(level), w, r)
            hist, totals, last = (got, here, before) if hist is None else (hist + got, totals + here, last + before)
        if hist is not None:
            yield tree.layout.spread(hist.reshape(len(hist), 2, len(level), CODES), width), totals, last

    add = lambda a, b: tuple(x + y for x, y in zip(a, b))
    return state.mapPartitions(count).treeReduce(add, 1 if state.getNumPartitions() <= DIRECT else 2)


def _best(hist: np.ndarray) -> tuple:
    """Per node the split with the largest fall in variance, the first of equals:
    (feature, bin, gain, value left, value right)."""
    w, s = hist[:, 0], hist[:, 1]
    wl, sl = w.cumsum(-1)[..., :-1], s.cumsum(-1)[..., :-1]
    wr, sr = (a[..., ::-1].cumsum(-1)[..., ::-1][..., 1:] for a in (w, s))  # an empty side weighs exactly 0
    sound = (wl > 0) & (wr > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        n, t = wl + wr, sl + sr
        gain = np.where(sound, (sl * sl / wl + sr * sr / wr - t * t / n) / n, -np.inf)
        left, right = sl / wl, sr / wr
    flat = lambda a: a.transpose(1, 0, 2).reshape(a.shape[1], -1)
    best = flat(gain).argmax(1)
    pick = lambda a: flat(a)[np.arange(len(best)), best]
    return (*np.divmod(best, gain.shape[2]), pick(gain), pick(left), pick(right))


def _advanced(block: tuple, tree: _Tree, depth: int, weight: float) -> tuple:
    """A block after a tree: new margins and residuals, and the tree's totals on these rows."""
    _settle()
    bins, y, w, margin, r, _ = block
    node = tree.find(bins, depth)
    margin = margin + weight * tree.value[node]
    return bins, y, w, margin, _residuals(y, margin), _totals(node, len(tree.feature), w, r)


# The learner -----------------------------------------------------------------------

class HistogramGBTClassifier(GBTClassifier):
    """``GBTClassifier`` for a 0/1 label, on all rows and features, with at most 256 bins."""

    columns = None

    def of_columns(self, names: list) -> "HistogramGBTClassifier":
        """Read features from these columns, a null as NaN, instead of the vectors that
        ``VectorAssembler`` makes of them: no vector is built to be taken apart again."""
        self.columns = names
        return self

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        if self.columns is None:
            return self._fitted(dataset, vector_to_array(self.getFeaturesCol()))
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.columns])
        return self._fitted(dataset.drop(self.getFeaturesCol()), x)

    def _fitted(self, dataset: DataFrame, x: Column) -> GBTClassificationModel:
        if self.getSubsamplingRate() != 1.0 or self.getFeatureSubsetStrategy() != "all" or self.getMaxBins() > 256:
            raise ValueError("all rows and features take part, in at most 256 bins")
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined("weightCol") and self.getWeightCol() else F.lit(1.0)
        columns = [x.alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weight.alias("w")]
        rows, n = dataset.select(*columns), dataset.count()
        if not n:
            raise ValueError("no training rows")
        need = max(self.getMaxBins() ** 2, SAMPLE_ROWS)
        some = (dataset.sample(need / n, self.getSeed()) if n > need else dataset).select(*columns).toPandas()  # about 10,000 rows
        x, w = np.array(some["x"].tolist()), some["w"].to_numpy()
        width = min(self.getMaxBins(), n)
        points = [thresholds(x[:, f], w, width - 1) for f in range(x.shape[1])]
        return self._model(self._boosted(rows, _Layout(points), width), points, dataset)

    def _boosted(self, rows: DataFrame, layout: _Layout, width: int) -> list:
        def opened(row):
            y, w = np.frombuffer(row.y, np.int8), np.frombuffer(row.w)
            bins = np.frombuffer(row.bins, np.uint8).reshape(layout.width, -1)
            return bins, y, w, np.zeros(len(y)), y.astype(float), np.zeros((4, 1))  # the first tree learns the labels

        depth, step, every = self.getMaxDepth(), self.getStepSize(), self.getCheckpointInterval()
        blocks = rows.mapInArrow(lambda batches: _blocks(batches, layout), "bins binary, y binary, w binary")
        state = blocks.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
        kept, trees, old = None, [], None
        for m in range(self.getMaxIter() + 1):
            tree, level = _Tree(layout), [0]
            for d in range(depth if m < self.getMaxIter() else 1):
                hist, totals, last = _counted(state, tree, d, level, width)
                if d == 0:
                    if old is not None:
                        old.unpersist()
                    if trees:
                        ended = trees[-1]
                        ended.totals = np.where(ended.feature < 0, last, ended.totals)
                    if m and every > 0 and m % every == 0:
                        kept = _forget(state, kept)
                    root = totals[:, 0]
                    tree.value[0] = root[2] / root[1] if root[1] > 0 else 0.0
                tree.totals[:, level] = totals
                if m == self.getMaxIter():
                    break
                pure = np.abs(tree.impurity(level)) < EPSILON
                found = [(node, b) for node, p, *b in zip(level, pure, *_best(hist))
                         if not (p and node) and b[2] > 0 and b[2] >= self.getMinInfoGain()]
                level = [c for node, (f, at, gain, left, right) in found for c in tree.split(node, f, at, gain, (left, right))]
                if not level:
                    break
            if m < self.getMaxIter():
                trees.append(tree)
                old, by = state, 1.0 if m == 0 else step
                state = old.map(lambda b, tree=tree, by=by: _advanced(b, tree, depth, by)).persist(StorageLevel.MEMORY_AND_DISK)
                if every > 0 and (m + 1) % every == 0:
                    state.checkpoint()
        state.unpersist()
        if kept:
            _forget(None, kept)
        return trees

    def _model(self, trees: list, points: list, dataset: DataFrame) -> GBTClassificationModel:
        """The trees as a stock model: its saved form, written and loaded."""
        spark = dataset.sparkSession
        path = scratch_path(spark, f"trees-{uuid.uuid4().hex[:12]}")
        params = {p.name: v for p, v in self._paramMap.items()}
        defaults = {p.name: v for p, v in self._defaultParamMap.items()}
        about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        top = about | {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": self.uid, "paramMap": params,
                       "defaultParamMap": defaults, "numFeatures": len(points), "numTrees": len(trees)}
        shared = ("checkpointInterval", "featuresCol", "labelCol", "maxBins", "maxDepth", "predictionCol", "seed", "weightCol")
        one = about | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "defaultParamMap": {},
                       "paramMap": {k: v for k, v in (defaults | params).items() if k in shared}}
        spark.createDataFrame([(json.dumps(top),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame([(i, json.dumps(one | {"uid": f"dtr_{uuid.uuid4().hex[:12]}"}), 1.0 if i == 0 else self.getStepSize())
                               for i in range(len(trees))], "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
        nodes = [(i, node) for i, t in enumerate(trees) for node in _saved(t, points)]
        spark.createDataFrame(nodes, "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, "
                              "rawCount long, gain double, leftChild int, rightChild int, "
                              "split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>").write.parquet(f"{path}/data")
        return GBTClassificationModel.load(path)


def _saved(tree: _Tree, points: list) -> list:
    """The nodes of a tree in preorder; two leaves of one value are one leaf."""
    same = set()

    def merged(node):
        if tree.feature[node] >= 0:
            left, right = tree.left[node], tree.left[node] + 1
            leaves = [merged(left), merged(right)]
            if all(leaves) and tree.value[left] == tree.value[right]:
                same.add(node)
        return tree.feature[node] < 0 or node in same

    out = []

    def put(node):
        count, *stats = map(float, tree.totals[:, node])
        at, leaf = len(out), merged(node)
        value = tree.value[tree.left[node]] if node in same else tree.value[node]
        out.append(None)
        children = (-1, -1) if leaf else (put(tree.left[node]), put(tree.left[node] + 1))
        f = int(tree.feature[node])
        cut = (-1, [], -1) if leaf else (f, [float(points[f][tree.bin[node]])], -1)
        out[at] = (at, float(value), float(tree.impurity(node)), stats, int(count), -1.0 if leaf else float(tree.gain[node]), *children, cut)
        return at

    put(0)
    return out


def _forget(state: RDD | None, before: str | None) -> str | None:
    """The checkpoint of ``state``; the one before it is deleted."""
    if before:
        from pyspark import SparkContext
        sc = SparkContext._active_spark_context
        old = sc._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(sc._jsc.hadoopConfiguration()).delete(old, True)
    return state.getCheckpointFile() if state is not None else None
