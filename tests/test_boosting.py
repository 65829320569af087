"""Trees grown from packed rows are those of Spark's own learner."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hazardlens.operators import boosting as B
from hazardlens.operators import features as FE
from hazardlens.operators import model as ML

NAMES = list("abcde")


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).selectExpr("id", "hash(id, 1) % 1000 / 100.0D AS a", "double(hash(id, 2) % 7) AS b", "hash(id, 3) % 100000 / 7.0D AS c",
                                      "double(hash(id, 4) % 2) AS d", "double(id % 500 = 0) AS e")
    df = df.withColumn("y", (F.col("a") + F.col("b") * F.col("d") + F.hash("id", F.lit(9)) % 9 / 2.0 > 1).cast("int"))
    df = df.withColumn("w", F.when(F.col("y") == 1, 1.7).otherwise(1.0))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).repartition(3).cache()


def _scores(model, rows):
    scored = model.transform(rows).select("id", vector_to_array("probability")[1].alias("p"), "prediction").collect()
    return {r.id: (r.p, r.prediction) for r in scored}


def test_trees_are_those_of_the_stock_learner(rows, tmp_path):
    settings = dict(labelCol="y", weightCol="w", maxDepth=4, stepSize=0.1, maxIter=5, seed=42, checkpointInterval=2)
    want, got = (learner(**settings).fit(rows) for learner in (GBTClassifier, B.HistogramGBTClassifier))
    assert type(got) is GBTClassificationModel
    assert (got.treeWeights, got.totalNumNodes) == (want.treeWeights, want.totalNumNodes)
    np.testing.assert_allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-3)
    a, b = _scores(want, rows), _scores(got, rows)
    assert all(abs(a[k][0] - b[k][0]) < 1e-9 and a[k][1] == b[k][1] for k in a) and len({v[0] for v in b.values()}) > 50
    got.save(str(tmp_path / "model"))
    assert _scores(GBTClassificationModel.load(str(tmp_path / "model")), rows) == b


def test_blocks_share_bytes_and_lose_no_count():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.random(5000)] * 2 + [rng.integers(0, n, 5000) for n in (2, 2, 2, 3, 7, 12, 1)])
    x[:40, 3] = np.nan  # beyond every threshold, as in the stock learner
    w, r = rng.random(5000), rng.normal(size=5000)
    points = [B.thresholds(x[:, f], np.ones(5000), 31) for f in range(x.shape[1])]
    layout = B._Layout(points)
    assert layout.width < 5 < len(points) and len(points[0]) == 31
    packed = layout.packed(x)
    sums = np.stack([[np.bincount(b, v, 256)[None] for v in (w, r)] for b in packed])
    spread = layout.spread(sums, 32)
    for f, p in enumerate(points):
        bins = np.searchsorted(p, x[:, f])
        assert (layout.bins(f)[packed[layout.at[f]]] == bins).all()
        for i, v in enumerate((w, r)):
            np.testing.assert_allclose(spread[f, i, 0], np.bincount(bins, v, 32), atol=1e-9)


def test_training_passes_over_packed_rows(spark, monkeypatch):
    """A pass reads a few bytes a row, not 33 numbers, and no pass reads rows of the table again."""
    held, count = [], B._counted

    def seen(state, *args):
        held.append(state.map(lambda b: (len(b[1]), sum(a.nbytes for a in b[:5]))).reduce(lambda p, q: (p[0] + q[0], p[1] + q[1])))
        return count(state, *args)

    monkeypatch.setattr(B, "_counted", seen)
    flags = [f"CAST(id % {n} = 0 AS INT) AS {c}" for n, c in enumerate((c for c in FE.FEATURE_ORDER if c.startswith("has_")), 2)]
    rows = spark.range(2000).selectExpr("CAST(id AS STRING) AS accident_id", "CAST(id % 24 AS INT) AS hour", *flags,
                                        "CAST(id % 3 = 0 AS INT) AS is_high_severity", "IF(id % 5 = 0, 'test', 'train') AS split")
    model, names = ML.train_gbt(rows, max_iter=2)
    assert len(names) == 13 and len(model.stages[-1].trees) == 2
    assert {n for n, _ in held} == {1600} and max(size for _, size in held) <= 1600 * 32


def test_split_ranks_only_rows_at_the_end_of_a_class(spark, monkeypatch):
    monkeypatch.setattr("hazardlens.operators.running._ranged", None)  # nothing is dealt by ranges or written
    ids = [f"{k}-{i}" for k in range(3) for i in range(400 * k + 7)]
    got = FE.stratified_split(spark.createDataFrame([(i, int(i[0])) for i in ids], "accident_id string, is_high_severity int")).collect()
    import hashlib
    for k in range(3):
        order = sorted((i for i in ids if i[0] == str(k)), key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))
        train = len(order) - int(len(order) * 0.2 + 0.5)
        assert {r.accident_id for r in got if r.is_high_severity == k and r.split == "train"} == set(order[:train])


def _flagged(spark):
    flags = [f"CAST(id % {n} = 0 AS INT) AS {c}" for n, c in enumerate((c for c in FE.FEATURE_ORDER if c.startswith("has_")), 2)]
    return spark.range(900).selectExpr("CAST(id AS STRING) AS accident_id", "CAST(id % 24 AS INT) AS hour", "IF(id % 7 = 0, NULL, id % 50 / 4.0D) AS latitude",
                                       *flags, "CAST(pmod(hash(id, 5), 3) = 0 AS INT) AS is_high_severity", "IF(id % 5 = 0, 'test', 'train') AS split")


def test_trees_read_dense_features(spark, monkeypatch):
    """Scoring hands the trees dense rows, with the scores of the pipeline as it is."""
    rows = _flagged(spark)
    model, _ = ML.train_gbt(rows, max_iter=2)
    want = {r.accident_id: r.p for r in model.transform(rows).select("accident_id", vector_to_array("probability")[1].alias("p")).collect()}
    kinds, transform = [], GBTClassificationModel.transform

    def seen(self, df):
        kinds.append({type(r.features).__name__ for r in df.select("features").collect()})
        return transform(self, df)

    monkeypatch.setattr(GBTClassificationModel, "transform", seen)
    got = {r.accident_id: r.risk_score for r in ML.score_model(model, rows).collect()}
    assert kinds == [{"DenseVector"}] and got == want and len(set(want.values())) > 2


def test_training_builds_no_vector_of_a_row(spark, monkeypatch):
    """Columns give the trees that the assembled vectors give, nulls among them."""
    rows = _flagged(spark)
    names = [c for c in FE.FEATURE_ORDER if c in rows.columns]
    settings = dict(labelCol="is_high_severity", featuresCol="features", maxDepth=3, maxIter=3, seed=42)
    vectors = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(rows)
    want = B.HistogramGBTClassifier(**settings).fit(vectors)
    got = B.HistogramGBTClassifier(**settings).of_columns(names).fit(vectors)
    trees = lambda m: m.toDebugString.split("\n", 1)[1]
    assert trees(got) == trees(want) and "If" in trees(got)
    plans, boosted = [], B.HistogramGBTClassifier._boosted

    def seen(self, rows, *args):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return boosted(self, rows, *args)

    monkeypatch.setattr(B.HistogramGBTClassifier, "_boosted", seen)
    ML.train_gbt(rows, max_iter=1)
    assert len(plans) == 1 and "InMemoryRelation" in plans[0] and "UDF" not in plans[0]
