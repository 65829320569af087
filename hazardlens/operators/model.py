"""Boosted-tree risk model with Spark ML.

Training reads the feature table (M8), splits it by hash (M10), weights the
positive class by neg/pos (A19) and fits ``HistogramGBTClassifier`` - a
distributed learner of stock ``GBTClassificationModel``s whose state is
checkpointed to the shared ``spark.checkpoint.dir`` every tenth round, so a
lost executor does not replay the whole lineage. The training rows are dealt
evenly over the cores first: boosting passes over them some 600 times, and a
pass takes as long as its largest partition. Scoring applies the model to a whole table (no row cap).
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
import os

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.functions import columns as C
from hazardlens.operators import features as FE
from hazardlens.operators import scoring as SC
from hazardlens.operators.boosting import HistogramGBTClassifier
from hazardlens.session import checkpoint_dir

# The reference's booster settings.
GBT_PARAMS = {"maxDepth": 6, "stepSize": 0.1, "maxIter": 100}
SEED = 42
TOP_IMPORTANCES = 20


def class_weights(train: DataFrame, label: str = FE.LABEL_COL) -> float:
    """neg / pos of the training rows (one small aggregate)."""
    r = train.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"),
                  F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n")).first()
    return float(r.n) / float(r.p) if r.p else 1.0


def split_of(features: DataFrame) -> DataFrame:
    """``features`` with their train / test split, by class unless they have one."""
    return features if "split" in features.columns else FE.stratified_split(features)


def train_gbt(features: DataFrame, max_iter: int | None = None, seed: int = SEED,
              label: str = FE.LABEL_COL) -> tuple[PipelineModel, list]:
    """Fit assembler + GBT on the 'train' split; returns (model, feature names)."""
    spark = features.sparkSession
    checkpoint_dir(spark)
    names = [c for c in FE.FEATURE_ORDER if c in features.columns]
    train = split_of(features).where(F.col("split") == "train")
    w = class_weights(train, label)
    train = (train.withColumn("__w", F.when(F.col(label) == 1, F.lit(w)).otherwise(F.lit(1.0)))
             .repartition(spark.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK))
    gbt = HistogramGBTClassifier(labelCol=label, featuresCol="features", weightCol="__w",
                                 maxDepth=GBT_PARAMS["maxDepth"], stepSize=GBT_PARAMS["stepSize"],
                                 maxIter=max_iter or GBT_PARAMS["maxIter"], seed=seed, checkpointInterval=10)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features",
                                            handleInvalid="keep"), gbt.of_columns(names)])
    try:
        return pipe.fit(train), names
    finally:
        train.unpersist()


def transformed(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``model.transform`` on dense features. Most flags are 0, so the assembler makes
    sparse vectors, in which each node of each tree would search for its feature."""
    for stage in model.stages:
        df = stage.transform(df)
        if isinstance(stage, VectorAssembler):
            features = stage.getOutputCol()
            df = df.withColumn(features, array_to_vector(vector_to_array(features)))
    return df


def score_model(model: PipelineModel, df: DataFrame, out: str = "risk_score") -> DataFrame:
    """P(class 1) for every row, plus level and confidence."""
    s = transformed(model, df)
    p = vector_to_array("probability")[1]
    return (s.withColumn(out, p)
             .withColumn("risk_level", C.risk_level3(out))
             .withColumn("confidence", C.round_half_away(C.confidence_distance(out), 4))
             .drop("features", "rawPrediction", "probability"))


def feature_importance(spark: SparkSession, model: PipelineModel, names: list,
                       top: int = TOP_IMPORTANCES) -> DataFrame:
    """(feature, importance, rank) from the fitted trees (33 rows at most)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)],
                               "feature string, importance double")
    from pyspark.sql import Window
    return (df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
              .where(F.col("rank") <= top)
              .withColumn("display_name", C.display_name("feature")))


def save_model(model: PipelineModel, path: str, metrics: dict | None = None,
               names: list | None = None, spark: SparkSession | None = None) -> None:
    """Model directory plus a metadata JSON (timestamp, type, metrics)."""
    model.write().overwrite().save(path)
    gbt = model.stages[-1]
    params = {"maxDepth": gbt.getMaxDepth(), "stepSize": gbt.getStepSize(), "maxIter": gbt.getMaxIter()}
    meta = {"model_type": "GBTClassifier", "saved_at": datetime.now(timezone.utc).isoformat(), "params": params, "feature_names": names or [],
            "metrics": metrics or {}}
    spark = spark or SparkSession.getActiveSession()
    (spark.createDataFrame([(json.dumps(meta),)], "value string")
     .write.mode("overwrite").text(os.path.join(path, "_hazardlens_metadata")))


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One-row metadata table read back from a saved model directory."""
    raw = spark.read.text(os.path.join(path, "_hazardlens_metadata"))
    schema = ("model_type string, saved_at timestamp, params struct<maxDepth:int,stepSize:double,maxIter:int>, "
              "feature_names array<string>, metrics map<string,double>")
    return raw.select(F.from_json("value", schema).alias("m")).select(
        "m.model_type", "m.saved_at", "m.params", F.size("m.feature_names").alias("feature_count"),
        "m.feature_names", "m.metrics")


def metrics_dict(metrics_df: DataFrame) -> dict:
    """The one-row metrics table as a dict (bounded: a dozen numbers)."""
    r = metrics_df.first().asDict()
    return {k: float(v) for k, v in r.items() if v is not None}


def evaluate(model: PipelineModel, features: DataFrame) -> DataFrame:
    """M16 on the held-out split, on the scores as they are."""
    test = split_of(features).where(F.col("split") == "test")
    return SC.eval_metrics(score_model(model, test))
