"""Model serving (M12, M14, M15, M22, S13): one pipeline that can be saved,
loaded and applied to incidents, requests, route segments and streams.

The fitted pipeline holds everything that scoring needs: the fill values, the
code tables of states, cities and weather texts, the feature layout, and the
boosted trees. Its stages are Spark ML stages, so ``PipelineModel.save`` and
``load`` keep them together; code tables are saved as Parquet, of any size, and
joined when applied (AQE broadcasts the small ones).
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.functions import columns as C
from hazardlens.operators import features as FE
from hazardlens.operators import model as ML
from hazardlens.operators import requests as RQ
from hazardlens.operators import scoring as SC
from hazardlens.session import scratch_path


# Stages ------------------------------------------------------------------------

class ImputeMissing(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns one fill value per column that has nulls (M1-M4)."""

    def _fit(self, dataset: DataFrame) -> "ImputeMissingModel":
        return ImputeMissingModel(FE.fit_imputer(dataset))


class ImputeMissingModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    fills = Param(Params._dummy(), "fills", "fill value per column, as JSON", TypeConverters.toString)

    def __init__(self, fills: dict | None = None):
        super().__init__()
        if fills is not None:
            self._set(fills=json.dumps(fills))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return FE.apply_imputer(dataset, json.loads(self.getOrDefault(self.fills)))


class CodeCategories(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the code tables (M5, M6): states and weather texts in alphabetical
    order, cities by frequency. Each table is written once when it is fitted."""

    def _fit(self, dataset: DataFrame) -> "CodeCategoriesModel":
        spark = dataset.sparkSession
        kept = {}
        for name, fit in (("state", FE.label_codes), ("city", FE.frequency_codes), ("weather_condition", FE.label_codes)):
            if name in dataset.columns:
                path = scratch_path(spark, f"codes-{name}-{uuid.uuid4().hex[:12]}")
                fit(dataset, name).select("value", "code").write.parquet(path)
                kept[name] = spark.read.parquet(path)
        return CodeCategoriesModel(kept)


class CodeCategoriesModel(Model, MLReadable, MLWritable):
    """Attaches the codes; ``tables`` maps a column to (value, code)."""

    outputs = {"state": "state_encoded", "city": "city_encoded", "weather_condition": "weather_encoded"}

    def __init__(self, tables: dict | None = None):
        super().__init__()
        self.tables = tables or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for name, codes in self.tables.items():
            out = FE.encode(out, name, codes, self.outputs[name], null_as_text=name != "city")
        return out.withColumn("time_period_encoded", C.period_label_code("time_period", compat=True))

    def write(self) -> MLWriter:
        return _CodesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CodesReader()


class _CodesWriter(MLWriter):
    def __init__(self, instance: CodeCategoriesModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, {"tables": list(self.instance.tables)})
        for name, codes in self.instance.tables.items():
            codes.write.parquet(os.path.join(path, "tables", name))


class _CodesReader(MLReader):
    def load(self, path: str) -> CodeCategoriesModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CodeCategoriesModel({name: self.sparkSession.read.parquet(os.path.join(path, "tables", name))
                                     for name in about["tables"]})
        model._resetUid(about["uid"])
        return model


class FeatureLayout(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Derived features and the fixed order of id, 33 features and label (M7, M8)."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return FE.select_final(FE.add_derived(dataset))


# Fitting, saving, loading --------------------------------------------------------

def fit_risk_pipeline(staged: DataFrame, max_iter: int | None = None,
                      features_path: str | None = None) -> tuple[PipelineModel, DataFrame]:
    """Fit all stages on staged incidents; returns (pipeline, split feature table).

    Labelled rows are written once and feed every fitting pass, features once
    before they are split; the feature table is written with its stratified
    split (to ``features_path``), so training and evaluation see the same rows.
    """
    spark = staged.sparkSession

    def written(df, name, path=None):
        path = path or scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    source = written(FE.feature_source(staged), "feature-source")
    prepared = Pipeline(stages=[ImputeMissing(), CodeCategories(), FeatureLayout()]).fit(source)
    whole = written(prepared.transform(source), "features-whole")
    feats = written(FE.stratified_split(whole), "features", features_path)
    booster, _ = ML.train_gbt(feats, max_iter)
    return PipelineModel([*prepared.stages, *booster.stages]), feats


def save_risk_pipeline(spark: SparkSession, model: PipelineModel, feats: DataFrame, path: str) -> None:
    """Save the pipeline with the metrics of the held-out rows."""
    metrics = ML.metrics_dict(ML.evaluate(booster(model), feats))
    ML.save_model(model, path, metrics, feature_names(model), spark)


def load_risk_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def booster(model: PipelineModel) -> PipelineModel:
    """The stages that score a table in the feature layout: assembler and trees."""
    return PipelineModel(model.stages[-2:])


def feature_names(model: PipelineModel) -> list:
    return model.stages[-2].getInputCols()


def code_tables(model: PipelineModel) -> dict:
    return next(s.tables for s in model.stages if isinstance(s, CodeCategoriesModel))


# Scoring -------------------------------------------------------------------------

def probability(model: PipelineModel, feats: DataFrame, out: str = "risk_score") -> DataFrame:
    """``feats`` with P(class 1); rows lacking a feature get null, not a guess."""
    names = feature_names(model)
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    scored = ML.transformed(booster(model), feats)
    p = F.when(whole, vector_to_array("probability")[1])
    return scored.withColumn(out, p).drop("features", "rawPrediction", "probability", "prediction")


def score_incidents(model: PipelineModel, staged: DataFrame) -> DataFrame:
    """M12 on staged incidents: the whole pipeline, from raw fields to a level."""
    return ML.score_model(model, FE.feature_source(staged))


def top_factors(model: PipelineModel, top_n: int = 5) -> list:
    """(feature, importance) of the strongest features."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(feature_names(model), weights), key=lambda x: (-x[1], x[0]))[:top_n]


def _factors(model: PipelineModel, top_n: int) -> Column:
    """Array of (feature, importance, the row's value)."""
    return F.array(*[F.struct(F.lit(name).alias("feature"), F.lit(round(weight, 4)).alias("importance"),
                              F.col(name).cast("double").alias("value")) for name, weight in top_factors(model, top_n)])


def predict_requests(model: PipelineModel, validated: DataFrame, top_n: int = 5) -> DataFrame:
    """M12/M14/M21/M23 on validated requests: valid ones get the model's
    probability, level, confidence and strongest factors; rejected ones, and
    any the model cannot score, get 0.5 / UNKNOWN / 0 and no factors.

    One projection over all requests; the only joins are those to the code
    tables that were fitted with the model.
    """
    tables = code_tables(model)
    keep = ["valid", "errors"]
    feats = RQ.request_features(validated, tables.get("state"), tables.get("city"), keep=keep)
    p = F.when(F.col("valid"), F.col("risk_score"))
    scored = probability(model, feats).withColumn("risk_score", p)
    scored = (scored.withColumn("risk_level", C.risk_level3("risk_score"))
              .withColumn("confidence", C.round_half_away(C.confidence_distance("risk_score"), 4))
              .withColumn("contributing_factors", F.when(F.col("risk_score").isNotNull(), _factors(model, top_n)))
              .withColumn("risk_score", C.round_half_away("risk_score", 4)))
    return SC.with_fallback(scored).select("request_id", *keep, "risk_score", "risk_level", "confidence", "contributing_factors")


def segment_scorer(model: PipelineModel):
    """A scorer for ``routes.score_segments``: the model on segment features."""
    return lambda feats: probability(model, feats)
