import corpus_pipeline as P
from pyspark.sql import functions as F

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names


def test_stages_keep_columns_and_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, sizes = docs, {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, before, SMALL)
        assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, sizes[name] = spark.read.parquet(path), None
        sizes[name] = before.count()
    assert sizes["toxicity"] <= docs.count() and sizes["near_dedup"] == sizes["secrets"] <= sizes["toxicity"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = labels.where("toxic = 0").join(docs, "doc_id").count()
    kept = spark.read.parquet(str(tmp_path / "toxicity")).join(labels.where("toxic = 0"), "doc_id").count()
    assert kept >= 0.95 * clean
    last = P.STAGES[-1][1](spark, before, SMALL)
    assert last.count() == before.count() and last.where(~F.col("round_trip")).count() == 0


def test_pipeline_of_odd_and_no_rows(spark, docs, empty, folder, tmp_path):
    labels = spark.createDataFrame([(1, 0, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    path = folder(documents=docs, labels=labels)
    assert P.run(spark, path).count() >= 1
    none = str(tmp_path / "none")
    empty.write.parquet(f"{none}/documents.parquet")
    labels.where("false").write.parquet(f"{none}/labels.parquet")
    assert P.run(spark, none).count() == 0
