"""Mixed CSV headers, published layers and reproducible prefixes."""

import os

import pytest
from pyspark.sql import functions as F

from hazardlens.sources import io as IO


def _csv(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_files_with_other_headers_are_read_by_name(spark, tmp_path):
    folder = str(tmp_path / "in")
    _csv(folder, "a.csv", ["ID,Severity,City,Crossing", "A-1,2,\"Troy, OH\",True", "A-2,three,Lima,False", "A-3,1,,"])
    _csv(os.path.join(folder, "deep"), "b.csv", ["City,Crossing,ID,Severity,Note", "Rome,,B-1,4,x", "Bonn,True,B-2", "Oslo,maybe,B-3,2,y"])
    _csv(folder, "c.csv", ["ID,Severity,City,Crossing", "C-1,3,Bern,False"])
    _csv(folder, "_hidden.csv", ["nothing"])
    open(os.path.join(folder, "empty.csv"), "w").close()
    assert sorted(len(f) for f in IO.csv_headers(spark, folder).values()) == [1, 2]
    rows, rejected = IO.read_csv_folder(spark, folder)
    got = {r.ID: (r.Severity, r.City, r.Crossing, r.Note) for r in rows.collect()}
    assert got == {"A-1": (2, "Troy, OH", True, None), "A-3": (1, None, False, None), "B-1": (4, "Rome", False, "x"), "C-1": (3, "Bern", False, None)}
    bad = {r.line: os.path.basename(r.file) for r in rejected.collect()}
    assert bad == {"A-2,three,Lima,False": "a.csv", "Bonn,True,B-2": "b.csv", "Oslo,maybe,B-3,2,y": "b.csv"}
    # Whichever columns are asked for, the same rows are sound.
    assert rows.count() == 4 and rejected.count() == 3
    assert sorted(r.City or "" for r in rows.select("City").collect()) == ["", "Bern", "Rome", "Troy, OH"]
    few, _ = IO.read_csv_folder(spark, folder, columns=["Note", "ID"])
    assert few.columns == ["Note", "ID"] and few.count() == 4


def test_folder_without_files(spark, tmp_path):
    rows, rejected = IO.read_csv_folder(spark, str(tmp_path))
    assert rows.count() == rejected.count() == 0 and "Severity" in rows.columns


@pytest.fixture()
def layers(spark, tmp_path):
    prefix = f"t{abs(hash(str(tmp_path))) % 10**8}_"
    IO.create_layers(spark, str(tmp_path), prefix=prefix)
    return str(tmp_path), prefix


def test_publish_replaces_a_table_in_one_step(spark, layers):
    base, prefix = layers
    first = IO.publish(spark, base, "staging.t", spark.range(3), prefix)
    before = spark.sql(f"SELECT * FROM {prefix}staging.t")
    second = IO.publish(spark, base, "staging.t", spark.range(5).withColumn("more", F.lit(1)), prefix)
    assert spark.sql(f"SELECT count(*), sum(more) FROM {prefix}staging.t").first()[:] == (5, 5)
    assert before.count() == 3  # a reader that started earlier goes on with its version
    assert IO.drop_old_versions(spark, base, "staging.t", second, prefix) == 1
    assert not os.path.exists(first) and spark.table(f"{prefix}staging.t").count() == 5
    assert {r.namespace for r in spark.sql("SHOW DATABASES").collect()} >= {f"{prefix}{x}" for x in ("raw", "staging", "analytics")}


def test_failed_write_leaves_the_old_layer(spark, layers):
    base, prefix = layers
    IO.publish(spark, base, "staging.t", spark.range(3), prefix)
    broken = spark.range(100).withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.lit(1)))
    with pytest.raises(Exception, match="broken"):
        IO.publish(spark, base, "staging.t", broken, prefix)
    assert spark.table(f"{prefix}staging.t").count() == 3


def test_table_may_be_published_from_itself(spark, layers):
    base, prefix = layers
    IO.publish(spark, base, "staging.t", spark.range(3), prefix)
    for n in (6, 12):
        t = spark.table(f"{prefix}staging.t")
        IO.publish(spark, base, "staging.t", t.unionAll(t), prefix)
        assert spark.table(f"{prefix}staging.t").count() == n


def test_prefix_in_total_order_does_not_depend_on_partitions(spark):
    df = spark.range(10_000).select(F.xxhash64("id").alias("k"), "id")
    a, b = (IO.prefix_sample(df.repartition(n), 50, ["k"]).collect() for n in (1, 9))
    assert a == b and len(a) == 50
