"""Typed CSV scan, Parquet sink, write verification, layered tables,
schema listing and table sizes (S1-S3, S5-S7, S9, S10).

Paths are whatever the cluster's storage accepts (HDFS, object stores,
shared folders); sizes come from the Hadoop FileSystem API, not from the
local disk.
"""

from __future__ import annotations

import csv
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 46 columns of the accident files, in their order.
RAW_COLUMNS = [
    "ID", "Source", "Severity", "Start_Time", "End_Time", "Start_Lat", "Start_Lng", "End_Lat", "End_Lng", "Distance(mi)",
    "Description", "Street", "City", "County", "State", "Zipcode", "Country", "Timezone", "Airport_Code", "Weather_Timestamp",
    "Temperature(F)", "Wind_Chill(F)", "Humidity(%)", "Pressure(in)", "Visibility(mi)", "Wind_Direction", "Wind_Speed(mph)",
    "Precipitation(in)", "Weather_Condition", "Amenity", "Bump", "Crossing", "Give_Way", "Junction", "No_Exit", "Railway",
    "Roundabout", "Station", "Stop", "Traffic_Calming", "Traffic_Signal", "Turning_Loop", "Sunrise_Sunset", "Civil_Twilight",
    "Nautical_Twilight", "Astronomical_Twilight"]

# Raw accident schema (S1). Times stay strings: staging parses them with
# try_cast so one bad value never fails the scan.
RAW_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType()), T.StructField("Source", T.StringType()),
    T.StructField("Severity", T.IntegerType()), T.StructField("Start_Time", T.StringType()),
    T.StructField("End_Time", T.StringType()), T.StructField("Start_Lat", T.DoubleType()),
    T.StructField("Start_Lng", T.DoubleType()), T.StructField("Distance(mi)", T.DoubleType()),
    T.StructField("City", T.StringType()), T.StructField("State", T.StringType()),
    T.StructField("Temperature(F)", T.DoubleType()), T.StructField("Humidity(%)", T.DoubleType()),
    T.StructField("Pressure(in)", T.DoubleType()), T.StructField("Visibility(mi)", T.DoubleType()),
    T.StructField("Wind_Speed(mph)", T.DoubleType()), T.StructField("Precipitation(in)", T.DoubleType()),
    T.StructField("Weather_Condition", T.StringType()), T.StructField("Junction", T.BooleanType()),
    T.StructField("Traffic_Signal", T.BooleanType()), T.StructField("Crossing", T.BooleanType()),
    T.StructField("Stop", T.BooleanType()),
])

BOOLEAN_FLAGS = ["Amenity", "Bump", "Crossing", "Give_Way", "Junction", "No_Exit", "Railway",
                 "Roundabout", "Station", "Stop", "Traffic_Calming", "Traffic_Signal", "Turning_Loop"]


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
                   fill_flags: bool = True, corrupt_column: str | None = None) -> DataFrame:
    """CSV with header, typed by column name (no inference pass).

    The header gives the columns and their order; names in ``schema`` take its
    type, all others stay strings. Files whose header differs fail the scan.
    With ``corrupt_column``, rows that do not parse keep their raw line there.
    Boolean road flags that are present get null -> false."""
    types = {f.name: f.dataType for f in schema} | {f: T.BooleanType() for f in BOOLEAN_FLAGS}
    header = spark.read.option("header", True).csv(path).columns
    by_name = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
    if corrupt_column:
        by_name = by_name.add(corrupt_column, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    df = reader.schema(by_name).csv(path)
    if fill_flags:
        flags = {f: False for f in BOOLEAN_FLAGS if f in df.columns}
        df = df.fillna(flags) if flags else df
    return df


def csv_headers(spark: SparkSession, path: str, threads: int = 16) -> dict:
    """Header line -> files below ``path`` that start with it.

    Files are listed and their first line read through the Hadoop FileSystem of
    ``path``; only names and header lines reach the driver, as in Spark's own
    listing of a scan.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    names, found = [], fs.listFiles(root, True)
    while found.hasNext():
        f = found.next()
        name = f.getPath().getName()
        if f.getLen() > 0 and not name.startswith(("_", ".")):
            names.append(f.getPath().toString())

    def first_line(name):
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(name))
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(jvm.org.apache.hadoop.fs.Path(name))
            plain = stream if codec is None else codec.createInputStream(stream)
            return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
        finally:
            stream.close()

    groups: dict = {}
    with ThreadPoolExecutor(threads) as pool:
        for name, line in zip(names, pool.map(first_line, names)):
            groups.setdefault(line.lstrip("\ufeff"), []).append(name)
    return groups


def read_csv_folder(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, columns: list | None = None,
                    fill_flags: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 for folders whose files differ in their columns or their order.

    Files with the same header are one scan, typed by column name like
    ``read_typed_csv``; the scans are unioned by name, a column that a file
    lacks is null. Returns (rows, rejected): rejected rows, those with a value
    that its type cannot hold or with too few or too many fields, keep their
    file and raw line. ``columns`` names the wanted columns (default: all found).
    """
    types = {f.name: f.dataType for f in schema} | {f: T.BooleanType() for f in BOOLEAN_FLAGS}
    scans, found = [], []
    for line, files in sorted(csv_headers(spark, path).items()):
        names = next(csv.reader([line]))
        by_name = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in names] + [T.StructField("_raw", T.StringType())])
        scan = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
                .option("columnNameOfCorruptRecord", "_raw").schema(by_name).csv(files))
        scans.append(scan.withColumn("_file", F.col("_metadata.file_path")))
        found += [c for c in names if c not in found]
    if not scans:
        empty = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in (columns or schema.names)])
        return spark.createDataFrame([], empty), spark.createDataFrame([], "file string, line string")
    rows = None
    for scan in scans:
        blank = [F.lit(None).cast(types.get(c, T.StringType())).alias(c) for c in found if c not in scan.columns]
        whole = scan.select("_file", "_raw", *[f"`{c}`" for c in found if c in scan.columns], *blank)
        rows = whole if rows is None else rows.unionByName(whole)
    # A row is bad by all its values, whichever columns a query asks for. The
    # parser converts only columns that are used, so the filter uses all.
    used = F.pmod(F.hash(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("_")]), F.lit(2)) >= 0
    rejected = rows.where(F.col("_raw").isNotNull() & used).select(F.col("_file").alias("file"), F.col("_raw").alias("line"))
    good = rows.where(F.col("_raw").isNull() & used).select(*[f"`{c}`" for c in (columns or found)])
    flags = {f: False for f in BOOLEAN_FLAGS if f in good.columns}
    return (good.fillna(flags) if flags and fill_flags else good), rejected


def prefix_sample(df: DataFrame, n: int = 100_000, order: list | None = None) -> DataFrame:
    """The first n rows (exploration sample; a sampling operator). With
    ``order``, a total order, reruns give the same rows."""
    return (df.orderBy(*order) if order else df).limit(n)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list | None = None,
                  sort_within: list | None = None) -> None:
    """S3: snappy Parquet; optional partition columns and in-file sort for
    row-group skipping (the analogue of the reference's secondary indexes)."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    w = out.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes under a path, from the Hadoop FileSystem of that path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(conf).getContentSummary(p).getLength())


def verify_write(spark: SparkSession, source: DataFrame, path: str,
                 source_path: str | None = None) -> DataFrame:
    """Reread what was written and compare row count, columns and types;
    with ``source_path`` also report the size ratio source / written."""
    back = spark.read.parquet(path)
    src_n, back_n = source.count(), back.count()
    same_cols = source.columns == back.columns
    type_diffs = [c for c in source.columns if c in back.columns
                  and source.schema[c].dataType != back.schema[c].dataType]
    size_out = path_size(spark, path)
    ratio = (path_size(spark, source_path) / size_out) if source_path and size_out else None
    return spark.createDataFrame(
        [(src_n, back_n, src_n == back_n, same_cols, len(type_diffs), size_out, ratio)],
        "source_rows long, written_rows long, rows_match boolean, columns_match boolean, "
        "type_mismatches int, written_bytes long, compression_ratio double")


def write_layers(base: str, tables: dict) -> dict:
    """Create-or-replace each ``layer.name`` table under ``base/layer/name``
    (a path prefix per layer); returns name -> path."""
    paths = {}
    for name, df in tables.items():
        layer, tname = name.split(".", 1)
        p = f"{base.rstrip('/')}/{layer}/{tname}"
        write_parquet(df, p)
        paths[name] = p
    return paths


def register_layers(spark: SparkSession, paths: dict) -> None:
    """Expose written layer tables as views ``layer_name``."""
    for name, p in paths.items():
        spark.read.parquet(p).createOrReplaceTempView(name.replace(".", "_"))


def create_layers(spark: SparkSession, base: str, layers=("raw", "staging", "analytics"), prefix: str = "") -> None:
    """One catalog database per layer, its files under ``base``."""
    for layer in layers:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}{layer} LOCATION '{base.rstrip('/')}/{prefix}{layer}'")


def publish(spark: SparkSession, base: str, name: str, df: DataFrame, prefix: str = "", sort_within: list | None = None) -> str:
    """Create or replace ``layer.table`` with the rows of ``df``.

    Each call writes a version of its own; only when all its files are
    committed does the catalog's view move on to it, in one step. Readers see
    the old version or the new one, never a part, and a write that fails leaves
    the old version in place. Returns the version's path. Old versions stay
    until ``drop_old_versions``, so running readers are not cut off.
    """
    layer, table = name.split(".", 1)
    path = f"{base.rstrip('/')}/{prefix}{layer}/{table}/version={uuid.uuid4().hex}"
    write_parquet(df, path, sort_within=sort_within)
    spark.sql(f"CREATE OR REPLACE VIEW {prefix}{layer}.{table} AS SELECT * FROM parquet.`{path}`")
    return path


def drop_old_versions(spark: SparkSession, base: str, name: str, keep: str, prefix: str = "") -> int:
    """Delete all versions of ``layer.table`` but ``keep``; returns how many."""
    layer, table = name.split(".", 1)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{prefix}{layer}/{table}")
    fs, gone = folder.getFileSystem(conf), 0
    for f in fs.listStatus(folder):
        if f.getPath().getName() != keep.rsplit("/", 1)[1]:
            fs.delete(f.getPath(), True)
            gone += 1
    return gone


def schema_listing(spark: SparkSession, df: DataFrame, with_nulls: bool = True) -> DataFrame:
    """(position, column, type, nullable) of a DataFrame's schema, plus
    each column's null count from one aggregation over the data."""
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)],
        "position int, column string, type string, nullable boolean")
    if not with_nulls:
        return meta
    from hazardlens.operators.quality import null_counts
    return meta.join(null_counts(df).select("column", "null_count"), "column").orderBy("position")


def table_sizes(tables: dict) -> DataFrame:
    """Row count of each named table, one aggregation job per table,
    unioned into one result."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
