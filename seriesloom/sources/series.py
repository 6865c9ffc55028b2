"""Reading and writing: series are long rows (series_key, t, value), matrices coordinate rows (i, j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import missing

SERIES = T.StructType([T.StructField("series_key", T.StringType()), T.StructField("t", T.LongType()), T.StructField("value", T.DoubleType())])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def series(df: DataFrame, key: str | None, t: str, value: str) -> DataFrame:
    """Any table as a series; only the three columns are read."""
    k = F.col(key).cast("string") if key else F.lit("x")
    return df.select(k.alias("series_key"), F.col(t).cast("long").alias("t"), missing(F.col(value).cast("double")).alias("value"))


def wide_to_long(df: DataFrame, t: str, keys: list[str]) -> DataFrame:
    absent = [k for k in keys if k not in df.columns]
    if absent:
        raise ValueError(f"no such series: {absent}")
    return df.select(F.col(t).alias("t"), *(F.col(k).cast("double").alias(k) for k in keys)).unpivot("t", keys, "series_key", "value").select("series_key", F.col("t").cast("long").alias("t"), missing(F.col("value")).alias("value"))


def long_to_wide(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys are listed, so no pass over the data finds them."""
    return df.groupBy("t").pivot("series_key", keys).agg(F.avg("value"))


def pivot_mean(df: DataFrame, index: str, column: str, values: str, names: list[str]) -> DataFrame:
    return df.groupBy(index).pivot(column, names).agg(F.avg(values))


def regular_grid(df: DataFrame, ts: str, value: str, unit: str = "hour", key: str | None = None) -> DataFrame:
    """Irregular events as averages on a grid of time units; empty cells are absent rows. t counts units since 1970."""
    seconds = {"minute": 60, "hour": 3600, "day": 86400}[unit]
    start = F.date_trunc(unit, F.col(ts))
    k = F.col(key).cast("string") if key else F.lit("x")
    grid = df.groupBy(k.alias("series_key"), start.cast("timestamp_ntz").alias("ts")).agg(F.avg(missing(F.col(value).cast("double"))).alias("value"))
    return grid.select("series_key", F.floor(F.unix_timestamp(F.col("ts").cast("string")) / seconds).cast("long").alias("t"), "ts", "value")


def date_index(series: DataFrame, start: str, unit: str = "minute") -> DataFrame:
    """The series with ts: its index t counted in units from a start."""
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
    at = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("t") * F.lit(seconds))
    return series.withColumn("ts", at)


def drop_keys(series: DataFrame, keys: list[str]) -> DataFrame:
    """The series without some of its keys, as a label that is no unit of a panel."""
    return series.where(~F.col("series_key").isin(keys))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_matrix(m: DataFrame, folder: str, label: str, mode: str = "overwrite") -> None:
    """One folder per label: a second label stands beside the first."""
    m.select("i", "j", "v").write.mode(mode).parquet(f"{folder}/{label}")


def read_matrix(spark: SparkSession, folder: str, label: str) -> DataFrame:
    return spark.read.schema("i long, j long, v double").parquet(f"{folder}/{label}")


def copy_matrix(spark: SparkSession, folder: str, label: str, to_folder: str, to_label: str | None = None) -> None:
    write_matrix(read_matrix(spark, folder, label), to_folder, to_label or label)


def random_matrix(spark: SparkSession, rows: int, cols: int, mean: float = 0.0, sd: float = 1.0, seed: int = 0, segments: int | None = None) -> DataFrame:
    """A Gaussian matrix. Segments are partitions: no cell meets another, so memory is bounded by a row."""
    cells = spark.range(0, rows * cols, 1, segments) if segments else spark.range(rows * cols)
    return cells.select(F.floor(F.col("id") / cols).cast("long").alias("i"), F.pmod("id", F.lit(cols)).cast("long").alias("j"), (F.randn(seed) * sd + mean).alias("v"))


def hdf_matrix(path: str, label: str, spark: SparkSession) -> DataFrame:
    """A two-dimensional HDF5 dataset as coordinate rows, where h5py is installed."""
    try:
        import h5py
    except ImportError as e:
        raise NotImplementedError("reading HDF5 needs h5py") from e
    with h5py.File(path, "r") as f:
        n, m = f[label].shape
    def block(batches):
        import pandas as pd
        with h5py.File(path, "r") as f:
            for b in batches:
                for i in b["id"]:
                    yield pd.DataFrame({"i": i, "j": range(m), "v": f[label][int(i)]})
    return spark.range(n).mapInPandas(block, "i long, j long, v double")
