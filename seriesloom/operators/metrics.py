"""Errors and shares. Each is one aggregate, combined where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg(F.pow(a - b, F.lit(2.0))))


def rmse_hidden(truth: Column, observed: Column, estimate: Column) -> Column:
    """Over the points that are hidden."""
    return F.sqrt(F.avg(F.when(observed.isNull(), F.pow(truth - estimate, F.lit(2.0)))))


def masked_mse(observed: Column, estimate: Column) -> Column:
    """Squared errors of the observed cells, over the number of all cells."""
    return F.coalesce(F.sum(F.pow(observed - estimate, F.lit(2.0))), F.lit(0.0)) / F.count(F.lit(1))


def observed_fraction(value: Column) -> Column:
    return F.count(value) / F.count(F.lit(1))


def series_rmse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per key, over the points that both have."""
    other = b.select("series_key", "t", F.col("value").alias("other"))
    return a.join(other, ["series_key", "t"]).groupBy("series_key").agg(rmse(F.col("value"), F.col("other")).alias("rmse"))


def shares(df: DataFrame, weight: str) -> DataFrame:
    """Weights divided by their sum."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(weight).alias("whole")))).withColumn(weight, F.col(weight) / F.col("whole")).drop("whole")
