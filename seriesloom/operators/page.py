"""Page matrices and the row filters around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import page_col, page_row, series_index


def page_matrix(series: DataFrame, n: int) -> DataFrame:
    """(series_key, r, c, value): column-major, cell (r, c) is point c * n + r. A projection: nothing moves."""
    return series.select("series_key", page_row(F.col("t"), n).alias("r"), page_col(F.col("t"), n).alias("c"), "value")


def page_series(page: DataFrame, n: int) -> DataFrame:
    return page.select("series_key", series_index(F.col("r"), F.col("c"), n).alias("t"), "value")


def check_shape(series: DataFrame, n: int, m: int, keys: list[str]) -> None:
    """Every key is there with at least n * m points."""
    if n < 1 or m < 1:
        raise ValueError("rows and columns must be positive")
    have = {r.series_key: r.n for r in series.where(F.col("series_key").isin(keys)).groupBy("series_key").agg(F.count(F.lit(1)).alias("n")).collect()}
    for k in keys:
        if have.get(k, 0) < n * m:
            raise ValueError(f"series {k!r} has {have.get(k, 0)} points; {n} x {m} are needed")


def tail_points(series: DataFrame, points: int) -> DataFrame:
    """The last points of each series, t from 0. An aggregate of one row a key is joined: no sort."""
    last = series.groupBy("series_key").agg(F.max("t").alias("last"))
    return series.join(last, "series_key").where(F.col("t") > F.col("last") - points).select("series_key", (F.col("t") - F.col("last") + points - 1).cast("long").alias("t"), "value")


def key_blocks(series: DataFrame, keys: list[str]) -> DataFrame:
    """The series of the keys, with their position: stacked rows go by block * n + r. The target is to be listed last."""
    if len(set(keys)) != len(keys):
        raise ValueError("keys must not repeat")
    block = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i).cast("long"))])
    return series.where(F.col("series_key").isin(keys)).withColumn("block", F.element_at(block, F.col("series_key")))


def split_at(series: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    return series.where(F.col("t") < cut), series.where(F.col("t") >= cut)


def stacked(series: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(row, c, value) of the page matrices of all keys, one below the other."""
    t = key_blocks(series, keys)
    return t.select((F.col("block") * n + page_row(F.col("t"), n)).cast("long").alias("row"), page_col(F.col("t"), n).alias("c"), "value")


def regressor_rows(n: int, n_keys: int, past_only: bool) -> list[int]:
    """Stacked rows that forecast weights are for: without each block's last row, or without the target's only."""
    return [i for i in range(n * n_keys) if not (i % n == n - 1 and (past_only or i // n == n_keys - 1))]


def combine_metrics(metrics: list[DataFrame], weights: list[float], m: int) -> DataFrame:
    """Metrics side by side: values by the root of their weight, metric k's times from k * m on. Inputs stay as they are."""
    if len(metrics) != len(weights):
        raise ValueError("one weight a metric is needed")
    out = None
    for k, (df, w) in enumerate(zip(metrics, weights, strict=True)):
        part = df.select("series_key", (F.col("t") + k * m).cast("long").alias("t"), (F.col("value") * F.sqrt(F.lit(float(w)))).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
