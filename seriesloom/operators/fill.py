"""Filling, hiding and scaling of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, lcg

#: Points of a block: windows never hold more of a series.
BLOCK = 65_536


def _one_row(series: DataFrame, extent: DataFrame) -> DataFrame:
    """Joined to a table of exactly one row, by its aggregate without keys."""
    return series.crossJoin(F.broadcast(extent))


def extent(series: DataFrame) -> DataFrame:
    return series.agg(F.min("value").alias("low"), F.max("value").alias("high"))


def midrange_fill(series: DataFrame, default: float | None = None) -> DataFrame:
    """Missing values become the middle between the least and the greatest of the whole frame; without any, default."""
    mid = extent(series).select(F.coalesce((F.col("low") + F.col("high")) / 2, F.lit(default).cast("double")).alias("mid"))
    return _one_row(series, mid).withColumn("value", F.coalesce("value", "mid")).drop("mid")


def batch_fill(series: DataFrame, size: int, default: float = 0.0) -> DataFrame:
    """Missing values become the middle of the range of their own batch of `size` points; without any there, default."""
    s = series.withColumn("b", F.floor(F.col("t") / size).cast("long"))
    mid = s.groupBy("series_key", "b").agg(F.coalesce((F.min("value") + F.max("value")) / 2, F.lit(default)).alias("mid"))
    return s.join(mid, ["series_key", "b"]).withColumn("value", F.coalesce("value", "mid")).drop("b", "mid")


def interpolate(series: DataFrame, block: int = BLOCK) -> DataFrame:
    """Missing values on the line between their neighbours by t; before the first and after the last the nearest value.

    A series' neighbours are looked up within blocks of t; only each block's first and last values meet over the series.
    """
    at = F.when(F.col("value").isNotNull(), F.struct("t", "value"))
    s = series.withColumn("b", F.floor(F.col("t") / block).cast("long")).withColumn("at", at)
    ends = s.groupBy("series_key", "b").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    w = Window.partitionBy("series_key").orderBy("b")
    ends = ends.select("series_key", "b", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("pb"), F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("nb"))
    v = Window.partitionBy("series_key", "b").orderBy("t")
    s = s.withColumns({"p": F.last("at", True).over(v.rowsBetween(Window.unboundedPreceding, 0)), "n": F.first("at", True).over(v.rowsBetween(0, Window.unboundedFollowing))})
    s = s.join(ends, ["series_key", "b"]).withColumns({"p": F.coalesce("p", "pb"), "n": F.coalesce("n", "nb")})
    line = F.col("p.value") + (F.col("n.value") - F.col("p.value")) * (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t"))
    return s.select("series_key", "t", F.coalesce(F.col("value"), F.when(F.col("p").isNull(), F.col("n.value")).when(F.col("n").isNull(), F.col("p.value")).otherwise(line)).alias("value"))


def hide_values(series: DataFrame, observed: float, uniform=lcg) -> DataFrame:
    """Each value stays with probability `observed`, by a number that only its t gives (or another expression)."""
    return series.withColumn("value", F.when(uniform(F.col("t")) <= observed, F.col("value")))


def hide_runs(series: DataFrame, observed: float, longest: int, gap: int, uniform=lcg) -> DataFrame:
    """Every gap points, with probability 1 - observed, a run of `longest` is hidden at a place within the gap.

    Runs are cut at their gap's end and at the end of the series; hiding stops once (1 - observed) of the points are
    hidden. Runs are planned on one row a gap that has points; the running sum goes over blocks of gaps, and over the
    blocks, so that no task reads all gaps of a series.
    """
    if longest > gap:
        raise ValueError("a run must fit into its gap")
    n = series.groupBy("series_key").agg((F.max("t") + 1).alias("n"))
    plan = series.where("t >= 0").select("series_key", F.floor(F.col("t") / gap).cast("long").alias("g")).distinct().join(n, "series_key")
    u, w = uniform(F.col("g") * gap), uniform(F.col("g") * gap + 1)
    plan = plan.withColumn("a", F.when(u > observed, (F.col("g") * gap + F.floor(w * (gap - longest))).cast("long")))
    plan = plan.withColumn("z", F.least(F.col("a") + longest, (F.col("g") + 1) * gap, F.col("n")))
    plan = plan.withColumns({"h": F.coalesce(F.col("z") - F.col("a"), F.lit(0)), "b": F.floor(F.col("g") / BLOCK).cast("long")})
    up = lambda part, by: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = plan.groupBy("series_key", "b").agg(F.sum("h").alias("all")).select("series_key", "b", F.coalesce(F.sum("all").over(up(["series_key"], "b")), F.lit(0)).alias("from"))
    plan = plan.join(blocks, ["series_key", "b"]).withColumn("done", F.coalesce(F.sum("h").over(up(["series_key", "b"], "g")), F.lit(0)) + F.col("from"))
    plan = plan.where(F.col("a").isNotNull() & (F.col("done") < F.floor((1 - observed) * F.col("n")))).select("series_key", "g", "a", "z")
    s = series.withColumn("g", F.floor(F.col("t") / gap).cast("long")).join(plan, ["series_key", "g"], "left")
    return s.select("series_key", "t", F.when(F.coalesce((F.col("t") < F.col("a")) | (F.col("t") >= F.col("z")), F.lit(True)), F.col("value")).alias("value"))


def clip_to_extent(estimate: DataFrame, observed: DataFrame) -> DataFrame:
    return _one_row(estimate, extent(observed)).withColumn("value", clip(F.col("value"), F.col("low"), F.col("high"))).drop("low", "high")


def fill_from(series: DataFrame, estimate: DataFrame) -> DataFrame:
    """Missing values taken from an estimate of the same points."""
    e = estimate.select("series_key", "t", F.col("value").alias("estimate"))
    return series.join(e, ["series_key", "t"], "left").select("series_key", "t", F.coalesce("value", "estimate").alias("value"))
