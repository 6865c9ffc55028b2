"""Synthetic series and matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C


def index(spark: SparkSession, steps: int, start: int = 0) -> DataFrame:
    return spark.range(start, steps).select(F.col("id").alias("t"))


def generated(spark: SparkSession, fn: Callable[..., Column], steps: int, start: int = 0, **options) -> DataFrame:
    """A series from a function of its index."""
    if fn is None:
        raise ValueError("a function is needed")
    return index(spark, steps, start).select(F.lit("x").alias("series_key"), "t", fn(F.col("t"), **options).alias("value"))


def harmonics(spark: SparkSession, sine: list[float], sine_periods: list[float], cosine: list[float], cosine_periods: list[float], steps: int, start: int = 0) -> DataFrame:
    if len(sine) != len(sine_periods) or len(cosine) != len(cosine_periods):
        raise ValueError("one period a coefficient is needed")
    pairs = list(zip(sine, sine_periods, strict=True)), list(zip(cosine, cosine_periods, strict=True))
    return index(spark, steps).select(F.lit("x").alias("series_key"), "t", C.harmonics(F.col("t"), *pairs, steps, start).alias("value"))


def arma(errors: DataFrame, ar: list[float], ma: list[float], start: list[float] | None = None, compat: bool = True, block: int = 65_536) -> DataFrame:
    """(series_key, t, observation, mean, error) of an ARMA recurrence over given errors (series_key, t, value).

    compat: coefficient j of either list acts at lag j (so the first autoregressive one has no effect, and the first
    moving-average one acts on the current error besides the error itself), and the last len(ma) points stay 0. Else
    coefficient j acts at lag j + 1 and all points are computed. t has no gaps.

    A series is dealt to blocks. The recurrence is linear: what a block makes of the observations before it is a matrix,
    which each block finds for itself along with its answer to no observations. Going through these, one row a block, gives
    the observations before each block, from which a second pass computes all blocks at once.
    """
    lag, q = (0 if compat else 1), len(ma)
    taps = [(j + lag, float(c)) for j, c in enumerate(ar) if j + lag > 0]
    back = [(j + lag, float(c)) for j, c in enumerate(ma)]
    deep, far = max((k for k, _ in taps), default=0), max((k for k, _ in back), default=0)
    if block <= max(deep, far):
        raise ValueError(f"a block must be longer than {max(deep, far)} points")
    head = [float(v) for v in (start if start is not None else [])[:q]]
    whole = F.when(F.max("t") - F.min("t") + 1 == F.count(F.lit(1)), F.count(F.lit(1))).otherwise(F.raise_error(F.lit("t has gaps or repeats")).cast("long"))
    rows = errors.join(errors.groupBy("series_key").agg(F.min("t").alias("t0"), whole.alias("n")), "series_key").withColumn("i", F.col("t") - F.col("t0"))
    own, halo = F.floor(F.col("i") / block).cast("long"), F.floor((F.col("i") + far) / block).cast("long")
    dealt = rows.withColumn("b", F.explode(F.array_distinct(F.array(own, halo)))).withColumn("own", own == F.col("b")).select("series_key", "b", "own", "i", "t", "n", "value")

    def answer(pdf, before):
        """The block's own rows, and its observations after each column of `before`: the first with the block's errors."""
        import numpy as np

        pdf = pdf.sort_values("i")
        e = pdf["value"].to_numpy(float)
        drive = e.copy()
        for k, c in back:
            drive[k:] += c * e[: len(e) - k]
        mine = pdf["own"].to_numpy(bool)
        pdf, drive = pdf[mine], drive[mine]
        i = pdf["i"].to_numpy()
        n = int(pdf["n"].iloc[0]) if len(pdf) else 0
        live = (i >= q) & (i < (n - q if compat else n))
        x = np.zeros((deep + len(i), before.shape[1]))
        x[:deep] = before
        lags, c = np.array([k for k, _ in taps], int), np.array([v for _, v in taps])
        for r in range(len(i)):
            if live[r]:
                x[deep + r] = c @ x[deep + r - lags] if len(lags) else 0.0
                x[deep + r, 0] += drive[r]
            elif i[r] < len(head):
                x[deep + r, 0] = head[i[r]]
        return pdf, live, x

    def through(key, pdf):
        import numpy as np
        import pandas as pd

        mine, _, x = answer(pdf, np.hstack([np.zeros((deep, 1)), np.eye(deep)]))
        last = x[len(x) - deep :]
        return pd.DataFrame({"series_key": [key[0]], "b": [key[1]], "own": [last[:, 0].tolist()], "passed": [last[:, 1:].ravel().tolist()]})[: 1 if len(mine) else 0]

    def carry(key, pdf):
        import numpy as np
        import pandas as pd

        pdf, state, out = pdf.sort_values("b"), np.zeros(deep), []
        for add, passed in zip(pdf["own"], pdf["passed"], strict=True):
            out.append(state.tolist())
            state = np.asarray(passed).reshape(deep, deep) @ state + np.asarray(add)
        return pd.DataFrame({"series_key": key[0], "b": pdf["b"].to_numpy(), "before": out})

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        mine, live, x = answer(pdf, np.array(pdf["before"].iloc[0], float).reshape(deep, 1))
        x, e = x[deep:, 0], mine["value"].to_numpy(float)
        return pd.DataFrame({"series_key": key[0], "t": mine["t"].to_numpy(), "observation": x, "mean": np.where(live, x - e, 0.0), "error": e})

    blocks = dealt.groupBy("series_key", "b").applyInPandas(through, "series_key string, b long, own array<double>, passed array<double>")
    states = blocks.groupBy("series_key").applyInPandas(carry, "series_key string, b long, before array<double>")
    return dealt.join(states, ["series_key", "b"]).groupBy("series_key", "b").applyInPandas(run, "series_key string, t long, observation double, mean double, error double")


def logistic_matrix(spark: SparkSession, rows: int, cols: int, uniform=C.lcg) -> DataFrame:
    """Low-rank logistic cells 10 / (1 + exp(-(a + b + a b))) of row and column factors in [0, 1)."""
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("long").alias("i"), F.pmod("id", F.lit(cols)).cast("long").alias("j"))
    a, b = uniform(F.col("i") + 1), uniform(F.col("j") + 100_001)
    return cells.select("i", "j", (F.lit(10.0) / (1 + F.exp(-(a + b + a * b)))).alias("v"))


def convex_row(matrix: DataFrame, weights: dict[int, float]) -> DataFrame:
    """A target row that is a convex combination of others, by their weights made to sum to 1."""
    whole = sum(weights.values())
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k).cast("long"), F.lit(v / whole))])
    return matrix.where(F.col("i").isin(list(weights))).groupBy("j").agg(F.sum(F.element_at(w, F.col("i")) * F.col("v")).alias("v")).select(F.lit(-1).cast("long").alias("i"), "j", "v")
