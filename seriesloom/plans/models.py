"""Forecasters and synthetic controls: immutable results of a fit over long series."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import factor, fill, page


@dataclass(frozen=True)
class Forecaster:
    """keys: the series, the target last. weights: by (key, lag row) in the order of the stacked regressor rows."""

    keys: list[str]
    n: int
    m: int
    k: int
    p: float
    past_only: bool
    rows: list[int]
    weights: np.ndarray
    s: np.ndarray
    u: np.ndarray
    cells: DataFrame = field(repr=False)
    last: int = 0
    method: str = "svd"
    cached: tuple[DataFrame, ...] = field(default=(), repr=False)

    def release(self) -> None:
        """Frees what the fit has cached; de-noised values can still be asked for, and are computed again."""
        for df in self.cached:
            df.unpersist()

    def update(self, *_, **__) -> None:
        """A fit is final: series that grow are followed by the states of `streaming.updates`, which are for SVD models."""
        how = "has no incremental form; fit it again" if self.method == "als" else "is final; use streaming.updates.start and update"
        raise NotImplementedError(f"a fitted {self.method} model {how}")

    def weight_table(self) -> DataFrame:
        rows = [(self.keys[r // self.n], r % self.n, float(w)) for r, w in zip(self.rows, self.weights, strict=True)]
        return self.cells.sparkSession.createDataFrame(rows, "series_key string, lag_row int, w double")

    def denoised(self, first: int | None = None, stop: int | None = None) -> DataFrame:
        """(series_key, t, value) of all series, or of a range of t; t counts within the fitted points."""
        key = F.element_at(F.array(*[F.lit(k) for k in self.keys]), (F.floor(F.col("row") / self.n) + 1).cast("int"))
        out = self.cells.select(key.alias("series_key"), (F.col("c") * self.n + F.pmod("row", F.lit(self.n))).cast("long").alias("t"), "value")
        out = out.where(F.col("t") >= first) if first is not None else out
        return out.where(F.col("t") < stop) if stop is not None else out

    def predict(self, others: dict[str, list[float]], target: list[float], check: bool = True) -> float:
        """The next value of the target from the newest points: n - 1 of each (n of others if not past_only)."""
        parts = []
        for i, key in enumerate(self.keys):
            own = target if i == len(self.keys) - 1 else others.get(key, [])
            need = self.n - 1 if self.past_only or i == len(self.keys) - 1 else self.n
            if check and len(own) < need:
                raise ValueError(f"series {key!r} has {len(own)} points; {need} are needed")
            parts.append(np.asarray(own[len(own) - need :], float))
        return float(np.concatenate(parts) @ self.weights)

    def forecast(self, series: DataFrame, block: int = 65_536) -> DataFrame:
        """(series_key, t, actual, forecast) one step ahead of the target for every t that has its past in `series`.

        Every forecast at once: points are dealt to blocks of t, each with the n - 1 points before it, so that windows
        stay within a block; keys meet by (t) after their parts are summed.
        """
        target = self.keys[-1]
        used = page.key_blocks(series, self.keys).select("series_key", "t", "value")
        own = F.floor(F.col("t") / block).cast("long")
        halo = F.floor((F.col("t") + self.n - 1) / block).cast("long")
        dealt = used.withColumn("b", F.explode(F.array_distinct(F.array(own, halo)))).withColumn("own", own == F.col("b"))
        w = Window.partitionBy("series_key", "b").orderBy("t")
        at = {k: i for i, k in enumerate(self.keys)}
        part = None
        for key, i in at.items():
            mine = {r % self.n: float(v) for r, v in zip(self.rows, self.weights, strict=True) if r // self.n == i}
            # lag row r stands n - 1 - r points before the forecast's own t
            total = sum((F.lag("value", self.n - 1 - r).over(w) if r < self.n - 1 else F.col("value")) * F.lit(v) for r, v in mine.items())
            part = F.when(F.col("series_key") == key, total) if part is None else part.when(F.col("series_key") == key, total)
        whole = F.lag("t", self.n - 1).over(w) == F.col("t") - (self.n - 1) if self.n > 1 else F.lit(True)
        sums = dealt.withColumns({"part": part, "whole": whole}).where("own")
        out = sums.groupBy("t").agg(F.sum("part").alias("forecast"), F.max(F.when(F.col("series_key") == target, F.col("value"))).alias("actual"), F.count(F.when(F.col("whole") & F.col("part").isNotNull(), 1)).alias("n"))
        return out.where(F.col("n") == len(self.keys)).select(F.lit(target).alias("series_key"), "t", "actual", "forecast")


def _points(series: DataFrame, keys: list[str], n: int, m: int, check: bool) -> DataFrame:
    if check:
        page.check_shape(series, n, m, keys)
    return page.stacked(page.tail_points(series.where(F.col("series_key").isin(keys)), n * m), keys, n)


def fit_svd(series: DataFrame, target: str, others: list[str] | None = None, *, n: int, m: int, k: int, p: float = 1.0, past_only: bool = True, rcond: float = 1e-7, check: bool = True) -> Forecaster:
    """Mid-range fill over the whole frame, page matrices stacked, rank k, weights. One pass for the Gram matrix, one to de-noise."""
    keys = [*(others or []), target]
    side = n * len(keys)
    cells = _points(fill.midrange_fill(series), keys, n, m, check)
    rows = page.regressor_rows(n, len(keys), past_only)
    if side <= max(m, 64):
        cols = factor.columns(cells, side).persist()
        held = (cols,)
        g = factor.gram(cols, side)
        s, u = factor.eigen(g, k)
        w = factor.forecast_weights(g, rows, side - 1, k, p, rcond)
        flat = factor.project(cols, u @ u.T / p).select("c", F.posexplode("y").alias("row", "value"))
    else:  # more rows than columns: the Gram matrix of the columns
        by_row = factor.columns(cells, m, "c", "row").persist()
        held = (by_row,)
        g = factor.gram(by_row, m)
        s, v = factor.eigen(g, k)
        q = v @ v.T
        picked = by_row.where(F.col("c").isin(rows))
        s2, v2 = factor.eigen(q @ factor.gram(picked, m) @ q / p**2, k)
        ell = np.array(by_row.where(F.col("c") == side - 1).select("x").first().x)
        x = v2 @ (factor.inverse_squares(s2, rcond) * (v2.T @ ell))
        w = _rows_dot(picked, q @ x, len(rows), rows)
        u = _left(by_row, v, s, side)
        flat = factor.project(by_row, q / p).select(F.col("c").alias("row"), F.posexplode("y").alias("c", "value"))
    return Forecaster(keys, n, m, k, p, past_only, rows, w, s, u, flat.select(F.col("row").cast("long").alias("row"), F.col("c").cast("long").alias("c"), "value"), side - 1, "svd", held)


def _rows_dot(by_row: DataFrame, x: np.ndarray, n: int, rows: list[int]) -> np.ndarray:
    """x dotted with each row, on the executors; one number a row comes back."""
    got = {r.c: r.y[0] for r in factor.project(by_row, x[None]).collect()}
    return np.array([got[r] for r in rows])


def _left(by_row: DataFrame, v: np.ndarray, s: np.ndarray, side: int) -> np.ndarray:
    out = np.zeros((side, len(s)))
    for r in factor.project(by_row, (v / np.where(s > 0, s, 1)).T).collect():
        out[r.c] = r.y
    return out


def fit_als(series: DataFrame, target: str, others: list[str] | None = None, *, n: int, m: int, k: int, p: float = 1.0, past_only: bool = True, iterations: int = 100, tol: float = 1e-9, seed: int = 0, check: bool = True) -> Forecaster:
    """Masked ALS without filling, estimates clipped to the observed range, the target's missing last-row values from the
    estimate, and weights by the pseudo-inverse of the estimate. p has no effect."""
    keys = [*(others or []), target]
    side = n * len(keys)
    cells = _points(series, keys, n, m, check).persist()
    u, v, _, _ = factor.als(cells, k, 0.0, iterations, tol, seed)
    e = cells.agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
    estimate = factor.reconstruct(u, v).withColumn("value", F.greatest(F.least("value", F.lit(e.b)), F.lit(e.a))).persist()
    ell = cells.where(F.col("row") == side - 1).select("c", F.col("value").alias("seen")).join(estimate.where(F.col("row") == side - 1), "c", "right").select(F.lit(side).cast("long").alias("row"), "c", F.coalesce("seen", "value").alias("value"))
    g = factor.gram(factor.columns(estimate.select("row", "c", "value").unionByName(ell), side + 1), side + 1)
    rows = page.regressor_rows(n, len(keys), past_only)
    w = np.linalg.pinv(g[np.ix_(rows, rows)], rcond=1e-12, hermitian=True) @ g[rows, side]
    s, left = factor.eigen(g[:side, :side], k)
    return Forecaster(keys, n, m, k, p, past_only, rows, w, s, left, estimate.select("row", F.col("c").cast("long").alias("c"), "value"), side - 1, "als", (cells, estimate))


FITS = {"svd": fit_svd, "als": fit_als}


@dataclass(frozen=True)
class SyntheticControl:
    """A forecaster of one row a unit: the target as a combination of donors at the same time."""

    model: Forecaster

    @classmethod
    def fit(cls, series: DataFrame, target: str, donors: list[str], *, m: int, k: int, p: float = 1.0, method: str = "svd", **options) -> SyntheticControl:
        if method not in FITS:
            raise ValueError(f"method must be one of {sorted(FITS)}")
        return cls(FITS[method](series, target, donors, n=1, m=m, k=k, p=p, past_only=False, **options))

    def weights(self) -> DataFrame:
        return self.model.weight_table().select("series_key", "w")

    def predict(self, donors: DataFrame) -> DataFrame:
        """(t, prediction) for every t of the donors' series. Weights are as many as donors: joined, not collected."""
        return donors.join(self.weights(), "series_key").groupBy("t").agg(F.sum(F.col("w") * F.col("value")).alias("prediction"))


@dataclass(frozen=True)
class MultiMetricControl:
    """Several metrics side by side, each scaled by the root of its weight."""

    control: SyntheticControl
    metric_weights: list[float]

    @classmethod
    def fit(cls, metrics: list[DataFrame], metric_weights: list[float], target: str, donors: list[str], *, m: int, k: int, p: float = 1.0, method: str = "svd", **options) -> MultiMetricControl:
        joined = page.combine_metrics(metrics, metric_weights, m)
        return cls(SyntheticControl.fit(joined, target, donors, m=m * len(metrics), k=k, p=p, method=method, **options), list(metric_weights))

    def predict(self, metrics: list[DataFrame], unscale: bool = False) -> DataFrame:
        """(metric, t, prediction). Predictions stay scaled by the root of the metric's weight unless unscale."""
        if len(metrics) != len(self.metric_weights):
            raise ValueError("as many metrics as were fitted are needed")
        out = None
        for i, (df, w) in enumerate(zip(metrics, self.metric_weights, strict=True)):
            root = F.sqrt(F.lit(float(w)))
            part = self.control.predict(df.withColumn("value", F.col("value") * root))
            part = part.select(F.lit(i).alias("metric"), "t", (F.col("prediction") / root if unscale else F.col("prediction")).alias("prediction"))
            out = part if out is None else out.unionByName(part)
        return out


@dataclass(frozen=True)
class Cut:
    """Stretches of `points` points: `regular` ones side by side, and perhaps a last one that ends with the points and overlaps.

    Starts and lengths are calculated, not listed: there may be very many."""

    size: int
    points: int
    regular: int
    overlaps: bool
    rows: int

    @classmethod
    def of(cls, points: int, size: int, gamma: float, rows: int) -> Cut:
        regular = max(points - size, 0) // size + 1
        return cls(size, points, regular, 0 < points - regular * size >= gamma * size, rows)

    def __len__(self) -> int:
        return self.regular + self.overlaps

    def start(self, b: int) -> int:
        return b * self.size if b < self.regular else self.points - self.size

    def length(self, b: int) -> int:
        return min(self.size, self.points - self.start(b)) // self.rows * self.rows


def _stretches(series: DataFrame, target: str, cut: Cut) -> DataFrame:
    """(b, x): the points of each stretch in order of t. Only the last stretch may overlap the one before."""
    last = len(cut) - 1
    own = F.floor(F.col("t") / cut.size).cast("long")
    at = F.array(F.when(own < cut.regular, own), F.when(F.lit(cut.overlaps) & (F.col("t") >= cut.start(last)), F.lit(last).cast("long")))
    used = series.where((F.col("series_key") == target) & (F.col("t") >= 0) & (F.col("t") < cut.start(last) + cut.length(last)))
    dealt = used.withColumn("b", F.explode(F.filter(at, lambda v: v.isNotNull())))
    points = F.transform(F.array_sort(F.collect_list(F.struct("t", F.coalesce("value", F.lit(float("nan"))).alias("v")))), lambda v: v["v"])
    return dealt.groupBy("b").agg(points.alias("x"))


def _segments(stretches: DataFrame, cut: Cut, rows: int, k: int) -> DataFrame:
    """(b, w, s, u, clean): each stretch's fit as `fit_svd` makes it, where its points are; one pass for all stretches."""
    used = page.regressor_rows(rows, 1, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array(x)
                if len(x) != cut.length(b):
                    raise ValueError(f"stretch {b} has {len(x)} points; {cut.length(b)} are needed")
                hole = np.isnan(x)
                x[hole] = (np.nanmin(x) + np.nanmax(x)) / 2 if not hole.all() else np.nan
                a = x.reshape(-1, rows).T
                g = a @ a.T
                s, u = factor.eigen(g, k)
                out.append((b, factor.forecast_weights(g, used, rows - 1, k, 1.0), s, u.ravel(), (u @ (u.T @ a)).T.ravel()))
            if out:
                b, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), *(pa.array([list(v) for v in c], pa.list_(pa.float64())) for c in rest)], ["b", "w", "s", "u", "clean"])

    return stretches.mapInArrow(run, "b long, w array<double>, s array<double>, u array<double>, clean array<double>")


#: Sub-models that come to the driver at once, and that it remembers.
FETCHED = 1024


class Submodels(Sequence):
    """The sub-models of a segmented model, which stay where they were fitted until one is asked for.

    The first `kept` are those of the model before, the others rows of `fitted`."""

    def __init__(self, target: str, rows: int, k: int, cut: Cut, kept: int, before: Sequence[Forecaster], fitted: DataFrame, cells: DataFrame):
        self.target, self.rows, self.k, self.cut, self.kept, self.before, self.fitted, self.cells = target, rows, k, cut, kept, before, fitted, cells
        self.seen: OrderedDict[int, Forecaster] = OrderedDict()

    def __len__(self) -> int:
        return len(self.cut)

    def __getitem__(self, i):
        if isinstance(i, slice):
            at = range(len(self))[i]
            return tuple(m for a in range(0, len(at), FETCHED) for m in self._take(at[a : a + FETCHED]))
        return self._take([range(len(self))[i]])[0]

    def __iter__(self) -> Iterator[Forecaster]:
        for a in range(0, len(self), FETCHED):
            yield from self._take(range(a, min(a + FETCHED, len(self))))

    def _take(self, at: Sequence[int]) -> list[Forecaster]:
        owners: dict[int, tuple[Submodels, list[int]]] = {}
        for b in at:
            m = self
            while b < m.kept:
                m = m.before
            owners.setdefault(id(m), (m, []))[1].append(b)
        out = {}
        for m, own in owners.values():
            out |= m._own(own)
        return [out[b] for b in at]

    def _own(self, at: list[int]) -> dict[int, Forecaster]:
        out = {b: self.seen[b] for b in at if b in self.seen}
        new = [b for b in at if b not in out]
        if new:
            used = page.regressor_rows(self.rows, 1, True)
            for r in self.fitted.where(F.col("b").isin(new)).select("b", "w", "s", "u").collect():  # FETCHED rows at most
                s = np.array(r.s)
                out[r.b] = self.seen[r.b] = Forecaster([self.target], self.rows, self.cut.length(r.b) // self.rows, self.k, 1.0, True, used, np.array(r.w), s, np.array(r.u).reshape(self.rows, len(s)), self.cells.where(F.col("b") == r.b).drop("b"), self.rows - 1)
            while len(self.seen) > FETCHED:
                self.seen.popitem(last=False)
        for b in new:
            if b not in out:
                raise ValueError(f"stretch {b} has no points; {self.cut.length(b)} are needed")
        return out


@dataclass(frozen=True)
class Segmented:
    """Sub-models over consecutive stretches of one series; forecasts are averages of the last few sub-models'.

    Our reading of an interface of which only the parameters are public: rows (L), the least points before the first fit
    (T0), the share of new points that lets a sub-model be built anew (gamma), rank (k) and columns per row (rect).
    """

    target: str
    rows: int
    k: int
    rect: int
    least: int
    gamma: float
    points: int = 0
    built: int = 0
    models: Sequence[Forecaster] = ()
    cut: Cut | None = None
    cells: DataFrame | None = field(default=None, repr=False)
    cached: tuple[DataFrame, ...] = field(default=(), repr=False)

    @classmethod
    def begin(cls, target: str, *, rows: int, k: int, rect: int, least: int = 0, gamma: float = 0.5) -> Segmented:
        """Without any point so far; `update` takes them."""
        return cls(target, rows, k, rect, least, gamma)

    @classmethod
    def fit(cls, series: DataFrame, target: str, points: int, *, rows: int, k: int, rect: int, least: int = 0, gamma: float = 0.5) -> Segmented:
        if points < least:
            raise ValueError(f"{least} points are needed")
        return cls.begin(target, rows=rows, k=k, rect=rect, least=least, gamma=gamma).update(series, points)

    def update(self, series: DataFrame, points: int) -> Segmented:
        """The model once the series has `points` points, of which only those of sub-models that are to be built are read.

        Nothing is built before there are `least` points and one whole column, nor until gamma times a segment (of the first
        sub-model, while it is shorter) have come since the last build. After a build all is as `fit` makes it of these points:
        whole segments stay, the last, shorter or overlapping one is replaced. `built` counts all sub-models ever built.
        """
        if points < self.points:
            raise ValueError(f"{self.points} points are fitted already")
        size = self.rows * self.rows * self.rect
        if points < max(self.least, self.rows) or self.models and points - self.points < self.gamma * min(size, self.points):
            return self
        cut = Cut.of(points, size, self.gamma, self.rows)
        kept = self.cut.regular if self.cut is not None and self.cut.length(0) == size else 0
        if self.cut is not None and kept == len(cut) == len(self.cut):  # no new point
            return self
        new = _stretches(series.where(F.col("t") >= cut.start(kept)), self.target, cut).where(F.col("b") >= kept)
        fitted = _segments(new, cut, self.rows, self.k).persist()
        fitted.count()  # all are built now; none comes to the driver
        cells = fitted.select("b", F.posexplode("clean").alias("q", "value")).select("b", F.pmod("q", F.lit(self.rows)).cast("long").alias("row"), F.floor(F.col("q") / self.rows).cast("long").alias("c"), "value")
        models = Submodels(self.target, self.rows, self.k, cut, kept, self.models, fitted, cells)
        if kept:
            cells = self.cells.where(F.col("b") < kept).unionByName(cells)
        return replace(self, points=points, built=self.built + len(cut) - kept, models=models, cut=cut, cells=cells, cached=(*self.cached, fitted))

    @property
    def starts(self) -> tuple[int, ...]:
        return tuple(self.cut.start(b) for b in range(len(self.cut))) if self.cut is not None else ()

    def release(self) -> None:
        """Frees what the fits have cached; de-noised values can still be asked for, and are computed again."""
        for df in self.cached:
            df.unpersist()

    def denoised(self) -> DataFrame:
        """Where sub-models overlap, the later one's values."""
        if not self.models:
            raise ValueError("no sub-model is built yet")
        start = F.when(F.col("b") < self.cut.regular, F.col("b") * self.cut.size).otherwise(self.cut.start(self.cut.regular))
        out = self.cells.withColumn("t", (start + F.col("c") * self.rows + F.col("row")).cast("long"))
        if self.cut.overlaps:
            out = out.where((F.col("b") >= self.cut.regular) | (F.col("t") < self.cut.start(self.cut.regular)))
        return out.select(F.lit(self.target).alias("series_key"), "t", "value")

    def predict(self, past: list[float], last: int = 1) -> float:
        """The next value from the newest rows - 1 points, as the mean of the last sub-models'."""
        if not self.models:
            raise ValueError("no sub-model is built yet")
        return float(np.mean([m.predict({}, past) for m in self.models[-last:]]))
