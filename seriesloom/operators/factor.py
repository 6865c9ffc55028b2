"""Low-rank factorisation through Gram matrices and masked alternating least squares.

Columns of a matrix travel as arrays (c, x): one shuffle brings a column's cells together, and every later step is a pass
without one. The Gram matrix is summed per task; only its square, of the smaller side of the matrix, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a Gram matrix that the driver holds: a side of 8,192.
MOST_BYTES = 1 << 29
#: Rows of a Gram matrix that travel together.
ROWS = 64
#: Blocks of rows, and of columns, of a product of factors.
DEALT = 16


def columns(cells: DataFrame, rows: int, row: str = "row", col: str = "c", value: str = "value") -> DataFrame:
    """(c, x): the columns of a dense matrix as arrays of `rows` values; columns with gaps are an error downstream."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(value).alias("v")))), lambda s: s["v"])
    return cells.groupBy(F.col(col).cast("long").alias("c")).agg(ordered.alias("x")).withColumn("x", F.when(F.size("x") == rows, F.col("x")))


def _block(b: pa.RecordBatch, width: int) -> np.ndarray:
    x = b.column(1)
    if x.null_count:
        raise ValueError(f"column {b.column(0)[x.to_pylist().index(None)]} does not have {width} cells")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)


def gram(cols: DataFrame, side: int) -> np.ndarray:
    """Sum over columns of x x': A A' of the matrix with these columns.

    Each task sums its own and sends the upper triangle as packed rows; rows are added up on the executors, so that one
    triangle comes to the driver, whatever the number of tasks.
    """
    if 8 * side * side > MOST_BYTES:
        raise ValueError(f"a Gram matrix of side {side} does not fit the driver; lay the matrix out by its shorter side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((side, side))
        for b in batches:
            x = _block(b, side)
            g += x.T @ x
        for a in range(0, side, ROWS):
            at = range(a, min(a + ROWS, side))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([g[i, i:].tobytes() for i in at], pa.binary())], ["i", "g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                row = np.frombuffer(raw.as_buffer())
                if i != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()], pa.binary())], ["i", "g"])
                    now, total = i, np.zeros(len(row))
                total += row
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()], pa.binary())], ["i", "g"])

    parts = cols.select("c", "x").mapInArrow(run, "i long, g binary").repartition("i").sortWithinPartitions("i")
    out = np.zeros((side, side))
    for r in parts.mapInArrow(add, "i long, g binary").collect():  # MOST_BYTES / 2 at most
        out[r.i, r.i :] = out[r.i :, r.i] = np.frombuffer(r.g)
    return out


def gram_rows(cells: DataFrame) -> DataFrame:
    """A A' of (row, c, value) cells as a table (i, j, g), for a side beyond the driver or few rows: a join on c."""
    a = cells.select(F.col("row").alias("i"), "c", F.col("value").alias("x"))
    b = cells.select(F.col("row").alias("j"), "c", F.col("value").alias("y"))
    return a.join(b, "c").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("g"))


def eigen(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values and left vectors of a matrix with this Gram matrix. k beyond the side is the side."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    w, u = np.linalg.eigh(g)
    order = np.argsort(-w)[: min(k, len(w))]
    return np.sqrt(np.maximum(w[order], 0)), u[:, order]


def inverse_squares(s: np.ndarray, rcond: float) -> np.ndarray:
    """1 / s^2, and 0 where s is at most rcond of the largest: a Gram matrix does not tell those from 0."""
    return np.where(s > rcond * max(s.max(initial=0), 1e-300), 1 / np.maximum(s, 1e-300) ** 2, 0)


def project(cols: DataFrame, p: np.ndarray) -> DataFrame:
    """(c, y) with y = p x: de-noising is one pass over the columns."""
    side = p.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _block(b, side) @ p.T
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], ["c", "y"])

    return cols.select("c", "x").mapInArrow(run, "c long, y array<double>")


def truncated(cols: DataFrame, side: int, k: int, p: float = 1.0) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Singular values, left vectors and the rank-k approximation, scaled by 1 / p."""
    s, u = eigen(gram(cols, side), k)
    return s, u, project(cols, u @ u.T / p)


def pseudo_inverse(cols: DataFrame, side: int, k: int, p: float = 1.0, rcond: float = 1e-7) -> DataFrame:
    """(c, y): rows of p V diag(1 / s) U', the pseudo-inverse of the rank-k part scaled by 1 / p."""
    s, u = eigen(gram(cols, side), k)
    return project(cols, p * (u * inverse_squares(s, rcond)) @ u.T)


def forecast_weights(g: np.ndarray, rows: list[int], target: int, k: int, p: float, rcond: float = 1e-7) -> np.ndarray:
    """Weights of the regressor rows for the target row, from the Gram matrix alone.

    The rank-k approximation's rows are regressed on: w = pinv' of their own rank-k part times the target row as it is.
    """
    _, u = eigen(g, k)
    b = (u @ u.T / p)[rows]
    s2, u2 = eigen(b @ g @ b.T, k)
    return p * u2 @ (inverse_squares(s2, rcond) * (u2.T @ (b @ g[:, target])))


def fold_in(u: np.ndarray, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rows of the right factor for new columns d (rows x new): U and s stay."""
    return d.T @ (u / s)


def rank_k_update(u: np.ndarray, s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left vectors and singular values of [A_k | d] cut to rank k, and the k x (k + new) map of the old right rows and
    the unit vectors of the new columns to its right rows."""
    k, new = len(s), d.shape[1]
    m = u.T @ d
    q, r = np.linalg.qr(d - u @ m)
    core = np.zeros((k + q.shape[1], k + new))
    core[:k, :k] = np.diag(s)
    core[:k, k:], core[k:, k:] = m, r
    a, b, c = np.linalg.svd(core, full_matrices=False)
    return np.hstack([u, q]) @ a[:, :k], b[:k], c[:k]


def als(cells: DataFrame, rank: int, lam: float = 0.0, iterations: int = 1000, tol: float = 1e-6, seed: int = 0, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame, float, int]:
    """Masked alternating least squares of (row, c, value) cells, missing ones NULL or absent: (U (row, f), V (c, f), error, rounds).

    Both factors stay tables: a round sends each factor once to the cells by a join and sums k x k normal equations where
    they are, so neither side has to fit a task. lam is not scaled by counts. The error is over all cells, as the stop
    rule needs, and follows from the normal equations without another join. V starts from `start` (c, f), or from the
    mid-range times fixed pseudo-random numbers. Of the rounds' factors only the last stay cached.
    """
    spark = cells.sparkSession
    obs = cells.where(F.col("value").isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("c").cast("long").alias("c"), F.col("value").cast("double").alias("value")).persist()
    e = cells.agg(F.min(F.coalesce("value", F.lit(0.0))).alias("a"), F.max(F.coalesce("value", F.lit(0.0))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    mid, size = (e.a + e.b) / 2 if e.n else 0.0, max(e.n, 1)
    if start is None:
        h = lambda f: F.pmod(F.xxhash64("c", F.lit(seed), F.lit(f)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        v = obs.select("c").distinct().select("c", F.array(*[h(f) * F.lit(float(mid)) for f in range(rank)]).alias("f"))
    else:
        v = start.select("c", "f")

    def solve(joined: DataFrame, key: str) -> DataFrame:
        pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
        at = lambda i: F.col("f")[i]
        sums = joined.groupBy(key).agg(F.array(*[F.sum(at(i) * at(j)) for i, j in pairs]).alias("a"), F.array(*[F.sum(at(i) * F.col("value")) for i in range(rank)]).alias("b"), F.sum(F.col("value") * F.col("value")).alias("s"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = b.num_rows
                upper = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, len(pairs))
                a = np.zeros((n, rank, rank))
                for q, (i, j) in enumerate(pairs):
                    a[:, i, j] = a[:, j, i] = upper[:, q]
                right = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, rank)
                f = np.einsum("nij,nj->ni", np.linalg.pinv(a + lam * np.eye(rank), hermitian=True), right)
                e = b.column(3).to_numpy(zero_copy_only=False) - 2 * (f * right).sum(1) + np.einsum("ni,nij,nj->n", f, a, f)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(f), pa.list_(pa.float64())), pa.array(np.maximum(e, 0))], [key, "f", "e"])

        return sums.mapInArrow(run, f"{key} long, f array<double>, e double")

    def kept(df: DataFrame) -> DataFrame:
        return df.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()

    error, done, held = float("inf"), 0, []
    for done in range(1, iterations + 1):
        u = kept(solve(obs.join(v.select("c", "f"), "c"), "row"))
        v = kept(solve(obs.join(u.select("row", "f"), "row"), "c"))
        now = (v.agg(F.sum("e").alias("e")).first().e or 0.0) / size
        for x in held:
            x.unpersist()
        held = [u, v]
        stop, error = abs(error - now) < tol, now
        if stop:
            break
    obs.unpersist()
    return u.select("row", "f"), v.select("c", "f"), error, done


def reconstruct(u: DataFrame, v: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(row, c, value) of U V', for the given cells or for all.

    For all cells the rows and columns are dealt to blocks, as in a product of matrices by blocks: each block of the result
    meets the factors of its rows and columns only, and neither factor has to fit anywhere as a whole.
    """
    g = v.withColumnRenamed("f", "g")
    if cells is not None:
        both = cells.select("row", "c").join(u, "row").join(g, "c")
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))
        deal = lambda key: F.pmod(F.xxhash64(key), F.lit(DEALT)).cast("int")
        both = u.withColumn("a", deal("row")).withColumn("b", every).join(g.withColumn("b", deal("c")).withColumn("a", every), ["a", "b"])
    return both.select("row", "c", F.aggregate(F.zip_with("f", "g", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y).alias("value"))
