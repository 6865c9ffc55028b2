"""Reading the tables, and writing intermediate ones where every executor sees them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textops import mix

#: With it, the shuffle files of a write are removed when the write ends, not when the driver's memory happens to be cleaned.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Most bits of the filter that keeps unwanted texts from being shipped; 16 for each wanted one, up to these.
FILTER = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, as in tests, one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return at.rstrip("/") if at else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/seriesloom-shared"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    was = spark.conf.get(CLEAN, None)
    try:
        spark.conf.set(CLEAN, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if was is None else spark.conf.set(CLEAN, was)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and a lost executor costs nothing already written."""
    return _write(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


class Shelf:
    """The intermediate tables of one job: written under names of their own, and removed once what reads them is written.

    What a lazy result still reads must stay; only the caller knows when that has been read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[str, list[str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{self.made}-{name}"
        self.made += 1
        self.paths.setdefault(name, []).append(path)
        return _write(df, path)

    def drop(self, *names: str) -> None:
        """Removes all tables written under these names."""
        jvm = self.spark.sparkContext._jvm
        for path in [p for n in names for p in self.paths.pop(n, ())]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _filter(wanted: DataFrame, key: str):
    """A Bloom filter of the wanted keys, of bounded size, as a function from keys to flags for use in tasks."""
    spark, span = wanted.sparkSession, 1 << 14
    width = span * 8
    while width < min(FILTER, 16 * wanted.count()):
        width *= 2

    def blocks(bits: np.ndarray) -> pa.RecordBatch:
        parts = [(i, bits[i * span : (i + 1) * span]) for i in range(len(bits) // span)]
        parts = [(i, x.tobytes()) for i, x in parts if x.any()]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["block", "bits"])

    def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h = mix(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        return (h & np.uint64(width - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(width, bool)
        for b in batches:
            for at in places(b.column(0)):
                bits[at] = True
        yield blocks(np.packbits(bits))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(width // 8, np.uint8)
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bits[i * span : (i + 1) * span] |= np.frombuffer(raw, np.uint8)
        yield blocks(bits)

    schema = "block int, bits binary"
    whole = np.zeros(width // 8, np.uint8)
    for r in wanted.select(key).coalesce(64).mapInArrow(mark, schema).repartition("block").mapInArrow(join, schema).collect():  # FILTER bits at most
        whole[r.block * span : (r.block + 1) * span] |= np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(whole.tobytes())

    def test(column: pa.Array) -> np.ndarray:
        bits = np.frombuffer(shared.value, np.uint8)
        one, two = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 for at in places(column))
        return (one & two).astype(bool)

    return test


def needed(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Rows without most of those whose key (whole numbers, the first decides) is not wanted, by a Bloom filter of bounded
    size; a key once a task, so that copies are not shipped. A join does the rest."""
    test = _filter(wanted, key[0])
    ordered = rows.select(*key, *(c for c in rows.columns if c not in key))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            found = np.flatnonzero(test(b.column(0)))
            first = []
            for k, own in zip(found.tolist(), zip(*(b.column(i).take(pa.array(found)).to_pylist() for i in range(len(key))), strict=True), strict=True):
                if own not in seen:
                    seen.add(own)
                    first.append(k)
            if len(seen) > 200_000:
                seen.clear()
            yield b.take(pa.array(first, pa.int64()))

    return ordered.mapInArrow(keep, ordered.schema)


def parted(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key (a whole number, the first column) is surely not wanted, and all others; both read the rows."""
    test = _filter(wanted, key)

    def side(flag: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(test(b.column(0)) == flag))

        return rows.mapInArrow(run, rows.schema)

    return side(False), side(True)
