"""Vectorised text primitives over Arrow string columns.

Everything here works on the UTF-8 bytes of a batch of texts with numpy, so the Python side of an operator costs a
few array passes a batch and no work per character. Batches are cut into slices of bounded bytes first: memory does
not depend on how long the texts are (a single text longer than the bound is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII whitespace: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Whatever is not a digit, an ASCII letter or part of a non-ASCII character.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
#: Bytes that start a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_TABLE = np.random.RandomState(20240229).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n < 1 << 23:  # a single huge text is not worth keeping its table
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most `most` bytes together (or one row)."""
    _, off = column_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def tokens(data: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without a separator byte, and the offsets of each row's runs among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    on = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = on[:-1]
    starts = np.flatnonzero(on & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = on[1:]
    ends = np.flatnonzero(on & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] = the polynomial of bytes s..e, or of 64-bit hashes, times a power that `span_hash` takes out."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLE[data] if data.dtype == np.uint8 else data) * _pow(_P, len(data))[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix((h[ends] - h[starts]) * _pow(_PINV, len(h))[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by the index of their first word (rows' borders are the caller's)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + words[j : j + m]
    return mix(out)


def rows_of(off: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def word_hashes(column: pa.Array, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a string column, and the rows' offsets among them."""
    data, off = column_bytes(column)
    data = LOWER[data]
    s, e, wo = tokens(data, off, separator)
    return span_hash(prefix_hash(data), s, e), wo


def segments(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def small_batches(spark) -> None:
    """Arrow batches of few rows: long texts make a batch of 10,000 rows too large for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
