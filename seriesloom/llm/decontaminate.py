"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item has a weighted SimHash of its word 5-grams. Windows of an item's size slide over the documents;
their fingerprints probe a multi-index, and what is near is verified by the exact weighted similarity of the 5-grams.
The index has blocks of 32 bits, each of two halves: of two fingerprints within the radius some block differs in at most
radius / blocks bits and one half of it in at most half of these, so that no fingerprint within the radius is missed, and
only items with such a half and block are compared as a whole.

A window without any 5-gram of an item has similarity 0 to it, so windows are made where at least one stands.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import NOT_ALNUM, mix, segments, slices, small_batches, windows_hash, word_hashes

#: Bits of a fingerprint, and the radius: at similarity 0.75 prints differ in 44 bits on average, with a deviation of 6.
BITS = 256
RADIUS = 63
#: Bits of a block of the multi-index, and of its halves.
BLOCK, HALF = 32, 16
#: Windows of a document whose fingerprints are made at a time.
WINDOWS = 2048
#: Items that are broadcast at a time; a larger benchmark is gone through in blocks of so many.
BLOCK_ITEMS = 20_000
_SALT = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))


def signs(grams: np.ndarray) -> np.ndarray:
    """+1 or -1 for each n-gram and bit."""
    words = mix(grams[:, None] ^ _SALT)
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def whole(weight: float) -> int:
    """Weights in fingerprints are whole numbers, so that running sums are exact and equal windows get equal prints."""
    return round(weight * 64)


def pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of bit sums, as rows of 64-bit words."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)


def within(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most `most` bits set."""
    every = np.arange(1 << bits, dtype=np.uint16 if bits <= 16 else np.uint32)
    return every[np.bitwise_count(every) <= most]


class Halves:
    """One half of a block of all items: which items differ from a value in at most `most` bits.

    Values that differ so little are looked up, or, where the items have fewer values than that, all their values compared:
    the items found are the same.
    """

    def __init__(self, values: np.ndarray, most: int):
        self.order = np.argsort(values, kind="stable")
        self.values, start = np.unique(values[self.order], return_index=True)
        self.start, self.most = np.append(start, len(values)), most
        self.masks = within(HALF, most)

    def near(self, asked: np.ndarray, look: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the asked value, item) for all that are near."""
        if look if look is not None else len(self.masks) < len(self.values):
            w, m = np.divmod(np.arange(len(asked) * len(self.masks)), len(self.masks))
            value = asked[w] ^ self.masks[m]
            at = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
            hit = self.values[at] == value
            w, at = w[hit], at[hit]
        else:
            w, at = np.nonzero(np.bitwise_count(asked[:, None] ^ self.values[None]) <= self.most)
        count = self.start[at + 1] - self.start[at]
        return np.repeat(w, count), self.order[np.repeat(self.start[at], count) + segments(count)]


@dataclass
class Index:
    """The items of one n-gram length n: grams, their multiset, fingerprints and the blocks of the multi-index."""

    n: int
    items: list[int]
    bags: list[dict[int, int]]
    sizes: np.ndarray
    totals: np.ndarray
    prints: np.ndarray
    weight: dict[int, float]
    rare: float
    radius: int

    def __post_init__(self) -> None:
        self.grams = np.array(sorted({g for bag in self.bags for g in bag}), np.uint64)
        self.weighted = np.array(sorted(self.weight), np.uint64)
        self.gram_weight = np.array([whole(self.weight[g]) for g in sorted(self.weight)], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.postings: dict[int, list[int]] = {}
        for i, bag in enumerate(self.bags):
            for g in bag:
                self.postings.setdefault(g, []).append(i)
        self.halves: list[Halves] | None = None

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Indices of n-grams that some item has."""
        at = np.flatnonzero(self.maybe[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(self.grams, grams[at]), max(len(self.grams) - 1, 0))
        return at[self.grams[pos] == grams[at]] if len(self.grams) else at[:0]

    def weights(self, grams: np.ndarray) -> np.ndarray:
        pos = np.minimum(np.searchsorted(self.weighted, grams), len(self.weighted) - 1)
        return np.where(self.weighted[pos] == grams, self.gram_weight[pos], whole(self.rare))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) that some block of the multi-index lets through, in order and once."""
        per = BLOCK // HALF
        if self.halves is None:  # made where it is used: it is larger than what it is made from
            values = self.prints.view(np.uint16)
            self.halves = [Halves(values[:, h], self.radius // (BITS // BLOCK) // per) for h in range(BITS // HALF)]
        asked, own, other = prints.view(np.uint16), prints.view(np.uint32), self.prints.view(np.uint32)
        found = []
        for h, half in enumerate(self.halves):
            w, i = half.near(asked[:, h])
            close = np.bitwise_count(own[w, h // per] ^ other[i, h // per]) <= self.radius // (BITS // BLOCK)
            found.append(w[close] * len(other) + i[close])
        return np.divmod(np.unique(np.concatenate(found)), len(other))

    def near(self, prints: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each fingerprint the items within the radius, with their distances."""
        found: dict[int, list[tuple[int, int]]] = {}
        w, i = self.candidates(prints)
        d = np.bitwise_count(prints[w] ^ self.prints[i]).sum(1, dtype=np.int64)
        close = d <= self.radius
        for k, item, far in zip(w[close].tolist(), i[close].tolist(), d[close].tolist(), strict=True):
            found.setdefault(k, []).append((item, far))
        return found

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard of multisets."""
        bag, own = self.bags[item], Counter(window.tolist())
        both = sum(min(k, bag[g]) * self.weight[g] for g, k in own.items() if g in bag)
        return both / (sum(k * self.weight.get(g, self.rare) for g, k in own.items()) + self.totals[item] - both)


def item_grams(items: list[tuple[int, str | None]], n: int) -> dict[int, list[tuple[int, np.ndarray]]]:
    """(item, n-grams) by n-gram length: n, or an item's own number of words if it has fewer. Items without words are left out."""
    words, wo = word_hashes(pa.array([t or "" for _, t in items], pa.string()), NOT_ALNUM)
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for (i, _), a, b in zip(items, wo[:-1], wo[1:], strict=True):
        if b > a:
            k = min(n, int(b - a))
            by.setdefault(k, []).append((i, windows_hash(words[a:b], k)))
    return by


def frequencies(items: DataFrame, n: int) -> dict[int, tuple[int, dict[int, int]]]:
    """By n-gram length: the number of items (i, t), and how many items have an n-gram, for those that several have.

    An n-gram that one item has weighs as much as one that none has, so only what items share comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, own in item_grams([(0, t) for t in b.column(0).to_pylist()], n).items():
                grams = np.concatenate([np.unique(g) for _, g in own]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k] * (len(grams) + 1), pa.int32()), pa.array([*grams.tolist(), None], pa.int64()), pa.array([1] * len(grams) + [len(own)], pa.int64())], ["k", "gram", "c"])

    rows = items.select("t").mapInArrow(run, "k int, gram long, c long").groupBy("k", "gram").agg(F.sum("c").alias("c"))
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in rows.where("gram is null or c > 1").orderBy(F.col("gram").asc_nulls_first()).toLocalIterator():
        if r.gram is None:
            out[r.k] = (r.c, {})
        else:
            out[r.k][1][r.gram & (1 << 64) - 1] = r.c
    return out


def build(items: list[tuple[int, str | None]], n: int, radius: int, every: dict[int, tuple[int, dict[int, int]]] | None = None) -> list[Index]:
    """Indexes by n-gram length. every: `frequencies` of the whole benchmark, where items are a block of it."""
    out = []
    for k, own in sorted(item_grams(items, n).items()):
        df = Counter(g for _, grams in own for g in set(grams.tolist()))
        total = len(own)
        if every is not None:
            total, shared = every[k]
            df = dict.fromkeys(df, 1) | shared
        weight = {g: 1 + log(total / c) for g, c in df.items()}
        bags = [dict(Counter(grams.tolist())) for _, grams in own]
        totals = np.array([sum(c * weight[g] for g, c in bag.items()) for bag in bags])
        prints = np.concatenate([pack((signs(grams) * np.array([whole(weight[g]) for g in grams.tolist()])[:, None]).sum(0)[None]) for _, grams in own])
        out.append(Index(k, [i for i, _ in own], bags, np.array([len(g) for _, g in own]), totals, prints, weight, 1 + log(total), radius))
    return out


def matches(index: Index, grams: np.ndarray, hit: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
    """(item, start, n-grams, distance, similarity) of a document's best window for each item, ties to the first start.

    hit: the indices of grams that some item has.
    """
    sizes = {}
    for q in hit.tolist():
        for i in index.postings[int(grams[q])]:
            sizes.setdefault(int(index.sizes[i]), set()).add(q)
    best: dict[int, tuple[float, int, int, int]] = {}
    for m, at in sizes.items():
        m = min(m, len(grams))
        pos = np.array(sorted(at))
        lo, hi = np.maximum(pos - m + 1, 0), np.minimum(pos, len(grams) - m)
        cut = np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1] + 1) + 1
        for a, b in zip(np.append(0, cut), np.append(cut, len(pos)), strict=True):
            first, last = int(lo[a]), int(hi[a:b].max())
            for part in range(first, last + 1, WINDOWS):  # a long run of windows in parts
                end = min(last, part + WINDOWS - 1)
                g = grams[part : end + m]
                sums = np.zeros((len(g) + 1, BITS), np.int32 if len(g) < 1 << 20 else np.int64)
                np.cumsum(signs(g) * index.weights(g)[:, None].astype(sums.dtype), axis=0, out=sums[1:])
                for k, cand in index.near(pack(sums[m:] - sums[:-m])).items():
                    for item, d in cand:
                        if min(int(index.sizes[item]), len(grams)) != m:
                            continue  # met by windows of its own size
                        sim = index.similarity(g[k : k + m], item)
                        if sim >= least and (item not in best or (-sim, part + k) < (-best[item][0], best[item][1])):
                            best[item] = (sim, part + k, m, d)
    return [(index.items[i], start, m, d, sim) for i, (sim, start, m, d) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, n: int, radius: int) -> Iterator:
    """Broadcast indexes of the benchmark: one block, unless it is larger than what is broadcast."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    last, full, every = None, True, None
    while full:
        after = items if last is None else items.where((F.col("i") > F.lit(last[0])) | (F.col("i") == F.lit(last[0])) & (F.col("t") > F.lit(last[1])))
        part = [(r.i, r.t) for r in after.orderBy("i", "t").limit(BLOCK_ITEMS).collect()]
        full = len(part) == BLOCK_ITEMS
        if full and every is None:  # weights are of the whole benchmark in every block
            every = frequencies(items, n)
        if part:
            yield spark.sparkContext.broadcast(build(part, n, radius, every))
            last = part[-1]


def _found(own: list[Index], texts: pa.Array, least: float) -> list[tuple]:
    """(row, item, first word, words, distance, similarity) of each text's best window for each item it holds."""
    words, wo = word_hashes(texts, NOT_ALNUM)
    found = []
    for x in own:
        grams = windows_hash(words, x.n)
        hit = x.hits(grams)
        if not len(hit):
            continue
        row = np.searchsorted(wo, hit, "right") - 1
        ok = hit + x.n <= wo[row + 1]
        hit, row = hit[ok], row[ok]
        edge = np.flatnonzero(np.diff(row, prepend=-1))
        for a, z in zip(edge, np.append(edge[1:], len(row)), strict=True):
            k = int(row[a])
            for item, start, m, d, sim in matches(x, grams[wo[k] : wo[k + 1] - x.n + 1], hit[a:z] - wo[k], least):
                found.append((k, item, start, m + x.n - 1, d, sim))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", n: int = 5, least: float = 0.75, radius: int = RADIUS) -> DataFrame:
    """(id, item, start_word, n_words, distance, similarity): the best window of each document for each item it holds.

    Words are runs of letters and digits, A-Z lower-cased. Null and empty texts and items match nothing, items without id
    are left out, and an item id on several texts is an item each; a document shorter than an item is one window. Documents
    may have no id. Repeated documents give repeated rows; repeated items count once. Extra
    columns are ignored; without documents or items there are no rows. All windows of whole texts are covered.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_id]
    schema = f"id {kind}, item {item_kind}, start_word long, n_words long, distance int, similarity double"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = spark.createDataFrame([], schema)

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, "text"):
                    found = _found(index.value, b.column(1), least)
                    if found:
                        k, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), *(pa.array(v, t) for v, t in zip(rest, (kinds, pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True))], ["id", "item", "start_word", "n_words", "distance", "similarity"])

        return run

    kinds = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    for index in _blocks(benchmark, item_id, item_text, n, radius):
        out = out.unionByName(rows.mapInArrow(scan(index), schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 5, least: float = 0.75, radius: int = RADIUS) -> DataFrame:
    """The rows, with all their columns, that hold no item, each decided by itself: ids do not matter, and nothing is shuffled."""
    small_batches(docs.sparkSession)

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, text):
                    texts = pa.array([t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()], pa.string())
                    keep = np.ones(b.num_rows, bool)
                    keep[[x[0] for x in _found(index.value, texts, least)]] = False
                    yield b.filter(pa.array(keep))

        return run

    for index in _blocks(benchmark, item_id, item_text, n, radius):
        docs = docs.mapInArrow(scan(index), docs.schema)
    return docs
