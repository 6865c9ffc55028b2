"""Exact Jaccard self-join of documents over word n-grams, by signature trees.

Two documents link when |A & B| / |A | B| of their n-gram sets reaches a threshold. All links between different sets are
decided exactly; the result is one row per document with the smallest document reachable over links.

Nodes are different sets, known by a 64-bit hash of their n-grams: ids play no part before the result, so rows without id,
ids of any kind and one id on several texts are all in order. How the work is dealt out:

1. One pass gives every set's node, size and signature, and counts n-grams in a sketch of fixed size, from which only an
   order is read: n-grams that look frequent come last. Any order gives the same result; this one keeps passages shared by
   very many documents out of the prefixes.
2. Prefix routing: sets of similarity t share one of their first |x| - ceil(t |x|) + 1 n-grams of that order. Rows
   (n-gram, node, size) meet by n-gram and are read as a sorted stream, never held as a group. Small groups of the same
   nodes are one group.
3. Each group's members are compared with its smallest by signature. What a signature allows ties nodes together, so a
   group of thousands of near copies becomes one piece by a linear number of comparisons.
4. Groups of several pieces go through signature trees: leaves are nodes' bitmaps, inner nodes OR-combined bitmaps with size
   ranges; the dual traversal drops node pairs whose largest possible overlap is too small or which lie in one piece. Large
   groups are cut into blocks by piece and size, and only blocks that can hold a link meet.
5. No link leaves a piece of what the trees allow, so texts are only shipped for pieces of two nodes and more. With counts,
   all pairs of a piece are decided on the sets themselves, in blocks that sizes allow. Without counts, the pairs that tie
   the piece together are verified, and only what they leave apart is compared in blocks.

A signature has 1.5 to 3 bits for each n-gram, and 256 at least, so that long documents prune as well as short ones; for a
pair of different widths the wider one is folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Shelf, needed, parted
from .textops import mix, slices, small_batches, windows_hash, word_hashes

#: Cells of the order sketch: the most that is sent to the driver and broadcast is twice as many bytes.
CELLS = 1 << 22
#: The fewest bits of a signature; sets of more than two thirds as many n-grams have the next power of two.
BITS = 256
#: Fan-out of the trees, and the most members of a block.
FANOUT, BLOCK = 16, 2048
#: Members that are verified beside one copy of their leader.
MEMBERS = 64
#: The most members and n-grams of a block whose pairs are decided, and n-grams whose places are held as a dense table at a time.
LINK_BLOCK, LINK_GRAMS, DENSE = 1024, 1 << 20, 4096
#: Members of one component in a group that are taken out of it.
PIECE = 8
#: Rows of small groups that are compared at a time.
POOL = 1 << 14


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Each row's sorted distinct n-gram hashes; fewer than n words make one n-gram, none an empty set."""
    words, wo = word_hashes(column)
    grams = windows_hash(words, n)
    out = []
    for a, b in zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else windows_hash(words[a:b], b - a) if b > a else grams[:0])
    return out


def node_of(s: np.ndarray) -> int:
    """A set's node: 64 bits of its n-grams and their number."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix_size(n: np.ndarray | int, percent: int):
    """|x| - ceil(t |x|) + 1."""
    return n - (n * percent + 99) // 100 + 1


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def _signature(s: np.ndarray) -> np.ndarray:
    """A bitmap of BITS times the power of two that the size needs; a set's n-gram has the bit of its low bits."""
    width = BITS
    while 2 * width < 3 * len(s):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def _digests(rows: DataFrame, n: int) -> DataFrame:
    """Rows of documents (id, t1, t2, node, size, bits; bits once a task and node) and rows of sketch blocks (block, bits)."""
    span = 1 << 14
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        names = ["id", "t1", "t2", "node", "size", "bits", "block"]
        held: list[np.ndarray] = []
        seen: set[int] = set()
        id_type = None

        def count() -> None:
            if held:
                cells, times = np.unique(_cells(np.concatenate(held)).astype(np.int32), return_counts=True)
                counts[cells] += times.astype(np.uint32)
                held.clear()

        for batch in batches:
            id_type = batch.column(0).type
            for b in slices(batch, "text"):
                sets = shingle_sets(b.column(3), n)
                held += sets
                if sum(map(len, held)) > 1 << 20:
                    count()
                nodes = [node_of(s) for s in sets]
                bits: list[bytes | None] = []
                for v, s in zip(nodes, sets, strict=True):
                    bits.append(None if v in seen else _signature(s).tobytes())
                    seen.add(v)
                if len(seen) > 200_000:
                    seen.clear()
                size = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(nodes, pa.int64()), size, pa.array(bits, pa.binary()), pa.nulls(b.num_rows, pa.int32())], names)
        count()
        for i in range(CELLS // span):
            part = counts[i * span : (i + 1) * span]
            if part.any():
                none = [pa.nulls(1, t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int32())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([np.minimum(part, 65535).astype(np.uint16).tobytes()], pa.binary()), pa.array([i], pa.int32())], names)

    return rows.select("id", "t1", "t2", "text").mapInArrow(run, f"id {kind}, t1 long, t2 long, node long, size int, bits binary, block int")


def _levels(digests: DataFrame) -> np.ndarray:
    """The sketch's sums on a scale of 1,500 steps for each doubling."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(raw.as_buffer(), np.uint16).astype(np.int64)
                sums[i] = sums[i] + part if i in sums else part
        if sums:
            level = [np.minimum(np.log2(np.maximum(sums[i], 1)) * 1500, 65535).astype(np.uint16).tobytes() for i in sums]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], ["block", "level"])

    out = np.zeros(CELLS, np.uint16)
    span = 1 << 14
    rows = digests.where("block is not null").select("block", "bits").repartition("block").mapInArrow(add, "block int, level binary").collect()
    for r in rows:  # 2 * CELLS bytes at most
        out[r.block * span : (r.block + 1) * span] = np.frombuffer(r.level, np.uint16)
    return out


def _prefixes(rows: DataFrame, n: int, percent: int, levels) -> DataFrame:
    """(gram, node, size) for each set's prefix. Equal sets met in one task are routed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = np.frombuffer(levels.value, np.uint16), set()
        for batch in batches:
            for b in slices(batch, "text"):
                grams, nodes, sizes = [], [], []
                for s in shingle_sets(b.column(0), n):
                    if not len(s):
                        continue
                    node = node_of(s)
                    if node in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(node)
                    p = prefix_size(len(s), percent)
                    order = (level[_cells(s)].astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16))
                    grams.append(s[np.argpartition(order, p - 1)[:p]] if p < len(s) else s)
                    nodes.append(node)
                    sizes.append(len(s))
                if nodes:
                    reps = [len(g) for g in grams]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), reps)), pa.array(np.repeat(np.array(sizes, np.int32), reps))], ["gram", "node", "size"])

    return rows.select("text").mapInArrow(run, "gram long, node long, size int")


class _Groups:
    """Reads rows sorted by (gram, size, node): star edges to a leader, and the members of groups of three or more.

    Of a group only its first FANOUT members and its leader are held: a group's size does not matter. A leader is replaced
    by the first member that is too large for it. Groups of up to FANOUT members are named after their members.
    """

    def __init__(self, percent: int):
        self.percent, self.key, self.n = percent, None, 0
        self.edges: list[tuple[int, int]] = []
        self.kept: list[tuple[int, int, int]] = []
        self.known: set[tuple[int, int]] = set()
        self.groups: set[int] = set()

    def edge(self, a: int, b: int) -> None:
        e = (a, b) if a < b else (b, a)
        if e not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known.add(e)
            self.edges.append(e)

    def close(self) -> None:
        """The end of a group."""
        if 2 < self.n <= FANOUT:
            name = hash(tuple(self.held))
            if name not in self.groups:
                if len(self.groups) > 500_000:
                    self.groups.clear()
                self.groups.add(name)
                self.kept += [(name, x, size) for size, x in self.held]
        self.n = 0

    def feed(self, key: int, size: int, node: int) -> None:
        if key != self.key or not self.n:
            self.close()
            self.key, self.n, self.held, self.lead, self.last = key, 1, [(size, node)], (size, node), node
            return
        if node == self.last:
            return
        self.last = node
        self.n += 1
        if self.lead[0] * 100 < self.percent * size:
            self.lead = (size, node)
        else:
            self.edge(self.lead[1], node)
        if self.n <= FANOUT:
            self.held.append((size, node))
        else:
            self.kept += [(key, x, s) for s, x in [*self.held, (size, node)]]
            self.held = []

    def batch(self, k: np.ndarray, n: np.ndarray, v: np.ndarray) -> None:
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(k)))
        last = len(start) - 1
        odd = count > 1  # single rows meet nobody
        odd[0] = odd[last] = True  # may go on from the batch before, or in the next
        for g in np.flatnonzero(odd).tolist():
            a = int(start[g])
            key = int(k[a])
            for size, node in zip(n[a : a + count[g]].tolist(), v[a : a + count[g]].tolist(), strict=True):
                self.feed(key, size, node)


def _route(prefixes: DataFrame, percent: int) -> DataFrame:
    """Star edges (a, b) and members (gram, a, size) of larger groups, whose b is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Groups(percent)

        def out() -> pa.RecordBatch:
            e, m = len(g.edges), len(g.kept)
            b = pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * e + [x[0] for x in g.kept], pa.int64()), pa.array([x[0] for x in g.edges] + [x[1] for x in g.kept], pa.int64()),
                    pa.array([x[1] for x in g.edges] + [None] * m, pa.int64()), pa.array([None] * e + [x[2] for x in g.kept], pa.int32()),
                ],
                ["gram", "a", "b", "size"],
            )
            g.edges, g.kept = [], []
            return b

        for b in batches:
            if b.num_rows:
                g.batch(*(b.column(i).to_numpy() for i in (0, 2, 1)))
                if len(g.edges) + len(g.kept) > 10_000:
                    yield out()
        g.close()
        yield out()

    return prefixes.repartition("gram").sortWithinPartitions("gram", "size", "node").mapInArrow(run, "gram long, a long, b long, size int")


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps, of fewer bytes: n-grams keep the bit of their lower bits."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class _Signatures:
    """Signatures of mixed widths, by row."""

    def __init__(self, column, size: np.ndarray):
        raw = [np.frombuffer(v.as_buffer(), np.uint8) for v in column]
        self.size, self.width = size.astype(np.int64), np.array([len(v) for v in raw], np.int64)
        self.place = np.zeros(len(raw), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.of[w] = np.stack([raw[q] for q in at])

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        """The signatures of rows of one width, folded to another."""
        return _folded(self.of[int(self.width[at[0]])][self.place[at]], width)

    def possible(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether the signatures allow the pairs of rows to reach the threshold: |x & y| * (100 + t) >= t * (|x| + |y|)."""
        n, m = self.size[i], self.size[j]
        keep = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n, m) > 0)
        at = np.flatnonzero(keep)
        wide = self.width[i[at]] << np.int64(32) | self.width[j[at]]
        for code in np.unique(wide).tolist():
            same = at[wide == code]
            w = min(code >> 32, code & 0xFFFFFFFF)
            for k in range(0, len(same), 1 << 14):
                p = same[k : k + (1 << 14)]
                x, y = self.rows(i[p], w), self.rows(j[p], w)
                slack = np.minimum(n[p] - np.bitwise_count(x).sum(1, dtype=np.int64), m[p] - np.bitwise_count(y).sum(1, dtype=np.int64))
                most = np.bitwise_count(x & y).sum(1, dtype=np.int64) + slack
                keep[p] = most * (100 + percent) >= percent * (n[p] + m[p])
        return keep


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and signatures allow."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("size").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where((100 * F.least("n_a", "n_b")) >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            m = t.num_rows
            if m:
                s = _Signatures([*t.column(4), *t.column(5)], np.concatenate([t.column(2).to_numpy(), t.column(3).to_numpy()]))
                yield t.select(["a", "b"]).filter(pa.array(s.possible(np.arange(m), np.arange(m, 2 * m), percent)))

    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int, shelf: Shelf) -> DataFrame:
    """Pairs (a, b) with the exact sizes of intersection and union, where the similarity is reached. texts: node, text.

    Members travel to their leader a in parts of about MEMBERS, and a leader's text once to each part; texts are shipped
    rather than sets, as they are smaller. A part is read as a stream.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    salted = shelf.write(pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt")), "pairs")
    members = salted.select(F.col("b").alias("node"), F.col("a").alias("lead"), "salt", F.lit(1).alias("member"))
    leads = salted.select("a", "salt").distinct().select(F.col("a").alias("node"), F.col("a").alias("lead"), "salt", F.lit(0).alias("member"))
    rows = members.unionByName(leads).join(texts, "node").select("lead", "salt", "member", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, None
        for batch in batches:
            for b in slices(batch, "text"):
                out: list[tuple[int, int, int, int]] = []
                cols = [b.column(i).to_pylist() for i in (0, 2, 3)]
                for key, member, node, s in zip(*cols, shingle_sets(b.column(4), n), strict=True):
                    if not member:
                        lead, own = key, s
                        continue
                    assert key == lead
                    small, big = (s, own) if len(s) <= len(own) else (own, s)
                    if not len(small):
                        continue
                    at = np.searchsorted(big, small)
                    both = int((big[np.minimum(at, len(big) - 1)] == small).sum())
                    union = len(s) + len(own) - both
                    if 100 * both >= percent * union:
                        out.append((lead, node, both, union))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "n_both", "n_union"])

    dealt = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "member", "node")
    return dealt.mapInArrow(run, "a long, b long, n_both long, n_union long")


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, component): for each node of the links the smallest node that it reaches.

    In each round a node goes to the smallest of itself and its neighbours, and on to where that goes; the links between
    the nodes gone to are the next round's, so that rounds shrink. Each round is a table in the shared folder.
    """
    edges = shelf.write(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges 0")
    labels = shelf.write(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("component")), "labels 0")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = shelf.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up")), "low")
        on = low.select(F.col("a").alias("up"), F.col("up").alias("top"))
        low = shelf.write(low.join(on, "up").select(F.col("a").alias("was"), "top"), "low")  # every up is a node of the round
        a, b = (low.select(F.col("was").alias(c), F.col("top").alias(f"top_{c}")) for c in ("a", "b"))
        near = edges.join(a, "a").join(b, "b").where("top_a <> top_b").select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct()
        edges = shelf.write(near, f"edges {turn}")
        labels = shelf.write(labels.join(low, F.col("component") == F.col("was"), "left").select("node", F.coalesce("top", "component").alias("component")), f"labels {turn}")
        shelf.drop("low", f"edges {turn - 1}", f"labels {turn - 1}")
    shelf.drop(f"edges {turn}")
    shelf.paths.setdefault("components", []).extend(shelf.paths.pop(f"labels {turn}"))
    return labels


def more_components(known: DataFrame, links: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, component) of the known links and more of them: only components that the new ones touch are gone through."""
    side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    new = components(ends, shelf).select(F.col("node").alias("old"), F.col("component").alias("now"))
    alone = new.join(known, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("old").alias("component"))
    out = known.unionByName(alone).join(new, F.col("component") == F.col("old"), "left").select("node", F.coalesce("now", "component").alias("component"))
    out = shelf.write(out, "all components")
    shelf.drop("components")
    shelf.paths.setdefault("components", []).extend(shelf.paths.pop("all components"))
    return out


class _Union:
    """Pieces that are being joined, by index."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins the pairs in turn; true for those that joined two pieces."""
        up, used = self.up, np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                used[k] = True
        return used


def tree_pairs(bits: np.ndarray, size: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, pieces: _Union | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left member, right member) of different components whose similarity the signatures allow.

    bits: a row of packed signature per member. Two trees are built over the left and the right members, sorted by
    component, size and signature; nodes hold the OR of their bitmaps, the range of sizes, the most n-grams that share bits
    in one member, and their component if there is only one. For x under A and y under B at most slack(A) + |bits A & bits
    B| n-grams are common; a pair of nodes is dropped if that is less than what the smallest sizes would need. With pieces
    (indexed by component) only pairs that join two pieces are returned, and join them.
    """
    several = np.bincount(np.searchsorted(ranked := np.unique(comp), comp), minlength=len(ranked)) > 1
    apart = np.where(several[np.searchsorted(ranked, comp)], comp, ranked[0] if len(ranked) else 0)

    def tree(members: np.ndarray) -> list[dict]:
        order = members[np.lexsort((bits[members].view("S%d" % bits.shape[1]).ravel(), size[members], apart[members]))]
        b = bits[order]
        level = {"bits": b, "lo": size[order], "hi": size[order], "slack": size[order] - np.bitwise_count(b).sum(1, dtype=np.int64), "c0": comp[order], "c1": comp[order], "member": order}
        levels = [level]
        while len(level["lo"]) > FANOUT:
            cut = np.arange(0, len(level["lo"]), FANOUT)
            level = {
                "bits": np.bitwise_or.reduceat(level["bits"], cut), "lo": np.minimum.reduceat(level["lo"], cut), "hi": np.maximum.reduceat(level["hi"], cut),
                "slack": np.maximum.reduceat(level["slack"], cut), "c0": np.minimum.reduceat(level["c0"], cut), "c1": np.maximum.reduceat(level["c1"], cut),
            }
            levels.append(level)
        return levels

    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = tree(left), tree(right)
    depth = max(len(one), len(two))
    one, two = ([lv[min(i, len(lv) - 1)] for i in range(depth)] for lv in (one, two))

    def allowed(a: dict, b: dict, i: np.ndarray, j: np.ndarray, leaves: bool) -> np.ndarray:
        keep = (100 * a["hi"][i] >= percent * b["lo"][j]) & (100 * b["hi"][j] >= percent * a["lo"][i])
        keep &= ~((a["c0"][i] == a["c1"][i]) & (b["c0"][j] == b["c1"][j]) & (a["c0"][i] == b["c0"][j]))
        at = np.flatnonzero(keep)
        for k in range(0, len(at), 1 << 15):
            p = at[k : k + (1 << 15)]
            if leaves and pieces is not None:
                root = pieces.roots()
                apart = root[a["c0"][i[p]]] != root[b["c0"][j[p]]]
                keep[p[~apart]] = False
                p = p[apart]
            x, y = i[p], j[p]
            both = np.bitwise_count(a["bits"][x] & b["bits"][y]).sum(1, dtype=np.int64)
            most = np.minimum(np.minimum(a["slack"][x], b["slack"][y]) + both, np.minimum(a["hi"][x], b["hi"][y]))
            # |x & y| * (100 + t) >= t * (|x| + |y|) is the threshold
            keep[p] = ok = most * (100 + percent) >= percent * (a["lo"][x] + b["lo"][y])
            if leaves and pieces is not None:
                keep[p[ok]] = pieces.join(a["c0"][x[ok]], b["c0"][y[ok]])
        return keep

    top_a, top_b = one[-1], two[-1]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(top_a["lo"])), np.arange(len(top_b["lo"])), indexing="ij"))
    for d in range(depth - 1, -1, -1):
        a, b = one[d], two[d]
        if d < depth - 1:  # down to the children of the pairs kept so far
            for side, tier in ((0, one), (1, two)):
                if tier[d] is tier[d + 1]:
                    continue
                at = i if side == 0 else j
                n = np.minimum(FANOUT, len(tier[d]["lo"]) - at * FANOUT)
                child = np.repeat(at * FANOUT, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i, j = (child, np.repeat(j, n)) if side == 0 else (np.repeat(i, n), child)
        keep = allowed(a, b, i, j, d == 0)
        i, j = i[keep], j[keep]
    return one[0]["member"][i], two[0]["member"][j]


def _apart(members: DataFrame) -> DataFrame:
    """The groups in which trees have to look for links between components: members' columns (gram, node, size, comp).

    Members of one component that stand together in many groups would be read again in each. So a component with PIECE
    members in a group leaves it, and becomes one group with all that it stood together with anywhere.
    """
    per = members.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = per.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("gram")
    per = per.join(mixed, "gram").withColumn("large", F.col("m") >= PIECE)
    rows = members.join(per.select("gram", "comp", "large"), ["gram", "comp"])
    name = F.xxhash64(F.lit("component"), F.col("piece"))
    own = rows.where("large").select(F.xxhash64(F.lit("component"), F.col("comp")).alias("gram"), "node", "size", "comp").distinct()
    pieces = per.where("large").select("gram", F.col("comp").alias("piece"))
    met = rows.join(pieces, "gram").where("comp <> piece and (not large or piece < comp)").select(name.alias("gram"), "node", "size", "comp").distinct()
    return rows.where("not large").select("gram", "node", "size", "comp").unionByName(own).unionByName(met)


def _cut(rows: DataFrame, group: str, most: int, heavy: int | None = None) -> DataFrame:
    """rows (node, size, comp and a group) with a block: a stretch of one group in order of component and size.

    A block has about `most` rows and sizes of `heavy` together. Only groups of more than one block are gone through: the
    running sum goes over their numbers by component and size, and rows of one such number are dealt by hash, so that no
    task reads a group. Nodes that are their own component stand together, by size.
    """
    cap = heavy or most
    load = F.greatest(F.lit(-(-cap // most)), F.col("size")) if heavy else F.lit(1)
    rows = rows.withColumn("_load", load.cast("long")).withColumn("_key", F.when(F.col("comp") == F.col("node"), F.lit(0)).otherwise(F.col("comp")))
    large = rows.groupBy(group).agg(F.sum("_load").alias("whole")).where(F.col("whole") > cap).select(group)
    few = rows.join(large, group, "left_anti").withColumn("block", F.xxhash64(group, F.lit(0).cast("long")))
    many = rows.join(large, group)
    cells = many.groupBy(group, "_key", "size").agg(F.sum("_load").alias("all"), F.count(F.lit(1)).alias("m"))
    before = F.sum("all").over(Window.partitionBy(group).orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("before", F.coalesce(before, F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("node"), F.col("m")) * F.col("_load")
    many = many.join(cells, [group, "_key", "size"]).withColumn("block", F.xxhash64(group, F.floor(place / cap).cast("long")))
    cols = [c for c in rows.columns if c not in ("_load", "_key")] + ["block"]
    return few.select(*cols).unionByName(many.select(*cols))


def _block_pairs(cut: DataFrame, group: str, percent: int, within: bool) -> DataFrame:
    """(block, i, j): the pairs of blocks i <= j of a group that sizes allow, once for each of the two blocks.

    Without `within`, pairs of blocks of one and the same component are left out.
    """
    blocks = cut.groupBy(group, "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    one = blocks.select(F.col(group).alias("g"), *(F.col(c).alias(f"{c}_i") for c in ("block", "lo", "hi", "c0", "c1")))
    two = blocks.select(F.col(group).alias("g"), *(F.col(c).alias(f"{c}_j") for c in ("block", "lo", "hi", "c0", "c1")))
    pairs = one.join(two, "g").where("block_i <= block_j").where((100 * F.col("hi_i") >= percent * F.col("lo_j")) & (100 * F.col("hi_j") >= percent * F.col("lo_i")))
    if not within:
        pairs = pairs.where("not (c0_i = c1_i and c0_j = c1_j and c0_i = c0_j)")
    sides = F.when(F.col("block_i") == F.col("block_j"), F.array("block_i")).otherwise(F.array("block_i", "block_j"))
    return pairs.select(F.explode(sides).alias("block"), F.col("block_i").alias("i"), F.col("block_j").alias("j"))


def _tree_candidates(cut: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) from the signature trees of groups, as many as it takes to join what signatures allow.

    cut: gram, node, size, comp, block. A task holds two blocks at a time, or some thousand rows of small groups.
    """
    rows = cut.join(_block_pairs(cut, "gram", percent, False), "block").select("i", "j", "block", "node", "comp")
    rows = rows.join(classes.select("node", "size", "bits"), "node").select("i", "j", "block", "node", "size", "comp", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[pa.RecordBatch] = []

        def small() -> pa.RecordBatch:
            """All pairs of the members of each group in the pool: a group of FANOUT members is one leaf."""
            t = pa.Table.from_batches(pool)
            count = np.array([p.num_rows for p in pool])
            begin = np.cumsum(count) - count
            node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
            sig = _Signatures(t.column("bits").combine_chunks(), t.column("size").to_numpy())
            i, j = [], []
            for m in np.unique(count[count > 1]).tolist():
                x, y = np.triu_indices(m, 1)
                at = begin[count == m][:, None]
                i.append((at + x).ravel())
                j.append((at + y).ravel())
            i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (i, j))
            keep = comp[i] != comp[j]
            i, j = i[keep], j[keep]
            keep = sig.possible(i, j, percent)
            i, j = i[keep], j[keep]
            names, of = np.unique(comp, return_inverse=True)
            used = _Union(len(names)).join(of[i], of[j])
            return pa.RecordBatch.from_arrays([pa.array(node[i[used]]), pa.array(node[j[used]])], ["a", "b"])

        def large(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            node, size, block = (t.column(c).to_numpy() for c in ("node", "size", "block"))
            left, right = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            names, comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)
            sig, pieces = _Signatures(t.column("bits").combine_chunks(), size), _Union(len(names))
            ab: list[tuple[np.ndarray, np.ndarray]] = []
            for w in np.unique(sig.width).tolist():  # sizes within the threshold have equal or neighbouring widths
                every = np.flatnonzero((sig.width == w) | (sig.width == 2 * w))
                low = sig.width[every] == w
                bits = np.empty((len(every), w), np.uint8)
                bits[low] = sig.rows(every[low], w)
                if not low.all():
                    bits[~low] = sig.rows(every[~low], w)
                on, off = block[every] == left, block[every] == right
                sides = ((on & low, off & low), (on & low, off & ~low)) + (((on & ~low, off & low),) if left != right else ())
                for x, y in sides:
                    if x.any() and y.any():
                        p, q = tree_pairs(bits, size[every].astype(np.int64), comp[every], np.flatnonzero(x), np.flatnonzero(y), percent, pieces)
                        ab.append((every[p], every[q]))
            a, b = (np.concatenate(v) for v in zip(*ab, strict=True)) if ab else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        def close(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sum(p.num_rows for p in parts)
            if m > FANOUT or parts[0].column(0)[0] != parts[0].column(1)[0]:
                yield large(parts)
            else:
                pool.append(parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
                if len(pool) * FANOUT > POOL:
                    yield small()
                    pool.clear()

        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            for p, q in zip(edge.tolist(), [*edge[1:].tolist(), batch.num_rows], strict=True):
                if (i[p], j[p]) != now and held:
                    yield from close(held)
                    held = []
                now = (i[p], j[p])
                held.append(batch.slice(p, q - p))
        if held:
            yield from close(held)
        if pool:
            yield small()

    return rows.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "a long, b long")


def link_table(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Whether the sets of one side link with those of the other; without right, with each other.

    Sizes of intersections are products of 0/1 tables of the n-grams that can be common, DENSE n-grams at a time.
    """
    both = left if right is None else left + right
    size = np.array([len(s) for s in both], np.int64)
    grams, row = np.concatenate(both), np.repeat(np.arange(len(both)), size)
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    place = np.cumsum(np.append(0, (grams[1:] != grams[:-1]).astype(np.int64))) if len(grams) else grams.astype(np.int64)
    times = np.bincount(place)
    if right is None:
        shared = times > 1
    else:
        first = np.bincount(place, row < len(left))
        shared = (first > 0) & (first < times)
    keep = shared[place]
    place, row = (np.cumsum(shared) - 1)[place[keep]], row[keep]
    n, width = len(left), int(shared.sum())
    common = np.zeros((n, n if right is None else len(right)), np.float32)  # whole numbers below 2^24 are exact
    edge = np.searchsorted(place, np.arange(0, width + DENSE, DENSE))
    for k, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        table = np.zeros((len(both), min(DENSE, width - k * DENSE)), np.float32)
        table[row[a:z], place[a:z] - k * DENSE] = 1
        common += table[:n] @ (table if right is None else table[n:]).T
    link = common * np.float64(100 + percent) >= percent * (size[:n, None] + (size if right is None else size[n:])[None]).astype(np.float64)
    link &= common > 0
    if right is None:
        np.fill_diagonal(link, False)
    return link


def spanning(link: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Row and column pairs that connect all that the table of links connects. same: rows and columns are the same sets."""
    n, m = link.shape
    out: list[tuple[int, int]] = []
    seen_row, seen_col = np.zeros(n, bool), np.zeros(m, bool)
    for seed in np.flatnonzero(link.any(1)).tolist():
        if seen_row[seed]:
            continue
        seen_row[seed] = True
        todo = [(seed, True)]
        while todo:
            at, is_row = todo.pop()
            if is_row or same:
                new = np.flatnonzero(link[at] & ~(seen_row if same else seen_col))
                out += [(at, x) for x in new.tolist()]
            else:
                new = np.flatnonzero(link[:, at] & ~seen_row)
                out += [(x, at) for x in new.tolist()]
            (seen_row if same or not is_row else seen_col)[new] = True
            todo += [(x, same or not is_row) for x in new.tolist()]
    return out


def _decided(members: DataFrame, texts: DataFrame, n: int, percent: int, count: bool, shelf: Shelf) -> DataFrame:
    """Exact links of pieces: rows (node, k) of numbers of links to be summed, and rows (a, b) that connect what links connect.

    members: node, size, piece, comp. All pairs of a piece that sizes allow are decided on the sets themselves, by pairs of
    blocks, to which texts are shipped; without count, pairs within a component (comp) may be left out. The work grows with
    the square of a piece where counts are wanted, as every pair of near copies is a link of its own.
    """
    cut = shelf.write(_cut(shelf.write(members, "link-members"), "piece", LINK_BLOCK, LINK_GRAMS), "link-blocks")
    rows = cut.join(_block_pairs(cut, "piece", percent, count), "block").join(texts, "node").select("i", "j", "block", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def solve() -> pa.RecordBatch:
            (x, left), (y, right) = (([v for v, _ in s], [g for _, g in s]) for s in sides)
            same = now[0] == now[1]
            k: list[tuple[int, int]] = []
            ab: list[tuple[int, int]] = []
            if left and (right or same):
                link = link_table(left, None if same else right, percent)
                if count:
                    k = list(zip(x, link.sum(1).tolist(), strict=True)) + ([] if same else list(zip(y, link.sum(0).tolist(), strict=True)))
                ab = [(x[p], (x if same else y)[q]) for p, q in spanning(link, same)]
            cols = [[v for v, _ in k] + [None] * len(ab), [c for _, c in k] + [None] * len(ab), [None] * len(k) + [a for a, _ in ab], [None] * len(k) + [b for _, b in ab]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "k", "a", "b"])

        for batch in batches:
            for b in slices(batch, "text"):
                cols = [b.column(i).to_pylist() for i in range(4)]
                for i, j, block, node, s in zip(*cols, shingle_sets(b.column(4), n), strict=True):
                    if (i, j) != now:
                        if now is not None:
                            yield solve()
                        now, sides = (i, j), ([], [])
                    sides[block != i].append((node, s))
        if now is not None:
            yield solve()

    dealt = rows.repartition("i", "j").sortWithinPartitions("i", "j", "block", "node")
    return dealt.mapInArrow(run, "node long, k long, a long, b long")


def _hashed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, t1, t2, text): t1 and t2 are 128 bits of the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")


def _joined(rows: DataFrame, n: int, percent: int, count: bool, shelf: Shelf) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(id, t1, t2, node, size) of every row, (node, component) of linked nodes, and (node, n_links) if counted."""
    spark = rows.sparkSession
    digests = shelf.write(_digests(rows, n), "digests")
    levels = spark.sparkContext.broadcast(_levels(digests).tobytes())
    sets = digests.where("block is null").select("id", "t1", "t2", "node", "size")
    classes = digests.where("block is null and size > 0").groupBy("node").agg(F.max("size").alias("size"), F.max("bits").alias("bits"), F.min(F.struct("t1", "t2")).alias("t"))
    classes = shelf.write(classes, "classes")
    routed = shelf.write(_route(_prefixes(rows, n, percent, levels), percent), "routed")
    near = shelf.write(_plausible(routed.where("gram is null").select("a", "b").distinct(), classes, percent), "near")
    pieces = components(near, shelf)
    members = routed.where("gram is not null").select("gram", F.col("a").alias("node"), "size").distinct()
    members = members.join(pieces, "node", "left").select("gram", "node", "size", F.coalesce("component", "node").alias("comp"))
    members = shelf.write(members, "members")
    shelf.drop("routed")
    cut = shelf.write(_cut(shelf.write(_apart(members), "apart"), "gram", BLOCK), "blocks")
    shelf.drop("members", "apart")
    more = shelf.write(_tree_candidates(cut, classes, percent).distinct(), "candidates")
    shelf.drop("blocks")
    near = near.unionByName(more)
    if not more.isEmpty():
        pieces = more_components(pieces, more, shelf)
    # no link leaves a piece; from here on only the texts of pieces matter
    wanted = pieces.join(classes.select("node", "size", "t.t1", "t.t2"), "node").select("node", F.col("component").alias("piece"), "size", "t1", "t2")
    wanted = shelf.write(wanted, "wanted")
    shelf.drop("components", "classes")
    texts = needed(rows.select("t1", "t2", "text"), wanted, ["t1", "t2"]).join(wanted.select("node", "t1", "t2"), ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = shelf.write(texts, "texts")
    members = wanted.select("node", "size", "piece", F.col("node").alias("comp"))
    if count:
        found = shelf.write(_decided(members, texts, n, percent, True, shelf), "found")
        comp = components(found.where("a is not null").select("a", "b"), shelf)
        linked = shelf.write(found.where("node is not null").groupBy("node").agg(F.sum("k").alias("n_links")), "counts")
    else:
        links, linked = shelf.write(verified(near, texts, n, percent, shelf).select("a", "b"), "verified"), None
        true = components(links, shelf)
        members = members.drop("comp").join(true, "node", "left").select("node", "size", "piece", F.coalesce("component", "node").alias("comp"))
        apart = members.groupBy("piece").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("piece")
        more = shelf.write(_decided(members.join(apart, "piece"), texts, n, percent, False, shelf).select("a", "b"), "found")
        comp = more_components(true, more, shelf)
    shelf.drop("near", "candidates", "wanted", "texts", "pairs", "link-members", "link-blocks", "found", "verified")
    return sets, comp, linked


def jaccard_components(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", n: int = 5, percent: int = 75, count_links: bool = True) -> DataFrame:
    """(id, n_shingles, component_id, n_links) per row.

    Words are what stands between ASCII white space, with A-Z lower-cased. component_id is the smallest id of the rows
    reachable by links, of any type that has an order; null only where no such row has an id. n_links counts all other sets
    that the row's set links with; equal sets are one. Without count_links the column is left out. Null and empty texts
    have no n-gram, link with nothing and are their own component. Rows count by their text: repeated rows, rows without id
    and rows of one id with different texts each give a row. An empty table gives no rows. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    shelf = Shelf(docs.sparkSession, "jaccard")
    sets, comp, linked = _joined(_hashed(docs, text, id_col), n, percent, count_links, shelf)
    names = sets.where("size > 0").groupBy("node").agg(F.min("id").alias("least")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = shelf.write(names, "names")
    least = names.groupBy("component").agg(F.min("least").alias("component_id"))
    names = names.select("node", "component").join(least, "component").select("node", "component_id")
    if count_links:
        names = names.join(linked, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    names = shelf.write(names, "result")
    shelf.drop("names", "components", "counts")
    some = F.when(F.col("size") > 0, F.col("node"))
    out = sets.select("id", "size", some.alias("node")).join(names, "node", "left")
    links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"), *links)


def _free(name: str, taken: set[str]) -> str:
    """The name, with underscores before it where a column has it already."""
    while name in taken:
        name = f"_{name}"
    return name


def one_of_each(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", n: int = 5, percent: int = 75) -> DataFrame:
    """The rows, with all their columns, without all but one of each component.

    The row with the smallest id stays, rows without id after all others, and of several rows with this id and text one,
    the smallest by all columns. Rows without words are linked with nothing and all stay. Ids may stand on several texts. Columns may have any names.
    """
    small_batches(docs.sparkSession)
    shelf = Shelf(docs.sparkSession, "one-of-each")
    sets, comp, _ = _joined(_hashed(docs, text, id_col), n, percent, False, shelf)
    rows = sets.where("size > 0").groupBy("id", "t1", "t2").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("m")).join(comp, "node", "left")
    rows = shelf.write(rows.select("id", "t1", "t2", "m", F.coalesce("component", "node").alias("component")), "rows")
    shelf.drop("components", "digests")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")).alias("first"), F.sum("m").alias("of")).where("of > 1").select("component", "first")
    here = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    taken = {c.lower() for c in docs.columns}
    i, a, b, stays, m, t = (_free(c, taken) for c in ("_id", "_1", "_2", "_stays", "_m", "_t"))
    touched = shelf.write(rows.join(first, "component").select(F.col("id").alias(i), F.col("t1").alias(a), F.col("t2").alias(b), (here == F.col("first")).alias(stays), F.col("m").alias(m)), "touched")
    gone, twice = touched.where(~F.col(stays) | (F.col(m) > 1)), touched.where(F.col(stays) & (F.col(m) > 1))
    shelf.drop("rows")
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text_of).alias(t), *docs.columns)
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(t) == F.col(a)) & (F.xxhash64(F.lit(7), text_of) == F.col(b))
    apart, maybe = parted(rows, gone.select(F.col(a).alias(t)), t)  # most rows are neither dropped nor repeated, and are not shuffled
    one = maybe.join(twice, same).groupBy(i, a, b).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    kept = maybe.join(gone, same, "left_anti").select(*docs.columns).unionByName(one)
    return apart.select(*docs.columns).unionByName(kept)
