"""Removal of repeated byte strings by column-wise construction of suffix orders over many documents.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the collection. Equal strings are
found in two steps, both exact:

* Anchors. In every string of that length the k-grams with the smallest hash are chosen by its content alone, so equal
  strings have an equal anchor at the same distance from their start. Only texts around anchors that occur twice or more
  are looked at further: their contexts, which hold every string of that length around the anchor.
* Columns. Contexts stand aligned at their anchors, so equal strings stand in the same columns. From the last column to
  the first each round inserts one symbol per context: the order of the suffixes is the stable partition of the last
  round's order by the new symbols (the round's column of the collection's Burrows-Wheeler transform), and the common
  prefixes follow from range minima of the last round's. A round reads and writes its columns once, front to back; only
  the last round's are kept, so they need no files: a part of more contexts than PART is first split.

Contexts that are equal throughout are counted, not compared. A group of more than PART contexts is split by comparing
all with a leader: what goes beyond a common part with the leader can only be equal among contexts that leave the leader
at the same place with the same symbol, and these form the next groups.

The same search over words, each a 64-bit symbol, finds passages: runs of many words that also stand elsewhere, however few
bytes they have.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Shelf, needed, parted
from .textops import SPACE, column_bytes, mix, prefix_hash, slices, small_batches, span_hash, tokens

LENGTH, GRAM = 400, 100
#: Words of a passage, and of its grams.
PASSAGE, PASSAGE_GRAM = 51, 13
#: The most contexts of one anchor that a task compares; larger groups are split first.
PART = 2000
#: Contexts whose columns are built together.
TOGETHER = 2000
#: Bytes of text whose hashes are made at a time: some fifteen numbers of eight bytes for each.
SLICE = 1 << 19
END = 256


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every run of w values, by doubling."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = f(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """Indices of k-grams that are a smallest one of some run of w k-grams."""
    if len(grams) < w:
        return np.zeros(0, np.int64)
    low = _slide(grams, w, np.minimum)
    edge = np.zeros(w - 1, grams.dtype)
    return np.flatnonzero(_slide(np.concatenate([edge, low, edge]), w, np.maximum)[: len(grams)] == grams)


def suffix_columns(x: np.ndarray, length: int, starts: int) -> np.ndarray:
    """For aligned rows of symbols: whether each of the first `starts` columns starts `length` symbols that another row
    has in the same columns. END is no symbol: it equals nothing."""
    m, width = x.shape
    found = np.zeros((m, starts), bool)
    if m < 2:
        return found
    order = np.arange(m)
    lcp = np.zeros(m + 1, np.int64)  # of row k - 1 and k in the order; 0 at both ends
    columns = np.ascontiguousarray(x.T)
    for j in range(width - 1, -1, -1):
        s = columns[j][order]
        p = np.argsort(s, kind="stable")
        t = s[p]
        order = order[p]
        same = np.flatnonzero((t[1:] == t[:-1]) & (t[1:] != END)) + 1
        new = np.zeros(m + 1, np.int64)
        if len(same):
            a, b = p[same - 1] + 1, p[same] + 1  # the minimum over old places a..b-1
            cut = np.column_stack([a, b]).ravel()
            new[same] = np.minimum.reduceat(lcp, cut)[::2] + 1
        lcp = new
        if j < starts:
            found[order, j] = np.maximum(lcp[:-1], lcp[1:]) >= length
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def _units(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a string column, bytes or hashes of words, and the offsets of its rows in them."""
    data, off = column_bytes(column)
    if not words:
        return data, off
    s, e, wo = tokens(data, off, SPACE)
    return span_hash(prefix_hash(data), s, e) | np.uint64(1 << 63), wo  # no word is END or a group's symbol


def _symbols(raw: bytes, lead: int, width: int, words: bool) -> np.ndarray:
    """A context's columns: `lead` times END, its symbols, and END up to the width."""
    own = np.frombuffer(raw, np.uint64 if words else np.uint8)
    out = np.full(width, END, np.uint64 if words else np.uint16)
    out[lead : lead + len(own)] = own
    return out


def _spans(pos: np.ndarray, n: np.ndarray, length: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """What goes where a whole context stands twice: all strings of the length around the anchor."""
    return np.maximum(0, pos - side), np.minimum(pos, n - length) + length


def _scan(docs: DataFrame, length: int, k: int, words: bool) -> DataFrame:
    """Anchors (gram, context, id, pos, n, c), and spans (id, pos to n) with a null gram.

    Equal texts met in one task are read once, and are a span as a whole. A context that some texts read together have twice
    is one row with its count c, and spans: that is a combine before the shuffle, which also takes what is periodic within a
    text.
    """
    side = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "context", "id", "pos", "n", "c"]
        seen: set[int] = set()
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                data, off = _units(b.column(1), words)
                h = prefix_hash(data)
                ids = b.column(0).to_pylist()
                got: list[tuple[np.ndarray, ...]] = []
                copies: dict[int, int] = {}
                for r, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    if e - s < length:
                        continue
                    if ids[r] in seen:
                        copies[ids[r]] = e - s
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(ids[r])
                    at = np.arange(s, e - k + 1)
                    grams = span_hash(h, at, at + k)
                    p = anchors(grams, side + 1)
                    a, z = np.maximum(p - side, 0), np.minimum(p + k + side, e - s)
                    ctx = span_hash(h, a + s, z + s) ^ mix(((p - a) * 1000 + (z - p)).astype(np.uint64))
                    got.append((np.full(len(p), ids[r]), p, np.full(len(p), e - s), grams[p].view(np.int64), ctx.view(np.int64)))
                if copies:
                    none = pa.nulls(len(copies), pa.int64())
                    zero = pa.array(np.zeros(len(copies), np.int64))
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(list(copies), pa.int64()), zero, pa.array(list(copies.values()), pa.int64()), none], names)
                if got:
                    i, p, size, g, c = (np.concatenate(v) for v in zip(*got, strict=True))
                    order = np.lexsort((c, g))
                    new = np.append(True, (g[order][1:] != g[order][:-1]) | (c[order][1:] != c[order][:-1]))
                    first = order[new]
                    count = np.diff(np.append(np.flatnonzero(new), len(order)))
                    twice = order[np.repeat(count > 1, count)]
                    x, y = _spans(p[twice], size[twice], length, side)
                    some = x < y
                    none = pa.nulls(int(some.sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(c[first]), pa.array(i[first]), pa.array(p[first]), pa.array(size[first]), pa.array(count)], names)
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(i[twice][some]), pa.array(x[some]), pa.array(y[some]), none], names)

    return docs.mapInArrow(run, "gram long, context long, id long, pos long, n long, c long")


def _contexts(found: DataFrame, length: int, k: int) -> DataFrame:
    """One row of each different context (gram, id, pos and its count c), and spans (id, a, b) of all places of those that
    stand twice. A context's places are read as a stream."""
    side = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "id", "pos", "c", "a", "b"]
        held: tuple | None = None  # the last context's gram, context, id, pos, n and count so far
        for batch in batches:
            if not batch.num_rows:
                continue
            g, x, i, p, n, c = (batch.column(q).to_numpy() for q in range(6))
            if held:  # the held place stands before the batch, with its count
                g, x, i, p, n, c = (np.append(v, w) for v, w in zip(held, (g, x, i, p, n, c), strict=True))
            new = np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]))
            start = np.flatnonzero(new)
            total = np.add.reduceat(c, start)
            at = np.repeat(total > 1, np.diff(np.append(start, len(g))))
            a, b = _spans(p[at], n[at], length, side)
            some = a < b
            done = start[:-1]  # the last context may go on
            none = pa.nulls(len(done), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(g[done]), pa.array(i[done]), pa.array(p[done]), pa.array(total[:-1]), none, none], names)
            none = pa.nulls(int(some.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(i[at][some]), none, none, pa.array(a[some]), pa.array(b[some])], names)
            last = start[-1]
            held = (g[last], x[last], i[last], p[last], n[last], total[-1])
        if held:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[2]]), pa.array([held[3]]), pa.array([held[5]]), none, none], names)

    dealt = found.repartition("gram", "context").sortWithinPartitions("gram", "context", "id", "pos")
    return dealt.mapInArrow(run, "gram long, id long, pos long, c long, a long, b long")


def _cut(docs: DataFrame, wanted: DataFrame, length: int, k: int, words: bool) -> DataFrame:
    """wanted (id, pos, gram, c) with the context: its symbols, `lead` columns from the left; rank grows with its count c,
    then with the text it has. A context may come several times where copies of its text are read in several tasks."""
    side = length - k
    by_doc = wanted.groupBy("id").agg(F.collect_list(F.struct("pos", "gram", "c")).alias("at"))
    names = ["gram", "id", "pos", "single", "rank", "lead", "raw"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out: list[tuple] = []
        for batch in batches:
            for b in slices(batch, "text", 1 << 18):
                symbols, off = _units(b.column(1), words)
                for r, (i, at) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    if i in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(i)
                    data = symbols[off[r] : off[r + 1]]
                    for w in at:
                        p = w["pos"]
                        lead, z = max(0, side - p), min(len(data), p + k + side)
                        rank = 2 * length * w["c"] + min(side, p) + min(side, len(data) - k - p)
                        out.append((w["gram"], i, p, w["c"] == 1, rank, lead, data[p - side + lead : z].tobytes()))
                        if len(out) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    joined = needed(docs.select("id", "text"), by_doc.select("id"), ["id"]).join(by_doc.hint("merge"), "id").select("id", "text", "at")  # copies of a text meet in one task
    return joined.mapInArrow(run, "gram long, id long, pos long, single boolean, rank long, lead int, raw binary")


def _solve(parts: DataFrame, length: int, k: int, words: bool) -> DataFrame:
    """Removed spans (id, a, b) of single contexts. parts: gram, id, pos, single, lead, raw, lo, hi (starts looked at)."""
    side = length - k
    width = 2 * side + k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def solve() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            gram, i, pos = (t.column(c).to_numpy() for c in ("gram", "id", "pos"))
            once = np.append(True, (gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (pos[1:] != pos[:-1]))
            if not once.all():  # copies of a text read in several tasks are one
                t = t.filter(pa.array(once))
            x = np.stack([_symbols(raw, lead, width, words) for raw, lead in zip(t.column("raw").to_pylist(), t.column("lead").to_pylist(), strict=True)])
            # one symbol of the anchor, which every string looked at covers, becomes the group's own: groups do not mix
            x[:, side] = END + 1 + np.unique(t.column("gram").to_numpy(), return_inverse=True)[1]
            found = suffix_columns(x, length, side + 1)
            out = []
            for r, (i, pos, single, lo, hi) in enumerate(zip(*(t.column(c).to_pylist() for c in ("id", "pos", "single", "lo", "hi")), strict=True)):
                if single:
                    flags = found[r].copy()
                    flags[:lo] = flags[hi + 1 :] = False
                    out += [(i, pos - side + a, pos - side + z + length) for a, z in _runs(flags)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], ["id", "a", "b"])

        now = None
        for batch in batches:
            grams = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(grams)) + 1).tolist(), len(grams)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z > a:
                    if grams[a] != now and n >= TOGETHER:  # groups stay whole
                        yield solve()
                        held, n = [], 0
                    now = grams[a]
                    held.append(batch.slice(a, z - a))
                    n += z - a
        if held:
            yield solve()

    cols = ["gram", "id", "pos", "single", "lead", "raw", "lo", "hi"]
    return parts.select(*cols).repartition("gram").sortWithinPartitions("gram", "id", "pos").mapInArrow(run, "id long, a long, b long")


def _split(big: DataFrame, length: int, k: int, words: bool, shelf: Shelf, turn: int) -> tuple[DataFrame, DataFrame]:
    """Compares the contexts of large groups with their leader: (spans found, the next groups).

    The leader is the most frequent context, as the others leave it where they are odd themselves, at many places; among
    equals it has the most text, as none can leave it where its own text ends. It gets the union of what the others share with it; each other context the part it shares, and a place in
    the groups of those that leave the leader on the left, or on the right only, at the same column by the same symbol.
    """
    side = length - k
    lead = big.groupBy("gram").agg(F.min(F.struct(-F.col("rank"), "id", "pos", "lead", "raw", "lo", "hi")).alias("lead"))
    lead = shelf.write(lead.select("gram", *(F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("id", "pos", "lead", "raw", "lo", "hi"))), f"leaders {turn}")
    both = big.join(lead, "gram").where("id <> lead_id or pos <> lead_pos")
    cols = ["gram", "id", "pos", "single", "rank", "lead", "raw", "lo", "hi", "lead_id", "lead_pos", "lead_lead", "lead_raw", "lead_lo", "lead_hi"]
    width = 2 * side + k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "id", "pos", "single", "rank", "lead", "raw", "lo", "hi", "a", "b", "lead_id", "lead_a", "lead_b"]
        for batch in batches:
            out: list[tuple] = []
            for gram, i, pos, single, rank, lead, raw, lo, hi, li, lp, llead, lraw, llo, lhi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = _symbols(raw, lead, width, words), _symbols(lraw, llead, width, words)
                differ = (x != y) | (x == END)
                if differ[side : side + k].any():
                    continue  # anchors of equal hash that are not equal
                left = np.flatnonzero(differ[:side])
                right = np.flatnonzero(differ[side + k :])
                first = int(left[-1]) + 1 if len(left) else 0  # the first common column
                after = side + k + int(right[0]) if len(right) else len(x)
                a, z = first, after - length  # starts shared with the leader
                shared = (max(a, lo), min(z, hi)) if single else None
                own = (pos - side + shared[0], pos - side + shared[1] + length) if shared and shared[0] <= shared[1] else (None, None)
                theirs = (lp - side + max(a, llo), lp - side + min(z, lhi) + length) if max(a, llo) <= min(z, lhi) else (None, None)
                if own[0] is not None or theirs[0] is not None:
                    out.append((None, i, *[None] * 7, *own, li, *theirs))
                key = lambda tag, at: int(mix(np.array([gram & (1 << 64) - 1], np.uint64) ^ mix(np.array([(tag << 40) + (at << 16) + int(x[at]) & (1 << 64) - 1], np.uint64)))[0])  # noqa: B023, E731
                signed = lambda v: v - (1 << 64) if v >> 63 else v
                if first > 0 and x[first - 1] != END and lo <= min(first - 1, hi):
                    out.append((signed(key(1, first - 1)), i, pos, single, rank, lead, raw, lo, min(first - 1, hi), None, None, None, None, None))
                if after < len(x) and x[after] != END and max(first, z + 1, lo) <= hi:
                    out.append((signed(key(2, after)), i, pos, single, rank, lead, raw, max(first, z + 1, lo), hi, None, None, None, None, None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 14, kinds, strict=True)], names)

    done = shelf.write(both.select(*cols).mapInArrow(run, "gram long, id long, pos long, single boolean, rank long, lead int, raw binary, lo int, hi int, a long, b long, lead_id long, lead_a long, lead_b long"), f"groups {turn + 1}")
    leaders = big.where("single").select("gram", F.col("id").alias("lead_id"), F.col("pos").alias("lead_pos")).join(lead.select("gram", "lead_id", "lead_pos"), ["gram", "lead_id", "lead_pos"]).select("lead_id").distinct()
    spans = done.where("a is not null").select("id", "a", "b").unionByName(done.where("lead_a is not null").join(leaders, "lead_id").select(F.col("lead_id").alias("id"), F.col("lead_a").alias("a"), F.col("lead_b").alias("b")).distinct())
    return spans, done.where("gram is not null").select("gram", "id", "pos", "single", "rank", "lead", "raw", "lo", "hi")


def repeated_spans(docs: DataFrame, shelf: Shelf, *, length: int = LENGTH, k: int = GRAM, words: bool = False) -> DataFrame:
    """Spans (id, a, b) of bytes, or of words, whose union is what is removed, or stands elsewhere. docs: id long, which names
    the text, and text without nulls. Copies read in one task are spans of the scan, others have equal contexts."""
    side = length - k
    scan = shelf.write(_scan(docs, length, k, words), "scan")
    spans = [shelf.write(scan.where("gram is null").select("id", F.col("pos").alias("a"), F.col("n").alias("b")), "spans")]
    found = shelf.write(_contexts(scan.where("gram is not null"), length, k), "contexts")
    shelf.drop("scan")
    spans.append(shelf.write(found.where("gram is null").select("id", "a", "b"), "spans"))
    found = found.where("gram is not null").select("gram", "id", "pos", "c")
    per = found.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("least")).where("m > 1 and least = 1").select("gram", "m")
    wanted = shelf.write(found.join(per, "gram"), "wanted")
    shelf.drop("contexts")
    ends = {"lo": F.lit(0), "hi": F.lit(side)}
    spans.append(shelf.write(_solve(_cut(docs, wanted.where(F.col("m") <= PART), length, k, words).withColumns(ends), length, k, words), "spans"))
    rows = shelf.write(_cut(docs, wanted.where(F.col("m") > PART), length, k, words).withColumns(ends), "groups 0")
    shelf.drop("wanted")
    turn = 0
    while not rows.isEmpty():
        large = shelf.write(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PART).select("gram"), "large")
        spans.append(shelf.write(_solve(rows.join(large, "gram", "left_anti"), length, k, words), "spans"))
        if large.isEmpty():
            break
        more, rows = _split(rows.join(large, "gram"), length, k, words, shelf, turn)
        spans.append(shelf.write(more, "spans"))
        shelf.drop(f"groups {turn}", f"leaders {turn}", "large")
        turn += 1
    shelf.drop(f"groups {turn}", "large")
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def _merged(spans: DataFrame) -> DataFrame:
    """(id, runs): each text's spans as maximal runs, start and end as 64-bit numbers, so that little travels with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ab = batch.column(1), batch.column(1).flatten()
            a, b = (ab.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            off = np.append(0, np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False)))
            out = []
            for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                order = np.argsort(a[s:e], kind="stable")
                low, high = a[s:e][order], np.maximum.accumulate(b[s:e][order])
                first = np.append(True, low[1:] > high[:-1])
                last = np.append(first[1:], True)
                out.append(np.column_stack([low[first], high[last]]).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "runs"])

    return spans.groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("at")).mapInArrow(run, "id long, runs binary")


def remove_repeats(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, k: int = GRAM, keep_bytes: bool = True, passage: int = 0, passage_k: int = PASSAGE_GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; kept is the remaining bytes, left out without keep_bytes.

    With passage, n_passage_words follows: the words that lie in runs of that many words which also start anywhere else, in
    the same text or another, of whatever bytes. Nothing is removed for them. Words are what ASCII white space parts.

    Texts count as UTF-8 and are known by a 64-bit hash of their bytes: ids play no part, may be of any type or missing, and
    may stand on several texts. Null, empty and shorter texts lose nothing. Repeated rows are occurrences of each other.
    Extra columns are ignored; an empty table gives no rows. A text's spans are as many as its anchors at most, so they fit
    where the text does.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shelf = Shelf(spark, "repeats")
    rows = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("id", F.xxhash64("text"))
    if passage:
        same = shelf.write(_merged(repeated_spans(rows.select("id", "text"), shelf, length=passage, k=passage_k, words=True)), "passages")
        shelf.drop("spans")
    runs = shelf.write(_merged(repeated_spans(rows.select("id", "text"), shelf, length=length, k=k)), "byte runs" if passage else "runs")
    shelf.drop("spans")
    if passage:
        runs = shelf.write(runs.hint("merge").join(same.withColumnRenamed("runs", "passages"), "id", "full"), "runs")
        shelf.drop("passages", "byte runs")
    more = [c for c in ("passages",) if passage]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else []), *(["n_passage_words"] if passage else [])]
    packed = lambda found: np.frombuffer(found.as_buffer(), np.int64).reshape(-1, 2) if found.is_valid else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                data, off = column_bytes(b.column(1))
                out = []
                for r, found in enumerate(b.column(2)):
                    raw = data[off[r] : off[r + 1]]
                    gone = packed(found)
                    edge = np.concatenate([[0], gone.ravel(), [len(raw)]]).tolist()
                    whole = b"".join(raw[p:q].tobytes() for p, q in zip(edge[::2], edge[1::2], strict=True))
                    out.append((len(raw), len(raw) - len(whole), len(gone), sha256(whole).hexdigest(), *([whole] if keep_bytes else []), *([int(np.diff(packed(b.column(3)[r])).sum())] if passage else [])))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if keep_bytes else []), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds))], names)  # noqa: B905

    kind = dict(rows.dtypes)["row_id"]
    apart, maybe = parted(rows.select("id", "row_id", "text"), runs, "id")  # texts without runs stay where they are
    joined = maybe.join(runs.hint("merge"), "id", "left").select("row_id", "text", "runs", *more)
    joined = joined.unionByName(apart.select("row_id", "text", *(F.lit(None).cast("binary").alias(c) for c in ("runs", *more))))
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "") + (", n_passage_words long" if passage else "")
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
