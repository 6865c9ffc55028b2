"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

The forward Viterbi pass gives every lattice node the best score of reaching it; these scores are exact heuristics for a
backward A* search, which so yields complete paths best first. No piece has a white-space mark after another character,
so a text's lattice has cut nodes before each mark that follows other text: the pass runs over the distinct chunks of a
batch at once, and the search over a text goes through its chunks with their alternatives as arcs.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import count, islice
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import mix, segments, slices, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks, and characters of chunks, whose best paths are remembered from batch to batch; beyond, all are forgotten.
MOST_CHUNKS, MOST_CHARS = 200_000, 1 << 22
#: Longer chunks go through the lattice one by one.
LONGEST = 48
#: Scores are whole multiples of this, so that sums are exact and equal paths have equal scores.
GRAIN = 1 / 65536
_B = np.uint64(0x9E3779B97F4A7C15)
_NO = np.float64(-1e18)
_LOW = (1 << 20) - 1


def k_best(n: int, arcs_into: dict[int, list[tuple[int, float, tuple]]], forward: list[float], k: int) -> list[tuple[float, list]]:
    """The k best paths 0..n, best first, as (score, arc labels), by backward A*.

    arcs_into[node]: (from node, score, label). forward[node] is the exact best score of 0..node, so the first k times
    that node 0 is taken from the agenda are the k best paths. Among equal scores what is nearest to node 0 goes first,
    so that many equal paths are not all begun before one is complete; scores are to be exact sums (see GRAIN).
    """
    agenda: list[tuple[float, int, int, float, tuple | None]] = [(-forward[n], n, 0, 0.0, None)]
    out, made = [], 0
    while agenda and len(out) < k:
        _, node, _, g, path = heapq.heappop(agenda)
        if node == 0:
            labels = []
            while path:
                labels.append(path[0])
                path = path[1]
            out.append((g, labels))
            continue
        for frm, score, label in arcs_into.get(node, ()):
            if forward[frm] > -inf:
                made += 1
                heapq.heappush(agenda, (-(g + score + forward[frm]), frm, made, g + score, (label, path)))
    return out


@dataclass
class Lattice:
    """A vocabulary for lattices: scores of pieces (their white-space mark a space), byte pieces for what has none."""

    score: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    byte_score: float

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.score), default=1)
        names = sorted(self.score)
        keys = np.array([self._key(p) for p in names], np.uint64)
        low = self._low(keys)
        order = np.argsort(low, kind="stable")
        self.keys = keys[order]
        self.key_id = np.array([self.ids[names[i]] for i in order], np.int64)
        self.key_score = np.array([self.score[names[i]] for i in order])
        # keys with the same low bits stand together, from first[low bits] on; no row of them is longer than `most`
        many = np.bincount(low, minlength=_LOW + 1)
        self.maybe = many > 0
        self.first = (np.cumsum(many) - many).astype(np.int32)
        self.most = int(many.max())
        self.text = {i: p.encode() for p, i in self.ids.items()} | {b: bytes([k]) for k, b in enumerate(self.byte_ids)}
        self.tag = {i: b"%d," % i for i in self.text}
        joined = {c for p in names if len(p) > 1 for c in p}
        if any(" " in p.lstrip(" ") for p in names):
            raise ValueError("a piece has a white-space mark after another character")
        solo = [c for c in map(chr, range(1, 128)) if c not in joined and c != " "]  # in no longer piece: a chunk of its own
        inner = "".join(map(re.escape, solo))
        self.chunk = re.compile(f"[{inner}]| *[^ {inner}]+| +" if inner else " *[^ ]+| +", re.S)
        self.long: list[tuple[str, int]] = []  # remembered for one batch only
        self.forget(0)
        self.memo: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}

    def forget(self, k: int) -> None:
        """Remembers no chunk; from now on the k best paths are asked for."""
        self.code: defaultdict[str, int] = defaultdict(count().__next__)  # chunks in the order of their numbers
        self.chunks: list[str] = []
        self.shown: list[bytes] = []  # a chunk's ids, each with a comma after it
        self.k, self.chars = k, 0
        self.best, self.gap, self.flat, self.offs = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.width = np.zeros(0, np.int64)

    def learn(self, chunks: list[str], k: int) -> None:
        """Best paths of new chunks, which follow those known."""
        best, gap, flat, offs = self.best_two(chunks, k)
        tags, ends = list(map(self.tag.__getitem__, flat.tolist())), offs.tolist()
        shown = [b"".join(tags[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.best, self.gap, self.flat = np.concatenate([self.best, best]), np.concatenate([self.gap, gap]), np.concatenate([self.flat, flat])
        self.offs = np.concatenate([self.offs, offs[1:] + self.offs[-1]])
        self.width = np.concatenate([self.width, np.array(list(map(len, shown)), np.int64)])
        self.chunks += chunks
        self.shown += shown
        self.chars += sum(map(len, chunks))

    @staticmethod
    def _low(keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(_LOW)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are pieces' (their places in `keys`, ascending), and which pieces."""
        low = self._low(keys)
        left = np.flatnonzero(self.maybe[low])
        pos, own = self.first[low[left]], keys[left]
        hit = np.full(len(left), -1, np.int64)
        for r in range(self.most):
            at = np.minimum(pos + r, len(self.keys) - 1)
            same = self.keys[at] == own
            hit[same] = at[same]
        found = hit >= 0
        return left[found], hit[found]

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_B) + (ord(c) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) & (1 << 64) - 1
        return int(mix(np.array([h], np.uint64))[0])

    def unknown(self, c: str) -> tuple[float, tuple[int, ...]]:
        raw = c.encode("utf-8", "surrogatepass")
        return self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)

    def arcs(self, chunk: str) -> tuple[dict[int, list], list[float]]:
        """The lattice of a chunk and its forward Viterbi scores. A character without a piece is one arc of its bytes."""
        into: dict[int, list] = {}
        forward = [0.0] + [-inf] * len(chunk)
        for e in range(1, len(chunk) + 1):
            own = into[e] = []
            for s in range(max(0, e - self.longest), e):
                p = chunk[s:e]
                if p in self.score:
                    own.append((s, self.score[p], (self.ids[p],)))
            if chunk[e - 1] not in self.score:
                own.append((e - 1, *self.unknown(chunk[e - 1])))
            forward[e] = max((forward[s] + v for s, v, _ in own), default=-inf)
        return into, forward

    def alternatives(self, chunk: str, k: int) -> list[tuple[float, list[int]]]:
        """The k best segmentations of a chunk."""
        found = self.memo.get((chunk, k))
        if found is None:
            into, forward = self.arcs(chunk)
            found = [(v, [i for a in labels for i in a]) for v, labels in k_best(len(chunk), into, forward, k)]
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[chunk, k] = found
            if len(chunk) > LONGEST:
                self.long.append((chunk, k))
        return found

    def best_two(self, chunks: list[str], k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For many chunks at once: best score, gap to the second best (inf if there is none), ids, offsets of the ids."""
        n = len(chunks)
        best, gap = np.zeros(n), np.full(n, np.inf)
        pieces: list = [None] * n
        size = np.array([len(c) for c in chunks])
        for i in np.flatnonzero(size > LONGEST).tolist():
            two = self.alternatives(chunks[i], max(2, k))
            best[i], gap[i] = two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf
            pieces[i] = np.array(two[0][1], np.int32)
        flat_ids: list[np.ndarray] = []
        for length in np.unique(size[size <= LONGEST]).tolist():
            at = np.flatnonzero(size == length)
            for part in range(0, len(at), 8192):
                rows = at[part : part + 8192]
                self._dp([chunks[i] for i in rows.tolist()], length, rows, best, gap, pieces)
        count = np.array([len(p) for p in pieces], np.int64)
        flat_ids = np.concatenate(pieces) if n else np.zeros(0, np.int32)
        return best, gap, flat_ids, np.concatenate([[0], np.cumsum(count)])

    def _dp(self, chunks: list[str], length: int, rows: np.ndarray, best: np.ndarray, gap: np.ndarray, pieces: list) -> None:
        n = len(chunks)
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64)
        term = code * np.uint64(0xD6E8FEB86659FD93)
        f1, f2 = np.full((length + 1, n), _NO), np.full((length + 1, n), _NO)
        f1[0] = 0
        step = np.zeros((length + 1, n), np.int64)
        piece = np.full((length + 1, n), -1, np.int64)
        hashes = np.zeros((length, n), np.uint64)  # of the piece from each start to the present end
        n_bytes = 1 + (code >= 0x80).astype(int) + (code >= 0x800) + (code >= 0x10000)
        for e in range(1, length + 1):
            lo = max(0, e - self.longest)
            hashes[lo:e] = hashes[lo:e] * _B + term[:, e - 1]
            where, pos = self._find(mix(hashes[lo:e]).ravel())
            # only chunks with a piece from s to e are touched: from each start its own run of `where`
            ends = np.searchsorted(where, np.arange(1, e - lo + 1) * n).tolist()
            for s, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True), lo):
                if a < b:
                    self._reach(f1, f2, step, piece, s, e, where[a:b] - (s - lo) * n, self.key_score[pos[a:b]], self.key_id[pos[a:b]])
            lone = np.ones(n, bool)
            lone[where[ends[-2] if len(ends) > 1 else 0 :] - (e - 1 - lo) * n] = False
            lone = np.flatnonzero(lone)
            if len(lone):
                self._reach(f1, f2, step, piece, e - 1, e, lone, self.byte_score * n_bytes[lone, e - 1], np.int64(-1))
        best[rows] = f1[length]
        gap[rows] = np.where(f2[length] > _NO / 2, f1[length] - f2[length], np.inf)
        back = np.full((n, length), -2, np.int64)
        pos = np.full(n, length)
        each = np.arange(n)
        for t in range(length - 1, -1, -1):
            live = pos > 0
            if not live.any():
                break
            back[live, t] = piece[pos[live], each[live]]
            pos = pos - np.where(live, step[pos, each], 0)
        odd = (back == -1).any(1)
        kept = back != -2
        flat, offs = back[kept], np.concatenate([[0], np.cumsum(kept.sum(1))])
        for i, r in enumerate(rows.tolist()):
            if not odd[i]:
                pieces[r] = flat[offs[i] : offs[i + 1]]
            else:
                out, at = [], 0
                for p in flat[offs[i] : offs[i + 1]].tolist():
                    if p < 0:
                        out.extend(self.unknown(chunks[i][at])[1])
                        at += 1
                    else:
                        out.append(p)
                        at += len(self.text[p].decode())
                pieces[r] = np.array(out, np.int64)

    @staticmethod
    def _reach(f1: np.ndarray, f2: np.ndarray, step: np.ndarray, piece: np.ndarray, s: int, e: int, at: np.ndarray, v: np.ndarray, ids: np.ndarray) -> None:
        """Arcs s..e of score v of the chunks `at`: best and second best scores of node e, and the best one's last arc."""
        a, b = f1[s, at] + v, f2[s, at] + v
        one = f1[e, at]
        better = a > one
        f2[e, at] = np.maximum(np.maximum(np.minimum(a, one), b), f2[e, at])
        step[e, at] = np.where(better, e - s, step[e, at])
        piece[e, at] = np.where(better, ids, piece[e, at])
        f1[e, at] = np.where(better, a, one)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first space, which encoding puts before the text, goes."""
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def encode_batch(self, texts: list[str], k: int) -> list[tuple[np.ndarray, list[tuple[float, list[tuple[int, list[int]]]]], np.ndarray, list[str]]]:
        """Per text: ids of the best path; the k best as (score, changed chunks with their ids); offsets of the chunks' ids;
        SHA-256 of the comma-joined ids of each of the k best."""
        for key in self.long:
            self.memo.pop(key, None)
        self.long.clear()
        if k != self.k or len(self.chunks) > MOST_CHUNKS or self.chars > MOST_CHARS:
            self.forget(k)
        codes, owner = [], [0]
        for t in texts:
            if t:
                codes += map(self.code.__getitem__, self.chunk.findall(" " + t))
            owner.append(len(codes))
        if len(self.code) > len(self.chunks):
            self.learn(list(islice(self.code, len(self.chunks), None)), k)
        chunks, best, gap, flat, offs = self.chunks, self.best, self.gap, self.flat, self.offs
        codes, owner = np.array(codes, np.int64), np.array(owner)
        many = np.diff(offs)
        out = []
        for a, b in zip(owner[:-1].tolist(), owner[1:].tolist(), strict=True):
            own = codes[a:b]
            n = many[own]
            ids = flat[np.repeat(offs[own], n) + segments(n)] if b > a else np.zeros(0, np.int64)
            total = float(best[own].sum())
            g = gap[own]
            m = min(k - 1, len(g))
            # of k best paths none changes a chunk outside the k - 1 with the smallest gaps: those alone give better ones
            pick = np.sort(np.lexsort((np.arange(len(g)), g))[:m]) if len(g) <= 64 else np.sort(self._smallest(g, m))
            pick = pick[np.isfinite(g[pick])]
            arcs: dict[int, list] = {}
            for node, at in enumerate(pick.tolist(), 1):
                alt = self.alternatives(chunks[own[at]], max(2, k))
                arcs[node] = [(node - 1, v - alt[0][0], (at, i)) for i, (v, _) in enumerate(alt)]
            ways = k_best(len(pick), arcs, [0.0] * (len(pick) + 1), k)
            changed = [(total + d, [(at, self.alternatives(chunks[own[at]], max(2, k))[i][1]) for at, i in labels if i]) for d, labels in ways]
            joined = b"".join(map(self.shown.__getitem__, own.tolist()))
            out.append((ids, changed, np.concatenate([[0], np.cumsum(n)]), digests(joined, np.concatenate([[0], np.cumsum(self.width[own])]), changed)))
        return out

    @staticmethod
    def _smallest(g: np.ndarray, m: int) -> np.ndarray:
        if m < 1:
            return np.zeros(0, np.int64)
        limit = np.partition(g, m - 1)[m - 1]
        less = np.flatnonzero(g < limit)
        return np.concatenate([less, np.flatnonzero(g == limit)[: m - len(less)]])


_loaded: dict[str, Lattice] = {}


def load(path: str = MODEL) -> Lattice:
    """The lattice vocabulary of a public model file. Its scores are ranks: a piece of rank r gets the log-probability of
    a Zipf distribution over the pieces, rounded to GRAIN, and a byte piece ten less than the rarest."""
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        own = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = sorted(own, key=lambda i: (-sp.get_score(i), i))
        whole = log(sum(1 / (r + 1) for r in range(len(ranked))))
        pieces = {i: sp.id_to_piece(i).replace("▁", " ") for i in own}
        score = {pieces[i]: round((-log(r + 1) - whole) / GRAIN) * GRAIN for r, i in enumerate(ranked)}
        byte_ids = [0] * 256
        for i in range(size):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        _loaded[path] = Lattice(score, {p: i for i, p in pieces.items()}, byte_ids, min(score.values()) - 10)
    return _loaded[path]


def spelled(ids: np.ndarray, offs: np.ndarray, changes: list[tuple[int, list[int]]]) -> list[int]:
    """The ids of a path that differs from the best one in some chunks."""
    out, done = [], 0
    for at, alt in sorted(changes):
        out += [*ids[done : offs[at]].tolist(), *alt]
        done = int(offs[at + 1])
    return out + ids[done:].tolist()


def digests(best: bytes, at_byte: np.ndarray, ways: list[tuple[float, list]]) -> list[str]:
    """SHA-256 of the comma-joined ids of each path; what a path shares with the best one is copied as bytes.

    best: the ids of the best path, each with a comma after it. at_byte: where its chunks begin, and its end.
    """
    out, best = [], memoryview(best)
    for _, changes in ways:
        own, done = sha256(), 0
        for at, alt in sorted(changes):
            own.update(best[done : at_byte[at]])
            done = int(at_byte[at + 1])
            # the last id has no comma after it
            own.update(b"".join(b"%d," % v for v in alt)[: None if done < len(best) else -1])
        own.update(best[done : max(done, len(best) - 1)])
        out.append(own.hexdigest())
    return out


def encode(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", n_best: int = 4, model: str = MODEL, all_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids, round_trip, scores, n_tokens_best, ids_sha256, nbest_sha256, nbest_ids) per row.

    ids is the best segmentation; scores and n_tokens_best list the n_best ones, best first, fewer if there are no more;
    nbest_ids has their ids if all_ids, else is null. ids_sha256 digests the ids as comma-joined decimals,
    nbest_sha256 those of each of the n_best segmentations. round_trip: decoding ids gives the text. Null and empty texts have no ids, one empty segmentation of score 0, and come back as
    empty. Characters without a piece become bytes. Repeated rows give repeated results; extra columns are ignored; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = ["id", "n_tokens", "ids", "round_trip", "scores", "n_tokens_best", "ids_sha256", "nbest_sha256", "nbest_ids"]
    ints, more = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = load(model)
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                texts = b.column(1).to_pylist()
                n, flat, trip, scores, sizes, digest, paths, every = [], [], [], [], [], [], [], []
                for t, (ids, ways, offs, shas) in zip(texts, lattice.encode_batch(texts, n_best), strict=True):
                    own = ids.tolist()
                    n.append(len(own))
                    flat.append(ids.astype(np.int32))
                    trip.append(lattice.decode(own) == t)
                    scores.append([v for v, _ in ways])
                    sizes.append([len(own) + sum(len(alt) - int(offs[at + 1] - offs[at]) for at, alt in c) for _, c in ways])
                    paths.append(shas)
                    digest.append(shas[0])
                    every.append([spelled(ids, offs, c) for _, c in ways] if all_ids else None)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), ids, pa.array(trip), pa.array(scores, pa.list_(pa.float64())), pa.array(sizes, ints), pa.array(digest), pa.array(paths, pa.list_(pa.string())), pa.array(every, more)], names)

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = f"id {kind}, n_tokens long, ids array<int>, round_trip boolean, scores array<double>, n_tokens_best array<int>, ids_sha256 string, nbest_sha256 array<string>, nbest_ids array<array<int>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, ids: str = "ids", id_col: str = "doc_id", model: str = MODEL) -> DataFrame:
    """(id, text) per row of ids; null ids give a null text, unknown ids are an error."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = load(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if v is None else lattice.decode(v) for v in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col).alias("id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
