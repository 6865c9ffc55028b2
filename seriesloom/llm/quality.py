"""Quality rules: counts over whole texts, and a linear-chain CRF over lines.

Each line is marked content or boilerplate by Viterbi decoding; the share of words in content lines decides whether a
document that passes the counts is kept. The CRF is trained here, on a bounded sample of labelled documents whose lines
all take their document's quality as target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import LEADS, SPACE, mix, prefix_hash, column_bytes, rows_of, slices, small_batches, span_hash, tokens, windows_hash

NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SHOUT = np.zeros(256, bool)
SHOUT[33] = True
END = np.zeros(256, bool)
END[[ord(c) for c in ".!?:;\"')"]] = True

FEATURES = ("bias", "words<=2", "words 3-5", "words 6-12", "words 13-30", "symbols>0.05/word", "symbols>0.5/word", "upper>0.5", "repeat of an earlier line", "repeated words>0.3", "repeated words>0.7", "no end mark", "digits>0.2", "short words", "long words", "shouts>0.3/word")
#: The sample the CRF is fitted on: at most this many labelled documents, and of each a run of at most so many lines.
MOST_DOCS, MOST_LINES = 3000, 200


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts per row, and features per line (binary, FEATURES) with the rows' offsets among the lines."""
    data, off = column_bytes(column)
    rows = len(off) - 1
    s, e, wo = tokens(data, off, SPACE)
    h = prefix_hash(data)
    words = span_hash(h, s, e)
    row = rows_of(wo)
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    per = lambda c: c[off[1:]] - c[off[:-1]]
    symbols, chars = sums(SYMBOL[data]), sums(LEADS[data] & ~SPACE[data])

    # words in 3-word windows that the row has twice or more
    again = np.zeros(len(words), bool)
    if len(words) >= 3:
        at = np.flatnonzero(row[:-2] == row[2:])
        _, inv, n = np.unique(windows_hash(words, 3)[at] ^ mix(row[at].astype(np.uint64) + np.uint64(7)), return_inverse=True, return_counts=True)
        at = at[n[inv] > 1]
        again[at] = again[at + 1] = again[at + 2] = True

    ls, le, lo = tokens(data, off, NEWLINE)
    before = np.searchsorted(s, ls)
    n_words = np.searchsorted(s, le) - before
    has = n_words > 0
    line_row = rows_of(lo)[has]
    ls, le, before, n_words = ls[has], le[has], before[has], n_words[has]
    lo = np.searchsorted(line_row, np.arange(rows + 1))
    key = span_hash(h, ls, le) ^ mix(line_row.astype(np.uint64) + np.uint64(7))
    copy = np.ones(len(key), bool)
    copy[np.unique(key, return_index=True)[1]] = False

    part = lambda c: (c[le] - c[ls]).astype(float)
    letters = np.maximum(part(sums(LETTER[data])), 1)
    n = np.maximum(n_words, 1).astype(float)
    repeated = np.concatenate([[0], np.cumsum(again)])
    repeated = (repeated[before + n_words] - repeated[before]) / n
    last_word = np.minimum(before + n_words - 1, max(len(e) - 1, 0))
    closed = END[data[e[last_word] - 1]] if len(ls) else np.zeros(0, bool)
    size = part(chars) / n
    sym = part(symbols) / n
    feats = np.stack([
        np.ones(len(ls), bool), n_words <= 2, (n_words > 2) & (n_words <= 5), (n_words > 5) & (n_words <= 12), (n_words > 12) & (n_words <= 30),
        sym > 0.05, sym > 0.5, part(sums(UPPER[data])) / letters > 0.5, copy, repeated > 0.3, repeated > 0.7, ~closed,
        part(sums(DIGIT[data])) / np.maximum(part(chars), 1) > 0.2, size < 3, size > 12, part(sums(SHOUT[data])) / n > 0.3,
    ], axis=1) if len(ls) else np.zeros((0, len(FEATURES)), bool)
    return {
        "n_words": np.diff(wo), "word_chars": per(chars), "n_symbols": per(symbols), "n_dup_lines": np.bincount(line_row[copy], minlength=rows),
        "n_repeat_words": np.bincount(row[again], minlength=rows), "features": feats, "line_words": n_words, "lines": lo,
    }


def viterbi(emit: np.ndarray, move: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The best labels (0 boilerplate, 1 content) of many chains at once. emit: score of label 1 against 0 per line.

    Ties go to content.
    """
    n = np.diff(lines)
    out = np.zeros(len(emit), np.int8)
    order = np.argsort(-n, kind="stable")
    start, n = lines[:-1][order], n[order]
    longest = int(n[0]) if len(n) else 0
    if not longest:
        return out
    back = np.zeros((2, len(emit)), np.int8)
    alive = np.searchsorted(-n, -np.arange(1, longest + 1), "right")  # chains of at least that many lines come first
    score = np.zeros((2, len(n)))
    score[1] = np.where(n > 0, emit[np.minimum(start, len(emit) - 1)], 0)
    for t in range(1, longest):
        k = alive[t]
        at = start[:k] + t
        for label in (0, 1):
            a, b = score[0, :k] + move[0, label], score[1, :k] + move[1, label]
            back[label, at] = b >= a
            if label:
                up = np.maximum(a, b) + emit[at]
            else:
                down = np.maximum(a, b)
        score[0, :k], score[1, :k] = down, up
    label = (score[1] >= score[0]).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        out[at] = label[:k]
        if t:
            label[:k] = back[label[:k], at]
    return out


def train(chains: list[np.ndarray], target: list[np.ndarray], steps: int = 120, rate: float = 0.5, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features for label 1 and the transition scores, by gradient ascent on the conditional likelihood.

    Deterministic: starts at zero, full batches. Transitions are held within 2, so that a line's own features can
    outvote its neighbours.
    """
    w, move = np.zeros(len(FEATURES)), np.zeros((2, 2))
    if not chains:
        return w, move
    n = np.array([len(c) for c in chains])
    lines = np.concatenate([[0], np.cumsum(n)])
    x, y = np.concatenate(chains).astype(float), np.concatenate(target).astype(int)
    row = rows_of(lines)
    inner = np.flatnonzero(row[1:] == row[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner + 1]), 1)
    first = np.zeros(len(x), bool)
    first[lines[:-1]] = True
    step_of = np.arange(len(x)) - lines[:-1][row]
    by_step = [np.flatnonzero(step_of == t) for t in range(int(n.max()))]
    gw, gm = np.zeros_like(w), np.zeros_like(move)
    for _ in range(steps):
        emit = np.stack([np.zeros(len(x)), x @ w], 1)
        fwd, bwd = emit.copy(), np.zeros_like(emit)
        for t in range(1, len(by_step)):
            at = by_step[t]
            fwd[at] += np.logaddexp(fwd[at - 1, 0, None] + move[0], fwd[at - 1, 1, None] + move[1])
        for t in range(len(by_step) - 1, 0, -1):
            at = by_step[t]
            z = emit[at] + bwd[at]
            bwd[at - 1] = np.logaddexp(z[:, :1] + move[:, 0], z[:, 1:] + move[:, 1])
        whole = np.logaddexp(*(fwd + bwd).T)
        p = np.exp(fwd + bwd - whole[:, None])
        edge = fwd[inner][:, :, None] + move[None] + (emit + bwd)[inner + 1][:, None, :] - whole[inner][:, None, None]
        dw = x.T @ (y - p[:, 1]) / len(x) - l2 * w
        dm = (seen - np.exp(edge).sum(0)) / max(len(inner), 1) - l2 * move
        gw += dw**2
        gm += dm**2
        w = w + rate * dw / (np.sqrt(gw) + 1e-8)
        move = np.clip(move + rate * dm / (np.sqrt(gm) + 1e-8), -2, 2)
    return w, move


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", label: str = "quality", most: int = MOST_DOCS, most_lines: int = MOST_LINES) -> tuple[np.ndarray, np.ndarray]:
    """The CRF of a bounded sample: the `most` labelled documents with the smallest hash of their id.

    Of a document with more than most_lines lines a run of so many takes part, at a place that its number of lines gives.
    Only line features come to the driver. Without labelled rows all weights are 0.
    """
    small_batches(docs.sparkSession)
    lab = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    lab = lab.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(lab), "id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                m = measure(b.column(0))
                out = []
                for y, a, z in zip(b.column(1).to_pylist(), m["lines"][:-1].tolist(), m["lines"][1:].tolist(), strict=True):
                    if z - a > most_lines:
                        a += (z - a) * 2654435761 % (z - a - most_lines + 1)
                        z = a + most_lines
                    if z > a:
                        out.append((y, np.packbits(m["features"][a:z], axis=None).tobytes(), z - a))
                if out:
                    ys, bits, n = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(bits, pa.binary()), pa.array([int(k) for k in n], pa.int32())], ["y", "bits", "n"])

    rows = sample.mapInArrow(run, "y int, bits binary, n int").collect()
    rows.sort(key=lambda r: (r.n, r.y, bytes(r.bits)))  # the order of arrival must not matter
    chains = [np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), count=r.n * len(FEATURES)).reshape(r.n, -1) for r in rows]
    return train(chains, [np.full(r.n, 1 if r.y else 0) for r in rows])


def quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, text: str = "text", id_col: str = "doc_id", least_words: int = 50, most_repeat: int = 50, least_share: float = 0.5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share) per row.

    A null text counts as empty: no words, base_failed, share 0. Repeated rows give repeated results; extra columns are
    ignored; an empty table gives no rows. A share equal to least_share keeps. A very long text is one slice of its own,
    handled with arrays of its length.
    """
    small_batches(docs.sparkSession)
    w, move = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                m = measure(b.column(1))
                content = viterbi(m["features"] @ w, move, m["lines"])
                have = np.concatenate([[0], np.cumsum(m["line_words"] * content)])
                share = (have[m["lines"][1:]] - have[m["lines"][:-1]]) / np.maximum(m["n_words"], 1)
                failed = (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > most_repeat * m["n_words"])
                cols = [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(failed), pa.array(~failed & (share >= least_share)), pa.array(share)], ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return out.mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double").withColumnRenamed("id", id_col)
