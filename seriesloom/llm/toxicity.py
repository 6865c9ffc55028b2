"""Toxicity by a weighted lexicon.

Texts are folded (homoglyphs, digit substitutions, case), every lexicon entry is matched in one Aho-Corasick pass,
matches inside exception phrases do not count, and the weighted sum is normalised by length. The lexicon and the scale
are learned from a bounded sample of the training fold; entries are whole words or word beginnings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written
from .textops import slices, small_batches

#: Look-alikes and the Latin letters they stand for. Fixed values.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l", "ո": "n", "ս": "u"}
#: Digits and signs that stand for letters inside words. Fixed values.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: Phrases in which lexicon words are harmless. Fixed values, a parameter of the operator.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser", "stupid question", "not stupid", "not an idiot", "idiot proof")

#: The sample that the lexicon and the scale are fitted on: at most so many labelled documents.
MOST_DOCS = 10_000
MOST_ENTRIES = 2_000
#: Evidence in nats that an entry needs, and the share of its documents that must be toxic.
EVIDENCE, PRECISION = 15.0, 0.6
PREFIXES = (4, 5, 6, 7)
LIMIT = 0.7
#: The scale where nothing was learned: every text is clean.
NOTHING = (-20.0, 0.0, 0.0)

_table = {i: chr(i) if chr(i).isalpha() or chr(i).isdigit() else " " for i in range(128)}
_table |= {i: chr(i + 32) for i in range(65, 91)}
_table |= {ord(k): v for k, v in HOMOGLYPHS.items()}
_table |= {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1 and ord(k.upper()) > 127}
_table |= {c: chr(c - 0xFEE0) for c in range(0xFF41, 0xFF5B)} | {c: chr(c - 0xFEE0 + 32) for c in range(0xFF21, 0xFF3B)}
_table |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_table |= {c: " " for c in (*range(0x80, 0xAA), *range(0x2010, 0x2028), 0xA0, 0xAB, 0xBB, 0x3000)}
_digits = str.maketrans(DIGITS)
_mixed = re.compile(r"\S*[^\W\d_]\S*")
_inside = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")


def fold(text: str) -> str:
    """Lower case, homoglyphs as Latin letters, digits in words as letters, all else as spaces; a space at both ends."""
    if "@" in text or "$" in text:
        text = _inside.sub(lambda m: "a" if m[0] == "@" else "s", text)
    text = text.translate(_table)
    if not text.isascii():
        text = text.lower()
    if re.search("[0-9]", text):
        text = re.sub(r"(?<![^ ])[^ ]*?[0-9][^ ]*", lambda m: m[0].translate(_digits) if _mixed.fullmatch(m[0]) else m[0], text)
    return f" {text} "


@dataclass
class Model:
    """entries: pattern (with its leading, and for whole words its ending space) to weight. scale: logit = dot with (1, log1p(sum), log1p(sum per 100 words))."""

    entries: dict[str, float]
    scale: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    def __init__(self, entries: dict[str, float], exceptions: tuple[str, ...]):
        import ahocorasick

        self.auto = None
        found: dict[str, tuple[float, bool]] = {f" {' '.join(fold(p).split())} ": (0.0, True) for p in exceptions}
        found |= {p: (w, False) for p, w in entries.items()}
        if entries:
            self.auto = ahocorasick.Automaton()
            for p, (w, harmless) in found.items():
                self.auto.add_word(p, (len(p), w, harmless))
            self.auto.make_automaton()

    def weigh(self, folded: str) -> tuple[float, int]:
        """The weighted sum of matches outside exception phrases, and their number."""
        if self.auto is None:
            return 0.0, 0
        hits = list(self.auto.iter(folded))
        if not hits:
            return 0.0, 0
        harmless = [(end - n + 1, end) for end, (n, _, h) in hits if h]
        total, k = 0.0, 0
        for end, (n, w, h) in hits:
            if not h and not any(a <= end - n + 1 and end - 1 <= b for a, b in harmless):
                total, k = total + w, k + 1
        return total, k


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept from the fit; a row without id has none and is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _features(total: float, words: int) -> tuple[float, float, float]:
    return 1.0, log1p(total), log1p(100 * total / max(words, 1))


def _sample(docs: DataFrame, labels: DataFrame, most: int, text: str, id_col: str, label: str) -> DataFrame:
    lab = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id")))
    lab = lab.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(lab), "id").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", label: str = "toxic", most: int = MOST_DOCS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon and scale from the training fold: of its labelled documents the `most` with the smallest hash of their id.

    Entries are counted where the documents are; entries with evidence, MOST_ENTRIES at most, and two numbers a document
    come to the driver. Without labelled rows, or if nothing tells toxic from clean, the lexicon is empty and every text
    has the same low score.
    """
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels, most, text, id_col, label)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list({*seen[0], *seen[1]})
            b = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])
            seen[0].clear()
            seen[1].clear()
            return b

        for batch in batches:
            for b in slices(batch, "text"):
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = set(fold(t).split())
                    own = {f" {w} " for w in words if 2 < len(w) < 40}
                    for n in PREFIXES:
                        own.update(f" {w[:n]}" for w in words if len(w) >= n)
                    own.add("")
                    seen[1 if y else 0].update(own)
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield out()
        yield out()

    counts = sample.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts, "lexicon")
    whole = counts.where("entry = ''").collect()
    n_toxic, n_clean = (whole[0].toxic, whole[0].clean) if whole else (0, 0)
    if not n_toxic or not n_clean:
        return Model({}, NOTHING, exceptions)
    rate = n_toxic / (n_toxic + n_clean)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    best = counts.where("entry <> '' and toxic > 0").withColumn("evidence", F.col("toxic") * F.log(share / rate)).where((F.col("evidence") >= EVIDENCE) & (share >= PRECISION))
    best = best.orderBy(F.desc("evidence"), "entry").limit(4 * MOST_ENTRIES).collect()
    best.sort(key=lambda r: (-r.evidence, r.entry[-1] != " ", -len(r.entry), r.entry))
    entries: dict[str, float] = {}
    stems: set[str] = set()
    for r in best:
        stem = r.entry.strip()
        if any(stem[:n] in stems for n in range(1, len(stem) + 1)) or any(s.startswith(stem) for s in stems):
            continue  # a better entry has most of its documents
        stems.add(stem)
        entries[r.entry] = log((r.toxic + 0.5) / (n_toxic + 1)) - log((r.clean + 0.5) / (n_clean + 1))
        if len(entries) == MOST_ENTRIES:
            break

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(entries, exceptions)
        for batch in batches:
            for b in slices(batch, "text"):
                f = [fold(t) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([m.weigh(t)[0] for t in f], pa.float64()), pa.array([len(t.split()) for t in f], pa.int64())], ["y", "total", "words"])

    if not entries:
        return Model({}, NOTHING, exceptions)
    rows = sorted((r.y, r.total, r.words) for r in sample.mapInArrow(weigh, "y int, total double, words long").collect())
    return Model(entries, fit_scale([_features(t, n) for _, t, n in rows], [1 if y else 0 for y, _, _ in rows]), exceptions)


def fit_scale(x: list[tuple[float, float, float]], y: list[int]) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, shifted so that the cut with the best F1 of the sample is LIMIT.

    Only cuts above the score of a text without matches count, so that such a text is always clean; NOTHING if none is left.
    """
    a, t = np.array(x), np.array(y, float)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-2, 1e-2]) * len(t) / 100
        w = w + np.linalg.solve(h, a.T @ (t - p) - np.array([1e-3, 1e-2, 1e-2]) * len(t) / 100 * w)
    z = a @ w
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(t[order])
    f1 = 2 * hit / (np.arange(1, len(t) + 1) + t.sum())
    cut = np.append(z[order][1:] < z[order][:-1], True)  # equal scores stay together
    cut &= (z[order] > w[0] + 1e-9) & (hit > 0)
    if not cut.any():
        return NOTHING
    k = int(np.argmax(np.where(cut, f1, -1)))
    at = (z[order][k] + max(z[order][k + 1] if k + 1 < len(z) else w[0], w[0])) / 2
    w[0] += log(LIMIT / (1 - LIMIT)) - at
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score, n_hits) per row. Null and empty texts have no match and so the score of a clean text.

    Repeated rows give repeated results; extra columns are ignored; an empty table gives no rows. Memory is a batch of
    texts, whatever their number; a very long text is folded as a whole.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, scale = Matcher(model.entries, model.exceptions), model.scale
        for batch in batches:
            for b in slices(batch, "text"):
                out, hits = [], []
                for t in b.column(1).to_pylist():
                    f = fold(t)
                    total, k = m.weigh(f)
                    z = sum(a * c for a, c in zip(_features(total, len(f.split()) if total else 1), scale, strict=True))
                    out.append(1 / (1 + exp(-max(-30.0, min(30.0, z)))))
                    hits.append(k)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array(hits, pa.int64())], ["id", "score", "n_hits"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return out.mapInArrow(run, f"id {kind}, score double, n_hits long").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """The rows, with all their columns, whose score is below the limit. Rows stay where they are: no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(model.entries, model.exceptions)
        for batch in batches:
            for b in slices(batch, text):
                keep = []
                for t in b.column(b.schema.get_field_index(text)).to_pylist():
                    f = fold(t or "")
                    total, _ = m.weigh(f)
                    z = sum(a * c for a, c in zip(_features(total, len(f.split()) if total else 1), model.scale, strict=True))
                    keep.append(1 / (1 + exp(-max(-30.0, min(30.0, z)))) < limit)
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
