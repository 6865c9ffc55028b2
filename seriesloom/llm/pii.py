"""Personal data: exact base patterns, and a skip-chain CRF over the tokens they leave undecided.

Base spans (email, ip, card, phone) are found as the patterns say. The CRF gives the other tokens that look like
identifiers a label: a kind of entity, or none. Neighbours are linked by a chain, repeated or similar tokens by skip edges
however far apart; both have a learned score for each pair of labels, and loopy belief propagation makes the labels of
one entity agree over the whole document. Base spans take part as fixed evidence of their kind and always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import segments, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_marked = re.compile(r"[0-9@+]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        k = ord(d) - 48
        total += k if i % 2 == 0 else k * 2 - 9 * (k > 4)
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches. The part before an @ is the whole run of its characters, so each @ is looked at once."""
    out, done = [], 0
    a = t.find("@")
    while a >= 0:
        s = a
        while s > done and t[s - 1] in _local:
            s -= 1
        m = _domain.match(t, a + 1) if s < a else None
        if m:
            out.append((s, m.end()))
            done = m.end()
        else:
            done = max(done, a + 1)
        a = t.find("@", max(a + 1, done))
    return out


def ips(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping runs of four dotted numbers; those with a part over 255 are dropped."""
    out = []
    for m in _dotted.finditer(t):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            n = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + n))
            at += n + 1
    return out


def cards(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _card.finditer(t):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def phones(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _phone.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    if not _marked.search(t):
        return {}
    return {"email": emails(t) if "@" in t else [], "ip": ips(t), "card": cards(t), "phone": phones(t) if "+" in t else []}


# --- the skip-chain CRF ---------------------------------------------------------------------------------------------

#: Tokens that can be identifiers: with a digit or an @, or long runs of capitals; others are outside by construction.
_candidate = re.compile(r"(?<![^\s<>\"'(),;:!?|*$#&%])[^\s<>\"'(),;:!?|*$#&%]*(?:[0-9@]|[A-Z]{8})[^\s<>\"'(),;:!?|*$#&%]*")
_plain = re.compile(r"[^a-z0-9]+")
#: Public credential formats used as weak labels in training. Fixed values.
_credential = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk_live_[0-9A-Za-z]{16,}|xox[bp]-[0-9A-Za-z-]{10,}")
#: What is given to a name of a secret, in the manner of configuration files; a weak label if it has a digit.
_given = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?\Z")
#: Words that announce an identifier. Fixed values.
_cue = re.compile(r"(?i)(?:e-?mail|mail|phone|tel|call|contact|account|acct|iban|passport|ssn|user(?:name)?|login|password|token|secret|key|id|card|address)\W{0,5}\Z")

FEATURES = ("bias", "@", "digits>=8", "digits 4-7", "digits 1-3", "letters and digits", "capitals and digits", "length>=16", "length 8-15", "length<=3", "only digits", "cue before", "dots", "marks")
#: Labels of a token: none, the base kinds, and the kinds that only the CRF gives.
LABELS = ("none", *KINDS, "secret", "name")
#: The sample the CRF is fitted on: at most so many documents, and of each one run of at most so many tokens.
MOST_DOCS, MOST_TOKENS = 3000, 500
ROUNDS = 30


@dataclass
class Model:
    """node: a row of weights of FEATURES for each label. chain, skip: the score of each pair of labels over an edge."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


@dataclass
class Tokens:
    """fixed: the label of a base span, 0 for tokens that are to be labelled."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    fixed: np.ndarray
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def shape(t: str, s: int, e: int) -> list[bool]:
    w = t[s:e]
    d = sum(c.isdigit() for c in w)
    up, low = any("A" <= c <= "Z" for c in w), any("a" <= c <= "z" for c in w)
    n = e - s
    return [True, "@" in w, d >= 8, 4 <= d < 8, 0 < d < 4, d > 0 and (up or low), d > 0 and up and not low and n >= 12, n >= 16, 8 <= n < 16, n <= 3, d == n, bool(_cue.search(t[max(0, s - 24) : s])), w.count(".") >= 2, any(c in "_-=/+" for c in w)]


def tokenize(t: str, base: list[tuple[str, int, int]]) -> Tokens:
    """Candidate tokens with their evidence and edges.

    Skip edges join each occurrence of a token to the one before it, and a token to the last base span that contains
    it as a part (an account name of an address): linear in the tokens, though any two equal tokens are connected.
    """
    kind = {(s, e): LABELS.index(k) for k, s, e in base}
    base = sorted(kind)
    starts = [s for s, _ in base]
    spans, fixed = [], []
    parts: dict[str, int] = {}
    found = sorted({m.span() for m in _candidate.finditer(t)} | set(base))
    for s, e in found:
        while e > s and t[e - 1] == ".":
            e -= 1
        k = bisect_right(starts, e - 1) - 1
        inside = k >= 0 and base[k][1] > s
        if inside and (s, e) != base[k]:
            continue  # covered by the base span, which is a token itself
        spans.append((s, e))
        fixed.append(kind[s, e] if inside else 0)
    for i, (s, e) in enumerate(spans):
        if fixed[i] and "@" in t[s:e]:
            parts.setdefault(t[s:e].split("@")[0].lower(), i)
    names = sorted((p for p in parts if len(p) >= 4 and not p.isdigit()), key=lambda p: (-len(p), p))
    if names:  # an account name elsewhere is a candidate, whatever its letters
        have = set(spans)
        covered = sorted(spans)
        at = [s for s, _ in covered]
        pattern = re.compile(r"(?<![A-Za-z0-9._%+@-])(?:" + "|".join(map(re.escape, names)) + r")(?![A-Za-z0-9_%+@-])", re.I)
        for m in pattern.finditer(t):
            k = bisect_right(at, m.end() - 1) - 1
            if m.span() not in have and not (k >= 0 and covered[k][1] > m.start()):
                spans.append(m.span())
                fixed.append(0)
        order = sorted(range(len(spans)), key=spans.__getitem__)
        spans, fixed = [spans[i] for i in order], [fixed[i] for i in order]
        parts = {t[s:e].split("@")[0].lower(): i for i, (s, e) in enumerate(spans) if fixed[i] and "@" in t[s:e]}
    last: dict[str, int] = {}
    chain, skip = [], []
    for i, (s, e) in enumerate(spans):
        if i:
            chain.append((i - 1, i))
        key = _plain.sub("", t[s:e].lower()) or t[s:e]
        if key in last:
            skip.append((last[key], i))
        last[key] = i
        home = parts.get(t[s:e].lower())
        if home is not None and home != i:
            skip.append((min(i, home), max(i, home)))
    return Tokens(spans, np.array([shape(t, s, e) for s, e in spans], bool).reshape(len(spans), len(FEATURES)), np.array(fixed, np.int64), chain, skip)


def propagate(docs: list[Tokens], model: Model, rounds: int = ROUNDS, damping: float = 0.5) -> list[np.ndarray]:
    """The probability of each label per token of each document, by loopy belief propagation; fixed tokens have their own.

    Messages are logarithms, sent along all edges at once. A document is done once its messages change by less than 1e-6,
    or after `rounds`; all others go on without it, so what documents stand together does not matter. On a graph without
    cycles the messages are exact.
    """
    n = np.array([len(x.spans) for x in docs])
    if not n.sum():
        return [np.zeros((0, len(LABELS))) for _ in docs]
    theta = np.concatenate([x.features for x in docs if len(x.spans)]) @ model.node.T
    fixed = np.concatenate([x.fixed for x in docs if len(x.spans)])
    sure = np.full((len(fixed), len(LABELS)), -12.0)
    sure[np.arange(len(fixed)), fixed] = 12.0
    theta = np.where(fixed[:, None] > 0, sure, theta)
    begin = np.cumsum(n) - n
    ends, kind, home = [], [], []
    for d, (x, at) in enumerate(zip(docs, begin.tolist(), strict=True)):
        e = x.chain + x.skip
        if e:
            e = np.array(e, np.int64) + at
            ends.append(np.concatenate([e, e[:, ::-1]]))
            kind.append(np.tile(np.arange(len(e)) >= len(x.chain), 2))
            home.append(np.full(2 * len(e), d))
    total = theta.copy()
    if ends:
        ends, kind, home = np.concatenate(ends), np.concatenate(kind), np.concatenate(home)
        score = np.exp(np.stack([model.chain, model.skip]))
        per = np.bincount(home, minlength=len(docs))
        half = np.repeat(per // 2, per)
        back = np.arange(len(home)) + np.where(segments(per) < half, half, -half)  # an edge and its way back
        msg = np.zeros((len(home), len(LABELS)))
        todo = np.arange(len(home))
        for _ in range(rounds):
            src = ends[todo, 0]
            h = total[src] - msg[back[todo]]
            h = np.exp(h - h.max(1, keepdims=True))
            new = np.where(kind[todo][:, None], h @ score[1], h @ score[0])
            new = np.log(new)
            new -= new.mean(1, keepdims=True)
            change = np.abs(new - msg[todo]).max(1)
            first = np.flatnonzero(np.append(True, home[todo][1:] != home[todo][:-1]))
            moving = np.repeat(np.maximum.reduceat(change, first) > 1e-6, np.diff(np.append(first, len(todo))))
            msg[todo] = np.where(moving[:, None], damping * msg[todo] + (1 - damping) * new, new)
            total = theta.copy()
            for c in range(len(LABELS)):
                total[:, c] += np.bincount(ends[:, 1], msg[:, c], len(theta))
            todo = todo[moving]
            if not len(todo):
                break
    p = np.exp(total - total.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return np.split(p, np.cumsum(n)[:-1])


def train(docs: list[tuple[Tokens, np.ndarray]], steps: int = 200, rate: float = 0.3, l2: float = 0.002) -> Model:
    """Pseudo-likelihood: each token's label given its neighbours' labels, by gradient ascent from zero.

    Node weights and the scores of pairs of labels, which are symmetric, are all learned; l2 holds back what few tokens say.
    """
    k = len(LABELS)
    if not docs:
        node = np.zeros((k, len(FEATURES)))
        node[0, 0] = 6.0
        return Model(node, np.zeros((k, k)), np.zeros((k, k)))
    x = np.concatenate([t.features for t, _ in docs]).astype(float)
    y = np.concatenate([v for _, v in docs]).astype(int)
    near = []
    for kind in ("chain", "skip"):
        parts = []
        for t, v in docs:
            e = np.array(getattr(t, kind), np.int64).reshape(-1, 2)
            counts = np.zeros((len(v), k))
            np.add.at(counts, (e[:, 0], v[e[:, 1]]), 1)
            np.add.at(counts, (e[:, 1], v[e[:, 0]]), 1)
            parts.append(counts)
        near.append(np.concatenate(parts))
    # equal rows count together: there are few of them
    rows, weight = np.unique(np.column_stack([x, *near, y]), axis=0, return_counts=True)
    f = x.shape[1]
    x, near, y = rows[:, :f], [rows[:, f : f + k], rows[:, f + k : f + 2 * k]], rows[:, -1].astype(int)
    want = np.eye(k)[y]
    w = [np.zeros((k, f)), np.zeros((k, k)), np.zeros((k, k))]
    g2 = [np.zeros_like(v) for v in w]
    for _ in range(steps):
        z = x @ w[0].T + near[0] @ w[1] + near[1] @ w[2]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (want - p) * (weight / weight.sum())[:, None]
        grads = [d.T @ x, near[0].T @ d, near[1].T @ d]
        for q, g in enumerate(grads):
            g = (g + g.T if q else g) - l2 * w[q]
            g2[q] += g * g
            w[q] = w[q] + rate * g / (np.sqrt(g2[q]) + 1e-9)
    return Model(*w)


def _flat(base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Base spans without overlaps: of overlapping ones the first and longest."""
    out: list[tuple[str, int, int]] = []
    for s, e, _, kind in sorted(((s, e, KINDS.index(k), k) for k, v in base.items() for s, e in v), key=lambda x: (x[0], -x[1], x[2])):
        if not out or s >= out[-1][2]:
            out.append((kind, s, e))
    return out


def weak_labels(t: str, x: Tokens) -> np.ndarray:
    """What the CRF is trained towards: base spans their kind, credentials and values given to names of secrets a secret
    wherever they stand, the account part of an address of the text a name, all else none."""
    accounts = {t[s:e].split("@")[0].lower() for (s, e), k in zip(x.spans, x.fixed.tolist(), strict=True) if k == 1}
    out = x.fixed.copy()
    secret = {w for s, e in x.spans if _credential.fullmatch(w := t[s:e]) or e - s >= 16 and any(c.isdigit() for c in w) and _given.search(t[max(0, s - 24) : s])}
    for i, (s, e) in enumerate(x.spans):
        if not out[i]:
            w = t[s:e]
            if w in secret:
                out[i] = LABELS.index("secret")
            elif w.lower() in accounts and len(w) >= 4 and not w.isdigit():
                out[i] = LABELS.index("name")
    return out


def fit(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", most: int = MOST_DOCS, most_tokens: int = MOST_TOKENS) -> Model:
    """The CRF, from weak labels, on a bounded sample: of the documents with a digit or an @, the `most` with the smallest
    hash of their id. Of a document with more than `most_tokens` tokens a run of so many takes part, at a place that its
    length gives; edges that leave it are left out. Features, labels and edges come to the driver, not texts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.col("id").isNotNull())
    ids = rows.where(F.col("text").rlike("[0-9@]")).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    sample = rows.join(F.broadcast(ids), "id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                out = []
                for t in b.column(0).to_pylist():
                    x = tokenize(t, _flat(base_spans(t)))
                    m = len(x.spans)
                    if m:
                        at = len(t) * 2654435761 % (m - most_tokens + 1) if m > most_tokens else 0
                        to = min(m, at + most_tokens)
                        y = weak_labels(t, x)[at:to]
                        inner = [[k - at for e in edges if at <= e[0] and e[1] < to for k in e] for edges in (x.chain, x.skip)]
                        out.append((np.packbits(x.features[at:to]).tobytes(), y.astype(np.uint8).tobytes(), len(y), *inner))
                if out:
                    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["x", "y", "n", "chain", "skip"])

    got = sample.mapInArrow(run, "x binary, y binary, n int, chain array<int>, skip array<int>").collect()  # at most most * most_tokens tokens
    got.sort(key=lambda r: (r.n, bytes(r.x), bytes(r.y), r.skip))
    pairs = lambda v: list(zip(v[::2], v[1::2], strict=True))
    bits = lambda raw, n: np.unpackbits(np.frombuffer(bytes(raw), np.uint8), count=n).astype(bool)
    return train([(Tokens([], bits(r.x, r.n * len(FEATURES)).reshape(r.n, -1), np.zeros(r.n, int), pairs(r.chain), pairs(r.skip)), np.frombuffer(bytes(r.y), np.uint8).astype(int)) for r in got])


def find(texts: list[str], model: Model, threshold: float = 0.5) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """Per text: base spans by kind, and all spans (kind, start, end) in order: kinds as listed, then those the CRF adds.

    A token is added if no label but none is likelier than the threshold, under the likeliest of the other labels.
    """
    out, todo = [], []
    for k, t in enumerate(texts):
        base = base_spans(t)
        out.append((base, [(kind, s, e) for kind in KINDS for s, e in base.get(kind, ())]))
        if base or _candidate.search(t):
            x = tokenize(t, _flat(base))
            if not x.fixed.all():
                todo.append((k, x))
    for (k, x), p in zip(todo, propagate([x for _, x in todo], model), strict=True):
        for i in np.flatnonzero((x.fixed == 0) & (p[:, 0] < 1 - threshold)).tolist():
            out[k][1].append((LABELS[1 + int(np.argmax(p[i, 1:]))], *x.spans[i]))
    return out


def mask(t: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by the first one's kind in brackets."""
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [t[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join([*out, t[done:]])


def personal_data(docs: DataFrame, model: Model, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans, masked) per row; places are code points,
    ends exclusive.

    spans lists kind:start:end, the base's first and then the n_added ones of the CRF, comma-joined; masked is the text
    without them. Null and empty texts have no spans and an empty mask. Repeated rows give repeated results; extra columns are ignored; an empty table
    gives no rows. Every pattern is read in one pass, so very long texts and runs take time in proportion.
    """
    small_batches(docs.sparkSession)
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans", "masked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                out = []
                texts = b.column(1).to_pylist()
                for t, (base, spans) in zip(texts, find(texts, model), strict=True):
                    n = sum(map(len, base.values()))
                    own = ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base.get(k, ()))
                    out.append((*(len(base.get(k, ())) for k in KINDS), sha256(own.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in spans), len(spans) - n, len(spans), mask(t, spans) if spans else t))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long, masked string").withColumnRenamed("id", id_col)


def masked(docs: DataFrame, model: Model, *, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows, with all their columns, their text without personal data and `length`, if it is a column, made anew.

    Null texts stay null, their length as well, empty ones empty; ids and repeated rows do not matter.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    n = docs.columns.index(length) if length in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text):
                old = b.column(at).to_pylist()
                new = [mask(t, spans) if spans else t for t, (_, spans) in zip(old, find([t or "" for t in old], model), strict=True)]
                cols = list(b.columns)
                cols[at] = pa.array(new, b.column(at).type)
                if n is not None:
                    cols[n] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(b.column(n).type)
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable or f.name == length) for f in docs.schema])
    return docs.mapInArrow(run, schema)
