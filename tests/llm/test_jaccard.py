import random
import re

import numpy as np
import pyarrow as pa

from seriesloom.llm import jaccard

from .fixtures import ODD, documents, empty, frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 75 * (len(x) + len(y) - n):
                    a1, b1 = sorted((root(a), root(b)))
                    up[b1] = a1
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=3):
    """Groups around the threshold: chains, exact copies, and a passage that many documents share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    out, i = [], 1000
    passage = [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(r.randint(20, 90))]
        for _ in range(r.randint(2, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 22))):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = w[: -r.randint(1, 6)]
            out.append((i, " ".join(w)))
            i += 1
    for _ in range(60):
        n = r.randint(1, 25)
        out.append((i, " ".join(passage + [word() for _ in range(n)])))
        i += 1
    out += [(i + k, out[k * 3][1].upper()) for k in range(10)]
    return out


def result(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len({(r.doc_id, r.n_shingles, r.component_id) for r in rows})
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_against_brute_force(spark):
    rows = documents() + ODD + near_copies()
    assert result(jaccard.jaccard_components(frame(spark, rows))) == brute(rows)


def test_small_blocks_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = near_copies(5)
    got = jaccard.jaccard_components(frame(spark, rows + rows[:20]))
    assert got.count() == len(rows) + 20
    assert result(got) == brute(rows)


def test_empty(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_trees_lose_no_pair():
    r = np.random.RandomState(0)
    base = [r.randint(0, 1 << 60, 80).astype(np.uint64) for _ in range(6)]
    sets = []
    for _ in range(300):
        s = base[r.randint(6)].copy()
        k = r.randint(0, 25)
        s[r.choice(80, k, replace=False)] = r.randint(0, 1 << 60, k).astype(np.uint64)
        sets.append(np.unique(s))
    bits = np.stack([jaccard._signature(s) for s in sets])
    size = np.array([len(s) for s in sets])
    comp = np.arange(300)
    a, b = jaccard.tree_pairs(bits, size, comp, np.arange(150), np.arange(150, 300), 75)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    want = {(i, j) for i in range(150) for j in range(150, 300) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (size[i] + size[j] - n)}
    assert want <= got and len(got) < 150 * 150 / 2


def links(rows):
    """The number of other sets that each document's set links with."""
    of = {i: frozenset(shingles(t)) for i, t in rows}
    every = {s for s in of.values() if s}
    count = {s: sum(s != x and 100 * len(s & x) >= 75 * len(s | x) for x in every) for s in every}
    return {i: count.get(s, 0) for i, s in of.items()}


def test_all_links_are_counted(spark, monkeypatch):
    word = [f"w{k}" for k in range(200)]
    clique = [(i, " ".join([*word, f"end{i}"])) for i in range(40)]
    rows = clique + near_copies(7) + ODD
    want = links(rows)
    assert all(want[i] == 39 for i, _ in clique)
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == want
    monkeypatch.setattr(jaccard, "LINK_BLOCK", 6)
    monkeypatch.setattr(jaccard, "DENSE", 64)
    df = frame(spark, rows).repartition(5)
    assert {r.doc_id: r.n_links for r in jaccard.jaccard_components(df).collect()} == want


def hidden_pair():
    """Two near copies; each n-gram they share also stands in a smaller text that is far from both."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("klmnopqrst") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-2], word(), word()]))]
    for k in range(0, 120, 10):
        part = base[k : k + 14]
        rows.append((100 + k, " ".join(part + [word() for _ in range(112 - len(part))])))
    return rows


def test_trees_find_what_leaders_do_not(spark, monkeypatch):
    rows, seen = hidden_pair(), []
    trees = jaccard._tree_candidates
    first = np.ones(jaccard.CELLS, np.uint16)  # an order in which the smaller texts lead all groups of the two
    first[jaccard._cells(jaccard.shingle_sets(pa.array([rows[0][1]]), 5)[0])] = 0
    monkeypatch.setattr(jaccard, "_levels", lambda digests: first)

    def watched(*args):
        out = trees(*args).distinct().persist()
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_tree_candidates", watched)
    got = result(jaccard.jaccard_components(frame(spark, rows)))
    assert got == brute(rows) and got[2][1] == 1 and seen == [1]
    monkeypatch.setattr(jaccard, "FANOUT", 2)  # the same through trees of several levels
    assert result(jaccard.jaccard_components(frame(spark, rows))) == got and seen == [1, 1]


def test_ids_do_not_matter(spark):
    """Rows without id, one id on several texts, repeated rows, and ids that are no numbers."""
    rows = near_copies(11)[:60]
    want = brute(rows)
    odd = [(None, rows[0][1]), (None, "only here and nowhere else at all"), (rows[5][0], rows[40][1]), (rows[5][0], "a text of its own with seven words"), rows[7], rows[7], (None, None), (None, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows + odd)).collect()), key=str)
    everything = [(k, t) for k, (_, t) in enumerate(rows + odd)]
    by_row = brute(everything)
    ids = [i for i, _ in rows + odd]
    least = {}
    for k, (_, c) in by_row.items():
        least[c] = min((x for x in (least.get(c), ids[k]) if x is not None), default=None)
    assert got == sorted(((ids[k], n, least[c] if n else ids[k]) for k, (n, c) in by_row.items()), key=str)
    named = spark.createDataFrame([(f"d{i:06d}", t) for i, t in rows], "doc_id string, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(named).collect()} == {f"d{i:06d}": (n, f"d{c:06d}") for i, (n, c) in want.items()}


def test_one_of_each(spark):
    rows = near_copies(13)
    want = {i for i, (_, c) in brute(rows).items() if i == c}
    assert {r.doc_id for r in jaccard.one_of_each(frame(spark, rows)).collect()} == want
    odd = [rows[0], rows[0], (rows[3][0], "one id on a text that is linked with nothing else here"), (None, rows[0][1]), (None, "no id and no copy of it anywhere"), (None, None), (7, ""), (7, "")]
    got = jaccard.one_of_each(frame(spark, rows + odd))
    assert got.columns == frame(spark, rows).columns
    had = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    text = dict(rows)
    assert had == sorted([(i, text[i]) for i in want] + [odd[2], odd[4], odd[5], odd[6], odd[7]], key=str)
    assert jaccard.one_of_each(empty(spark)).count() == 0
