"""License scans: phrases, and templates with optional and replaceable regions compiled to token automata.

Template markup: plain words are mandatory, ``[[ ... ]]`` may be missing (regions nest), ``{{name:n}}`` stands for any 1 to
n words and ``{{name?:n}}`` for 0 to n. A text matches where the automaton accepts a run of its words: every mandatory
word stands there exactly and in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import LOWER, NOT_ALNUM, column_bytes, prefix_hash, slices, small_batches, span_hash, tokens

#: Base phrases and their labels. Fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "[[3]] neither the name of {{holder:12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "this software is provided by {{holder:12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_GNU = "under the terms of the gnu {{family}}general public license as published by the free software foundation [[either]] version {{version}} [[of the license]] [[or at your option any later version]]"

#: Templates of public license texts, of the notices that the licenses ask for, and of short notices. Fixed values.
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of {{this:1}} software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software [[" + _AS_IS + "]]",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies [[the software is provided as is and the author disclaims all warranties with regard to this software]]",
    "0bsd-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this software",
    "bsd-2-clause-text": _BSD + " " + _BSD_AS_IS,
    "bsd-3-clause-text": _BSD + " " + _BSD_NAMES + " [[" + _BSD_AS_IS + "]]",
    "bsd-text": _BSD + " [[" + _BSD_NAMES + "]]",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-1.0-text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl-text": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license",
    "apache-2.0-text": "apache license version 2 0 january 2004 [[http www apache org licenses]] terms and conditions for use reproduction and distribution",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http www apache org licenses license 2 0]] [[https www apache org licenses license 2 0]] [[unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied]]",
    "gpl-3.0-text": "gnu general public license version 3 29 june 2007 [[copyright [[c]] {{year:1}} free software foundation inc {{at?:4}}]] everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl-2.0-text": "gnu general public license version 2 june 1991 [[copyright [[c]] {{year:1}} [[{{year:1}}]] free software foundation inc {{at?:16}}]] everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "lgpl-3.0-text": "gnu lesser general public license version 3 29 june 2007",
    "lgpl-2.1-text": "gnu lesser general public license version 2 1 february 1999",
    "agpl-3.0-text": "gnu affero general public license version 3 19 november 2007",
    **{f"{name}-{version}-notice": _GNU.replace("{{family}}", family).replace("{{version}}", said) for name, family in (("gpl", ""), ("lgpl", "lesser "), ("agpl", "affero ")) for version, said in (("2.0", "2"), ("2.1", "2 1"), ("3.0", "3")) if (name, version) not in (("gpl", "2.1"), ("agpl", "2.0"), ("agpl", "2.1"))},
    "mpl-2.0-notice": "this source code [[form]] is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can obtain one at {{place:8}}]]",
    "epl-2.0-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license [[v]] 2 0",
    "cc0-1.0-text": "[[to the extent possible under law]] {{person:12}} has waived all copyright and related or neighboring rights to {{work:20}}",
    "cc-by-4.0-text": "this work is licensed under [[a]] [[the]] creative commons attribution 4 0 international [[license]]",
    "cc-by-sa-4.0-text": "this work is licensed under [[a]] [[the]] creative commons attribution sharealike 4 0 international [[license]]",
    "cc-by-nc-4.0-text": "this work is licensed under [[a]] [[the]] creative commons attribution noncommercial 4 0 international [[license]]",
    "apache-2.0": "licensed under the apache license version 2 0 [[the license]]",
    "gpl-3.0": "[[this work is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]] [[or at your option any later version]]",
    "gpl-2.0": "[[this work is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]] [[or at your option any later version]]",
    "mit": "{{how:1}} under the mit license",
    "cc-by-nc-4.0": "licensed under [[the]] cc by nc 4 0",
    "cc-by-4.0": "licensed under [[the]] cc by 4 0",
    "cc-by-sa-4.0": "licensed under [[the]] cc by sa 4 0",
    "all-rights-reserved": "[[copyright [[c]] {{year:1}} {{holder?:8}}]] all rights reserved",
}
_PART = re.compile(r"(\[\[|\]\]|\{\{\w+\??:\d+\}\})|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")


@dataclass
class Automaton:
    """A token NFA without empty moves left. step[state]: (word or None for any, next state)."""

    label: str
    step: list[list[tuple[str | None, int]]] = field(default_factory=list)
    start: frozenset[int] = frozenset()
    accept: frozenset[int] = frozenset()
    n_mandatory: int = 0
    longest: int = 0
    anchor: tuple[str, str, int, int] | None = None  # the first two mandatory words in a row, and how many words stand before, at least and at most


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of a template; unbalanced markup is an error."""
    empty: dict[int, set[int]] = {0: set()}
    step: list[list[tuple[str | None, int]]] = [[]]

    def new() -> int:
        step.append([])
        empty[len(step) - 1] = set()
        return len(step) - 1

    at, opened, mandatory, longest, least = 0, [], 0, 0, 0
    anchor, before = None, None  # before: the word just read, if it is mandatory, and what stood before it
    for mark, word in _PART.findall(markup.lower()):
        if word and not opened:
            if before and not anchor:
                anchor = (before[0], word, before[1], before[2])
            before = (word, least, longest)
            least += 1
        else:
            before = None
            least += bool(mark) and mark[0] == "{" and "?" not in mark and not opened
        if word:
            nxt = new()
            step[at].append((word, nxt))
            at, longest = nxt, longest + 1
            mandatory += not opened
        elif mark == "[[":
            opened.append(at)
            nxt = new()
            empty[at].add(nxt)
            at = nxt
        elif mark == "]]":
            if not opened:
                raise ValueError(f"{label}: ]] without [[")
            nxt = new()
            empty[at].add(nxt)
            empty[opened.pop()].add(nxt)
            at = nxt
        else:
            name, n = mark[2:-2].split(":")
            first, end = at, new()
            for _ in range(int(n)):
                nxt = new()
                step[at].append((None, nxt))
                empty[nxt].add(end)
                at = nxt
            if name.endswith("?"):
                empty[first].add(end)
            at, longest = end, longest + int(n)
    if opened:
        raise ValueError(f"{label}: [[ without ]]")

    def reach(s: int) -> set[int]:
        found, todo = {s}, [s]
        while todo:
            for t in empty[todo.pop()] - found:
                found.add(t)
                todo.append(t)
        return found

    close = [reach(s) for s in range(len(step))]
    flat = [sorted({(w, t) for q in close[s] for w, t in step[q]}, key=lambda x: (x[0] or "", x[1])) for s in range(len(step))]
    return Automaton(label, flat, frozenset({0}), frozenset(s for s in range(len(step)) if at in close[s]), mandatory, longest, anchor)


def run_automaton(a: Automaton, words: list[str], start: int) -> tuple[int, int]:
    """The end of the longest run of words from `start` that the automaton accepts, or -1, and how many words it read."""
    now, end, at = set(a.start), -1, start
    while now and at < len(words):
        w = words[at]
        now = {t for s in now for want, t in a.step[s] if want is None or want == w}
        at += bool(now)
        if now & a.accept:
            end = at
    return end, at - start


class Scanner:
    """Phrases and automata over a batch. Starts are found with array operations, automata run only from there."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.automata = [compile_template(k, v) for k, v in templates.items()]
        if any(0 in a.accept for a in self.automata):
            raise ValueError("a template needs a mandatory word")
        vocabulary = sorted({w for p, _ in self.phrases for w in p} | {w for a in self.automata for s in a.step for w, _ in s if w})
        raw = [w.encode() for w in vocabulary]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        keys = span_hash(prefix_hash(data), ends - [len(x) for x in raw], ends)
        order = np.argsort(keys)
        self.keys, self.words = keys[order], [vocabulary[i] for i in order]
        self.id = {w: i for i, w in enumerate(self.words)}

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def starts(self, a: Automaton, ids: np.ndarray) -> np.ndarray:
        """Where the template can begin: a head word stands there, and a second word it can go on with follows.

        Where any two words can begin it, only places near its first two mandatory words in a row are left.
        """
        nxt: dict[str | None, set[str | None]] = {}
        for s in a.start:
            for w, t in a.step[s]:
                nxt.setdefault(w, set()).update(x for x, _ in a.step[t])
                if t in a.accept:
                    nxt[w].add(None)
        after = np.append(ids[1:], -1)
        found = np.zeros(len(ids), bool)
        for w, follow in nxt.items():
            here = np.ones(len(ids), bool) if w is None else ids == self.id[w]
            if None not in follow:
                here &= np.isin(after, [self.id[x] for x in follow])
            if w is None and None in follow and a.anchor:
                one, two, low, high = a.anchor
                hit = np.flatnonzero((ids == self.id[one]) & (after == self.id[two]))
                near = np.zeros(len(ids) + 1, np.int64)
                np.add.at(near, np.maximum(hit - high, 0), 1)
                np.add.at(near, np.maximum(hit - low + 1, 0), -1)
                here &= np.cumsum(near)[:-1] > 0
            found |= here
        return np.flatnonzero(found)

    def scan(self, column: pa.Array) -> list[tuple]:
        """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        data, off = column_bytes(column)
        data = LOWER[data]
        s, e, wo = tokens(data, off, NOT_ALNUM)
        ids = self.ids(span_hash(prefix_hash(data), s, e))
        rows = len(off) - 1
        base: dict[int, list[tuple[int, str]]] = {}
        found: dict[int, list[tuple[int, int, str]]] = {}
        part: dict[int, float] = {}
        row_of = lambda at: np.searchsorted(wo, at, "right") - 1
        for words, label in self.phrases:
            n = len(ids) - len(words) + 1
            if n <= 0:
                continue
            hit = np.ones(n, bool)
            for j, w in enumerate(words):
                hit &= ids[j : n + j] == self.id[w]
            hit = np.flatnonzero(hit)
            r = row_of(hit)
            for at, k in zip(hit.tolist(), r.tolist(), strict=True):
                if at + len(words) <= wo[k + 1]:
                    base.setdefault(k, []).append((at - int(wo[k]), label))
        text = self.words
        for a in self.automata:
            hit = self.starts(a, ids)
            for at, k in zip(hit.tolist(), row_of(hit).tolist(), strict=True):
                to = min(int(wo[k + 1]), at + a.longest)
                end, read = run_automaton(a, [text[i] if i >= 0 else "" for i in ids[at:to].tolist()], 0)
                part[k] = max(part.get(k, 0.0), min(1.0, read / a.n_mandatory))
                if end > 0:
                    found.setdefault(k, []).append((at - int(wo[k]), at - int(wo[k]) + end, a.label))
        out = []
        for k in range(rows):
            b, f = base.get(k), found.get(k)
            own = {x for _, x in b} if b else set()
            both = own | {x[2] for x in f} if f else own
            place = [x[0] for x in b] if b else []
            spans = ",".join(f"{label}:{x}:{y}" for x, y, label in sorted(f)) if f else ""
            out.append((int(wo[k + 1] - wo[k]), len(place), min(place, default=None), max(place, default=None), ",".join(sorted(own)), ",".join(sorted(both)), 1.0 if f else (0.5 if b else 0.0) + 0.4 * part.get(k, 0.0), spans))
        return out


def license_scan(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row.

    score: 1 where a template is accepted; else 0.5 where phrases stand, and up to 0.4 more for the part of a template's
    mandatory words that was read before the wording differs. spans: label:start:end of the accepted runs in words, the
    longest from each start. Null and empty texts have no words, empty labels, null places and score
    0. Repeated rows give repeated results; extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            for b in slices(batch, "text"):
                cols = list(zip(*scanner.scan(b.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(cols, kinds, strict=True))], ["id", *(k for k, _ in kinds)])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return out.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string").withColumnRenamed("id", id_col)
