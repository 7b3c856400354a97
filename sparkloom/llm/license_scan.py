"""License scans with a generalised suffix automaton over licence tokens.

The automaton is built once from the token sequences of all templates and base
phrases; a separator that no text has keeps the sequences apart.  A text is
streamed through it, which gives at each word the length of the longest run of
words ending there that occurs in any template (the matching statistics).  A
word outside the templates' vocabulary resets the state, and runs of known
words that are shorter than any phrase and than ``min_match`` can't matter, so
only the longer ones are streamed; word hashes find them for a whole batch of texts at once.

* A base phrase occurs where it is a suffix of the current match.
* Matches that can't be extended to the right and have ``min_match`` words are
  chained for each template where both the text and the template move on, with
  at most ``max_gap`` words left out on either side.  A chain that covers
  ``min_cover`` of a template's words is a span of that template and adds its
  label.

Templates are short public licence notices and grants.  Defined results: a
null or empty text, or one without words, has no words and no labels and score
0; phrases may overlap and all places count; rows are independent of each
other.  A text's work and memory grow with its length only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textscan
from .frames import annotate

BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wording of public licence notices, lower-cased.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0-waiver": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences.

    ``places[state]`` lists (sequence, end) of the state's strings.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for s, seq in enumerate(sequences):
            last = 0
            for i, x in enumerate(seq):
                last = self._extend(last, x)
                while len(own) < len(self.next):
                    own.append([])
                own[last].append((s, i + 1))
        places = [set(x) for x in own]
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            places[self.link[v]] |= places[v]
        self.places = [sorted(x) for x in places]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, x: int, q: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, x: int) -> int:
        q = self.next[last].get(x)
        if q is not None:  # a prefix that an earlier sequence had
            return q if self.length[q] == self.length[last] + 1 else self._split(last, x, q)
        cur, p = self._new(self.length[last] + 1), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, x, q)
        return cur

    def step(self, state: int, length: int, x: int) -> tuple[int, int]:
        """State and length of the longest match after one more token."""
        while state and x not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(x)
        return (0, 0) if to is None else (to, length + 1)


@dataclass
class Scanner:
    vocabulary: textscan.Lookup
    automaton: SuffixAutomaton
    phrases: list[tuple[list[tuple[int, int]], ...]]  # by state: (phrase length, phrase number)
    base_labels: list[str]
    sizes: list[int]
    labels: list[str]
    min_match: int
    max_gap: int
    min_cover: float
    shortest: int  # words that a run needs to matter

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Covered spans ``(template, first word, word after the last, words covered)`` of right-maximal matches."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in matches:
            for s, place in self.automaton.places[state]:
                if s < len(self.sizes) and place >= length:
                    by.setdefault(s, []).append((end - length, place - length, length))
        out = []
        for s, found in by.items():
            found.sort()
            best: list[tuple[int, int]] = []  # words covered by the best chain that ends with each match, and where it began
            spans = []
            lo = 0
            for i, (d, t, n) in enumerate(found):
                cover, began = n, d
                while lo < i and found[lo][0] + self.sizes[s] + self.max_gap < d:
                    lo += 1
                for j in range(lo, i):
                    d2, t2, n2 = found[j]
                    lap = max(0, d2 + n2 - d, t2 + n2 - t)  # words that both matches have count once
                    if d2 < d and t2 < t and lap < n and d - d2 - n2 <= self.max_gap and t - t2 - n2 <= self.max_gap:
                        if best[j][0] + n - lap > cover:
                            cover, began = best[j][0] + n - lap, best[j][1]
                best.append((cover, began))
                if cover >= self.min_cover * self.sizes[s]:
                    spans.append((began, d + n, cover))
            for a, b, c in spans:
                if out and out[-1][0] == s and a < out[-1][2]:
                    if c > out[-1][3]:
                        out[-1] = (s, min(a, out[-1][1]), b, c)
                else:
                    out.append((s, a, b, c))
        return out

    def scan(self, ids: list[int], runs: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Base places ``(first word, phrase)`` and spans of one text; runs are (from, to, place of the first word)."""
        hits, matches = [], []
        step, phrases = self.automaton.step, self.phrases
        for a, b, at in runs:
            state = length = 0
            for k in range(a, b):
                before, was = state, length
                state, length = step(state, length, ids[k])
                if length <= was and was >= self.min_match:
                    matches.append((at + k - a, was, before))
                for n, p in phrases[state]:
                    if n <= length:
                        hits.append((at + k - a + 1 - n, p))
            if length >= self.min_match:
                matches.append((at + b - a, length, state))
        return hits, self.chains(matches) if matches else []


def scanner(base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, min_match: int = 3, max_gap: int = 6, min_cover: float = 0.75) -> Scanner:
    words = sorted({w for x in (*templates.values(), *base) for w in x.split()})
    ids = {w: i for i, w in enumerate(words)}
    sequences = [[ids[w] for w in x.split()] for x in (*templates.values(), *base)]
    automaton = SuffixAutomaton(sequences)
    phrases: list[list[tuple[int, int]]] = [[] for _ in automaton.next]
    for p, x in enumerate(base):
        state = 0
        for w in x.split():
            state = automaton.next[state][ids[w]]
        phrases[state].append((len(x.split()), p))
    for v in sorted(range(1, len(phrases)), key=automaton.length.__getitem__):
        phrases[v] = phrases[v] + phrases[automaton.link[v]]
    lookup = textscan.Lookup(np.array([textscan.hash_of(w.encode()) for w in words], dtype=np.uint64))
    return Scanner(lookup, automaton, phrases, list(base.values()), [len(x.split()) for x in templates.values()], list(templates), min_match, max_gap, min_cover, min([min_match, *(len(x.split()) for x in base)]))


FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.StringType()),
    ]
)


def scan(docs: DataFrame, text: str = "text", using: Scanner | None = None) -> DataFrame:
    """``docs`` with what the scan found; ``spans`` is JSON: [label, first word, word after the last, share covered]."""
    spread = docs.sparkSession.sparkContext.broadcast(using or scanner())
    new = {f.name for f in FIELDS}
    at = [c for c in docs.columns if c.lower() not in new].index(text)

    def run(batch: pa.RecordBatch) -> list:
        s = spread.value
        cols: list[list] = [[] for _ in FIELDS]
        for t in textscan.chunks(batch.column(at)):
            t = t.lowered()
            starts, ends, first = textscan.word_spans(t, textscan.ALNUM)
            ids = s.vocabulary(textscan.Hasher(t.data)(starts, ends)) if len(starts) else np.zeros(0, np.int64)
            known = ids >= 0
            edge = np.zeros(len(known) + 1, dtype=bool)
            edge[first] = True  # a run ends where a text does
            opens = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
            closes = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
            long = closes - opens >= s.shortest
            opens, closes = opens[long], closes[long]
            of = np.searchsorted(first, opens, "right") - 1
            runs: dict[int, list[tuple[int, int, int]]] = {}
            for d, a, b in zip(of.tolist(), opens.tolist(), closes.tolist(), strict=True):
                runs.setdefault(d, []).append((a, b, a - int(first[d])))
            tokens = ids.tolist() if runs else []
            for i, n in enumerate(np.diff(first).tolist()):
                hits, spans = s.scan(tokens, runs[i]) if i in runs else ((), ())
                base = {s.base_labels[p] for _, p in hits}
                more = base | {s.labels[k] for k, *_ in spans}
                best = max([c / s.sizes[k] for k, _, _, c in spans], default=0.0)
                row = (
                    n, len(hits), min((a for a, _ in hits), default=None), max((a for a, _ in hits), default=None),
                    ",".join(sorted(base)), ",".join(sorted(more)), 1.0 if hits else min(1.0, best),
                    json.dumps([[s.labels[k], a, b, round(min(1.0, c / s.sizes[k]), 4)] for k, a, b, c in sorted(spans, key=lambda x: x[1])]) if spans else None,
                )
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        return cols

    return annotate(docs, FIELDS, run)
