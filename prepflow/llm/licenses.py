"""Licence scans by a generalised suffix automaton of template words.

The automaton holds every run of consecutive words of every template.  Streaming
a text through it gives matching statistics: at each word, the longest run that
ends there and stands in some template.  Runs that cannot be extended and have at
least ``MIN_MATCH`` words are matches; matches that follow each other in both text
and template chain into a covered span, and the best chain's share of the
template is its cover.  A label is given where a template is covered to
``MIN_COVER`` or more; base phrases are templates that must be covered whole.

Only stretches where every pair of neighbouring words stands next to each other
in some template can hold matches, so the automaton runs over those alone.

Defined results: NULL text counts as empty (0 words, no labels, score 0);
repeated rows are scanned each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.columns import q

MIN_MATCH = 3
MIN_COVER = 0.7
MAX_GAP = 12  # words between two chained matches

#: Phrases that count as places, with their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Opening or key sentences of public licence texts, with their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation either version 3 of the license "
            "or at your option any later version"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and all other non-ASCII characters, A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; ``places`` has, per state, the end of a match in each template."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, int]] = [{}]
        for number, words in enumerate(templates):
            last = 0
            for end, w in enumerate(words, 1):
                last = self._extend(last, w)
                self.places[last].setdefault(number, end)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for number, end in self.places[state].items():  # a suffix ends wherever the longer run ends
                self.places[self.link[state]].setdefault(number, end)

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.places.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the run that reaches ``next[p][w]`` by exactly one word after ``p``."""
        old = self.next[p][w]
        if self.length[old] == self.length[p] + 1:
            return old
        new = self._new(self.length[p] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = new
        while p >= 0 and self.next[p].get(w) == old:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, w)
        return new

    def statistics(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            yield state, length


class Scanner:
    def __init__(self):
        texts = [*BASE_PHRASES, *TEMPLATES]
        self.labels = [label for label, _ in texts]
        split = [t.encode().split() for _, t in texts]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in split for w in t))}
        self.templates = [[self.number[w] for w in t] for t in split]
        n = len(self.number)
        self.neighbours = np.zeros((n + 1, n + 1), dtype=bool)
        for t in self.templates:
            self.neighbours[t[:-1], t[1:]] = True
        self.automaton = a = SuffixAutomaton(self.templates)
        ends = {}
        for k in range(len(BASE_PHRASES)):
            state = 0
            for w in self.templates[k]:
                state = a.next[state][w]
            ends.setdefault(state, []).append(k)
        self.phrases = []  # per state, the base phrases that end there if the match is long enough
        for state in range(len(a.next)):
            found, s = [], state
            while s > 0:
                found += ends.get(s, ())
                s = a.link[s]
            self.phrases.append(found)

    def _stretches(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        n = len(self.number)
        ids = np.fromiter(map(self.number.get, words, repeat(n)), dtype=np.int32, count=len(words))
        good = np.flatnonzero(self.neighbours[ids[:-1], ids[1:]])
        if len(good) < MIN_MATCH - 1:
            return
        breaks = np.flatnonzero(np.diff(good) > 1) + 1
        for run in np.split(good, breaks):
            if len(run) >= MIN_MATCH - 1:
                yield int(run[0]), ids[run[0]:run[-1] + 2].tolist()

    def __call__(self, text: bytes) -> dict:
        words = words_of(text)
        base: list[tuple[int, int]] = []  # (start, phrase)
        chains: dict[int, list[list[int]]] = defaultdict(list)  # template: [start, end, end in template, covered]
        a = self.automaton
        for first, ids in self._stretches(words) if len(words) >= MIN_MATCH else ():
            stats = list(a.statistics(ids))
            for i, (state, length) in enumerate(stats):
                for k in self.phrases[state]:
                    size = len(self.templates[k])
                    if length >= size:
                        base.append((first + i + 1 - size, k))
                if length < MIN_MATCH or i + 1 < len(stats) and stats[i + 1][1] == length + 1:
                    continue
                end = first + i + 1
                for number, at in a.places[state].items():
                    own = chains[number]
                    if own and 0 <= end - length - own[-1][1] <= MAX_GAP and at - length >= own[-1][2]:
                        own[-1] = [own[-1][0], end, at, own[-1][3] + length]
                    else:
                        own.append([end - length, end, at, length])
        spans, score = [], 0.0
        for number, own in chains.items():
            size = len(self.templates[number])
            need = 1.0 if number < len(BASE_PHRASES) else MIN_COVER
            for start, end, _, covered in own:
                cover = min(1.0, covered / size)
                score = max(score, cover)
                if cover >= need:
                    spans.append((start, end, self.labels[number], cover))
        base_labels = sorted({self.labels[k] for _, k in base})
        return {"n_words": len(words), "n_base": len(base),
                "first_word": min(base)[0] if base else None, "last_word": max(base)[0] if base else None,
                "base_labels": base_labels,
                "labels": sorted({*base_labels, *(s[2] for s in spans)}), "score": 1.0 if base else score,
                "spans": [{"start": s, "end": e, "label": label, "cover": c} for s, e, label, c in sorted(spans)]}


RESULT = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                    ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
                    ("labels", pa.list_(pa.string())), ("score", pa.float64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                                                  ("label", pa.string()), ("cover", pa.float64())])))])
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "labels array<string>, score double, spans array<struct<start:long,end:long,label:string,cover:double>>")


def _scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = Scanner()
    for b in batches:
        found = pa.array([scan(t.as_py() or b"") for t in b.column(1)], RESULT)
        yield pa.RecordBatch.from_arrays([b.column(0), *found.flatten()], ["doc_id", *(f.name for f in RESULT)])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, places of base phrases, labels, the covered template ``spans`` (in words) and ``score``."""
    rows = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_scan_batches, SCHEMA)
