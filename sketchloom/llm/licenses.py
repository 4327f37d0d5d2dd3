"""Licence scans: a generalised suffix automaton over licence tokens.

The automaton is built once from all templates.  A file streams through it and yields, at
each token, the longest suffix that occurs in any template (matching statistics).  Base
phrases are counted from the automaton's states; along suffix links each state knows every
place of every template where its strings end.  Matches of ``min_match`` tokens or more that
can't be extended are chained, in text and template order, by dynamic programming into the
span that covers most of a template, and a template of which ``min_cover`` is covered gives
its label.

Defined cases: a null or empty text has no words and no labels (score 0); repeated rows
are scanned alike; an empty table gives an empty result; extra columns are ignored; ties
between templates give all their labels, sorted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Longer templates: (label, pieces of the notice in their order), then whole licence texts.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge", "to any person obtaining a copy of this software", "to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0", "you may not use this file except", "in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing", "distributed on an as is basis"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms", "with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license", "v 2 0"),
    ("isc", "permission to use copy modify and or distribute", "this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software", "released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution", "4 0 international license"),
    ("mit", "released under the mit license"),
    ("cc-by-nc", "licensed under cc by nc"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise",
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """The words: runs of digits, letters a-z after lower-casing A-Z, and bytes above ASCII."""
    return _WORD.findall((text or b"").lower())


@dataclass
class Automaton:
    """A generalised suffix automaton over token ids, with its phrases and occurrences."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: By state: (template, place) of every place where the state's strings end.
    places: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])
    #: By state: (template, place, most tokens that match there), along the suffix links.
    reach: list[list[tuple[int, int, int]]] = field(default_factory=list)
    #: By state: (phrase, tokens) of all phrases that end with the state's longest string.
    phrases: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        for column, value in ((self.step, step), (self.link, link), (self.length, length), (self.places, set()), (self.phrases, [])):
            column.append(value)
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if (q := self.step[last].get(token)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.step[p]:
            self.step[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    @classmethod
    def of(cls, templates: list[list[int]], phrases: list[list[int]]) -> Automaton:
        a = cls()
        for tokens in [*templates, *phrases]:
            last = 0
            for t in tokens:
                last = a._extend(last, t)
        for k, tokens in enumerate(templates):
            s = 0
            for at, t in enumerate(tokens):
                s = a.step[s][t]
                up = s
                while up > 0:
                    a.places[up].add((k, at + 1))
                    up = a.link[up]
        for k, tokens in enumerate(phrases):
            s = 0
            for t in tokens:
                s = a.step[s][t]
            a.phrases[s].append((k, len(tokens)))
        for s in sorted(range(1, len(a.length)), key=a.length.__getitem__):
            a.phrases[s] = a.phrases[s] + a.phrases[a.link[s]]
        for s in range(len(a.length)):
            found: dict[tuple[int, int], int] = {}
            up = s
            while up > 0:
                for place in a.places[up]:
                    found.setdefault(place, a.length[up])
                up = a.link[up]
            a.reach.append([(k, at, n) for (k, at), n in sorted(found.items())])
        return a

    def statistics(self, tokens):
        """(state, length) after each token: the longest suffix so far that occurs in a template."""
        s = n = 0
        step, link, length = self.step, self.link, self.length
        for t in tokens:
            while s and t not in step[s]:
                s = link[s]
                n = length[s]
            if t in step[s]:
                s = step[s][t]
                n += 1
            yield s, n


@dataclass(frozen=True)
class Scan:
    min_match: int = 4
    min_cover: float = 0.75
    max_gap: int = 50
    phrases: tuple = BASE_PHRASES
    templates: tuple = TEMPLATES


class Scanner:
    """The automaton with its vocabulary; scans one text at a time in memory of its own size."""

    def __init__(self, params: Scan = Scan()):
        self.params, self.vocabulary = params, {}
        ids = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())]
        phrases = [ids(t) for _, t in params.phrases]
        templates = [ids(" ".join(t)) for _, *t in params.templates]
        self.sizes = [len(t) for t in templates]
        self.shortest = min([params.min_match, *map(len, phrases)])
        self.automaton = Automaton.of(templates, phrases)

    def scan(self, text: bytes | None):
        """(n_words, places of base phrases, base labels, labels, score, spans (template, first, end, cover))."""
        words = words_of(text)
        lookup = self.vocabulary.get
        ids = np.fromiter((lookup(w, -1) for w in words), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0])).astype(np.int8)))
        places, base, matches = [], set(), {}
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - first >= self.shortest:
                self._run(ids[first:end].tolist(), first, places, base, matches)
        cover, spans = self._chain(matches)
        labels = base | {self.params.templates[k][0] for k, c in cover.items() if c >= self.params.min_cover}
        score = 1.0 if base else max(cover.values(), default=0.0)
        return len(words), places, sorted(base), sorted(labels), score, [(k, a, b, cover[k]) for k, a, b in spans]

    def _run(self, tokens, first, places, base, matches) -> None:
        a, least = self.automaton, self.params.min_match
        open_: dict[tuple[int, int], int] = {}
        for at, (s, n) in enumerate(a.statistics(tokens), first):
            for k, size in a.phrases[s]:
                if size <= n:
                    places.append(at + 1 - size)
                    base.add(self.params.phrases[k][0])
            now = {(k, end): min(n, most) for k, end, most in a.reach[s] if most >= least} if n >= least else {}
            for (k, end), size in open_.items():
                if (k, end + 1) not in now:
                    matches.setdefault(k, []).append((at, end, size))
            open_ = now
        for (k, end), size in open_.items():
            matches.setdefault(k, []).append((first + len(tokens), end, size))

    def _chain(self, matches):
        """By template: the largest share that a chain of its matches covers; and the spans of the best chains.

        ``matches`` has (end in the text, end in the template, tokens) by template.  Matches
        of a chain rise in both, at most ``max_gap`` words apart; where two overlap, only what
        the later adds counts.
        """
        cover, spans = {}, []
        for k, found in sorted(matches.items()):
            found.sort()
            chains: list[tuple[int, int]] = []  # covered, start in the text
            low = 0
            longest = max(n for _, _, n in found)
            for end, at, n in found:
                while found[low][0] < end - longest - self.params.max_gap:
                    low += 1
                best = (n, n - end)
                for j in range(low, len(chains)):
                    before, at_before, _ = found[j]
                    new = min(n, at - at_before, end - before)
                    if new > 0 and end - n - before <= self.params.max_gap:
                        best = max(best, (chains[j][0] + new, -chains[j][1]))
                chains.append((best[0], -best[1]))
            most = max(range(len(found)), key=lambda j: (chains[j][0], -found[j][0]))
            cover[k] = chains[most][0] / self.sizes[k]
            spans.append((k, chains[most][1], found[most][0]))
        return cover, spans


def scan_licenses(docs: DataFrame, params: Scan = Scan()) -> DataFrame:
    """One row per document: word and phrase counts, labels, score, and covered template spans."""
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())])
    schema = pa.schema([
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span)),
    ])

    def run(batches):
        scanner = Scanner(params)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                n, places, base, labels, score, spans = scanner.scan(t.as_py())
                found = [{"label": params.templates[k][0], "first_word": a, "end_word": b, "cover": c} for k, a, b, c in spans]
                rows.append({
                    "n_words": n, "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
                    "base_labels": ",".join(base), "labels": ",".join(labels), "score": score, "spans": found,
                })
            out = pa.Table.from_pylist(rows, schema=schema).combine_chunks()
            yield from out.add_column(0, pa.field("doc_id", batch.column(0).type), batch.column(0)).to_batches()

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,end_word:bigint,cover:double>>")
