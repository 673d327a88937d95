"""License notices in texts: an exact set-similarity join of text blocks with notice templates.

A block is a stretch of a text's words, across line ends, that is at most a fifth longer than the template (``SLACK``): a
notice may be wrapped, and its words may not be gathered from far apart.  A template matches a block if at least
``threshold`` of the template's distinct words are in the block.  Every such block of every template is found; of blocks of
one template that overlap, the best is given for all.  Blocks of different templates may overlap.

Words are put in the order of how many lines of all documents hold them, rarest first.  A block that reaches the threshold
must hold one of a template's first ``|T| - ceil(threshold * |T|) + 1`` words in that order, so only the words around such a word are
looked at (prefix filter); there must be enough of the template's words among them (length filter), and enough of the template must
be left from the rarest of these on (positional filter).  The filters only drop what cannot reach the threshold; in what is left
the words of every block are counted, by a window that moves from one word of the template to the next.

Labelling is a step of its own: a block is ``named`` if it holds the template's ``TELLING`` words and none of its ``BARRED`` ones,
by which notices that share most of their words differ.

The templates are a small fixed list, so they and the counts of their words go to every task; documents are never
shuffled.  Null texts are empty, and an empty text has no words, blocks or labels.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from muster.llm.common import text_batches, texts

#: Words that must stand side by side, and the label of each phrase.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: One notice each, as it stands in published works.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files",
    "gpl-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License",
    "gpl-version": "the GNU General Public License, version 3",
    "lgpl-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "all-rights": "Copyright. All rights reserved. No part of this work may be reproduced without permission",
}

#: Letters to lower case; ASCII that is neither a letter nor a digit becomes a blank, line ends stay.
BLANKED = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or c == 10 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

#: Words of a template without which a block is another licence's notice.
TELLING = {
    "apache-notice": {"apache"}, "mit-notice": {"mit"}, "gpl-notice": {"gnu", "general"}, "gpl-version": {"gnu", "general"},
    "lgpl-notice": {"lesser"}, "mpl-notice": {"mozilla"}, "cc-by-nc": {"cc", "by", "nc"}, "cc-by-sa": {"cc", "by", "sa"},
    "cc-by": {"creative", "commons", "attribution"}, "cc0": {"waived"}, "all-rights": {"rights", "reserved"},
}

#: Words that make a block another licence's notice.
BARRED = {
    "gpl-notice": {"lesser", "affero"}, "gpl-version": {"lesser", "affero"},
    "cc-by": {"noncommercial", "sharealike", "noderivatives", "noderivs"},
}

#: How much longer than its template a block may be.
SLACK = 0.2

SCHEMA = (
    "doc_id bigint, n_words bigint, places array<struct<word:bigint,label:string>>, "
    "blocks array<struct<block:bigint,word:bigint,label:string,containment:double,named:boolean>>"
)


def blocks_of(text: bytes) -> list[list[bytes]]:
    return [line.split() for line in text.translate(BLANKED).split(b"\n")]


def template_sets(templates: dict[str, str]) -> dict[str, frozenset[bytes]]:
    sets = {label: frozenset(w for line in blocks_of(text.encode()) for w in line) for label, text in templates.items()}
    return {label: words for label, words in sets.items() if words}


def word_counts(df: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """In how many lines of all documents each template word stands; as many rows as there are template words."""
    known = frozenset().union(*template_sets(templates).values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for _, values in text_batches(batches):
            for text in values:
                for line in blocks_of(text):
                    seen.update(known.intersection(line))
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in seen], "n": pa.array(seen.values(), pa.int64())})

    rows = df.mapInArrow(count, "word string, n bigint").groupBy("word").sum("n").collect()
    return {r[0].encode(): r[1] for r in rows}


class Matcher:
    """Prefix index over the templates in global word order."""

    def __init__(
        self, templates: dict[str, str], counts: dict[bytes, int], threshold: float,
        telling: dict[str, set[str]] | None = None, barred: dict[str, set[str]] | None = None,
    ):
        self.telling, self.barred = (
            {label: {w.encode() for w in words} for label, words in (given or {}).items()} for given in (telling, barred)
        )
        self.rank = {}
        sets = template_sets(templates)
        for at, word in enumerate(sorted(frozenset().union(*sets.values()), key=lambda w: (counts.get(w, 0), w))):
            self.rank[word] = at
        self.needed, self.size, self.words = {}, {}, sets
        self.width = {
            label: math.floor((1 + SLACK) * sum(map(len, blocks_of(templates[label].encode())))) for label in sets
        }
        self.index: dict[bytes, list[tuple[str, int]]] = {}
        self.place: dict[str, dict[bytes, int]] = {}
        for label, words in sets.items():
            ordered = sorted(words, key=self.rank.__getitem__)
            need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
            self.needed[label], self.size[label] = need, len(ordered)
            self.place[label] = {word: at for at, word in enumerate(ordered)}
            for at, word in enumerate(ordered[: len(ordered) - need + 1]):
                self.index.setdefault(word, []).append((label, at))
        self.prefixes = frozenset(self.index)

    def regions(self, words: list[bytes]) -> Iterator[tuple[str, list[tuple[int, bytes]]]]:
        """(label, its words with their places) wherever a block of a template may lie; the three filters."""
        near: dict[str, list[list[int]]] = {}
        for at, word in enumerate(words):
            for label, _ in self.index.get(word, ()):
                spans = near.setdefault(label, [])
                if spans and at - self.width[label] < spans[-1][1]:
                    spans[-1][1] = at + self.width[label]
                else:
                    spans.append([at - self.width[label] + 1, at + self.width[label]])
        for label, spans in near.items():
            known, need, size = self.words[label], self.needed[label], self.size[label]
            for start, stop in spans:
                held = [(at, words[at]) for at in range(max(start, 0), min(stop, len(words))) if words[at] in known]
                distinct = {word for _, word in held}
                rarest = min(self.place[label][word] for word in distinct)
                if len(distinct) >= need and size - rarest >= need:
                    yield label, held

    def windows(self, held: list[tuple[int, bytes]], label: str) -> Iterator[tuple[int, int, int]]:
        """(start, stop, distinct words) of the block that begins at each word of the template, if it reaches the threshold."""
        count: Counter[bytes] = Counter()
        after = 0
        for start, (at, word) in enumerate(held):
            while after < len(held) and held[after][0] < at + self.width[label]:
                count[held[after][1]] += 1
                after += 1
            if len(count) >= self.needed[label]:
                stop, seen = after, set()
                for stop, (_, other) in enumerate(held[start:after], start):  # noqa: B007
                    seen.add(other)
                    if len(seen) == len(count):
                        break
                yield at, held[stop][0] + 1, len(count)
            count[word] -= 1
            if not count[word]:
                del count[word]

    def find(self, words: list[bytes]) -> list[tuple[int, str, float, bool]]:
        """(place of the first word, label, containment, named) of the blocks of a text, in the order of their places."""
        if self.prefixes.isdisjoint(words):
            return []
        found = []
        for label, held in self.regions(words):
            for start, stop, common in self.apart(held, label):
                block = words[start:stop]
                named = self.telling.get(label, set()).issubset(block) and self.barred.get(label, set()).isdisjoint(block)
                found.append((start, label, common / self.size[label], named))
        return sorted(found)

    def apart(self, held: list[tuple[int, bytes]], label: str) -> Iterator[tuple[int, int, int]]:
        """Blocks that do not overlap, the best first, and again between them until no block is left that overlaps none."""
        gaps = [held]
        while gaps:
            gap = gaps.pop()
            taken: list[tuple[int, int]] = []
            for common, length, start in sorted((-c, b - a, a) for a, b, c in self.windows(gap, label)):
                at = bisect.bisect(taken, (start, start))
                if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < start + length):
                    continue
                taken.insert(at, (start, start + length))
                yield start, start + length, -common
            for (_, after), (before, _) in zip([(0, gap[0][0]), *taken], [*taken, (gap[-1][0] + 1, 0)], strict=True) if taken else ():
                rest = gap[bisect.bisect_left(gap, (after,)) : bisect.bisect_left(gap, (before,))]
                if len(rest) >= self.needed[label]:
                    gaps.append(rest)


def scan_licenses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
    threshold: float = 0.8, phrases: dict[str, str] | None = None,
) -> DataFrame:
    """A row per document: its words, every place of a phrase, and every block that reaches a template.

    ``places`` holds the word position and label of each phrase, ``blocks`` the line and the position of the block's
    first word, the template, its containment, and whether the block is named after it.
    """
    telling, barred = (TELLING, BARRED) if templates is None else ({}, {})
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    rows = texts(df, id_col, text_col)
    counts = word_counts(rows, templates) if templates else {}
    wanted = [(b" %s " % " ".join(p.split()).encode(), label) for p, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, counts, threshold, telling, barred) if templates else None
        for ids, values in text_batches(batches):
            n_words, places, blocks = [], [], []
            for text in values:
                lines = blocks_of(text)
                ends = list(itertools.accumulate(map(len, lines)))
                hits = [
                    {"block": bisect.bisect_right(ends, at), "word": at, "label": label, "containment": share, "named": named}
                    for at, label, share, named in (matcher.find([w for line in lines for w in line]) if matcher else ())
                ]
                joined = b" %s " % b" ".join([b" ".join(x) for x in lines if x])
                found = []
                for phrase, label in wanted:
                    found += [
                        {"word": joined.count(b" ", 0, m.start()), "label": label}
                        for m in re.finditer(b"(?=" + re.escape(phrase) + b")", joined)
                    ] if phrase in joined else []
                n_words.append(ends[-1])
                places.append(found)
                blocks.append(hits)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(n_words, pa.int64()),
                    pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                    pa.array(blocks, pa.list_(pa.struct([
                        ("block", pa.int64()), ("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64()),
                        ("named", pa.bool_()),
                    ]))),
                ],
                names=["doc_id", "n_words", "places", "blocks"],
            )

    return rows.mapInArrow(scan, SCHEMA)
