"""Licence scans by a positional index of rare tokens.

Document frequencies of the licence vocabulary are counted over all documents.
For each template whose key phrases may stand in it, a text looks up the
template's words of highest inverse document frequency, as many as no match can
lack; each place of such a word and its postings vote for the offset at which
the template would start, so postings meet by relative position. At the
best offsets the template's mandatory key phrases are verified and the share
of its words that stand in place is the score. Base phrases are searched for
in every text apart from that, and their labels stay.

Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII
characters. Null texts count as empty. Repeated rows get equal results; equal
frequencies are ordered by word. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, raw_texts, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, template wording, key phrases of which each must stand in the text.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "except in compliance with the license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose with or without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work cc0", ["waived all copyright and related"]),
]
#: Share of a template that must stand in place.
MIN_SHARE = 0.6


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Index:
    """Postings (word -> template, position) and key phrases of the templates."""

    def __init__(self, templates: list = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.templates = [(label, text.encode().split(), [k.encode().split() for k in keys]) for label, text, keys in templates]
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            for q, w in enumerate(words):
                self.postings[w].append((t, q))
        self.vocabulary = frozenset(self.postings)

    def base(self, words: list[bytes], present: set[bytes]) -> list[tuple[int, str]]:
        """(start, label) of each place where a phrase's words stand consecutively."""
        out = []
        for phrase, label in self.phrases:
            if present.issuperset(phrase):
                n = len(phrase)
                out += [(i, label) for i in _places(words, phrase[0]) if words[i : i + n] == phrase]
        return out

    def scan(self, words: list[bytes], present: set[bytes], idf: dict[bytes, float]) -> list[tuple[str, int, float]]:
        """(label, start, share) of the templates found."""
        votes: Counter = Counter()
        places: dict[bytes, list[int]] = {}
        for t, (_, wording, keys) in enumerate(self.templates):
            if not all(present.issuperset(k) for k in keys):
                continue
            # words that the text lacks cost nothing; of more places than may miss, two at least vote for a true offset
            left = _most_misses(len(wording)) + 2
            for w in sorted(set(wording), key=lambda w: (w in present, -idf.get(w, 0.0), w)):
                own = [q for u, q in self.postings[w] if u == t]
                if w in present:
                    if w not in places:
                        places[w] = _places(words, w)
                    votes.update((t, p - q) for p in places[w] for q in own)
                left -= len(own)
                if left <= 0:
                    break
        found: dict[str, tuple[float, int]] = {}
        for (t, start), n in votes.items():
            label, wording, keys = self.templates[t]
            if n < 2:
                continue
            share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(wording)) / len(wording)
            here = words[max(0, start - 3) : start + len(wording) + 3]
            if share >= MIN_SHARE and all(any(here[i : i + len(k)] == k for i in range(len(here))) for k in keys):
                found[label] = max(found.get(label, (0.0, 0)), (share, -start))
        return [(label, -at, share) for label, (share, at) in sorted(found.items())]


def _most_misses(n: int) -> int:
    """How many of n words may stand out of place."""
    return max(m for m in range(n + 1) if (n - m) / n >= MIN_SHARE)


def _places(words: list[bytes], word: bytes) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = words.index(word, at + 1)
            out.append(at)
    except ValueError:
        return out


def inverse_frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> dict[bytes, float]:
    """log((n + 1) / (texts with the word + 1)) of each licence word, over all documents; each batch sends its counts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        texts = raw_texts(batch, text_col)
        for text in texts:
            counts.update(index.vocabulary.intersection(words_of(text)))
        counts[b""] = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([k.decode() for k in counts]), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = map_texts(docs.select(text_col), run, "word string, n long", text_col).groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r.word.encode(): r.n for r in rows}
    n = got.pop(b"", 0)
    return {w: math.log((n + 1) / (got.get(w, 0) + 1)) for w in index.vocabulary}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """One row per document: base places and labels, all labels, score, and `found` (label:start:share of templates)."""
    index = index or Index()
    idf = inverse_frequencies(docs, index, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for text in raw_texts(batch, text_col):
            words = words_of(text)
            present = set(words)
            base = index.base(words, present)
            found = index.scan(words, present, idf)
            starts = [s for s, _ in base]
            own = {label for _, label in base}
            score = 1.0 if base else max((s for _, _, s in found), default=0.0)
            out.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {f[0] for f in found})), score, ",".join(f"{a}:{b}:{c:.3f}" for a, b, c in found)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *columns], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found string"
    return map_texts(docs.select(id_col, text_col), run, schema, text_col)


def op6(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
