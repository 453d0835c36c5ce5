"""Operator 10: licence scans with a positional rare-token index.

Templates are short statements by which texts declare a licence. The index holds, for each template,
the ``PROBES`` words of its mandatory phrase of the highest inverse document frequency in the corpus
at hand, with their places in the template. A file's words are looked up; each hit votes for (template, shift), shift
being where the template would begin. Where all of a template's probes agree on a shift,
the template is laid over the file there; it counts if its mandatory phrase stands in that very
place and enough of its other words do too. Document frequencies come from a pass over all documents
and number no more than the templates' words.

Beside the templates there is a base rule, plain phrases that stand anywhere, which the method may
only add to.

Defined results: a null text counts as empty: no words, no labels, score 0. Ties in document
frequency go by the word. Repeated rows each give a row. Extra columns are dropped by ``scan``
except those asked for.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices

#: The base rule's phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, statement, mandatory phrase.
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0-1.0", "released under the creative commons zero v1 0 universal public domain dedication", "creative commons zero"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)

#: Words of the index per template, and the share of a template's words that must stand in place.
PROBES, COVER = 4, 0.6

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _hash_words(phrase: str) -> np.ndarray:
    data = np.frombuffer(phrase.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), _IS_WORD).hashes()


def vocabulary(templates: tuple = TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def _file_words(texts: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    for at, to, data, bounds in slices(texts):
        words = Words(_LOWER[data], bounds, _IS_WORD)
        yield at, to, words, words.hashes()


def _count_batches(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    keys = np.array([_hash_words(w)[0] for w in words])
    order = np.argsort(keys)
    keys = keys[order]
    total = np.zeros(len(words), np.int64)
    for batch in batches:
        for at, to, found, hashes in _file_words(batch.column("text")):
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == hashes)
            doc = np.searchsorted(found.first, hit, "right") - 1
            pairs = np.unique(doc * len(words) + place[hit])
            total += np.bincount(order[pairs % len(words)], minlength=len(words))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(total)], names=["word", "docs"])


def document_frequencies(docs: DataFrame, templates: tuple = TEMPLATES) -> dict[str, int]:
    """In how many documents each word of the templates stands; as many entries as the templates have words."""
    words = vocabulary(templates)
    counts = docs.select("text").mapInArrow(partial(_count_batches, words=words), "word bigint, docs bigint")
    rows = counts.groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    return {w: 0 for w in words} | {words[r["word"]]: r["docs"] for r in rows}


class Index:
    """The positional rare-token index of templates."""

    def __init__(self, frequency: dict[str, int], templates: tuple = TEMPLATES):
        self.labels = [label for label, _, _ in templates]
        self.words = [_hash_words(text) for _, text, _ in templates]
        self.texts = [text.split() for _, text, _ in templates]
        self.needs = []
        postings = defaultdict(list)
        self.probes = []
        for t, (_, text, phrase) in enumerate(templates):
            words = text.split()
            need = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
            self.needs.append((at, at + len(need)))
            rare = sorted(set(need), key=lambda w: (frequency.get(w, 0), w))[:PROBES]
            places = [i for i in range(at, at + len(need)) if words[i] in rare]
            self.probes.append(len(places))
            for i in places:
                postings[words[i]].append((t, i))
        keys = np.array([_hash_words(w)[0] for w in postings])
        order = np.argsort(keys)
        lists = [list(postings.values())[i] for i in order]
        self.keys = keys[order]
        self.length = np.array([len(x) for x in lists])
        self.first = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.template = np.array([t for x in lists for t, _ in x])
        self.place = np.array([i for x in lists for _, i in x])

    def candidates(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, template, index of the word where it would begin) with enough votes."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == hashes)
        if not len(hit):
            return
        length = self.length[at[hit]]
        which = np.repeat(self.first[at[hit]], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        doc = np.repeat(np.searchsorted(words.first, hit, "right") - 1, length)
        template = self.template[which]
        shift = np.repeat(hit, length) - self.place[which]
        votes, counts = np.unique(np.stack([doc, template, shift], axis=1), axis=0, return_counts=True)
        for (d, t, s), n in zip(votes.tolist(), counts.tolist(), strict=True):
            if n == self.probes[t]:
                yield d, t, s

    def cover(self, d: int, t: int, s: int, words: Words, hashes: np.ndarray) -> float:
        """Share of the template's words that stand in place; 0 if the mandatory phrase isn't there."""
        own = self.words[t]
        places = s + np.arange(len(own))
        inside = (places >= words.first[d]) & (places < words.first[d + 1])
        same = inside.copy()
        same[inside] = hashes[places[inside]] == own[inside]
        a, b = self.needs[t]
        if not same[a:b].all() or any(_word(words, places[i]) != self.texts[t][i] for i in range(a, b)):
            return 0.0
        return float(same.mean())


def _word(words: Words, i: int) -> str:
    return words.data[words.start[i] : words.end[i]].tobytes().decode()


def _scan_batches(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    phrases = [(p.split(), _hash_words(p), label) for p, label in BASE.items()]
    for batch in batches:
        n = batch.num_rows
        n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first, last = [None] * n, [None] * n
        base, all_labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
        for at, to, words, hashes in _file_words(batch.column("text")):
            n_words[at:to] = words.counts
            for texts, keys, label in phrases:
                m = len(hashes) - len(keys) + 1
                if m <= 0:
                    continue
                hit = hashes[:m] == keys[0]
                for j in range(1, len(keys)):
                    hit &= hashes[j : m + j] == keys[j]
                for i in np.flatnonzero(hit).tolist():
                    d = int(np.searchsorted(words.first, i, "right")) - 1
                    if i + len(keys) > words.first[d + 1] or any(_word(words, i + j) != w for j, w in enumerate(texts)):
                        continue
                    place = int(i - words.first[d])
                    row = at + d
                    n_base[row] += 1
                    first[row] = place if first[row] is None else min(first[row], place)
                    last[row] = place if last[row] is None else max(last[row], place)
                    base[row].add(label)
                    score[row] = 1.0
            for d, t, s in index.candidates(words, hashes):
                cover = index.cover(d, t, s, words, hashes)
                if cover >= COVER:
                    all_labels[at + d].add(index.labels[t])
                    score[at + d] = max(score[at + d], cover)
        keep = [c for c in batch.schema.names if c != "text"]
        columns = [
            *(batch.column(c) for c in keep), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
            pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x | y)) for x, y in zip(base, all_labels, strict=True)], pa.string()),
            pa.array(score),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, *SCANNED])


SCANNED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), templates: tuple = TEMPLATES) -> DataFrame:
    """The columns ``keep`` and SCANNED of every row of docs.

    score: the best share of a template in place, 1 where a base phrase stands, 0 without labels.
    """
    index = Index(document_frequencies(docs, templates), templates)
    kept = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep]
    types = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select(*keep, "text").mapInArrow(partial(_scan_batches, index=index), ", ".join([*kept, types]))
