"""License scan by a positional index of rare tokens.

Templates are short licence passages. Their words get an inverse document frequency from all documents;
the rarest words of each template make up the index (word -> template, place). A file's rare licence
words are looked up, every hit votes for (template, file place minus template place), and an alignment
with enough votes is read word by word: it counts when the matching words carry enough of the template's
weight and the template's mandatory phrases stand at their places. Besides, all places of the base phrases count.

Defined results: a null text is an empty one; a text without words has no place and score 0; equal rows give
equal rows; very long texts are read whole; an empty table gives no rows.
"""

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import fold_table

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Templates (label, passage, mandatory phrases). The passages are sentences of public licences.
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free of charge"]),
    ("apache-2.0", "Licensed under the Apache License Version 2.0", ["apache license version 2 0"]),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License", ["gnu general public license"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License version 3", ["general public license version 3"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the GNU Affero General Public License", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0", ["mozilla public license"]),
    ("cc-by-nc-4.0", "Licensed under CC BY NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc0", "To the extent possible under law the author has waived all copyright and related rights", ["waived all copyright"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["released into the public domain"]),
]

# Rare words of a template in the index, and the share of a template's weight that has to match.
RARE_WORDS = 3
MATCH = 0.75

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: bytes, table: bytes) -> list[bytes]:
    """Lower-cased words of a whole text: digits, letters and everything beyond ASCII."""
    return text.translate(table).split()


class Templates:
    """The templates as words, weights and the index of their rare words."""

    def __init__(self, templates, base, df: dict[bytes, int], documents: int):
        table = fold_table()
        split = lambda s: words_of(s.encode(), table)
        self.base = [(split(phrase), label) for phrase, label in base.items()]
        self.idf = defaultdict(lambda: math.log(1 + documents))
        self.idf.update({w: math.log((1 + documents) / (1 + n)) + 1e-9 for w, n in df.items()})
        self.rows, self.index = [], defaultdict(list)
        for number, (label, passage, phrases) in enumerate(templates):
            words = split(passage)
            keys = [(self.find(words, split(p)), split(p)) for p in phrases]
            if any(not places for places, _ in keys):
                raise ValueError(f"a mandatory phrase is not part of its template: {label}")
            self.rows.append((label, words, [(places[0], phrase) for places, phrase in keys], sum(self.idf[w] for w in words)))
            rare = set(sorted(set(words), key=lambda w: (-self.idf[w], w))[:RARE_WORDS])
            for place, word in enumerate(words):
                if word in rare:
                    self.index[word].append((number, place))
        self.votes = [min(2, len({w for w in words if any(n == k for n, _ in self.index.get(w, ()))})) for k, (_, words, _, _) in enumerate(self.rows)]
        self.lookup = set(self.index) | {w for phrase, _ in self.base for w in phrase[-1:]}

    @staticmethod
    def find(words: list[bytes], phrase: list[bytes]) -> list[int]:
        n = len(phrase)
        return [i for i in range(len(words) - n + 1) if words[i : i + n] == phrase]

    def scan(self, words: list[bytes]) -> tuple:
        """(base places with labels, [(label, start, end, share)] of the verified templates)."""
        if self.lookup.isdisjoint(words):
            return [], []
        places, votes = [], Counter()
        for at, word in enumerate(words):
            if word not in self.lookup:
                continue
            for phrase, label in self.base:
                first = at - len(phrase) + 1
                if word == phrase[-1] and first >= 0 and words[first : at + 1] == phrase:
                    places.append((first, label))
            votes.update((number, at - place) for number, place in self.index.get(word, ()))
        found = []
        for (number, shift), n in votes.items():
            label, template, keys, weight = self.rows[number]
            if n < self.votes[number]:
                continue
            if any(shift + at < 0 or words[shift + at : shift + at + len(phrase)] != phrase for at, phrase in keys):
                continue
            same = sum(self.idf[w] for k, w in enumerate(template) if 0 <= shift + k < len(words) and words[shift + k] == w)
            if same >= MATCH * weight:
                found.append((label, max(shift, 0), min(shift + len(template), len(words)), min(1.0, same / weight)))
        return sorted(places), sorted(found, key=lambda x: (x[1], x[0]))


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the templates stands, and the number of documents; over all rows.

    Each task sends one row per template word; the vocabulary is bounded by the templates.
    """
    table = fold_table()
    vocabulary = {w for _, passage, _ in templates for w in words_of(passage.encode(), table)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                n += 1
                seen.update(vocabulary.intersection(words_of(text.as_py() or b"", table)))
        seen[b""] = n
        yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["word"]): r["n"] for r in rows}
    return df, df.pop(b"", 0)


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row per document: words, base places and labels, all labels, score.

    `score` is 1 where a base phrase stands, else the best share of a verified template's weight.
    """
    index = Templates(templates, base, *document_frequencies(docs, templates))
    index.idf = dict(index.idf) | {w: index.idf[w] for _, words, _, _ in index.rows for w in words}
    table = fold_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            out = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = words_of(text.as_py() or b"", table)
                places, found = index.scan(words)
                own = sorted({label for _, label in places})
                every = sorted({*own, *(label for label, *_ in found)})
                score = 1.0 if places else max((share for *_, share in found), default=0.0)
                row = (doc_id, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(own), ",".join(every), score)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
