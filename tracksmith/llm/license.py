"""Operator 8: licence scan with a positional index of rare tokens.

Templates (licence passages, and the three base phrases) are indexed by word: postings (template, position). A word's
IDF is the logarithm of templates over templates that have it. A template's anchors are its highest-IDF words, as many as
it takes for the other words to weigh less than MATCH of the template: whatever matches has an anchor, so none is missed.
Of a text, only anchors are looked up; each occurrence votes for a place (template, own position minus the posting's
position). A place is verified: a phrase must stand word for word; of a passage, the heaviest common subsequence with the
words from SLACK before the place to SLACK after the template's end there must have MATCH of its IDF weight (so that words
may be put in, left out or replaced), and its mandatory key phrases must stand in these words.

A base phrase's rarest word is its anchor, so no place is missed. Texts are judged where they are read; the index
is bounded by the templates.

Defined results: null and empty texts have no words, no labels and score 0; first_word and last_word are null without a
base place; a passage that is found at several places counts by its best share; repeated rows give repeated rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm import common

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Passages of licences and notices: label, text, mandatory key phrases.
PASSAGES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["substantial portions of the software"]),
    ("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", ["without warranty of any kind"]),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("apache-2.0-basis", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["as is basis", "conditions of any kind"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ["in the hope that it will be useful"]),
    ("gpl-mention", "licensed under the gnu general public license", ["gnu general public license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-endorsement", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ["endorse or promote products"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution license", ["creative commons attribution"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", ["has waived all copyright"]),
    ("boost", "boost software license version 1 0", ["boost software license"]),
    ("spdx", "spdx license identifier", ["spdx license identifier"]),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", ["authors be held liable"]),
    ("liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", ["copyright holders be liable"]),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ["sil open font license"]),
    ("cddl", "common development and distribution license", ["common development and distribution license"]),
    ("artistic-2.0", "the artistic license 2 0", ["artistic license 2 0"]),
]
MATCH, SLACK = 0.7, 4
#: Word bytes stay (A-Z lower-cased), any other becomes a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Index:
    def __init__(self, base: dict[str, str] | None = None, passages: list | None = None) -> None:
        base, passages = BASE if base is None else base, PASSAGES if passages is None else passages
        # label, words, mandatory phrases as (place or None, words), exact
        self.templates = [(label, tuple(words_of(t)), (), True) for t, label in base.items()]
        self.templates += [(label, tuple(words_of(t)), tuple(tuple(words_of(k)) for k in keys), False) for label, t, keys in passages]
        seen = Counter(w for _, words, _, _ in self.templates for w in set(words))
        self.idf = {w: math.log(1 + len(self.templates) / n) for w, n in seen.items()}
        self.weight = [sum(self.idf[w] for w in words) for _, words, _, _ in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words, _, exact) in enumerate(self.templates):
            rarest = sorted(set(words), key=lambda w: (-self.idf[w], w))
            if exact:
                rarest = rarest[:1]
            else:
                left = self.weight[k]
                for n, w in enumerate(rarest):
                    if left < MATCH * self.weight[k] - 1e-9:
                        rarest = rarest[:n]
                        break
                    left -= self.idf[w] * words.count(w)
            for place, w in enumerate(words):
                if w in rarest:
                    self.postings[w].append((k, place))
        self.anchors = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, str, float]]]:
        """Base places (start, label) and passages (start, label, matched share), both sorted."""
        if self.anchors.isdisjoint(words):
            return [], []
        starts: dict[int, set[int]] = defaultdict(set)
        for at, w in enumerate(words):
            if w in self.anchors:
                for k, place in self.postings[w]:
                    starts[k].add(at - place)
        places, passages = [], []
        for k, found in starts.items():
            label, template, keys, exact = self.templates[k]
            if exact:
                places += [(start, label) for start in found if start >= 0 and tuple(words[start : start + len(template)]) == template]
                continue
            windows = sorted({(max(0, start - SLACK), start + len(template) + SLACK) for start in found})
            weights = self._weights(words, k, windows)
            for (low, high), most in zip(windows, weights, strict=True):
                if most < MATCH * self.weight[k] - 1e-9 or not all(self._holds(words, low, min(high, len(words)), key) for key in keys):
                    continue
                share = self._aligned(template, words[low:high]) / self.weight[k]
                if share >= MATCH - 1e-12:
                    passages.append((low, label, share))
        return sorted(places), sorted(passages)

    def _weights(self, words: list[bytes], k: int, windows: list[tuple[int, int]]) -> list[float]:
        """For each window the IDF weight of its words that are words of the template: no alignment has more."""
        template = set(self.templates[k][1])
        if len(windows) < 4:
            return [sum(self.idf[w] for w in words[low:high] if w in template) for low, high in windows]
        upto = np.concatenate(([0.0], np.cumsum([self.idf[w] if w in template else 0.0 for w in words])))
        return [float(upto[min(high, len(words))] - upto[low]) + 1e-6 for low, high in windows]

    def _aligned(self, template: tuple[bytes, ...], words: list[bytes]) -> float:
        """IDF weight of the heaviest common subsequence."""
        row = np.zeros(len(words) + 1)
        places: dict[bytes, list[int]] = defaultdict(list)
        for n, w in enumerate(words, 1):
            places[w].append(n)
        for w in template:
            if w in places:
                at = np.array(places[w])
                new = row.copy()
                new[at] = np.maximum(row[at], row[at - 1] + self.idf[w])
                row = np.maximum.accumulate(new)
        return float(row[-1])

    @staticmethod
    def _holds(words: list[bytes], low: int, high: int, key: tuple[bytes, ...]) -> bool:
        return any(tuple(words[i : i + len(key)]) == key for i in range(low, high - len(key) + 1))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in SCHEMA.split(", ")])


def findings(index: Index, text: str | None) -> tuple:
    words = words_of(text)
    places, passages = index.scan(words)
    base = {label for _, label in places}
    both = base | {label for _, label, _ in passages}
    score = max([1.0 if places else 0.0, *(share for _, _, share in passages)])
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(both)), min(1.0, score)


def scan(docs: DataFrame, base: dict[str, str] | None = None, passages: list | None = None) -> DataFrame:
    """(the columns of SCHEMA) of every row of docs."""
    index = Index(base, passages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, "doc_id", "text"):
            yield common.record_batch(_ARROW, [(doc_id, *findings(index, text)) for doc_id, text in part])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents", "doc_id", "text"))
