"""License scans (11): an exact set-similarity join of text blocks with license templates, by containment.

scanned(docs) returns one row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, found (the labels, blocks and
containments of the join), labels, score. links(docs) returns one row per text block and template that meet the threshold.

A document's blocks: for a template of n words let L be the least power of two of n or more; blocks of 2 L words begin at
every L-th word. So any stretch of L words lies in a block whole. A block meets a template if it has THRESHOLD percent or more of the
template's distinct words. The join is exact:

1. All words of all documents that occur in a template are counted, in the JVM. That count orders words globally, the rarest
   first (ties by the word); the words that no template has are in no intersection and stay out of the blocks' sets.
2. Of a template with r words, k = ceil(r * THRESHOLD / 100) must be in the block, so one of its first r - k + 1 words is: its prefix. The
   prefixes make an inverted index, word -> (template, position).
3. Only blocks that hold a word of a prefix are looked at. Such a block with s words goes on with a template if s >= k (length),
   if the first word they share is among the block's first s - k + 1 (prefix), and if as many words as k can still follow in both from
   there (position). What is left is verified on the full sets.

Templates are broadcast, in groups of TEMPLATE_WORDS words: links() makes one pass for each group; scanned() takes one group and says
so where there are more. Documents are read where they lie; nothing is shuffled but the counts, a row a template word and task.

Base labels are phrases whose words stand consecutively, counted at every place.

Cases. Null, empty or word-less text: n_words 0, no labels, null places, score 0. Null ids, ids that clash, repeated rows: a row each.
Ties: templates of one label give it once; score is the best containment, 1 with a base label. A template without words is
left out. Very long texts: one task, four bytes a word. Empty tables of documents or templates: no rows, or base labels alone. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import over_batches

#: Words: runs of what is no ASCII character but a letter or digit; on lower-cased UTF-8.
WORD, WORD_PATTERN = re.compile(rb"[0-9a-z\x80-\xff]+"), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 80
#: Words of templates that are broadcast at once.
TEMPLATE_WORDS = 500_000
#: Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Labels and notices of common public licenses.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
FOUND = "array<struct<label: string, first_word: bigint, last_word: bigint, shared: int, words: int>>"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def least_shared(words: int, percent: int) -> int:
    return -(-words * percent // 100)


def scale(words: int) -> int:
    """The least power of two of words or more."""
    return 1 << max(0, words - 1).bit_length()


class Index:
    """Templates by global word order. order: word -> rank, the rarest 0; postings: rank -> (template, position in its order) of prefixes."""

    def __init__(self, templates: Sequence[tuple[str, str]], counts: dict[str, int], percent: int):
        known = [(label, w) for label, text in templates if (w := words_of(text))]
        self.labels = [label for label, _ in known]
        by_count = sorted({x for _, w in known for x in w}, key=lambda x: (counts.get(x.decode("utf-8", "replace"), 0), x))
        self.order = {w: k for k, w in enumerate(by_count)}
        self.sets = [np.array(sorted({self.order[x] for x in w}), np.int32) for _, w in known]
        self.scales = [scale(len(w)) for _, w in known]
        self.needs = [least_shared(len(s), percent) for s in self.sets]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.sets):
            for i, c in enumerate(s[: len(s) - self.needs[t] + 1].tolist()):
                self.postings.setdefault(c, []).append((t, i))
        self.in_prefix = np.zeros(len(self.order) + 1, bool)
        self.in_prefix[list(self.postings)] = True
        #: Scales of the templates whose prefixes hold a word.
        self.scales_of = {c: sorted({self.scales[t] for t, _ in p}) for c, p in self.postings.items()}

    def blocks(self, ranks: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(L, first word, set) of the blocks that hold a word of a prefix."""
        hit = np.flatnonzero(self.in_prefix[ranks]).tolist()
        for size, k in sorted({(size, k) for p in hit for size in self.scales_of[int(ranks[p])] for k in (p // size, p // size - 1) if k >= 0}):
            mine = ranks[k * size : (k + 2) * size]
            yield size, k * size, np.unique(mine[mine < len(self.order)])

    def candidates(self, size: int, block: np.ndarray) -> Iterator[int]:
        """Templates of one scale that the filters leave for a block's set (in the global order)."""
        s, seen = len(block), set()
        for j, c in enumerate(block.tolist()):
            for t, i in self.postings.get(c, ()):
                if self.scales[t] == size and t not in seen:
                    seen.add(t)  # the first word they share, if they share enough
                    need = self.needs[t]
                    if s >= need and j <= s - need and min(len(self.sets[t]) - i, s - j) >= need:
                        yield t

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, int, int]]:
        """(label, first and last word of the block, words shared, words of the template) of all blocks that meet the threshold."""
        known = self.order.get
        ranks = np.fromiter((known(w, len(self.order)) for w in words), np.int32, len(words))
        out = []
        for size, at, block in self.blocks(ranks):
            for t in self.candidates(size, block):
                shared = len(np.intersect1d(block, self.sets[t], assume_unique=True))
                if shared >= self.needs[t]:
                    out.append((self.labels[t], at, min(at + 2 * size, len(words)) - 1, shared, len(self.sets[t])))
        return out


def counts(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> dict[str, int]:
    """How often each word of the templates occurs in all texts(text); a row a template word reaches the driver."""
    vocabulary = sorted({w.decode("utf-8", "replace") for _, text in templates for w in words_of(text)})
    if not vocabulary:
        return {}
    spark = docs.sparkSession
    words = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD_PATTERN), F.lit(0))).alias("word")
    asked = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    return dict(map(tuple, docs.select(words).join(asked, "word", "left_semi").groupBy("word").count().collect()))


def groups(templates: Sequence[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Templates in groups of TEMPLATE_WORDS words or less (or one template)."""
    out, size = [[]], 0
    for label, text in templates:
        n = len(words_of(text))
        if out[-1] and size + n > TEMPLATE_WORDS:
            out.append([])
            size = 0
        out[-1].append((label, text))
        size += n
    return out


def phrase_places(words: list[bytes], base: Sequence[tuple[str, str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand."""
    out = []
    for phrase, label in base:
        first, *rest = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(first, at + 1)
            except ValueError:
                break
            if words[at + 1 : at + 1 + len(rest)] == rest:
                out.append((at, label))
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _joined(docs: DataFrame, templates: Sequence[tuple[str, str]], base: Sequence[tuple[str, str]], percent: int) -> DataFrame:
    """doc_id, n_words, places and labels of base phrases, found, for one group of templates."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, counts(docs, templates), percent))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("shared", pa.int32()), ("words", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("base", pa.list_(pa.string())), ("found", found_type)])
    names = [f.name for f in found_type.value_type]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0), b.column(1)):
                words = words_of(text.as_py())
                at = phrase_places(words, base)
                rows.append((doc.as_py(), len(words), [p for p, _ in at], [x for _, x in at], [dict(zip(names, m)) for m in index.matches(words)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return over_batches(docs, work, f"doc_id long, n_words long, places array<long>, base array<string>, found {FOUND}")


def links(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """doc_id, label, first_word, last_word, shared, words, containment: every text block that meets a template."""
    texts, out = _texts(docs, id_col, text_col), None
    for group in groups(templates):
        rows = _joined(texts, group, (), percent).select("doc_id", F.inline("found"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("containment", F.col("shared") / F.col("words"))


def scanned(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found per row of docs."""
    if len(groups(templates)) > 1:
        raise ValueError(f"more than {TEMPLATE_WORDS} words of templates: take links(), which passes over the documents once for each group")
    rows = _joined(_texts(docs, id_col, text_col), templates, base, percent)
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.array_max(F.transform("found", lambda m: m["shared"] / m["words"]))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        text(F.col("base")).alias("base_labels"), text(F.concat("base", F.col("found.label"))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"), "found",
    )
