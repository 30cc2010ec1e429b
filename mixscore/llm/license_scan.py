"""Find licence texts in documents, paragraph by paragraph.

A multinomial logistic regression on hashed word 1-grams and 2-grams gives
every paragraph (line) a probability for each licence family and for the class
unknown. It is trained on the phrases of the templates below, varied by rule,
and on a bounded sample of the corpus' own paragraphs as unknown ones. A
temperature fitted on held-back examples calibrates the probabilities. A
prediction counts only if it is confident and its template confirms it: the
words of one of the family's phrases have to stand in the paragraph, or the
paragraph has to be a piece of the template.

A paragraph is scored whole and, where that finds nothing, by overlapping windows
of its words, so prose around a statement doesn't hide it.

Paragraphs are read as bytes in numpy; each word costs two look-ups in a table
of weights, so whole documents are scanned where they lie and only findings
leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixscore.llm import bytetext
from mixscore.llm.common import column, hashed_sample, ship

# Phrases of well-known public licences, notices and identifiers, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain.",
        "Released into the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "all-rights-reserved": ("All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without permission."),
}

#: Paragraphs of the corpus that are learned as unknown, at most.
UNKNOWN_PARAGRAPHS = 4000

#: Hashed features of the classifier.
FEATURES = 1 << 14

#: Confidence that a prediction needs, and share of a phrase's (or a paragraph's) shingles for its confirmation.
CONFIDENT = 0.5
CONFIRMED = 0.8

#: Words in the windows of a longer paragraph, and the step from one to the next; phrases have up to 25 words.
WINDOWS = ((8, 1), (16, 3), (32, 7))

_SHINGLE = 2
_FOUND = "doc_id long, paragraph long, family string, probability double, similarity double, text string"


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all words and word pairs, and where each paragraph's words begin."""
    words, begin = bytetext.words(_plain(data), offsets)
    pairs = bytetext.combine([words[:-1], words[1:]]) if len(words) > 1 else words[:0]
    mask = np.uint64(FEATURES - 1)
    return (words & mask).astype(np.int64), (pairs & mask).astype(np.int64), begin


_KEPT = np.full(256, 32, np.uint8)
for _range in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _KEPT[list(_range)] = list(_range)


def _plain(data: np.ndarray) -> np.ndarray:
    """Punctuation as blanks; digits, letters and bytes beyond ASCII stay."""
    return _KEPT[data]


def paragraph_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of all lines of all texts, and each line's text and number in it."""
    after = np.flatnonzero(data == 10) + 1
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], after[after < len(data)])
    row = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(starts, offsets[:-1])
    return np.append(starts, len(data)), row, np.arange(len(starts)) - first[row]


def logits(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """The classifier's logits of each paragraph: mean weights of its words and pairs, scaled."""
    words, pairs, begin = _features(data, offsets)
    rows = len(begin) - 1
    out = np.zeros((rows, weights.shape[1]))
    count = np.diff(begin)
    filled = np.flatnonzero(count)
    if len(filled):
        total = weights[words]
        inside = np.ones(len(pairs), bool)
        inside[begin[1:-1][(begin[1:-1] > 0) & (begin[1:-1] <= len(pairs))] - 1] = False
        total[:-1][inside] += weights[pairs[inside]]
        out[filled] = np.add.reduceat(total, begin[filled], axis=0) / np.sqrt(2.0 * count[filled])[:, None]
    return out + intercepts


def window_candidates(
    data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, intercepts: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Windows likelier a licence than unknown: paragraph, first word, end, family, probability; likeliest first."""
    words, pairs, begin = _features(data, offsets)
    count = np.diff(begin)
    sums = np.zeros((len(words) + 1, weights.shape[1]))
    np.cumsum(weights[words], axis=0, out=sums[1:])
    joint = np.zeros((len(pairs) + 1, weights.shape[1]))
    np.cumsum(weights[pairs], axis=0, out=joint[1:])
    out = []
    for width, step in WINDOWS:
        longer = np.flatnonzero(count > width)
        spare = count[longer] - width
        windows = -(-spare // step) + 1
        line = np.repeat(longer, windows)
        nth = np.arange(len(line)) - np.repeat(np.cumsum(windows) - windows, windows)
        a = begin[line] + np.minimum(nth * step, np.repeat(spare, windows))
        for low in range(0, len(a), 1 << 16):
            some, rows = a[low : low + (1 << 16)], line[low : low + (1 << 16)]
            z = sums[some + width] - sums[some] + joint[some + width - 1] - joint[some]
            z = z / np.sqrt(2.0 * width) + intercepts
            likely = np.flatnonzero(z.argmax(1) < z.shape[1] - 1)
            p = _softmax(z[likely])
            sure = p.max(1) >= CONFIDENT
            at = likely[sure]
            out.append((rows[at], some[at], some[at] + width, p[sure].argmax(1), p[sure].max(1)))
    line, a, b, family, p = (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(5))
    order = np.lexsort((a, -p, line))
    return line[order], a[order], b[order], family[order], p[order]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _matrix(texts: list[str]) -> np.ndarray:
    data, offsets = bytetext.utf8(pa.array(texts, pa.string()))
    words, pairs, begin = _features(data, offsets)
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
        np.add.at(out[i], words[a:b], 1)
        np.add.at(out[i], pairs[a : max(a, b - 1)], 1)
        out[i] /= np.sqrt(2.0 * max(1, b - a))
    return out


def examples() -> tuple[list[str], list[str]]:
    """Training texts of the families: the phrases whole, in halves, with headers around them, and joined."""
    texts, families = [], []
    for family, phrases in TEMPLATES.items():
        for phrase in phrases:
            words = phrase.split()
            half = max(3, len(words) * 2 // 3)
            varied = [phrase, phrase.upper(), f"Copyright 2020 The Authors. {phrase}", f"{phrase} See the LICENSE file."]
            if len(words) > 5:
                varied += [" ".join(words[:half]), " ".join(words[-half:])]
            texts += varied
            families += [family] * len(varied)
        texts.append(" ".join(phrases))
        families.append(family)
    return texts, families


def _fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    target = np.eye(classes, dtype=np.float32)[y]
    share = (1 / np.bincount(y, minlength=classes).clip(1))[y].astype(np.float32)[:, None] / classes
    for _ in range(steps):
        wrong = (_softmax(x @ w + b) - target) * share
        vw = 0.9 * vw - 2.0 * (x.T @ wrong + 1e-5 * w)
        vb = 0.9 * vb - 2.0 * wrong.sum(0)
        w, b = (w + vw).astype(np.float32), (b + vb).astype(np.float32)
    return w, b


def train(unknown: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Family names (unknown last), weights and intercepts, calibrated on every fifth example."""
    texts, families = examples()
    confirm = Confirmation()
    unknown = [u for u in unknown if confirm.best(u)[1] < 0.5]  # licence texts of the corpus itself aren't unknown
    names = [*TEMPLATES, "unknown"]
    y = np.array([names.index(f) for f in families] + [len(names) - 1] * len(unknown))
    x = _matrix(texts + unknown)
    kept = np.arange(len(y)) % 5 == 4
    w, b = _fit(x[~kept], y[~kept], len(names))
    z = x[kept] @ w + b
    sharpness = np.geomspace(0.1, 10, 41)
    loss = [-np.log(_softmax(z * s)[np.arange(len(z)), y[kept]] + 1e-12).mean() for s in sharpness]
    best = sharpness[int(np.argmin(loss))]
    return names, w * np.float32(best), b * np.float32(best)


class Confirmation:
    """Compares a paragraph with the families' phrases on shingles of two words."""

    def __init__(self) -> None:
        self.phrases = [(f, self._set(p)) for f, phrases in TEMPLATES.items() for p in phrases]
        self.families = {f: set().union(*(s for g, s in self.phrases if g == f)) for f in TEMPLATES}

    @staticmethod
    def _set(text: str) -> set:
        data, offsets = bytetext.utf8(pa.array([text], pa.string()))
        hashes, begin = bytetext.words(_plain(data), offsets)
        return set(bytetext.shingle_sets(hashes, begin, _SHINGLE)[0].tolist())

    def similarity(self, family: str, text: str) -> float:
        """The best share of a phrase that stands in the text, or of the text that stands in the template."""
        return self.compare(family, self._set(text))

    def compare(self, family: str, own: set) -> float:
        if not own or family not in self.families:
            return 0.0
        whole = len(own & self.families[family]) / len(own)
        return max(whole, *(len(own & s) / len(s) for f, s in self.phrases if f == family))

    def best(self, text: str) -> tuple[str, float]:
        return max(((f, self.similarity(f, text)) for f in TEMPLATES), key=lambda r: r[1])


def _scan(names: list[str], weights: np.ndarray, intercepts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        confirm = Confirmation()
        for batch in batches:
            for part in bytetext.slices(batch, "text", 1 << 20):
                data, offsets = bytetext.utf8(part.column(part.schema.get_field_index("text")))
                lines, row, number = paragraph_offsets(data, offsets)
                if not len(row):
                    continue
                p = _softmax(logits(data, lines, weights, intercepts))
                best = p.argmax(1)
                found, done = [], set()
                ids = part.column(part.schema.get_field_index("doc_id"))
                for i in np.flatnonzero((best < len(names) - 1) & (p.max(1) >= CONFIDENT)).tolist():
                    text = data[lines[i] : lines[i + 1]].tobytes().decode("utf-8", "replace").strip("\n")
                    similarity = confirm.similarity(names[best[i]], text)
                    if similarity >= CONFIRMED:
                        done.add(i)
                        found.append((ids[row[i]].as_py(), int(number[i]), names[best[i]], float(p[i, best[i]]), similarity, text))
                windows = window_candidates(data, lines, weights, intercepts)
                if len(windows[0]):
                    hashes, _ = bytetext.words(_plain(data), lines)
                for i, a, b, family, sure in zip(*(w.tolist() for w in windows)):
                    if i in done:
                        continue
                    own = set(bytetext.shingle_sets(hashes[a:b], np.array([0, b - a]), _SHINGLE)[0].tolist())
                    similarity = confirm.compare(names[family], own)
                    if similarity >= CONFIRMED:
                        done.add(i)
                        text = data[lines[i] : lines[i + 1]].tobytes().decode("utf-8", "replace").strip("\n")
                        found.append((ids[row[i]].as_py(), int(number[i]), names[family], sure, similarity, text))
                if found:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                        ["doc_id", "paragraph", "family", "probability", "similarity", "text"],
                    )

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, text) of every paragraph that states a licence.

    A paragraph is a line, numbered from 0. ``probability`` is the calibrated
    one of its family against the others and unknown, ``similarity`` the
    confirming comparison with the template. Both are the whole paragraph's, or
    else those of the likeliest of its windows that is confirmed.

    Defined cases: null and empty texts state none. Rows that repeat an id are
    scanned each; a null id stays null. Equal paragraphs of a document are each
    found. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    filled = rows.where(F.length("text") > 0).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    sample = (
        hashed_sample(filled, F.col("h"), UNKNOWN_PARAGRAPHS)
        .select(F.substring(F.substring_index("text", "\n", 1), 1, 500).alias("line"))
        .collect()
    )
    names, weights, intercepts = train([r["line"] for r in sample if r["line"].strip()])
    return rows.mapInArrow(_scan(names, weights, intercepts), _FOUND)
