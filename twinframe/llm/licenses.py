"""Licence scans with a trained paragraph classifier.

Sparse word n-grams (one and two words, hashed) feed a multinomial logistic
regression over licence families and an unknown class.  Probabilities are
calibrated on paragraphs kept from training.  A prediction counts only if the
words also hold most of a template of that family.  Scored are the lines, and
inside each paragraph (from blank line to blank line, so that a notice may be
wrapped) the spans that hold most of a template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, received, scramble, shared_model, unit_hash

# Short licence notices as their publishers word them.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Licensed under the Apache License, Version 2.0.",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
    ],
    "gpl": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "Released under the MIT License.",
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability',
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
UNKNOWN = "unknown"
BITS = 16
#: Words of a line scored at a time, and the step between such segments; also the
#: most words that a notice inside a paragraph spreads over.
SEGMENT, STEP = 48, 24
#: Bounds on corpus rows whose paragraphs teach the unknown class: their number and the bytes of their texts, on average.
FIT_ROWS, FIT_BYTES = 1500, 4 << 20
LEAST_PROBABILITY, LEAST_TEMPLATE = 0.5, 0.6

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _c in range(33, 128):
    if not (48 <= _c <= 57 or 65 <= _c <= 90 or 97 <= _c <= 122 or _c in b"-."):
        _PLAIN[_c] = 32


class Paragraphs:
    """Words of a text, hashed, with their lines, and segments of the lines."""

    def __init__(self):
        self.hasher = WordHasher()

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes, line number of each)."""
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        plain = _PLAIN[raw]
        # a dot counts inside a word only ("4.0", not the end of a sentence)
        dot = plain == 46
        if dot.any():
            after = np.concatenate([plain[1:], [32]])
            plain = np.where(dot & ~((after >= 48) & (after <= 57)), 32, plain).astype(np.uint8)
        # and so does a hyphen, which else marks a comment ("-- " before each line) or a rule
        dash = plain == 45
        if dash.any():
            inside = (plain > 32) & ~dash & (plain != 46)
            plain = np.where(dash & ~(np.concatenate([[False], inside[:-1]]) & np.concatenate([inside[1:], [False]])), 32, plain).astype(np.uint8)
        hashes, starts, _ = self.hasher(plain.tobytes())
        return hashes, np.cumsum(raw == 10)[starts] if len(starts) else np.zeros(0, np.int64)

    def segments(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word hashes, first word, length and line of every segment)."""
        hashes, line = self.words(text)
        if not len(hashes):
            none = np.zeros(0, dtype=np.int64)
            return hashes, none, none, none
        edge = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1, [len(line)]])
        first, length = edge[:-1], np.diff(edge)
        extra = np.maximum(0, -(-(length - SEGMENT) // STEP)) + 1
        own = np.repeat(np.arange(len(first)), extra)
        step = np.arange(len(own)) - np.repeat(np.cumsum(extra) - extra, extra)
        begin = first[own] + step * STEP
        return hashes, begin, np.minimum(SEGMENT, first[own] + length[own] - begin), line[first[own]]


def paragraph_starts(line: np.ndarray) -> np.ndarray:
    """Whether each word begins a paragraph: between it and the last word is a line without words."""
    return np.concatenate([[True], np.diff(line) > 1])[: len(line)]


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    return scramble(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(0x9E3779B97F4A7C15))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


class LicenceModel:
    def __init__(self):
        self.families = [UNKNOWN, *sorted(TEMPLATES)]
        self.weights = np.zeros((1 << BITS, len(self.families)), dtype=np.float32)
        self.bias = np.zeros(len(self.families), dtype=np.float32)
        self.heat = 1.0
        read = Paragraphs()
        self.templates = [(f, np.unique(pair_hashes(read.words(t)[0]))) for f, ts in sorted(TEMPLATES.items()) for t in ts]
        self.template_pairs = np.unique(np.concatenate([t for _, t in self.templates]))

    def logits(self, hashes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logits of segments from running sums of word and word-pair weights."""
        one = np.zeros((len(hashes) + 1, len(self.families)), dtype=np.float64)
        np.cumsum(self.weights[_bucket(hashes)], axis=0, out=one[1:])
        two = np.zeros_like(one)
        if len(hashes) > 1:
            np.cumsum(self.weights[_bucket(pair_hashes(hashes))], axis=0, out=two[1:-1])
            two[-1] = two[-2]
        end = first + length
        total = one[end] - one[first] + two[np.maximum(end - 1, first)] - two[first]
        return self.bias + total / np.sqrt(2.0 * length)[:, None]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.heat
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def template_share(self, family: str, hashes: np.ndarray) -> float:
        """Largest share of a template's word pairs that the words hold."""
        pairs = np.unique(pair_hashes(hashes)) if len(hashes) > 1 else np.zeros(0, np.uint64)
        return max((len(np.intersect1d(pairs, t, assume_unique=True)) / len(t) for f, t in self.templates if f == family), default=0.0)

    def spans(self, hashes: np.ndarray, paragraph: np.ndarray) -> list[tuple[int, int]]:
        """(first word, words) of the spans inside a paragraph that hold most of a template.

        For every template and each of its pairs in the text, the distinct pairs
        of the next ``SEGMENT`` words are counted.  Fuller spans come first,
        then those of longer templates and shorter ones; spans that overlap a
        better one are left out.
        """
        if len(hashes) < 2:
            return []
        pairs = pair_hashes(hashes)
        near = np.flatnonzero(np.isin(pairs, self.template_pairs) & (paragraph[1:] == paragraph[:-1]))
        found: list[tuple[float, int, int, int]] = []
        for _, template in self.templates:
            at = near[np.isin(pairs[near], template)]
            end = np.minimum(np.searchsorted(at, at + SEGMENT - 1), np.searchsorted(paragraph[at], paragraph[at], side="right"))
            for i in np.flatnonzero(end - np.arange(len(at)) >= LEAST_TEMPLATE * len(template)):
                own = at[i : end[i]]
                _, where = np.unique(pairs[own], return_index=True)
                if len(where) >= LEAST_TEMPLATE * len(template):
                    found.append((-len(where) / len(template), -len(template), int(own[where.max()] - own[0]) + 2, int(own[0])))
        taken = np.zeros(len(hashes), dtype=bool)
        out = []
        for _, _, length, first in sorted(found):
            if not taken[first : first + length].any():
                taken[first : first + length] = True
                out.append((first, length))
        return out

    def scan(self, read: Paragraphs, texts: list[str]) -> list[tuple[int, list[tuple[int, str, float, float]]]]:
        """For each text its number of paragraphs, and (first line, family, probability, template share) found."""
        parts = [read.segments(t) for t in texts]
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        hashes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        first = np.concatenate([p[1] + b for p, b in zip(parts, base)])
        length, line = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        which = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        # segments are in order, so their lines are all lines with a word
        out: list[tuple[int, list]] = [(int(paragraph_starts(p[3]).sum()), []) for p in parts]
        if not len(first):
            return out
        paragraph = np.zeros(len(hashes), dtype=np.int64)
        starts = np.concatenate([paragraph_starts(p[3]) for p in parts])
        paragraph[first[starts]] = 1
        paragraph = np.cumsum(paragraph)
        inside = self.spans(hashes, paragraph)
        if inside:
            begin, size = (np.array(x, dtype=np.int64) for x in zip(*inside))
            # the segment in which a span begins tells its text and line
            home = np.searchsorted(first, begin, side="right") - 1
            first, length = np.concatenate([first, begin]), np.concatenate([length, size])
            which, line = np.concatenate([which, which[home]]), np.concatenate([line, line[home]])
        p = self.probabilities(self.logits(hashes, first, length))
        best = p.argmax(axis=1)
        hits: dict[tuple[int, int, str], tuple[float, float]] = {}
        for k in np.flatnonzero((best > 0) & (p.max(axis=1) >= LEAST_PROBABILITY)):
            family = self.families[best[k]]
            share = self.template_share(family, hashes[first[k] : first[k] + length[k]])
            if share >= LEAST_TEMPLATE:
                key = (int(which[k]), int(line[k]), family)
                hits[key] = max(hits.get(key, (0.0, 0.0)), (float(p[k, best[k]]), share))
        for (i, at, family), (probability, share) in sorted(hits.items()):
            out[i][1].append((at, family, probability, share))
        return out


def train(background: list[str], seed: int = 13, copies: int = 60, epochs: int = 12) -> LicenceModel:
    """Fit on altered templates against paragraphs of the corpus.

    Template words are dropped, cut at either end and surrounded by corpus
    words; paragraphs that hold most of a template are kept out of the unknown
    class.  A fifth of all examples sets the softmax's temperature.
    """
    rng, read, model = np.random.default_rng(seed), Paragraphs(), LicenceModel()
    index = {f: i for i, f in enumerate(model.families)}
    plain: list[np.ndarray] = []
    for text in background:
        hashes, first, length, _ = read.segments(text)
        plain += [hashes[a : a + n] for a, n in zip(first, length)]
    everything = np.concatenate([t for _, t in model.templates])
    kept = []
    for h in plain:
        pairs = pair_hashes(h) if len(h) > 1 else h[:0]
        if not np.isin(pairs, everything).any() or all(len(np.intersect1d(pairs, t)) < 0.3 * len(t) for _, t in model.templates):
            kept.append(h)
    pool = np.concatenate(kept) if kept else np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    xs, ys = [], []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = read.words(text)[0]
            for c in range(copies):
                w = words[rng.random(len(words)) > (0.15 if c else -1)]
                around = [rng.choice(pool, rng.integers(0, 12)) for _ in range(2)] if c % 3 else [pool[:0], pool[:0]]
                xs.append(np.concatenate([around[0], w if len(w) else words, around[1]])[: SEGMENT * 2])
                ys.append(index[family])
    some = rng.permutation(len(kept))[: 3 * len(xs)]
    xs += [kept[i] for i in some]
    ys += [0] * len(some)
    # words of licences out of place are unknown too
    vocabulary = np.concatenate([read.words(t)[0] for ts in TEMPLATES.values() for t in ts])
    for _ in range(len(xs) // 8):
        xs.append(np.concatenate([rng.choice(vocabulary, rng.integers(1, 4)), rng.choice(pool, rng.integers(4, 30))]))
        ys.append(0)
    y = np.array(ys)
    order = rng.permutation(len(xs))
    held, own = order[: len(xs) // 5], order[len(xs) // 5 :]
    grams = [np.concatenate([_bucket(x), _bucket(pair_hashes(x)) if len(x) > 1 else np.zeros(0, np.int64)]) for x in xs]
    scale = [1.0 / np.sqrt(2.0 * len(x)) for x in xs]
    square = np.full(model.weights.shape, 1e-6, dtype=np.float32)
    for _ in range(epochs):
        rng.shuffle(own)
        for at in range(0, len(own), 64):
            part = own[at : at + 64]
            z = np.stack([model.weights[grams[i]].sum(axis=0) * scale[i] + model.bias for i in part])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            rows = np.concatenate([grams[i] for i in part])
            g = np.concatenate([np.repeat(p[[j]] * scale[i], len(grams[i]), axis=0) for j, i in enumerate(part)]) / len(part)
            distinct, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(distinct), p.shape[1]), dtype=np.float32)
            np.add.at(total, back, g.astype(np.float32))
            square[distinct] += total * total
            model.weights[distinct] -= 0.3 * total / np.sqrt(square[distinct])
            model.bias -= (0.3 * p.mean(axis=0)).astype(np.float32)
    z = np.stack([model.weights[grams[i]].sum(axis=0) * scale[i] + model.bias for i in held]).astype(np.float64)

    def loss(heat: float) -> float:
        q = z / heat
        return float((np.log(np.exp(q - q.max(axis=1, keepdims=True)).sum(axis=1)) + q.max(axis=1) - q[np.arange(len(q)), y[held]]).mean())

    model.heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return model


def fit(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, seed: int = 23) -> LicenceModel:
    """Train with corpus texts of any length as background, chosen by a hash: about ``fit_rows`` at most, and about ``fit_bytes`` bytes."""
    text = F.col(text_col).cast("string")
    all_ = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text).cast("long")).alias("bytes")).first()
    share = min(1.0, fit_rows / max(1, all_["rows"]), fit_bytes / max(1, all_["bytes"] or 0))
    rows = docs.where(text.isNotNull() & (unit_hash(text, seed=seed) < share)).select(text.alias("t")).distinct().collect()
    return train(sorted(r["t"] for r in rows))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_paragraphs, licences, score, found``.

    A paragraph runs from one line without a word to the next.  ``found`` lists
    the confirmed notices (first line from 0, family, calibrated probability,
    share of the template); a notice may be wrapped over lines of a paragraph
    and is looked for in each line by itself as well.  ``licences`` names their families in order, joined by commas
    (empty if none) and ``score`` is the largest probability (0 if none).  Null
    and empty texts have no paragraph; long lines are scored in overlapping
    segments; repeated rows give repeated results; an empty table gives an empty
    result; extra columns are ignored.
    """
    model = model or fit(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = shared_model(docs.sparkSession, model)
    spans = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("template_share", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, read = received(shared), Paragraphs()
        for large in batches:
            for at in range(0, large.num_rows, 200):
                batch = large.slice(at, 200)
                found = own.scan(read, [t.as_py() or "" for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([n for n, _ in found], pa.int64()),
                        pa.array([",".join(sorted({h[1] for h in hits})) for _, hits in found], pa.string()),
                        pa.array([max((h[2] for h in hits), default=0.0) for _, hits in found], pa.float64()),
                        pa.array([[dict(zip(("line", "family", "probability", "template_share"), h)) for h in hits] for _, hits in found], spans),
                    ],
                    names=["doc_id", "n_paragraphs", "licences", "score", "found"],
                )

    return rows.mapInArrow(work, f"doc_id {kind}, n_paragraphs bigint, licences string, score double, found array<struct<line:int,family:string,probability:double,template_share:double>>")
