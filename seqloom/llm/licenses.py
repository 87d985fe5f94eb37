"""Licence scans: a trained paragraph classifier, with classes for unknown licences and for none, confirmed by templates.

A text is read twice, line by line and by runs of lines up to the next line without a word (so that hard-wrapped
notices, also in comments, are whole); longer lines and runs are read in half-overlapping windows, so no part of a
text is left out. Features are the hashed word 1-, 2- and 3-grams. Multinomial logistic regression is trained on variants of the notices below
(words dropped, replaced, added) and on paragraphs of no licence, among them ones that use the same words. Its
temperature and its threshold come from variants that it was not trained on. A prediction counts only if the
paragraph also holds enough word pairs of one of the family's templates.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import separators
from .kernels import U, mix, numbers, releasing, text_chunks, word_hashes

# Usual notices of each family.
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT License, see the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This software is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is free software under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for more details.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text available under the Creative Commons Attribution License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available for non-commercial use under CC BY-NC 3.0.",
    ),
    "CC0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work is in the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2024 the authors. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
# Notices of licences of no family above; what is like them is a licence, but an unknown one.
OTHER_NOTICES = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, by any means.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0.",
    "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Use of this software is governed by the Business Source License included in the LICENSE file.",
    "This program is free software. It comes without any warranty. You just do what the fuck you want to.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Released under the ISC License.",
    "Licensed under the zlib license.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "SPDX-License-Identifier: ISC",
)
#: Families whose notices hold another's words: where both are found in one place, the more specific one counts.
SPECIFIC = {"GPL": ("LGPL", "AGPL"), "CC-BY": ("CC-BY-SA", "CC-BY-NC")}
# Paragraphs that use the words of notices and are none.
NEAR_MISSES = (
    "She renewed her driving license at the public office.", "The license plate of the car was stolen.", "He reserved all the rooms of the hotel.", "The rights of the public were reserved for a later debate.",
    "An apache helicopter flew over the general store.", "The version of the story that was released differs.", "Under the terms of the agreement the work was finished.", "The fishing licence costs four dollars.",
    "Students at MIT released a new robot.", "You may obtain a copy of the report at the library.", "The author of this work is free to attend.", "A general released the prisoners under a public promise.",
    "The software crashed without permission to write the file.", "International attribution of the painting is in doubt.", "The source of the river is in the public park.", "Poetic license permits the author to modify the facts.",
)
UNKNOWN, NONE = "unknown", "none"
BITS, ORDERS, WINDOW = 20, 3, 32
#: Least probability of a family that a template may confirm.
LEAST_FAMILY = 0.1
#: Share of a template's word pairs that confirms it.
SHARE = 0.6
GRAM = numbers(6, ORDERS, odd=True)


def grams(words: np.ndarray, order: int) -> np.ndarray:
    """Bins of the word ``order``-grams that begin at each word (the last ones too few: left out)."""
    n = len(words) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = words[:n] * GRAM[0]
    for k in range(1, order):
        h = h + words[k : k + n] * GRAM[k]
    return (mix(h + U(order)) >> U(64 - BITS)).astype(np.int64)


def words_of(texts: list[str]) -> list[np.ndarray]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    out = []
    for _, _, data, offsets in text_chunks(batch):
        words, at = word_hashes(data, offsets, separators())
        out += [words[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def pairs(words: np.ndarray) -> set[int]:
    """Word pairs of a paragraph (the word itself if there is only one), as full hashes."""
    h = mix(words[:-1] * GRAM[0] + words[1:] * GRAM[1]) if len(words) > 1 else words
    return set(h.tolist())


@dataclass
class Model:
    names: list[str]
    rows: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    templates: list[tuple[str, set[int]]]

    def pairs(self) -> np.ndarray:
        return np.array(sorted(set().union(*(t for _, t in self.templates))), U)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def variants(rng: np.random.Generator, text: str, n: int, filler: list[str]) -> list[str]:
    """A text and n - 1 changed ones: a word dropped, replaced or swapped for filler, filler before or after it."""
    out = [text]
    for _ in range(n - 1):
        w = text.split()
        for _ in range(int(rng.integers(0, 1 + len(w) // 6 + 1))):
            k = int(rng.integers(0, len(w)))
            w[k : k + 1] = [] if rng.random() < 0.5 and len(w) > 3 else [str(rng.choice(filler))]
        before, after = (list(rng.choice(filler, int(rng.integers(0, 14)))) for _ in range(2))
        out.append(" ".join([*before, *w, *after]))
    return out


@functools.lru_cache(1)
def train(seed: int = 7, per_notice: int = 40, steps: int = 250, rate: float = 1.0, decay: float = 1e-4, false_rate: float = 0.005) -> Model:
    """Fit, calibrate on held-out variants, and set the threshold that lets at most ``false_rate`` of the held-out paragraphs of no licence pass."""
    rng = np.random.default_rng(seed)
    notices = NOTICES | {UNKNOWN: OTHER_NOTICES}
    names = [*notices, NONE]
    vocabulary = sorted({w for group in (*notices.values(), NEAR_MISSES) for t in group for w in t.split()})
    filler = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "sun", "ple") for b in ("ro", "nda", "s", "tion", "vel", "x")] + ["the", "of", "and", "a", "to", "in", "is", "for", "by", "with"]
    texts = [(v, k) for k, f in enumerate(notices) for t in notices[f] for v in variants(rng, t, per_notice, filler)]
    none = [v for t in NEAR_MISSES for v in variants(rng, t, per_notice // 2, filler)]
    none += [" ".join(rng.choice(filler, int(rng.integers(1, 40)))) for _ in range(600)]
    none += [" ".join([*rng.choice(filler, int(rng.integers(2, 20))), *rng.choice(vocabulary, int(rng.integers(1, 5)))]) for _ in range(800)]
    texts += [(t, len(names) - 1) for t in none]
    held = rng.random(len(texts)) < 0.25
    y = np.array([k for _, k in texts])
    bins = [np.unique(np.concatenate([grams(w, o) for o in range(1, ORDERS + 1)])) for w in words_of([t for t, _ in texts])]
    known = np.unique(np.concatenate([b for b, h in zip(bins, held) if not h]))
    rows = np.full(1 << BITS, -1, np.int32)
    rows[known] = np.arange(len(known))
    sample = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    row = rows[np.concatenate(bins)]
    scale = 1 / np.sqrt(np.array([max(1, len(b)) for b in bins]))
    weights, bias = np.zeros((len(known), len(names))), np.zeros(len(names))

    def logits(which: np.ndarray) -> np.ndarray:
        use = (row >= 0) & which[sample]
        out = np.stack([np.bincount(sample[use], weights=weights[row[use], c], minlength=len(bins)) for c in range(len(names))], axis=1)
        return out * scale[:, None] + bias

    fit = ~held
    use = (row >= 0) & fit[sample]
    balance = 1 / np.maximum(np.bincount(y[fit], minlength=len(names)), 1)[y] / len(names)
    square_w, square_b = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(steps):
        z = logits(fit)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= (balance * fit)[:, None]
        slope = np.stack([np.bincount(row[use], weights=(p[:, c] * scale)[sample[use]], minlength=len(known)) for c in range(len(names))], axis=1) + decay * weights / len(known)
        square_w += slope**2
        square_b += p.sum(axis=0) ** 2
        weights -= rate * slope / np.sqrt(square_w)
        bias -= rate * p.sum(axis=0) / np.sqrt(square_b)
    z = logits(held)[held]
    true = y[held]

    def loss(t: float) -> float:
        q = z / t - (z / t).max(axis=1, keepdims=True)
        return float(-(q[np.arange(len(true)), true] - np.log(np.exp(q).sum(axis=1))).mean())

    temperature = min((0.25 * 1.25**k for k in range(20)), key=loss)
    templates = [(f, pairs(w)) for f, group in notices.items() for w in words_of(list(group))]
    model = Model(names, rows, weights.astype(np.float32), bias.astype(np.float32), temperature, 0.0, templates)
    # Of the paragraphs of no licence, only those that a template would confirm can pass.
    passing = [any(len(t & mine) >= SHARE * len(t) for _, t in templates) for mine in map(pairs, words_of([t for (t, k), h in zip(texts, held) if h and k == len(names) - 1]))]
    top = (1 - model.probabilities(z[true == len(names) - 1])[:, -1]) * np.array(passing)
    model.least = float(min(0.95, max(0.5, np.quantile(top, 1 - false_rate))))
    return model


def segments(words: np.ndarray, starts: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every paragraph window: lines of words, in windows of WINDOW words that begin WINDOW / 2 apart."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    size = np.diff(np.append(head, len(words)))
    half = WINDOW // 2
    count = np.where(size <= WINDOW, 1, -(-(size - WINDOW) // half) + 1)
    first = np.repeat(head, count) + half * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return first, np.minimum(first + WINDOW, np.repeat(head + size, count))


def find(model: Model, data: np.ndarray, offsets: np.ndarray, share: float = SHARE) -> list[tuple[int, int, int, str, float]]:
    """(text, start byte, end byte, family, probability) of the confirmed paragraphs of all texts."""
    inside = ~separators()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    words, at = word_hashes(data, offsets, separators())
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    breaks = np.cumsum(data == 10)
    line = (breaks[starts] if len(starts) else starts) + text
    if not len(line):
        return []
    rows = [model.rows[grams(words, order)] for order in range(1, ORDERS + 1)]
    out = []
    for s, e, family, p, _ in confirmed(model, words, rows, line, *segments(words, starts, line), share):
        out.append((int(text[s]), int(starts[s]), int(ends[e - 1]), family, p))
    # Runs of several lines; their spans are the words that the template shares, not the whole window.
    run = np.cumsum(np.append(False, (text[1:] != text[:-1]) | (np.diff(line) > 1)))
    several = np.bincount(run, weights=np.append(False, (run[1:] == run[:-1]) & (line[1:] != line[:-1]))) > 0
    first, end = segments(words, starts, run)
    keep = several[run[first]]
    for _, _, family, p, (s, e) in confirmed(model, words, rows, run, first[keep], end[keep], share):
        out.append((int(text[s]), int(starts[s]), int(ends[e - 1]), family, p))
    return sorted(out)


def tightest(words: np.ndarray, template: set[int]) -> tuple[int, int]:
    """First word and end of the shortest part that holds every pair of the template that ``words`` hold."""
    h = mix(words[:-1] * GRAM[0] + words[1:] * GRAM[1]).tolist()
    at = [k for k, x in enumerate(h) if x in template]
    need, inside, best, low = len({h[k] for k in at}), Counter(), (0, len(words)), 0
    for k in at:
        inside[h[k]] += 1
        while inside[h[at[low]]] > 1:
            inside[h[at[low]]] -= 1
            low += 1
        if len(inside) == need and k + 2 - at[low] < best[1] - best[0]:
            best = (at[low], k + 2)
    return best


def confirmed(model: Model, words: np.ndarray, rows: list[np.ndarray], group: np.ndarray, first: np.ndarray, end: np.ndarray, share: float) -> Iterator[tuple[int, int, str, float, tuple[int, int]]]:
    """(first word, end, family, probability, first word and end of the template's part) of the windows that the model and a template confirm."""
    if not len(first):
        return
    logits = np.zeros((len(first), len(model.names)), np.float32)
    for order, row in enumerate(rows, 1):
        hit = np.flatnonzero(row >= 0)
        last = np.searchsorted(first, hit, side="right") - 1
        for back in (0, 1):
            s = np.maximum(last - back, 0)
            ok = (last >= back) & (first[s] <= hit) & (hit + order <= end[s])
            for c in range(len(model.names)):
                logits[:, c] += np.bincount(s[ok], weights=model.weights[row[hit[ok]], c], minlength=len(first)).astype(np.float32)
    n = end - first
    total = np.maximum(1, sum(np.maximum(0, n - k) for k in range(ORDERS)))
    p = model.probabilities(logits / np.sqrt(total)[:, None] + model.bias)
    licence = 1 - p[:, -1]
    # No template is confirmed by fewer than two of its word pairs in reach.
    known = np.append(np.isin(mix(words[:-1] * GRAM[0] + words[1:] * GRAM[1]), model.pairs()), False)
    before = np.concatenate([[0], np.cumsum(known)])
    reach = before[np.minimum(end + WINDOW, len(words))] - before[np.maximum(first - WINDOW, 0)]
    for s in np.flatnonzero((licence >= model.least) & (reach >= 2)).tolist():
        # The template may reach beyond the window, but not beyond the line or run.
        a, b = max(first[s] - WINDOW, np.searchsorted(group, group[first[s]])), min(end[s] + WINDOW, np.searchsorted(group, group[first[s]], side="right"))
        mine = pairs(words[a:b])
        # The likeliest family that a template confirms.
        for c in np.argsort(-p[s, :-1], kind="stable").tolist():
            if p[s, c] < LEAST_FAMILY:
                break
            most, k = max((len(t & mine) / len(t), k) for k, (f, t) in enumerate(model.templates) if f == model.names[c])
            if most >= share:
                x, y = tightest(words[a:b], model.templates[k][1])
                yield int(first[s]), int(end[s]), model.names[c], float(licence[s]), (int(a + x), int(a + y))
                break


def code_points(data: np.ndarray, places: list[int]) -> dict[int, int]:
    """Byte places of one text -> code points before them, each byte counted once."""
    at, known, before = sorted(set(places)), {}, 0
    for a, b in zip([0, *at], at):
        before += int(np.count_nonzero((data[a:b] & 0xC0) != 0x80))
        known[b] = before
    return known


def joined(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Spans ``(start, end, family, probability)`` of one text in order: those of a family that overlap or touch are one, and those that lie where a more specific family is found are left out."""
    own: list[tuple[int, int, str, float]] = []
    last: dict[str, int] = {}
    for a, b, family, p in sorted(found):
        k = last.get(family)
        if k is not None and a <= own[k][1]:
            own[k] = (own[k][0], max(b, own[k][1]), family, max(p, own[k][3]))
        else:
            last[family] = len(own)
            own.append((a, b, family, p))
    by = {f: [x for x in own if x[2] == f] for f in last}
    hides = lambda x, f: (k := np.searchsorted([y[1] for y in by[f]], x[0], side="right")) < len(by[f]) and by[f][k][0] < x[1]
    return [x for x in own if not any(f in by and hides(x, f) for f in SPECIFIC.get(x[2], ()))]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, families, n_spans, spans, score`` of every whole text.

    ``families``: sorted, comma-joined, ``unknown`` for a licence of none of them; ``spans``: ``family:start:end`` in code
    points, end exclusive, those of a family that overlap or touch joined; of equal probabilities the first family
    counts; ``score``: the highest probability of being a licence, 0 without one. Null and empty texts have none; texts of any length
    are read whole, in memory of about sixty times a text above half a MB; repeated rows are rows like any other; an
    empty table gives an empty result; other columns are not read.
    """
    model = train()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                found: list[list[tuple[int, int, str, float]]] = [[] for _ in range(j - i)]
                for t, a, b, family, p in find(model, data, offsets):
                    found[t].append((a - int(offsets[t]), b - int(offsets[t]), family, p))
                rows, spans = [joined(x) for x in found], []
                for t, own in enumerate(rows):
                    at = code_points(data[offsets[t] : offsets[t + 1]], [k for x in own for k in x[:2]])
                    spans.append(",".join(f"{f}:{at[a]}:{at[b]}" for a, b, f, _ in own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([",".join(sorted({x[2] for x in own})) for own in rows], pa.string()), pa.array([len(own) for own in rows], pa.int32()),
                     pa.array(spans, pa.string()), pa.array([max((x[3] for x in own), default=0.0) for own in rows], pa.float64())],
                    names=["doc_id", "families", "n_spans", "spans", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, families string, n_spans int, spans string, score double")
