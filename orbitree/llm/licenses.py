"""License scans (operator 8).

Consecutive lines with words are a paragraph; comment marks are no words, so hard-wrapped notices
in comments stay together. A softmax regression over hashed word unigrams and bigrams, trained
here on licence notices and on a bounded sample of ordinary lines, gives each paragraph, each of
its lines and each of its overlapping word windows a family or the unknown class. The unknown class
also learns lines of the sample that speak of licences but hold no notice. Probabilities are
calibrated by a temperature: a first model is fitted without every third line and without the last
notice of each family that has three, the temperature fits its losses on these, and the final model is
fitted on all. A family needs at least ``least_chance``. A prediction is confirmed if the paragraph, in the reach of a notice around the
place, holds most bigrams of a notice of that family. Of predictions whose matched words overlap,
the best one counts; unconfirmed ones count for lines and paragraphs only.

A text of any length is scanned whole in slices of words; a task needs memory in proportion to its
longest text (about a hundred times its words).
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitree.llm.textkernel import mix64, word_slices

#: Documents that give ordinary lines to the training sample at most; chosen by the hash of their id.
TRAIN_DOCS = 600
LEAST_CHANCE = 0.6
LEAST_OVERLAP = 0.6
_DIM = 1 << 15
#: Word windows inside a paragraph, and the words from one to the next.
_WINDOWS = ((8, 2), (24, 8), (48, 16))
#: Words around a place that can belong to its notice, longer than any notice.
_REACH = 64

#: Notices by family (fixed values).
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
}
FAMILIES = tuple(NOTICES)
#: Sentences that share words with notices but grant nothing (fixed values).
NEAR_MISSES = (
    "He was released under the terms of the agreement in the public interest.",
    "Her driving license was renewed and the version of the form changed.",
    "The general public may use the library free of charge without restriction.",
    "All rights reserved by the author of this work.",
    "The software is distributed in two forms to any person who asks for a copy.",
    "The terms of the contract were modified at the option of the buyer.",
    "Permission to enter the source of the river was granted by the law.",
    "The talk compares the MIT license with other licenses and asks which license a project should choose.",
    "Many authors prefer the Apache License because their lawyers know it.",
    "The GNU General Public License has been discussed in court more than once.",
    "Which Creative Commons license fits photographs was the question of the evening.",
)

#: Letters, digits and bytes of other scripts stay, in lower case; line ends stay; the rest is space.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x0A] = 0x0A


@dataclass
class Model:
    weights: np.ndarray  # (_DIM, families + 1), the last class is unknown
    bias: np.ndarray
    temperature: float
    templates: list[list[np.ndarray]]  # bigram hashes of each notice, by family


@dataclass
class Lines:
    """Paragraphs with words: owner text, line number, word range, and hashes of words and bigrams."""

    owner: np.ndarray
    line: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    words: np.ndarray
    pairs: np.ndarray
    lines: np.ndarray  # line number of each word


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:])


def _lines(column: pa.Array) -> Iterator[Lines]:
    for w in word_slices(column, fold=_FOLD):
        if not len(w.hashes):
            continue
        owner = np.repeat(np.arange(len(w)), np.diff(w.offsets))
        breaks = np.flatnonzero(w.data == 0x0A)
        seen = np.searchsorted(breaks, w.starts)
        line = seen - np.searchsorted(breaks, w.text_offsets[:-1])[owner]
        lo = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (line[1:] != line[:-1]))))
        hi = np.concatenate((lo[1:], [len(owner)]))
        pairs = _bigrams(w.hashes)
        yield Lines(w.first + owner[lo], line[lo], lo, hi, w.hashes, np.concatenate((pairs, np.zeros(1, np.uint64))), line)


def _units(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges to be scored: (lo, hi, paragraph, whether a window), and the paragraphs' bounds."""
    apart = np.concatenate(([True], (lines.owner[1:] != lines.owner[:-1]) | (lines.line[1:] > lines.line[:-1] + 1)))
    first = np.flatnonzero(apart)
    lo, hi = lines.lo[first], lines.hi[np.concatenate((first[1:], [len(apart)])) - 1]
    bounds = np.stack((lo, hi), axis=1)
    several = np.flatnonzero(np.diff(np.concatenate((first, [len(apart)]))) > 1)
    los, his, of, window = [lines.lo, lo[several]], [lines.hi, hi[several]], [np.cumsum(apart) - 1, several], [np.zeros(len(apart) + len(several), dtype=bool)]
    for width, step in _WINDOWS:
        n = np.maximum(-(-(hi - lo - width) // step), -1) + 1
        at = np.repeat(np.arange(len(lo)), n)
        start = lo[at] + step * (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))
        los.append(start)
        his.append(np.minimum(start + width, hi[at]))
        of.append(at)
        window.append(np.ones(len(at), dtype=bool))
    return np.concatenate(los), np.concatenate(his), np.concatenate(of), np.concatenate(window), bounds


def _scores(lines: Lines, lo: np.ndarray, hi: np.ndarray, model: Model) -> np.ndarray:
    """Class scores per word range: summed weights of its words and bigrams over the root of their number."""
    each = model.weights[(lines.words % np.uint64(_DIM)).astype(np.int64)]
    pair = model.weights[(lines.pairs % np.uint64(_DIM)).astype(np.int64)]
    total = np.concatenate((np.zeros((1, each.shape[1])), np.cumsum(each + pair, axis=0, dtype=np.float64)))
    return (total[hi] - total[lo] - pair[hi - 1]) / np.sqrt(2 * (hi - lo) - 1)[:, None] + model.bias


def _chances(scores: np.ndarray, temperature: float) -> np.ndarray:
    z = scores / temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _examples(notices: dict[str, tuple[str, ...]], ordinary: list[str], seed: int) -> tuple[list[str], list[int]]:
    """Notices with words dropped and text around them, near misses, and ordinary lines."""
    draw = random.Random(seed)
    texts, labels = [], []
    plain = ordinary or list(NEAR_MISSES)
    for family, own in notices.items():
        for notice in own:
            for kind in range(24):
                words = notice.split()
                if kind >= 8 and len(words) > 6:
                    words = [w for w in words if draw.random() > 0.08]
                if kind % 4 == 1:
                    words = draw.choice(plain).split()[:6] + words
                if kind % 4 == 2:
                    words += draw.choice(plain).split()[:6]
                texts.append(" ".join(words))
                labels.append(FAMILIES.index(family))
    unknown = [*ordinary, *(list(NEAR_MISSES) * 12)]
    return texts + unknown, labels + [len(NOTICES)] * len(unknown)


def _design(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices, the example of each, their values, and the examples that have words."""
    columns, rows, values, held = [], [], [], []
    for lines in _lines(pa.array([t.replace("\n", " ") for t in texts], pa.string())):
        for owner, lo, hi in zip(lines.owner.tolist(), lines.lo.tolist(), lines.hi.tolist()):
            own = np.concatenate((lines.words[lo:hi], lines.pairs[lo : hi - 1]))
            columns.append((own % np.uint64(_DIM)).astype(np.int64))
            rows.append(np.full(len(own), len(held)))
            values.append(np.full(len(own), 1 / np.sqrt(len(own))))
            held.append(owner)
    return np.concatenate(columns), np.concatenate(rows), np.concatenate(values), np.array(held)


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed by their place."""
    return np.stack([np.bincount(at, column, n) for column in values.T], axis=1)


def _fitted(texts: list[str], labels: list[int], steps: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression by gradient descent."""
    classes = len(FAMILIES) + 1
    columns, rows, values, held = _design(texts)
    y = np.eye(classes)[np.array(labels)[held]]
    weights = np.zeros((_DIM, classes))
    used = np.unique(columns)
    place = np.searchsorted(used, columns)
    small = weights[used]
    bias = np.zeros(classes)
    for _ in range(steps):
        error = _chances(_sums(rows, small[place] * values[:, None], len(held)) + bias, 1.0) - y
        small -= rate * (_sums(place, error[rows] * values[:, None], len(used)) / len(held) + decay * small)
        bias -= error.mean(axis=0)
    weights[used] = small
    return weights, bias


def _temperature(weights: np.ndarray, bias: np.ndarray, texts: list[str], labels: list[int]) -> float:
    """The temperature of least loss on examples that the weights don't know."""
    columns, rows, values, held = _design(texts)
    scores, truth = _sums(rows, weights[columns] * values[:, None], len(held)) + bias, np.array(labels)[held]
    losses = {t: -np.log(_chances(scores, t)[np.arange(len(held)), truth] + 1e-12).mean() for t in (0.1, 0.15, 0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    return min(losses, key=losses.get)


def train(ordinary: list[str], steps: int = 60, rate: float = 30.0, decay: float = 1e-4) -> Model:
    """The temperature by held-out notices and lines, then the model on all of them."""
    known = {f: n[:-1] if len(n) >= 3 else n for f, n in NOTICES.items()}
    other = {f: n[-1:] for f, n in NOTICES.items() if len(n) >= 3}
    kept, out = [t for i, t in enumerate(ordinary) if i % 3], ordinary[::3]
    first = _fitted(*_examples(known, kept, 1), steps, rate, decay)
    temperature = _temperature(*first, *_examples(other, out, 2))
    weights, bias = _fitted(*_examples(NOTICES, ordinary, 3), steps, rate, decay)
    return Model(weights.astype(np.float32), bias.astype(np.float32), temperature, _templates())


def _templates() -> list[list[np.ndarray]]:
    return [[np.unique(_bigrams(next(word_slices(pa.array([n]), fold=_FOLD)).hashes)) for n in notices] for notices in NOTICES.values()]


def _holds_notice(line: str, templates: list[list[np.ndarray]], least: float) -> bool:
    words = next(iter(word_slices(pa.array([line]), fold=_FOLD))).hashes
    pairs = _bigrams(words) if len(words) > 1 else np.empty(0, np.uint64)
    return any(np.isin(t, pairs).mean() >= least for notices in templates for t in notices)


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAIN_DOCS) -> Model:
    """Train with the first lines of at most ``bound`` documents, and with lines of theirs that speak of
    licences; lines that hold a third of a notice are left out.

    The documents' ids are chosen first, so tasks send only ids besides the chosen lines."""
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).where("k is not null")
    chosen = rows.select("k", F.xxhash64("k").alias("o")).orderBy("o", "k").limit(bound).select("k").distinct()
    lines = rows.join(F.broadcast(chosen), "k").select("k", F.posexplode(F.split("t", "\n")).alias("i", "line")).where(F.length("line").between(20, 400))
    lines = lines.where((F.col("i") < 3) | F.lower("line").rlike("licen[sc]e|copyright|permission|public domain|redistribut"))
    templates = _templates()
    return train([row.line for row in lines.orderBy("k", "i", "line").limit(3 * bound).collect() if not _holds_notice(row.line, templates, 1 / 3)])


def _match(template: np.ndarray, pairs: np.ndarray, begin: int, end: int) -> tuple[float, int, int]:
    """Share of a template's bigrams in words [begin, end), and the words they span (the first negated)."""
    at = np.flatnonzero(np.isin(pairs[begin : end - 1], template)) + begin
    if not len(at):
        return 0.0, -begin, begin
    share = len(np.unique(pairs[at])) / len(template)
    if len(at) > 1 and at[-1] - at[0] > 2 * len(template) + 8:  # stray bigrams far from the notice don't widen its span
        dense = np.searchsorted(at, at + len(template) + 4) - np.arange(len(at))
        k = int(dense.argmax())
        at = at[k : k + dense[k]]
    return share, -int(at[0]), int(at[-1]) + 2


def _found(model: Model, least_chance: float, least_overlap: float):
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("chance", pa.float64()), ("overlap", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for lines in _lines(batch.column(1)):
                lo, hi, of, window, bounds = _units(lines)
                scores = _scores(lines, lo, hi, model)
                best = scores.argmax(axis=1)
                at = np.flatnonzero(best < len(FAMILIES))
                if not len(at):
                    continue
                chance = _chances(scores[at], model.temperature)[np.arange(len(at)), best[at]]
                owners = np.repeat(lines.owner, lines.hi - lines.lo)
                hits: dict[int, list[tuple]] = {}
                for i, p in zip(at.tolist(), chance.tolist()):
                    if p < least_chance:
                        continue
                    begin, end = max(bounds[of[i], 0], lo[i] - _REACH), min(bounds[of[i], 1], hi[i] + _REACH)
                    overlap, first, last = max(_match(t, lines.pairs, int(begin), int(end)) for t in model.templates[best[i]])
                    sure = overlap >= least_overlap
                    if sure or not window[i]:
                        span = (-first, last) if sure else (int(lo[i]), int(hi[i]))
                        hits.setdefault(int(of[i]), []).append((sure, overlap, p, span, int(best[i])))
                for group in hits.values():
                    taken: list[tuple[int, int]] = []
                    for sure, overlap, p, span, family in sorted(group, reverse=True):
                        if any(s < span[1] and span[0] < e for s, e in taken):
                            continue
                        taken.append(span)
                        found[owners[span[0]]].append({"line": int(lines.lines[span[0]]), "family": FAMILIES[family], "chance": round(p, 4), "overlap": round(overlap, 4), "confirmed": sure})
            for one in found:
                one.sort(key=lambda x: (x["line"], x["family"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "licenses"])

    return run


def scan_licenses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_chance: float = LEAST_CHANCE, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """Licence paragraphs: (doc_id, licenses array<struct<line,family,chance,overlap,confirmed>>).

    One row per input row. Null and empty texts have none; null and repeated ids stay as they
    are; an empty table gives no rows; other columns are ignored."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_found(model, least_chance, least_overlap), "doc_id long, licenses array<struct<line:int,family:string,chance:double,overlap:double,confirmed:boolean>>")


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, families, n_confirmed, n_doubtful): confirmed families, comma-joined in order."""
    found = scan_licenses(docs, train_on(docs, id_col, text_col), id_col, text_col)
    sure = F.filter("licenses", lambda x: x["confirmed"])
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"), F.size(sure).cast("long").alias("n_confirmed"), (F.size("licenses") - F.size(sure)).cast("long").alias("n_doubtful"))
