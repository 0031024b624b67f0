"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text, and runs of lines, however many, over which a licence text is
wrapped.  A softmax regression on hashed word n-grams (one to three words) separates licence
families and an unknown class.  It is trained here on template sentences with words dropped or
changed, against lines of the corpus (a bounded sample, those that look like licence talk among
them), shuffled template words and templates with another family's names as unknown; a temperature
calibrates it on examples made from templates and lines that the training has not seen.  A family
counts only if its probability reaches `threshold` and the paragraph contains the n-grams of one of
the family's templates to a share of `containment`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, slices

#: Sentences by which texts and files declare common licences.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "LGPL": ("Licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "BSD": (
        "Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission."),
}
FAMILIES = ("unknown", *TEMPLATES)
DIMS = 1 << 14
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def hashed(words: list[str]) -> np.ndarray:
    return np.array(sorted({zlib.crc32(g.encode()) % DIMS for g in ngrams(words)}), np.int64)


@lru_cache(maxsize=1)
def _template_grams() -> dict[str, list[set[str]]]:
    return {family: [ngrams(words_of(t)) for t in texts] for family, texts in TEMPLATES.items()}


_COMMON = frozenset("a all and any as at by for from in is it its not of on or the this to under use with without work which".split())


@lru_cache(maxsize=4)
def anchor_words(containment: float) -> frozenset[str]:
    """Words of which a paragraph has one if it contains any template's n-grams to the share of `containment`: of each template the
    rarer looking words, until the n-grams without them are too few."""
    out: set[str] = set()
    for texts in TEMPLATES.values():
        for text in texts:
            words, chosen = words_of(text), set()
            grams = ngrams(words)
            for w in sorted(set(words), key=lambda w: (w in _COMMON, -len(w), w)):
                if sum(1 for g in grams if not chosen.intersection(g.split(" "))) < containment * len(grams):
                    break
                chosen.add(w)
            out |= chosen
    return frozenset(out)


@dataclass(frozen=True, eq=False)
class Classifier:
    weights: np.ndarray  # dims x families
    bias: np.ndarray
    temperature: float

    def probabilities(self, features: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(f) for f in features], np.int64)
        sums = np.zeros((len(n), len(FAMILIES)))
        if n.sum():
            starts = (np.cumsum(n) - n)[n > 0]
            sums[n > 0] = np.add.reduceat(self.weights[np.concatenate(features)], starts, axis=0)
        z = (sums / np.sqrt(np.maximum(n, 1))[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(negatives: list[str], *, copies: int = 40, seed: int = 7, rounds: int = 60) -> Classifier:
    """Fits on noised templates and three quarters of the negative lines, calibrates on templates noised otherwise and
    the other lines."""
    rng = np.random.default_rng(seed)
    vocabulary = sorted({w for p in negatives for w in words_of(p)}) or ["text"]
    shown: list[tuple[list[str], int]] = []
    unseen: list[tuple[list[str], int]] = []

    def noised(words: list[str], drop: float) -> list[str]:
        kept = [w for w in words if rng.random() > drop]
        around = [str(rng.choice(vocabulary)) for _ in range(rng.integers(0, 6))]
        cut = int(rng.integers(0, len(around) + 1))
        return around[:cut] + kept + around[cut:]

    for k, (_, texts) in enumerate(TEMPLATES.items(), 1):
        for text in texts:
            words = words_of(text)
            shown.append((words, k))
            shown += [(noised(words, 0.08), k) for _ in range(copies)]
            # calibration sees templates in a noise that training has not: more words gone, others in between
            unseen += [(noised(words, 0.2), k) for _ in range(copies // 4)]
            for pile in (shown, unseen):
                pile += [([str(w) for w in rng.permutation(words)][: max(1, len(words) // 2)], 0) for _ in range(copies // 8)]
    lines = [words_of(p) for p in negatives]
    shown += [(w, 0) for i, w in enumerate(lines) if i % 4]
    unseen += [(w, 0) for i, w in enumerate(lines) if i % 4 == 0]
    shown, unseen = [(x, k) for x, k in shown if x], [(x, k) for x, k in unseen if x]
    order = rng.permutation(len(shown))
    x, y, n = [hashed(shown[i][0]) for i in order], np.array([shown[i][1] for i in order]), len(shown)
    w, b = np.zeros((DIMS, len(FAMILIES))), np.zeros(len(FAMILIES))
    seen = np.full((DIMS, 1), 1e-3)
    for step in range(rounds):
        for start in range(0, n, 256):
            part = range(start, min(n, start + 256))
            e = Classifier(w, b, 1.0).probabilities([x[i] for i in part])
            e[np.arange(len(part)), y[list(part)]] -= 1
            sizes = np.array([len(x[i]) for i in part])
            at, where = np.unique(np.concatenate([x[i] for i in part]), return_inverse=True)
            g = np.zeros((len(at), len(FAMILIES)))
            np.add.at(g, where, np.repeat(e / np.sqrt(np.maximum(sizes, 1))[:, None], sizes, axis=0))
            g += 1e-4 * w[at]
            seen[at, 0] += (g**2).mean(1)
            w[at] -= 0.3 * g / np.sqrt(seen[at])
            b -= 0.05 * e.mean(0)
        if step > 4 and -np.log(Classifier(w, b, 1.0).probabilities(x[:n:7])[np.arange(len(x[:n:7])), y[:n:7]] + 1e-12).mean() < 0.02:
            break
    held, want = [hashed(w) for w, _ in unseen], np.array([k for _, k in unseen])
    loss = {t: -np.log(Classifier(w, b, t).probabilities(held)[np.arange(len(want)), want] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    return Classifier(w, b, min(loss, key=loss.get))


def confirm(words: list[str], family: str) -> float:
    """The largest share of a template's n-grams that the paragraph contains."""
    own = ngrams(words)
    return max(len(t & own) / len(t) for t in _template_grams()[family])


def classify(words: list[list[str]], model: Classifier, threshold: float, containment: float) -> list[tuple[str, float]]:
    """Family and probability of each paragraph, given by its words; unknown unless sure and confirmed."""
    anchors = anchor_words(containment)
    at = [i for i, w in enumerate(words) if not anchors.isdisjoint(w)]
    out = [("unknown", 1.0)] * len(words)
    if at:
        for i, row in zip(at, model.probabilities([hashed(words[i]) for i in at]), strict=True):
            best = FAMILIES[int(row.argmax())]
            if best != "unknown" and row.max() >= threshold and confirm(words[i], best) >= containment:
                out[i] = (best, float(row.max()))
    return out


#: A wrapped text is looked for in so many times its own number of words.
STRETCH = 3


@lru_cache(maxsize=1)
def _grams_of_templates() -> tuple[dict[str, list[int]], list[tuple[int, int]]]:
    """Which templates have an n-gram, and of each template its n-grams and the words that it may stretch over."""
    held: dict[str, list[int]] = {}
    sizes = []
    for texts in TEMPLATES.values():
        for text in texts:
            words = words_of(text)
            for g in ngrams(words):
                held.setdefault(g, []).append(len(sizes))
            sizes.append((len(ngrams(words)), STRETCH * len(words)))
    return held, sizes


def wrapped_runs(words: list[list[str]], containment: float) -> list[tuple[int, int]]:
    """(first line, last line) of the runs of several lines in which a template's n-grams stand to the share of `containment`, those
    with the most of them first, of these the ones that end first, the shortest first: a window over the places of each template's n-grams."""
    held, sizes = _grams_of_templates()
    flat = [(w, i) for i, ws in enumerate(words) for w in ws]
    places: dict[int, list[tuple[int, int, str]]] = {}
    for p in range(len(flat)):
        for n in (1, 2, 3):
            if p + n <= len(flat):
                gram = flat[p][0] if n == 1 else " ".join(w for w, _ in flat[p : p + n])
                for t in held.get(gram, ()):
                    places.setdefault(t, []).append((p, p + n - 1, gram))
    runs: dict[tuple[int, int], int] = {}
    for t, hits in places.items():
        need, most = containment * sizes[t][0], sizes[t][1]
        if len({g for *_, g in hits}) < need:
            continue
        count: dict[str, int] = {}
        first = 0
        for p, end, gram in hits:
            count[gram] = count.get(gram, 0) + 1
            while hits[first][0] <= end - most or count[hits[first][2]] > 1:
                g = hits[first][2]
                count[g] -= 1
                if not count[g]:
                    del count[g]
                first += 1
            if len(count) >= need and flat[hits[first][0]][1] < flat[end][1]:
                run = (flat[hits[first][0]][1], flat[end][1])
                runs[run] = max(runs.get(run, 0), len(count))
    return sorted(runs, key=lambda r: (-runs[r], r[1], -r[0]))


def spans_of(text: str | None, model: Classifier, threshold: float, containment: float) -> tuple[int, list[dict]]:
    """Number of paragraphs, and the licence spans of a text: lines, then runs of lines that hold a licence only
    together, in the order of wrapped_runs(), without those that meet a span already found."""
    lines = text.split("\n") if text else []
    words = [words_of(x) for x in lines]
    spans: list[dict] = []
    taken: set[int] = set()
    if not anchor_words(containment).isdisjoint(w for ws in words for w in ws):
        ends = np.cumsum([len(x) + 1 for x in lines]).tolist()

        def add(i: int, j: int, family: str, p: float) -> None:
            spans.append({"line": i, "start": ends[i] - 1 - len(lines[i]), "end": ends[j] - 1, "family": family, "probability": p})
            taken.update(range(i, j + 1))

        for i, (family, p) in enumerate(classify(words, model, threshold, containment)):
            if family != "unknown":
                add(i, i, family, p)
        for i, j in wrapped_runs(words, containment) if len(lines) > 1 else ():
            if taken.isdisjoint(range(i, j + 1)):
                family, p = classify([[w for ws in words[i : j + 1] for w in ws]], model, threshold, containment)[0]
                if family != "unknown":
                    add(i, j, family, p)
    return sum(1 for x in lines if x.strip()), sorted(spans, key=lambda s: s["start"])


def sample_lines(docs: DataFrame, column: str, sample_rows: int, lines_a_row: int) -> list[str]:
    """Distinct lines of the `sample_rows` distinct texts with the smallest hashes, from each the `lines_a_row` with
    the smallest hashes; lines of licence talk that fit no template stay, those that do are left out.
    Hashes go first: the texts of the smallest ones are looked up after that, so no other text is shuffled."""
    at = docs.where(F.col(column).isNotNull()).withColumn("h", F.xxhash64(column))
    least = [r["h"] for r in at.select("h").distinct().orderBy("h").limit(sample_rows).collect()]
    texts = at.where(F.col("h").isin(least)).select("h", F.col(column).alias("t")).dropDuplicates(["h", "t"]).orderBy("h", "t").limit(sample_rows) if least else at.select("h", F.col(column).alias("t")).limit(0)
    each = F.slice(F.array_sort(F.transform(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, lines_a_row)
    found = {r["x"] for r in texts.select(F.explode(F.transform(each, lambda x: x["x"])).alias("x")).distinct().collect()}
    return sorted(x for x in found if max(confirm(words_of(x), family) for family in TEMPLATES) < 0.5)


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    containment: float = 0.7,
    sample_rows: int = 500,
    lines_a_row: int = 20,
    model: Classifier | None = None,
) -> DataFrame:
    """One row per document row: id, n_paragraphs and found, an array of (line, start, end, family,
    probability) in code points.  Every paragraph of every whole text is judged; only the unknown
    class is trained on a sample, whose bounds are `sample_rows` texts and `lines_a_row` lines of each.
    Null and empty texts have no paragraphs; repeated rows give repeated results and weigh once in the
    sample; an empty table gives no rows; columns but the two named are not looked at.  Narrow."""
    spark = docs.sparkSession
    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        model = train(sample_lines(at, "text", sample_rows, lines_a_row))
    sent = spark.sparkContext.broadcast(model)
    pattern = "(?i)" + "|".join(re.escape(w) for w in sorted(anchor_words(containment)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("licenses")
        for batch in slices(batches):
            # most texts have no word that a licence must have: one pass by a compiled pattern, and they are done
            some = pc.fill_null(pc.match_substring_regex(batch.column(1), pattern), False).to_pylist()
            texts = batch.column(1).to_pylist()
            found = [spans_of(text, sent.value, threshold, containment) if near else (sum(1 for x in (text or "").split("\n") if x.strip()), []) for text, near in zip(texts, some, strict=True)]
            kind = pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], kind)], names=["id", "n_paragraphs", "found"])

    kind = at.schema["id"].dataType.simpleString()
    return at.mapInArrow(run, f"id {kind}, n_paragraphs long, found array<struct<line:int,start:int,end:int,family:string,probability:double>>").withColumnRenamed("id", id_col)
