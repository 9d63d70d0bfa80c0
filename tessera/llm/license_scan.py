"""Licence scans: a paragraph classifier over word n-grams, confirmed by comparison with templates.

Paragraphs are the lines of a text, and notices that are wrapped over lines. A softmax regression over the 1- to 3-grams of the templates' words (n-grams of
common words alone left out, small weights pruned) gives each paragraph a licence family or `unknown`. It is trained
here on the templates with words dropped, put in and cut off, against ordinary paragraphs: at most LINES stretches of
STRETCH words of the lines of at most SAMPLE documents, both chosen by hashes (bounds of the training sample; what is
scanned has none), and the templates' own words out of order. The temperature that calibrates it is fitted on wordings that
had no part in training: the templates are dealt to FOLDS, and each fold is scored by a model of the others. A family needs
THRESHOLD. The prediction is confirmed if a template of that family has SHARED of its shingles (SHINGLE words; shorter
templates: all their words as one) in the paragraph.

Wrapped notices are looked for in the joined words of consecutive lines that are not blank: least stretches that hold
SHARED of a template's shingles, joined where they overlap up to twice the shortest, are classified and confirmed like
lines (line breaks and the signs of comments are no words). One that is confirmed takes the place of what its lines gave for its family, or
unconfirmed. n_paragraphs counts lines alone. Lines of which half the shingles are a template's, parts of wrapped
notices, are no ordinary paragraphs to learn from.

Cases: a null text counts as empty: no paragraph, no family. Blank lines are no paragraphs. Repeated rows are returned
each; null doc_ids are kept; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import mapped, table

SAMPLE, LINES, STRETCH = 2_000, 2_000, 60
COPIES, STEPS, FOLDS = 14, 60, 3
THRESHOLD = 0.5
SHINGLE, SHARED = 5, 0.8
UNKNOWN = "unknown"
PRUNE = 0.02

#: Wordings of licence notices, by family (fixed values).
TEMPLATES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": [
        "Released into the public domain under CC0 1.0.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "epl": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "isc": [
        "Released under the ISC License.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced or distributed in any form without prior written permission of the publisher.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
}
COMMON = frozenset(
    b"a above all along also an and any are as at be but by can copy even ever every first following for form forms free from has have he her his how however if in into is it its made may means met "
    b"more no nor not of on one only or other out own part person provided rights see shall so such that the their there these they this those to under use used was were whether which who will with "
    b"within without work you your v".split()
)
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 or c == 10 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def grams(own: list[bytes]) -> set[bytes]:
    """The 1- to 3-grams of words that hold a word beyond the common ones."""
    out = set()
    for n in (1, 2, 3):
        for i in range(len(own) - n + 1):
            part = own[i : i + n]
            if not COMMON.issuperset(part):
                out.add(b" ".join(part))
    return out


def shingles(own: list[bytes]) -> set[bytes]:
    return {b" ".join(own[i : i + SHINGLE]) for i in range(max(1, len(own) - SHINGLE + 1))}


def softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax regression over rows of zeros and ones, small weights pruned."""
    truth = np.eye(classes, dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    square = np.full_like(w, 1e-6)
    for _ in range(STEPS):
        g = softmax(x @ w + b) - truth
        step = x.T @ g / len(x) + 1e-5 * w
        square += step**2
        w -= 0.3 * step / np.sqrt(square)
        b -= 0.5 * g.mean(0)
    w[np.abs(w) < PRUNE] = 0
    return w, b


class Model:
    """Families, n-gram weights, temperature and the templates' shingles."""

    def __init__(self, negatives: list[bytes]):
        self.families = [UNKNOWN, *sorted(TEMPLATES)]
        templates = [(self.families.index(f), words(t.encode())) for f, ts in sorted(TEMPLATES.items()) for t in ts]
        self.shingles = [(k, shingles(w), len(w)) for k, w in templates]
        vocabulary = sorted({g for _, w in templates for g in grams(w)})
        self.column = {g: i for i, g in enumerate(vocabulary)}
        self.content = frozenset(w for _, t in templates for w in t) - COMMON
        # By template: its content words, how many of them a text may lack, its shingles, their size and how many it needs.
        self.wrapped = []
        for _, s, n in self.shingles:
            need = math.ceil(SHARED * len(s))
            own = frozenset(w for x in s for w in x.split()) - COMMON
            self.wrapped.append((own, len(own) - len(s) + need, s, min(n, SHINGLE), need))
        rng = np.random.default_rng(11)
        noise = [w for t in negatives for w in words(t)] or [b"text"]
        some = lambda n: [noise[i] for i in rng.integers(len(noise), size=n)]
        rows, y, of = [], [], []  # of: the template that a row was made from
        for _ in range(COPIES):
            for place, (k, w) in enumerate(templates):
                own = [x for x in w if rng.random() > 0.08]
                if rng.random() < 0.3:
                    own = own[: max(3, int(len(own) * rng.uniform(0.6, 1)))]
                at = rng.integers(len(own) + 1)
                rows.append(some(rng.integers(0, 8)) + own[:at] + some(rng.integers(0, 2)) + own[at:] + some(rng.integers(0, 30)))
                mixed = [w[i] for i in rng.permutation(len(w))[: rng.integers(1, max(2, min(12, len(w) // 2)))]]
                rows.append(some(rng.integers(0, 30)) + mixed + some(rng.integers(0, 30)))
                y += [k, 0]
                of += [place, place]
        parts = frozenset().union(*(s for _, s, _ in self.shingles))
        known = [t for t in negatives if not any(len(s & shingles(words(t))) >= SHARED * len(s) for _, s, _ in self.shingles)]
        known = [t for t in known if 2 * len(parts & (own := shingles(words(t)))) < len(own)]
        rows += [words(t) for t in known]
        y, of = np.array(y + [0] * len(known)), np.array(of + [*range(len(known))])
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, own in enumerate(rows):
            x[i, [self.column[g] for g in grams(own) if g in self.column]] = 1
        scores = np.empty((len(y), len(self.families)), np.float32)
        for k in range(FOLDS):
            held = of % FOLDS == k
            w, b = fit(x[~held], y[~held], len(self.families))
            scores[held] = x[held] @ w + b
        loss = {t: -np.log(softmax(scores / t)[np.arange(len(y)), y] + 1e-9).mean() for t in np.geomspace(0.2, 5, 40)}
        self.temperature = float(min(loss, key=loss.get))
        self.weights, self.bias = fit(x, y, len(self.families))

    def paragraph(self, own: list[bytes]) -> tuple[int, float, bool]:
        """Family, its calibrated probability and whether a template confirms it; family 0 is unknown."""
        at = [self.column[g] for g in grams(own) if g in self.column]
        score = (self.weights[at].sum(0) + self.bias) / self.temperature
        p = np.exp(score - score.max())
        p /= p.sum()
        k = int(p.argmax())
        if not k or p[k] < THRESHOLD:
            return 0, float(p[0]), False
        there = shingles(own) if len(own) >= SHINGLE else {b" ".join(own)}
        padded = b" " + b" ".join(own) + b" "
        hold = lambda s, n: len(s & there) if n >= SHINGLE else sum(b" " + x + b" " in padded for x in s)
        return k, float(p[k]), any(hold(s, n) >= SHARED * len(s) for f, s, n in self.shingles if f == k)

    def notices(self, own: list[bytes], lines: list[int]) -> list[tuple[int, int]]:
        """Stretches (first and after, in words) of consecutive lines' words that hold SHARED of a template's shingles and
        lie in several lines; lines has the line of each word."""
        there = frozenset(own)
        found = []
        for content, least, s, size, need in self.wrapped:
            if len(content & there) < least:
                continue
            held: deque[tuple[int, bytes]] = deque()
            count: Counter[bytes] = Counter()
            for i in range(len(own) - size + 1):
                if (x := b" ".join(own[i : i + size])) not in s:
                    continue
                held.append((i, x))
                count[x] += 1
                while count[held[0][1]] > 1 or len(count) > need:
                    y = held.popleft()[1]
                    count[y] -= 1
                    if not count[y]:
                        del count[y]
                if len(count) == need and lines[held[0][0]] < lines[i + size - 1]:
                    found.append((held[0][0], i + size))
        taken: list[tuple[int, int, int]] = []
        holder = [0] * len(own)
        for a, b in sorted(found, key=lambda x: (x[1] - x[0], x[0])):
            met = {*holder[a:b]} - {0}
            if not met:
                taken.append((a, b, 2 * (b - a)))
                met = {len(taken)}
            k = min(met)
            first, after, most = taken[k - 1]
            first, after = min(a, first), max(b, after)
            if len(met) == 1 and after - first <= most:
                taken[k - 1] = first, after, most
                holder[a:b] = [k] * (b - a)
        return sorted((a, b) for a, b, _ in taken)

    def joined(self, found: list[dict], block: list[list[bytes]], place: int) -> list[dict]:
        """found, what lines gave, with the wrapped notices of a block of lines, the first of which is at `place`."""
        own = [w for line in block for w in line]
        lines = [place + i for i, line in enumerate(block) for _ in line]
        for a, b in self.notices(own, lines):
            k, p, sure = self.paragraph(own[a:b])
            if sure:
                first, last, family = lines[a], lines[b - 1], self.families[k]
                found = [f for f in found if not (first <= f["place"] <= last and (f["family"] == family or not f["confirmed"]))]
                found.append({"place": first, "family": family, "score": p, "confirmed": True})
        return sorted(found, key=lambda f: f["place"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model, with stretches of lines of at most `sample` documents as ordinary paragraphs."""
    share = min(1.0, sample / max(1, docs.count()))
    chosen = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).select("text")
    lines = chosen.select(F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''").select(F.split("line", " +").alias("words"))
    starts = F.sequence(F.lit(1), F.size("words"), F.lit(STRETCH))
    stretches = lines.select("words", F.explode(starts).alias("at")).select(F.array_join(F.slice("words", F.col("at"), STRETCH), " ").alias("line"))
    held = stretches.filter(F.length("line") <= 100 * STRETCH).distinct().orderBy(F.xxhash64("line"), "line").limit(LINES).collect()
    return Model([r["line"].encode() for r in held])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, n_paragraphs, n_predicted, n_confirmed, families (confirmed, comma-joined), score (the
    greatest probability of a family, 0 without one) and paragraphs: (place, of the first line, family, score, confirmed) of those predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        content = own.content
        for batch in batches:
            rows = []
            for t in batch.column("text").cast(pa.binary()):
                n, found = 0, []
                block: list[list[bytes]] = []
                for line in [*(t.as_py() or b"").translate(PLAIN).split(b"\n"), b""]:
                    w = line.split()
                    if not w:
                        if len(block) > 1:
                            found = own.joined(found, block, n - len(block))
                        block = []
                        continue
                    block.append(w)
                    if not content.isdisjoint(w):
                        k, p, sure = own.paragraph(w)
                        if k:
                            found.append({"place": n, "family": own.families[k], "score": p, "confirmed": sure})
                    n += 1
                sure = [f["family"] for f in found if f["confirmed"]]
                rows.append((n, len(found), len(sure), ",".join(sorted({*sure})), max([f["score"] for f in found], default=0.0), found))
            yield pa.record_batch([batch.column("doc_id"), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names)

    names = ["doc_id", "n_paragraphs", "n_predicted", "n_confirmed", "families", "score", "paragraphs"]
    each = pa.struct([("place", pa.int64()), ("family", pa.string()), ("score", pa.float64()), ("confirmed", pa.bool_())])
    kinds = [pa.int64()] * 3 + [pa.string(), pa.float64(), pa.list_(each)]
    schema = docs.select("doc_id").selectExpr("doc_id", *[f"0L AS {c}" for c in names[1:4]], "'' AS families", "0D AS score", "array(named_struct('place', 0L, 'family', '', 'score', 0D, 'confirmed', true)) AS paragraphs").schema
    for field in schema:
        field.nullable = True
    return mapped(docs.select("doc_id", "text"), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs)).drop("paragraphs")
