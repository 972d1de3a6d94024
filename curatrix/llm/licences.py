"""Licence scans with a trained paragraph classifier, in DataFrame functions only.

A paragraph is the text between line feeds; its words are runs of ASCII letters
and digits, lower-cased.  Features are the distinct words and word pairs of the
licence templates that hold at least one word outside a list of common words; a
multinomial logistic regression over them is trained on the templates'
sentences, on variants of them, on licence-like sentences of no listed family
(class ``unknown``) and on scrambled or unrelated ones (class ``none``).
Probabilities are tempered on held-out variants; a family below ``SURE`` becomes
``unknown``.  A prediction is confirmed if the paragraph shares at least
``SHARED`` of the word pairs of the smaller of itself and some template sentence
of the family; unconfirmed families also become ``unknown``.

Training reads only the fixed texts below, so it is bounded and the same
everywhere.  Scanning is one projection over the documents: no shuffle, no
join, one row out per row in.

Defined cases: null and empty texts have no paragraphs and no hits; ties between
classes go to the first in alphabetical order; repeated rows are each scanned;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SURE, SHARED = 0.5, 0.5
SEED = 7

# Public licence notices and the sentences licences are known by.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
        "Released into the public domain under CC0.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies.",
        "Licensed under the ISC License.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright Example Corporation. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
# Licence-like sentences of no listed family.
UNKNOWN = [
    "Licensed under the terms of the accompanying agreement.",
    "This software is licensed under a custom license.",
    "See the LICENSE file for license details.",
    "Distributed under the Eclipse Public License.",
    "Licensed under the Artistic License.",
    "Released under the zlib license.",
    "Use of this work is governed by the license agreement of its publisher.",
    "Licensed under the European Union Public Licence.",
    "This material may be used under license from its owner.",
    "Released under the Open Database License.",
]
# Sentences that share words with licences but state none.
NONE = [
    "The driver lost his license after the second accident.",
    "Copies of the public notice were distributed in the city.",
    "Version 3 of the program includes a new source editor.",
    "The general of the free army asked for permission to leave.",
    "She reserved a table and paid the fee for all.",
    "The work of the foundation is published every year.",
    "The apache helicopter landed near the public library.",
    "Students of MIT modified the software for this purpose.",
    "He has all rights to the commons and the land.",
    "Creative writing is the domain of the author.",
    "The warranty of this file cabinet covers any medium damage.",
]
# Words that alone are no feature.
COMMON = frozenset("a an and any are as at be by can do either for from has have he his in into is it its lost may new not of on or other she should such that the their this to under used via was were will with without you your 0 1 2 3 4 www http".split())
_WORDS = re.compile("[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {g for g in {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))} if not COMMON.issuperset(g.split())}


def _variants(words: list[str], rng: random.Random) -> list[list[str]]:
    """The sentence, it within others, and with words missing or replaced."""
    filler = ["lorem", "project", "page", "see", "note", "our", "text", "here", "below"]
    out = [words]
    for _ in range(6):
        kept = [w for w in words if rng.random() > 0.08]
        out.append([*rng.sample(filler, rng.randrange(3)), *kept, *rng.sample(filler, rng.randrange(3))])
    if len(words) > 14:
        for _ in range(4):
            i = rng.randrange(len(words) - 10)
            out.append(words[i : i + rng.randrange(8, 13)])
    return [v for v in out if v]


class Classifier:
    """Weights [features, classes], intercepts and temperature of the trained regression."""

    def __init__(self) -> None:
        rng = random.Random(SEED)
        self.classes = sorted([*TEMPLATES, "none", "unknown"])
        texts = [(c, words_of(t)) for c, ts in [*TEMPLATES.items(), ("unknown", UNKNOWN), ("none", NONE)] for t in ts]
        features = sorted(set().union(*(grams_of(w) for _, w in texts)))
        self.index = {g: i for i, g in enumerate(features)}
        rows: list[tuple[str, list[str]]] = []
        held: list[tuple[str, list[str]]] = []
        for c, w in texts:
            for v in _variants(w, rng):
                (held if rng.random() < 0.2 and v is not w else rows).append((c, v))
            if c not in ("none", "unknown"):
                for _ in range(2):  # single words of a licence are none
                    rows.append(("none", rng.sample(w, min(len(w), 2))))
        rows.append(("none", []))
        x, y = self._matrix(rows)
        n = len(self.classes)
        w, b = np.zeros((len(features), n)), np.zeros(n)
        target = np.eye(n)[y]
        for step in range(400):
            p = self._softmax(x @ w + b)
            g = (p - target) / len(y)
            rate = 6.0 / (1 + step / 200)
            w -= rate * (x.T @ g + 1e-4 * w)
            b -= rate * g.sum(0)
        hx, hy = self._matrix(held)
        loss = {t: -np.log(self._softmax((hx @ w + b) / t)[np.arange(len(hy)), hy] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
        t = min(loss, key=loss.get)
        self.weights, self.intercepts = np.round(w / t, 6), np.round(b / t, 6)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _matrix(self, rows: list[tuple[str, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(self.index)))
        for i, (_, w) in enumerate(rows):
            x[i, [self.index[g] for g in grams_of(w) if g in self.index]] = 1
        return x, np.array([self.classes.index(c) for c, _ in rows])

    def scan(self, line: str) -> tuple[str, float] | None:
        """The same decision in plain Python, for tests: (family, probability), or None."""
        words = words_of(line)
        z = self.intercepts + sum((self.weights[self.index[g]] for g in grams_of(words) if g in self.index), np.zeros(len(self.classes)))
        p = self._softmax(z[None])[0]
        k = int(p.argmax())
        if self.classes[k] == "none":
            return None
        pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        shared = max((len(pairs & t) / min(len(pairs), len(t)) for t in template_pairs().get(self.classes[k], []) if pairs and t), default=0.0)
        return (self.classes[k] if p[k] >= SURE and shared >= SHARED else "unknown"), float(p[k])


@functools.cache
def classifier() -> Classifier:
    return Classifier()


@functools.cache
def template_pairs() -> dict[str, list[set[str]]]:
    return {c: [{f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} for w in map(words_of, ts)] for c, ts in TEMPLATES.items()}


def _strings(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with hits: array of (line, family, probability, similarity) of the paragraphs that state a licence."""
    model = classifier()
    names = model.classes
    # a paragraph without any of these words has no feature: the intercepts alone decide, for class none
    anchors = sorted({w for g in model.index for w in g.split() if w not in COMMON})
    weights = F.create_map(*[x for g, i in model.index.items() for x in (F.lit(g), F.array(*[F.lit(float(v)) for v in model.weights[i]]))])
    pairs = F.create_map(*[x for c in names for x in (F.lit(c), F.array(*[_strings(sorted(t)) for t in template_pairs().get(c, []) if t] or [F.array().cast("array<string>")]))])

    words = lambda line: F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")
    lines = F.transform(F.split(F.col(text), "\n"), lambda line, i: F.struct(i.alias("line"), words(line).alias("words")))
    found = F.filter(lines, lambda x: F.arrays_overlap(x["words"], _strings(anchors)))
    pair = lambda w: F.array_distinct(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda b, i: F.concat(F.get(w, i), F.lit(" "), b)))
    with_pairs = F.transform(found, lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), pair(x["words"]).alias("pairs")))
    with_rows = F.transform(
        with_pairs,
        lambda x: F.struct(x["line"].alias("line"), x["pairs"].alias("pairs"), F.filter(F.transform(F.array_union(F.array_distinct(x["words"]), x["pairs"]), lambda g: F.try_element_at(weights, g)), lambda r: r.isNotNull()).alias("rows")),
    )
    adds = lambda k: lambda s, r: s + F.get(r, F.lit(k))
    logits = lambda x: F.array(*[F.aggregate(x["rows"], F.lit(float(model.intercepts[k])), adds(k)) for k in range(len(names))])
    with_logits = F.transform(with_rows, lambda x: F.struct(x["line"].alias("line"), x["pairs"].alias("pairs"), logits(x).alias("z")))

    def decided(x):
        top = F.array_max(x["z"])
        name = F.get(_strings(names), (F.array_position(x["z"], top) - 1).cast("int"))
        p = 1 / F.aggregate(x["z"], F.lit(0.0), lambda s, z: s + F.exp(z - top))
        share = F.transform(F.element_at(pairs, name), lambda t: F.size(F.array_intersect(t, x["pairs"])) / F.greatest(F.least(F.size(t), F.size(x["pairs"])), F.lit(1)))
        return F.struct(x["line"].alias("line"), name.alias("name"), p.alias("p"), F.coalesce(F.array_max(share), F.lit(0.0)).alias("shared"))

    hits = F.transform(
        F.filter(F.transform(with_logits, decided), lambda x: x["name"] != "none"),
        lambda x: F.struct(x["line"].alias("line"), F.when((x["p"] >= SURE) & (x["shared"] >= SHARED), x["name"]).otherwise(F.lit("unknown")).alias("family"), x["p"].alias("probability"), x["shared"].alias("similarity")),
    )
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "hits"], F.coalesce(hits, F.array().cast("array<struct<line:int,family:string,probability:double,similarity:double>>")).alias("hits"))


def op9_licences(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, families (sorted, comma-joined), n_hits, hits."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["family"]))), ",")
    return out.select("doc_id", families.alias("families"), F.size("hits").cast("long").alias("n_hits"), "hits")
