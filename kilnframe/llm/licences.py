"""Licence scan: a trained paragraph classifier whose finds are confirmed by templates.

Paragraphs are lines and runs of adjacent lines, as notices are often wrapped;
a line without words ends a run. Their features are words and pairs of words that occur in
the templates. A softmax regression gives the probability of each licence family
and of ``unknown``; it is trained on varied templates and on paragraphs of the
corpus itself, and its temperature is fitted on other variations. Notices that
are denied or past ("is not licensed under", "was licensed under") are trained as
``unknown``. A predicted family counts only if the paragraph holds most of one of
its templates, and something of it that no other family's templates have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Notices by which works state their licence.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Released under the GPL v3 license.",
    ),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License.", "Licensed under the LGPL version 2.1 or later.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved. No part of this work may be reproduced without permission.", "This software is proprietary and confidential."),
}
UNKNOWN = "unknown"
#: The tags by which files name their licence.
TAGS = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache-2.0",), "GPL-2.0": ("GPL-2.0-only", "GPL-2.0-or-later"), "GPL-3.0": ("GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"), "AGPL-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "MPL-2.0": ("MPL-2.0",), "CC-BY": ("CC-BY-4.0",), "CC-BY-SA": ("CC-BY-SA-4.0",), "CC-BY-NC": ("CC-BY-NC-4.0",), "CC0": ("CC0-1.0",), "ISC": ("ISC",), "Unlicense": ("Unlicense",),
}
#: What makes a notice one that doesn't hold, in place of "is".
DENIALS = ("is not", "is never", "is no longer", "was", "was not", "was never", "was formerly", "was previously", "was originally")
DENYING = frozenset(d.split()[-1] for d in DENIALS)
#: Words too common to say that a paragraph could be a notice.
COMMON = frozenset("a all and any as author be by can do either except files for form forms foundation free from in is it its later library may met modify no not of on only option or other part person possible program published purpose redistribute software source terms that the this to under use used version with without work you your 0 1 2 3 4 v3".split())
_WORD = re.compile(r"[a-z]+|\d+")


def features(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:]))}


def denials(words: list[str]) -> list[tuple[list[str], list[str]]]:
    """A notice denied or put in the past, and for each the word that does so with the next one; none if it has no "is" and begins with no participle."""
    before, after = (words[: words.index("is")], words[words.index("is") + 1 :]) if "is" in words else (["this"], words)
    if after == words and not words[0].endswith("ed"):
        return []
    return [([*before, *d.split(), *after], [d.split()[-1], after[0]]) for d in DENIALS]


@dataclass
class Classifier:
    families: list[str]
    names: dict[str, int]
    weights: np.ndarray
    temperature: float
    triggers: frozenset[str]
    templates: dict[str, list[frozenset[str]]]
    reach: int

    def __post_init__(self) -> None:
        own = {f: frozenset().union(*ts) - frozenset().union(*(t for g, us in self.templates.items() if g != f for t in us)) for f, ts in self.templates.items()}
        self.listed = [(f, t, t & own[f]) for f, ts in self.templates.items() for t in ts]
        self.holding: dict[str, list[int]] = {}
        for k, (_, t, _) in enumerate(self.listed):
            for w in t:
                self.holding.setdefault(w, []).append(k)

    def row(self, words: list[str]) -> np.ndarray:
        return self.numbers(features(words))

    def numbers(self, have: set[str]) -> np.ndarray:
        return np.array(sorted({self.names[f] for f in have if f in self.names}), np.int64)

    def probabilities(self, have: set[str]) -> np.ndarray:
        z = (self.weights[0] + self.weights[1:][self.numbers(have)].sum(0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def confirmed(self, have: set[str], family: str, share: float) -> float:
        """How much of a template of the family is there, if that is ``share`` at least, with something that only this family has (if its template has such)."""
        best = max((len(t & have) / len(t) for f, t, own in self.listed if f == family and (not own or own & have)), default=0.0)
        return best if best >= share else 0.0

    def paragraph(self, have: set[str], least: float, share: float) -> tuple[str, float, float] | None:
        p = self.probabilities(have)
        k = int(p.argmax())
        if self.families[k] == UNKNOWN or p[k] < least:
            return None
        held = self.confirmed(have, self.families[k], share)
        return (self.families[k], float(p[k]), held) if held else None

    def notices(self, text: str, least: float, share: float) -> list[tuple[int, str, float, float]]:
        """Confirmed paragraphs by their first line, no two with a line in common.

        A run goes on until the lines after its first hold twice the words of
        the longest template; what it holds of each template is counted as
        lines join it. If the line before it ends in a word of denial, that
        word counts as the run's first. Of paragraphs that overlap, the one that
        holds most of its template counts, then the one of fewest lines.
        """
        lines = [_WORD.findall(line) for line in text.lower().split("\n")]
        hot = [not self.triggers.isdisjoint(w) for w in lines]
        found = []
        for i, first in enumerate(lines):
            if not first:
                continue
            last = lines[i - 1][-1] if i and lines[i - 1] and lines[i - 1][-1] in DENYING else None
            have: set[str] = {last} if last else set()
            counts, full = [0] * len(self.listed), False
            any_hot, j, n = False, i, 0
            while True:
                any_hot = any_hot or hot[j]
                for w in lines[j]:
                    for f in (w, f"{last} {w}") if last else (w,):
                        if f in self.names and f not in have:
                            have.add(f)
                            for k in self.holding.get(f, ()):
                                counts[k] += 1
                                full = full or counts[k] >= share * len(self.listed[k][1])
                    last = w
                if full and any_hot and (hit := self.paragraph(have, least, share)):
                    found.append((-hit[2], j - i, i, hit))
                n += len(lines[j]) if j > i else 0
                j += 1
                if j == len(lines) or not lines[j] or n >= self.reach:
                    break
        taken: set[int] = set()
        out = []
        for _, more, i, f in sorted(found):
            if taken.isdisjoint(range(i, i + more + 1)):
                taken.update(range(i, i + more + 1))
                out.append((i, *f))
        return sorted(out)


def _varied(words: list[str], rng: np.random.Generator, noise: list[str]) -> list[str]:
    """A notice as it might stand in a text: some words gone, others around it."""
    kept = [w for w in words if rng.random() > 0.1] or words
    pad = lambda: [noise[int(i)] for i in rng.integers(0, len(noise), rng.integers(0, 8))] if noise else []
    before = pad()
    while before and before[-1] in DENYING:  # else it would be denied
        before.pop()
    return before + kept + pad()


def _softmax(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 300, rate: float = 2.0, l2: float = 1e-4) -> np.ndarray:
    w = np.zeros((x.shape[1], k))
    goal = np.eye(k)[y]
    for _ in range(rounds):
        z = x @ w
        e = np.exp(z - z.max(1, keepdims=True))
        w -= rate * (x.T @ (e / e.sum(1, keepdims=True) - goal) / len(x) * 10 + l2 * w)
    return w


def notices_of(templates: dict[str, tuple[str, ...]], tags: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """Templates with a tag line for each of a family's tags."""
    return {f: (*ts, *(f"SPDX-License-Identifier: {v}" for v in tags.get(f, ()))) for f, ts in templates.items()}


def fit(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, tags: dict[str, tuple[str, ...]] = TAGS, most_paragraphs: int = 3_000, copies: int = 30, seed: int = 7) -> Classifier:
    """Train on ``copies`` variations of each template and on paragraphs of ``docs`` for ``unknown``.

    At most ``most_paragraphs`` of those are taken, the first by a hash, without
    any that hold half of a template; the driver gets no more.
    """
    templates = notices_of(templates, tags)
    sets = {f: [frozenset(features(_WORD.findall(t.lower()))) for t in ts] for f, ts in templates.items()}
    line = F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")
    h = F.xxhash64("doc_id")
    cut = texts(docs).select(h.alias("h")).orderBy("h").limit(most_paragraphs // 3).agg(F.max("h")).first()[0]  # so that only the sample's texts are sorted
    some = texts(docs).where(h <= F.lit(cut).cast("long")).orderBy(h, "text").limit(most_paragraphs // 3).select("doc_id", line)
    plain = [_WORD.findall(r.line.lower()) for r in some.where("trim(line) <> ''").orderBy(F.xxhash64("doc_id", "line"), "line").limit(most_paragraphs).collect()]
    plain = [w for w in plain if w and not any(len(t & features(w)) >= 0.5 * len(t) for ts in sets.values() for t in ts)]
    rng = np.random.default_rng(seed)
    noise = [w for p in plain[:300] for w in p]
    families = [UNKNOWN, *templates]
    denied = [d for ts in templates.values() for t in ts for d in denials(_WORD.findall(t.lower()))]
    marks = {f for _, mark in denied for f in features(mark)}
    held = set().union(*(t for ts in sets.values() for t in ts))
    names = {f: i for i, f in enumerate(sorted(held))}
    names |= {f: len(held) for f in sorted(marks - held) if " " in f}  # all words of denial before a participle are one feature
    model = Classifier(families, names, np.zeros((len(names) + 1, len(families))), 1.0, frozenset(w for w in held if " " not in w and w not in COMMON), sets, 2 * max(len(_WORD.findall(t.lower())) for ts in templates.values() for t in ts))

    def sample(n: int) -> tuple[np.ndarray, np.ndarray]:
        rows, y = [], []
        for k, ts in enumerate(templates.values(), 1):
            for t in ts:
                for _ in range(n):
                    rows.append(_varied(_WORD.findall(t.lower()), rng, noise))
                    y.append(k)
        vocabulary = sorted(model.triggers)
        for p in plain[:: max(1, 30 // n)]:  # as they are, and with single words of notices in them
            rows.append(p)
            rows.append(p[:40] + [vocabulary[int(i)] for i in rng.integers(0, len(vocabulary), 2)])
            y += [0, 0]
        for words, _ in denied:
            for _ in range(max(1, n // 3)):
                pad = [noise[int(i)] for i in rng.integers(0, len(noise), rng.integers(0, 8))] if noise else []
                rows.append(words + pad)
                y.append(0)
        for k in range(2 * n):  # tags of other licences
            rows.append(["spdx", "license", "identifier", *[noise[int(i)] for i in rng.integers(0, len(noise), k % 3)]] if noise else ["spdx"])
            y.append(0)
        rows.append([])
        y.append(0)
        x = np.zeros((len(rows), len(names) + 1))
        x[:, 0] = 1
        for i, r in enumerate(rows):
            x[i, 1 + model.row(r)] = 1
        return x, np.array(y)

    x, y = sample(copies)
    model.weights = _softmax(x, y, len(families))
    x, y = sample(max(1, copies // 3))
    z = x @ model.weights

    def loss(t: float) -> float:
        e = z / t - (z / t).max(1, keepdims=True)
        return float(-(e[np.arange(len(y)), y] - np.log(np.exp(e).sum(1))).mean())

    model.temperature = min((0.25, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    return model


def scan(docs: DataFrame, model: Classifier, least: float = 0.5, share: float = 0.7) -> DataFrame:
    """One row for each confirmed paragraph: ``(doc_id, paragraph, family, probability, held)``.

    ``paragraph`` is its first line, counted from 0; ``held`` is the share of the template
    found. A paragraph without a word of the families' own vocabulary is
    unknown. Empty and null texts have no rows.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(i, *found) for i, t in zip(pdf.doc_id, pdf.text) for found in model.notices(t, least, share)]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "paragraph", "family", "probability", "held"])

    return texts(docs).mapInPandas(run, "doc_id long, paragraph int, family string, probability double, held double")


def query(docs: DataFrame, least: float = 0.5, share: float = 0.7) -> DataFrame:
    """One row for each row of ``docs`` that has a ``doc_id``: its lines, its confirmed paragraphs, and the families in order, joined by commas."""
    model = fit(docs)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, t in zip(pdf.doc_id, pdf.text):
                found = model.notices(t, least, share)
                out.append((i, t.count("\n") + 1 if t else 0, len(found), ",".join(sorted({f[1] for f in found})), max((f[2] for f in found), default=0.0)))
            yield pd.DataFrame(out, columns=["doc_id", "n_paragraphs", "n_licensed", "families", "probability"])

    return texts(docs).mapInPandas(run, "doc_id long, n_paragraphs long, n_licensed long, families string, probability double")
