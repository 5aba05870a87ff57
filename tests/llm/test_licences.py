"""The licence scan: notices it was not trained on, denied and past ones, tags, and a plain version of the search for paragraphs."""

import re

import numpy as np
import pytest

from kilnframe.llm import licences as L

#: Notices that are not in TEMPLATES, with their family; None for what is no notice.
HELD_OUT = [
    ("LGPL", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MIT", "The library is distributed under the MIT license."),
    ("MIT", "All code here is released under the MIT License, see LICENSE."),
    ("Apache-2.0", "This code is licensed under the Apache License, Version 2.0."),
    ("CC-BY-SA", "Our data are licensed under CC BY-SA 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-only"),
    (None, "SPDX-License-Identifier: Zlib"),
    (None, "This project is not licensed under the MIT License."),
    (None, "This code is not\nlicensed under the MIT License."),
    (None, "It was licensed under the Apache License, Version 2.0 but we dropped it."),
    (None, "The tool is no longer released under the BSD 3-Clause License."),
    (None, "The licence of a fisher and the gnu of the general public."),
]


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(2)
    words = "the river was stone green light open page of paper winter and number field not hand line a market in to glass sound mit".split()
    rows = [(i, "\n".join(" ".join(rng.choice(words, rng.integers(4, 20))) for _ in range(6))) for i in range(400)]
    return L.fit(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("family, text", HELD_OUT)
def test_held_out(model, family, text):
    for around in ("{}", "the river was green\n\n{}\n\nan open page"):
        assert {f[1] for f in model.notices(around.format(text), 0.5, 0.7)} == ({family} if family else set())


def plain(model, text, least, share):
    """Every run of lines, its features made anew."""
    lines = [re.findall(r"[a-z]+|\d+", line) for line in text.lower().split("\n")]
    found = []
    for i in range(len(lines)):
        before = lines[i - 1][-1:] if i and lines[i - 1] and lines[i - 1][-1] in L.DENYING else []
        for j in range(i, len(lines)):
            run = lines[i : j + 1]
            if not all(run) or sum(map(len, run[1:-1])) >= model.reach:
                break
            have = L.features([*before, *(w for line in run for w in line)]) & model.names.keys()
            if any(not model.triggers.isdisjoint(line) for line in run) and any(len(t & have) >= share * len(t) for ts in model.templates.values() for t in ts):
                p = model.probabilities(have)
                family = model.families[int(p.argmax())]
                held = 0.0 if family == L.UNKNOWN or p.max() < least else model.confirmed(have, family, share)
                if held:
                    found.append((-held, j - i, i, (family, float(p.max()), held)))
    taken, out = set(), []
    for _, more, i, f in sorted(found):
        if not taken & set(range(i, i + more + 1)):
            taken |= set(range(i, i + more + 1))
            out.append((i, *f))
    return sorted(out)


def test_paragraphs_against_plain_search(model):
    rng = np.random.default_rng(9)
    pool = [t for ts in L.notices_of(L.TEMPLATES, L.TAGS).values() for t in ts] + [t for _, t in HELD_OUT]
    hits = 0
    for _ in range(60):
        words = []
        for _ in range(rng.integers(1, 6)):
            words += str(rng.choice(pool)).split() + ["\n"] * int(rng.integers(0, 3)) + ["is", "not"] * int(rng.integers(0, 2))
        text = "".join(w if w == "\n" else w + ("\n" if rng.random() < 0.15 else " ") for w in words)
        got = model.notices(text, 0.5, 0.7)
        assert got == plain(model, text, 0.5, 0.7)
        hits += len(got)
    assert hits > 60


def test_texts_of_every_shape(spark, model):
    notice = "Released under the MIT License."
    long = "\n".join(["a licensed word of a line"] * 60_000 + ["", notice])
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, notice), (4, notice), (None, notice), (5, notice + "\n\n" + notice), (6, long), (7, "x" * 2_000_000 + " " + notice)]
    got = [(r.doc_id, r.paragraph, r.family) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as family", "2 as held"), model).collect()]
    assert sorted(got) == [(4, 0, "MIT"), (4, 0, "MIT"), (5, 0, "MIT"), (5, 2, "MIT"), (6, 60_001, "MIT"), (7, 0, "MIT")]
    assert L.scan(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []
