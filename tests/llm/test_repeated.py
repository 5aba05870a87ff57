"""Repeated ids, rows without an id, and rows that must all come back."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kilnframe.llm import jaccard, lattice, mixing, sharding, toxicity
from tests.llm.test_operators import prose


def lattice_brute(rows, threshold=0.93):
    """Vertices are ids; an id has each of its contents."""
    n = {i: set() for i, _, _ in rows}
    for i, v, a in rows:
        for j, w, b in rows:
            if i != j and a == b and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                n[i].add(j)
    low = {i: i for i in n}
    for _ in n:
        for i in n:
            for j in n[i]:
                low[i] = low[j] = min(low[i], low[j])
    return {i: (len(n[i]), low[i]) for i in n}


def test_links_of_repeated_ids(spark):
    rng = np.random.default_rng(1)
    v, w, u = (rng.standard_normal(16) for _ in range(3))
    near = [v + 0.02 * rng.standard_normal(16) for _ in range(3)]
    rows = [(1, v, 1), (1, v, 1), (2, w, 1), (2, v, 1), (3, w, 1), (4, u, 1), (5, near[0], 1), (5, near[1], 1), (6, near[2], 1), (7, v, 2), (8, u, 1)]
    got = lattice.link(spark.createDataFrame([(i, x.tolist(), y) for i, x, y in rows], "vec_id long, embedding array<double>, label int")).collect()
    want = lattice_brute(rows)
    assert Counter(r.vec_id for r in got) == Counter(i for i, _, _ in rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and want[3][1] == 1 and want[1][0] == 3


def test_shards_hold_every_row_once(spark, tmp_path):
    rows = [("k", "x" * 100, i) for i in range(30)] + [(None, None, 30), (None, "y" * 60, 31)] + [(f"k{i}", "z" * i, 32 + i) for i in range(40)]
    d = spark.createDataFrame(rows, "key string, text string, turn int")
    sharding.write(d, 500, str(tmp_path / "out"), "key")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("key", "text", "turn").collect()), key=lambda r: r[2]) == rows
    size = got.groupBy("shard").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("b")).collect()
    assert len(size) > 6 and max(r.b for r in size) <= 500


def test_distinct_takes_rows_not_ids(spark):
    rng = random.Random(1)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (5, a), (5, b), (5, b), (6, c), (6, c + " more"), (None, a), (7, None), (7, None), (8, "")]
    got = jaccard.distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = Counter((r.doc_id, r.text) for r in got)
    assert {(1, a), (5, b), (None, a), (7, None), (8, "")} <= texts.keys() and max(texts.values()) == 1
    assert (5, a) not in texts and len({t for i, t in texts if i == 6}) == 1


def test_sampling_keeps_rows_without_an_id(spark):
    rows = [(None, "a b", "s", "en"), (1, "a b c", "s", "en"), (1, "d", "t", "en"), (2, "e f", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    assert sorted(map(str, mixing.sampled(d, budget=1.0).collect())) == sorted(map(str, d.collect()))
    many = spark.createDataFrame([(i % 40, f"w{i} " * (1 + i % 7), f"s{i % 3}", "en") for i in range(400)], "doc_id long, text string, source string, lang string")
    chosen = mixing.mix(many).where("selected")
    assert 0 < chosen.count() == mixing.sampled(many).count() < 400


def test_toxicity_learns_exceptions_and_skips_conflicts(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        t, y = prose(rng, 40), int(i % 5 == 0)
        t += " grubword" if y else " a grubword bin" if i % 17 == 0 else ""
        rows.append((i, t))
        labels.append((i, y))
    labels += [(0, 0), (None, 1)]
    rows += [(None, "grubword"), (None, "b"), (900, "a b c grubword bin"), (901, "a b c grubword")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fitted(d, lab)
    assert "grubword" + toxicity.fold("bin").rstrip() in model.exceptions
    got = {r.doc_id: r.predicted for r in toxicity.query(d, lab).collect()}
    assert len(got) == 302 and got[900] == 0 and got[901] == 1 and all(got[i] == y for i, y in labels[1:300])
    assert toxicity.phrases(" the trash can ", toxicity.Model({" trash ": 1.0}, (), 0.0, 1.0).matcher()) == {"the trash", "trash can"}
    assert toxicity.phrases(" sorehead ", toxicity.Model({" sore": 1.0}, (), 0.0, 1.0).matcher()) == set()
