"""Links of near-equal vectors: what is sent grows with the vectors, and blocks of a large cell lose and repeat none."""

import numpy as np

from kilnframe.llm import lattice
from kilnframe.llm.vectors import unit
from tests.llm.test_repeated import lattice_brute


def frame(spark, rows):
    return spark.createDataFrame([(i, x.tolist(), y) for i, x, y in rows], "vec_id long, embedding array<double>, label int")


def near_copies(rng, n, dim=64):
    """``n`` vectors, a fifth of them near copies of one."""
    x = unit(rng.standard_normal((n, dim)))
    x[: n // 5] = unit(x[0] + 0.01 * rng.standard_normal((n // 5, dim)))
    return x.astype(np.float32).astype(np.float64)


def test_what_is_sent_grows_with_the_vectors(spark):
    """Neither the cells of a vector nor the links of a group of near copies are sent for each pair."""
    store, sent = spark.sparkContext._jsc.sc().statusStore(), []
    for n in (1000, 4000):
        df = frame(spark, [(i, v, 1) for i, v in enumerate(near_copies(np.random.default_rng(5), n))])
        before = store.executorSummary("driver").totalShuffleWrite()
        got = lattice.link(df).collect()
        sent.append(store.executorSummary("driver").totalShuffleWrite() - before)
        assert sorted(r.n_links for r in got)[-n // 5 :] == [n // 5 - 1] * (n // 5) and sum(r.kept for r in got) == n - n // 5 + 1
    assert sent[1] < 5 * sent[0] and sent[1] < 6000 * 4000


def test_blocks_of_a_large_cell(spark, monkeypatch):
    """Cells of over 256 vectors are dealt into pairs of blocks; some ids have two contents, some contents two ids."""
    monkeypatch.setattr(lattice, "BLOCK", 1)
    rng = np.random.default_rng(6)
    x = near_copies(rng, 1500, 16)
    x[:300] += 0.068 * rng.standard_normal((300, 16))  # cosines on both sides of the threshold
    rows = [(i, v, 1) for i, v in enumerate(x)] + [(7, x[900], 1), (8, x[3], 1), (3, x[901], 1), (2000, x[5], 1), (2001, x[5], 2)]
    u = unit(x[:300])
    assert 0.2 < (u @ u.T >= 0.93).mean() < 0.9 and np.unique(lattice.kept_in(unit(x)), return_counts=True)[1].max() > 256
    got = lattice.link(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    mine = [r for r in rows if r[0] < 320 or r[0] >= 900 and r[0] < 903 or r[0] >= 2000]
    want = lattice_brute(mine)
    have = {r.vec_id: (r.n_links, r.component_id) for r in lattice.link(frame(spark, mine)).collect()}
    assert have == want
    assert sum(r.n_links for r in {r.vec_id: r for r in got}.values()) == all_links(rows)


def all_links(rows):
    ids, labels = np.array([i for i, _, _ in rows]), np.array([y for _, _, y in rows])
    u = unit(np.stack([v for _, v, _ in rows]))
    i, j = np.nonzero((u @ u.T >= 0.93) & (labels[:, None] == labels))
    return len({(a, b) for a, b in zip(ids[i].tolist(), ids[j].tolist()) if a != b})


def test_near_pairs_meet():
    """Pairs of cosine 0.93 in random directions have a cell in common; few of the others do."""
    rng = np.random.default_rng(7)
    x, r = unit(rng.standard_normal((10_000, 64))), rng.standard_normal((10_000, 64))
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * unit(r - (r * x).sum(1, keepdims=True) * x)
    a, b = lattice.kept_in(x), lattice.kept_in(y)

    def meet(a, b):
        return (a[:, :, None] == b[:, None, :]).any((1, 2)).mean()

    assert meet(a, b) >= 0.9995 and meet(a, np.roll(a, 1, 0)) < 0.25
