"""Exact neighbours: bounds from a part of the points, bits for chebyshev distances, shares of the queries."""

import numpy as np
import pytest

from kilnframe.operators import neighbours as N


def made(rows, seed, dim=24):
    x = np.random.default_rng(seed).normal(size=(rows, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found(a, b, metric, k, tops=None):
    return N._found(a, b, N.Rough(b, metric, range(b.shape[1])), [(np.arange(len(a)), None)], k, None, tops)[0]


@pytest.mark.parametrize("metric", N.METRICS)
def test_bounds_of_a_part_save_measuring(monkeypatch, metric):
    """Queries that come with the distance of the k-th point of a part measure fewer pairs and find the same."""
    a, b = made(60, 1), made(9_000, 2)
    n = []
    exact = N._exact
    monkeypatch.setattr(N, "_exact", lambda x, y, q, *more: n.append(len(q)) or exact(x, y, q, *more))
    whole = found(a, b, metric, 10)
    without, n[:] = sum(n), []
    tops = found(a, b[::4], metric, 10).top
    n[:] = []
    got = found(a, b, metric, 10, tops)
    assert sum(n) < 0.6 * without
    for x in "qpd":
        assert np.array_equal(getattr(got, x), getattr(whole, x))
    # a chunk without near points gives what is within the bound, and no more
    other = made(5_000, 3)
    some, all_ = found(a, other, metric, 10, tops), found(a, other, metric, 10)
    near = all_.d <= tops[all_.q]
    assert len(some.q) == near.sum() and np.array_equal(some.p, all_.p[near]) and np.array_equal(some.d, all_.d[near])


@pytest.mark.parametrize("odd", [0.0, 1e6, 1e300, np.inf])
def test_bits_leave_out_no_near_pair(odd):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 9)), rng.normal(size=(700, 9))
    b[::97, 3], a[::13, 5] = odd, -odd
    a[:, 7] = b[:, 7] = 2.0
    b[:, 8] = np.round(b[:, 8])
    rough = N.Rough(b, "chebyshev", range(9))
    assert rough.bits == (odd < 1e300 or odd == np.inf)
    if not rough.bits:  # no steps hold such values: every pair is measured
        return
    rough.queries(a)
    with np.errstate(all="ignore"):
        d = np.round(np.abs(b[None] - a[:, None]).max(2), 9)
    top = np.sort(d, 1)[:, 20]
    rows, at = np.arange(3, 40), slice(64, 693)
    q, p = rough.within(top[rows], rows, at)
    close = np.zeros((len(rows), 629), bool)
    close[q, p] = True
    assert not (~close & (d[rows, at] <= top[rows, None])).any()
    assert odd or close.mean() < 0.2


def test_shares_leave_few_cores_waiting():
    assert N._shares(1, 1_000, 8) == 32 and N._shares(1, 3, 8) == 3 and N._shares(100, 1_000, 8) == 2
    for chunks in (1, 2, 3, 5, 7, 11):
        n = chunks * N._shares(chunks, 10_000, 12)
        assert n >= 48 and -(-n // 12) * 12 <= 1.1 * n
