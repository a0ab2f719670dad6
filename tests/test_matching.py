"""Descriptor matching: exact nearest counterparts from few exact distances, in many tasks."""

import numpy as np
import pytest

from capturelake.operators import matching as M


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    out = np.round(rng.normal(size=(n, 16)), 3)
    out[n // 2:n // 2 + 5] = out[0]
    return out


def brute(a, b):
    return np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2) / a.shape[1]


@pytest.mark.parametrize(("rows", "others"), [(1, 1), (1, 9), (9, 1), (300, 400)])
def test_two_closest_from_few_exact_distances(rows, others, monkeypatch):
    monkeypatch.setattr(M, "SCAN", 4_096)
    a, b = vectors(rows, 1), vectors(others, 2)
    b[:1] = a[:1]
    ends, measured = (M._Nearest(rows), M._Nearest(others)), 0
    for i, j, d in M._candidates(a, b, False):
        ends[0].add(i, d, j)
        ends[1].add(j, d, i)
        measured += len(i)
    for near, d in ((ends[0], brute(a, b)), (ends[1], brute(b, a))):
        order = np.argsort(d, axis=1, kind="stable")[:, :2]
        assert (near.n[:order.shape[1]].T == order).all()
        assert (near.d[:order.shape[1]].T == np.take_along_axis(d, order, axis=1)).all()
    assert rows < 100 or measured < rows * others / 10


def test_odd_numbers_are_never_nearest():
    a, b = vectors(4, 3), vectors(30, 4)
    b[3, 2], b[4, 5], a[1, 0] = np.nan, np.inf, np.nan
    near = M._Nearest(len(a))
    for i, j, d in M._candidates(a, b, False):
        near.add(i, d, j)
    want = brute(a, b)
    assert near.n[0, 1] == -1 and all(near.n[0, k] == np.nanargmin(want[k]) for k in (0, 2, 3))


def test_block_pairs_are_tasks_of_their_own(spark):
    """Two images of forty keypoints in blocks of ten: sixteen tasks, and what one block finds."""
    rows = [(image, k, [float(x) for x in v]) for image in (1, 2) for k, v in enumerate(vectors(40, image))]
    keypoints = spark.createDataFrame(rows, "image_id int, kp_idx bigint, descriptor array<double>")
    pairs = spark.createDataFrame([(1, 2)], "left_image int, right_image int")
    near = M.two_nearest(pairs, keypoints, block=10)
    assert "RoundRobinPartitioning(16)" in near._jdf.queryExecution().executedPlan().toString()
    whole = M.two_nearest(pairs, keypoints)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, whole.collect()))
    d = brute(vectors(40, 1), vectors(40, 2))
    got = {r.idx: (r.nearest, r.distance, r.second) for r in near.filter("side = 'left'").collect()}
    assert got == {k: (int(row.argmin()), row.min(), np.sort(row)[1]) for k, row in enumerate(d)}


def test_steps_are_off_by_what_was_rounded():
    rng = np.random.default_rng(6)
    a, b = (rng.normal(size=(n, 16)) for n in (50, 60))
    qa, qb, off = M._steps(a, b)
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    scale = (65_534 // 16 - 1) / (high - low)
    sums = np.abs(qa[:, None, :].astype(int) - qb[None, :, :]).sum(axis=2)
    assert np.abs(sums - np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2) * scale).max() <= off < 16
    # Whole steps are not rounded at all, and numbers whose range has no float are left to the exact distances.
    assert M._steps(np.array([[0.0, 32_766.0]]), np.array([[5.0, 7.0]]))[2] == 1
    huge = np.array([[1.7e308, -1.7e308], [1.0, 2.0]])
    assert M._steps(huge, huge)[2] == 1
