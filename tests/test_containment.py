"""The innermost node around each occurrence and the first use in each node, against every pair; and how the work grows."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernweave.operators import callgraph


def every_pair(px, py, rank, qx, qy):
    out = []
    for x, y in zip(qx, qy, strict=True):
        found = [r for a, b, r in zip(px, py, rank, strict=True) if a <= x and b >= y]
        out.append(min(found, default=-1))
    return out


small = st.integers(-4, 9)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(small, small), max_size=40), st.lists(st.tuples(small, small), max_size=20), st.randoms())
def test_least_dominating(points, asked, random):
    px, py = (np.array([p[i] for p in points], np.int64) for i in (0, 1))
    qx, qy = (np.array([p[i] for p in asked], np.int64) for i in (0, 1))
    rank = np.arange(len(points))
    random.shuffle(rank)
    assert callgraph.least_dominating(px, py, rank, qx, qy).tolist() == every_pair(px, py, rank, qx, qy)


@pytest.mark.parametrize("nested", [True, False])
def test_work_grows_with_the_rows_not_the_pairs(nested):
    def seconds(n):
        rng = np.random.default_rng(1)
        start = np.arange(n) if nested else rng.integers(0, 4 * n, n)
        end = 4 * n - start if nested else start + rng.integers(0, n, n)
        left = rng.integers(0, 4 * n, n)
        began = time.process_time()
        callgraph.least_dominating(start, end, np.arange(n), left, left + 3)
        return time.process_time() - began

    seconds(2_000)
    # Every pair would take 400 times as long.
    assert seconds(200_000) < 60 * max(seconds(10_000), 0.01)
