"""What the neighbour search holds at once."""

import tracemalloc

import numpy as np

from lumenfold.operators import nn


def test_a_task_holds_few_distances_at_once_and_finds_the_nearest():
    rng = np.random.default_rng(3)
    pts, ids = rng.normal(size=(20_000, 3)), rng.permutation(20_000)
    cells = nn.Cells(ids, pts, 3)
    tracemalloc.start()
    found = [np.stack([q, rank, pid]) for q, rank, pid, _ in cells.nearest(ids[:10_000], pts[:10_000], 2, True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    found = np.concatenate(found, axis=1)
    assert found.shape[1] == 20_000
    for row in range(0, 10_000, 500):
        d = np.sqrt(((pts - pts[row]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((ids, d)) if i != row][:2]
        mine = found[:, found[0] == row]
        assert mine[2][np.argsort(mine[1])].tolist() == ids[want].tolist()
