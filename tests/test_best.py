"""Tiles of rough scores against all exact ones, and the heaps that cells share."""

import numpy as np
import pytest

from parley.operators import similarity as sim
from parley.operators.best import Best


@pytest.mark.parametrize("tile", [50, 900, 4_000_000])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_tiles_agree_with_all_scores(monkeypatch, tile, exclude_self):
    monkeypatch.setattr(sim, "SCORE_CELLS", tile)
    rng = np.random.default_rng(5)
    rows = sim._unit_rows(np.vstack([rng.normal(size=(90, 8)), np.ones((40, 8)), np.zeros((5, 8))]))
    rows[90:100, 0] += 1e-8  # ties once they are rounded
    ids = rng.permutation(len(rows))
    best = Best(ids, 3, exclude_self)
    for start in range(0, len(rows), 30):
        part = slice(start, start + 30)
        sim._offer(best, rows, np.arange(len(rows)), rows[part], ids[part])
    got = best.found().groupby("query_id").apply(lambda f: list(zip(f["id"], f["similarity"])), include_groups=False)
    scores = np.round(rows @ rows.T, sim.DIGITS) + 0.0
    for q, own in zip(ids, scores):
        want = sorted((-s, i) for s, i in zip(own, ids) if not (exclude_self and i == q))[:3]
        assert got[q] == [(i, -s) for s, i in want]


def test_known_scores_rule_out():
    rows = np.eye(4)
    best = Best(np.arange(4), 2, False, np.full(4, 1.0))
    sim._offer(best, rows, np.arange(4), rows, np.arange(4))
    assert best.found().values.tolist() == [[i, i, 1.0] for i in range(4)]


def test_cells_share_heaps_and_full_cells_have_their_own():
    assert sim._heaps(np.array([3, 3, 3, 9, 1, 0, 2]), 8) == [(0, 2, 0, 1), (2, 3, 1, 1), (3, 4, 2, 2), (4, 7, 4, 1)]
    assert sim._heaps(np.full(700, 700), 32_768)[-1][2] < 20
