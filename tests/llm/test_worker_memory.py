"""Python workers hold little while they work and wait."""

import os
import re
from pathlib import Path
from types import SimpleNamespace

import numpy as np

from parley.llm import common, quality


def held() -> float:
    """MB of this process that no file backs."""
    return int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{os.getpid()}/status").read_text())[1]) / 1024


def test_free_memory_goes_back_to_the_system():
    small = [bytes(1000) for _ in range(200_000)]  # far below the size that goes back by itself
    last = small.pop()  # lies behind all others
    del small
    stuck = held()
    common.give_back()
    assert held() < stuck - 100 and len(last) == 1000


def test_tasks_end_by_giving_back(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append("back"))
    frame = SimpleNamespace(mapInArrow=lambda run, schema: run)
    run = common.map_batches(frame, lambda batches: (told.append(b) or b for b in batches), "x int")
    assert list(run(iter([1, 2]))) == [1, 2] and told == [1, 2, "back"]


def test_tables_of_a_model_are_small_and_weigh_the_same():
    rnd = np.random.default_rng(1)
    places = np.sort(rnd.choice(1 << quality.BITS, 1000, replace=False))
    model = quality.Model(places, rnd.normal(size=1000).astype(np.float32), 0.5)
    table = model.table()
    assert table.nbytes <= 1 << quality.BITS
    whole = np.zeros(1 << quality.BITS, np.float32)
    whole[places] = model.weights
    for n in (0, 1, 400):
        found = np.concatenate((rnd.choice(places, n), rnd.integers(0, 1 << quality.BITS, 5000), rnd.choice(places, n)))
        assert model.margin(table, found) == 0.5 + float(whole[np.unique(found)].sum(dtype=np.float64))
