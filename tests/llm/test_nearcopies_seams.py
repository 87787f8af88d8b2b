"""Near copies among many texts of one template, which crowd the regions without being near copies."""

import random

import numpy as np
import pytest

from parley.llm import nearcopies

TREES = 8  # few trees miss more


def texts(pairs):
    """Most of a text is the template's, the rest its own; its copy has some words changed."""
    rnd = random.Random(5)
    template = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(pairs):
        own = template + [f"p{i}w{k}" for k in range(60)]
        copy = list(own)
        for at in rnd.sample(range(1, len(own) - 1, 2), 8):
            copy[at] = f"n{rnd.randrange(10**9)}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(copy))]
    return rows


def shares_a_region(left, right):
    """Whether some tree holds both texts in one region at ``DEPTH``, and their signatures are alike."""
    shingler = nearcopies.Shingler(2)
    a, b = (np.frombuffer(shingler.signature(shingler.shingles(t)), ">u2") for t in (left, right))
    trees = (a == b)[: TREES * nearcopies.DEPTH].reshape(TREES, nearcopies.DEPTH)
    return trees.all(1).any() and (a == b).sum() >= nearcopies.LOOSE * nearcopies.HASHES


@pytest.mark.parametrize("seam", [64, 100_000])
def test_near_copies_in_parted_regions_are_linked(spark, monkeypatch, seam):
    for name, value in {"TREES": TREES, "CROWD": 2, "SEAM": seam}.items():
        monkeypatch.setattr(nearcopies, name, value, raising=False)
    rows = texts(200)
    pairs = [{(a, b) for a, b in zip(t.split(), t.split()[1:])} for _, t in rows]
    near = [i for i in range(0, 400, 2) if 100 * len(pairs[i] & pairs[i + 1]) >= 80 * len(pairs[i] | pairs[i + 1])]
    near = [i for i in near if shares_a_region(rows[i][1], rows[i + 1][1])]
    assert len(near) > 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.components_of(docs).collect()}
    assert [i for i in near if got[i] != got[i + 1]] == []
    assert all(got[i] >= i - 1 for i in got)  # texts of other pairs are not linked
