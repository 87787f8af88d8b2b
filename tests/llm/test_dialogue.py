"""Role repair against all ways of repairing, and the rendered form."""

import random
import re
from itertools import product

import pytest

from parley.llm import dialogue

SCHEMA = "conv_id long, turn int, role string, text string, conv string, place int, cost int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA)


def by_hand(roles):
    """Least cost and first sequence of new roles, over all sequences."""
    best = None
    for states in product((1, 2, 3), repeat=len(roles)):
        cost, before = 0, 0
        for role, state in zip(roles, states):
            known = role.strip().lower() if role else None
            cost += 0 if known == dialogue.ROLES[state - 1] else dialogue.RELABEL
            if before == state:
                cost += dialogue.MERGE
            elif (before, state) in dialogue.MISSING:
                cost += dialogue.INSERT * len(dialogue.MISSING[before, state])
            else:
                cost = None
                break
            before = state
        if cost is not None:
            cost += dialogue.INSERT * len(dialogue.ENDING[before])
            if best is None or cost < best[0]:
                best = cost, states
    return best[0], [dialogue.ROLES[s - 1] for s in best[1]]


def legal(text):
    """Whether a rendered dialogue is a sentence of the automaton."""
    found = re.findall(r"<\|(system|user|assistant|end)\|>\n", text)
    return re.fullmatch("(system end )?(user end assistant end )*", " ".join([*found, ""])) is not None


@pytest.mark.parametrize("stretch", [1, 3, 1024])
def test_against_all_sequences(spark, monkeypatch, stretch):
    monkeypatch.setattr(dialogue, "STRETCH", stretch)
    rnd = random.Random(stretch)
    names = ["system", "user", "assistant", "User ", "tool", None]
    talks = {i: rnd.choices(names, k=rnd.randrange(1, 8)) for i in range(60)}
    rows = [(i, t, r, f"t{i}.{t}") for i, roles in talks.items() for t, r in enumerate(roles)]
    rnd.shuffle(rows)
    got = dialogue.repair(frame(spark, rows))
    found = {}
    for r in got.collect():
        found.setdefault(r.conv_id, []).append(r)
    assert set(found) == set(talks)
    for i, roles in talks.items():
        own = sorted(found[i], key=lambda r: r.position)
        cost, states = by_hand(roles)
        assert [r.position for r in own] == list(range(len(roles)))
        assert (sum(r.cost for r in own), [r.new_role for r in own]) == (cost, states)
    for r in dialogue.rendered(got).collect():
        assert legal(r.text)
        assert re.findall(r"t\d+\.\d+", r.text) == [f"t{r.conv_id}.{t}" for t in range(len(talks[r.conv_id]))]


def test_one_long_dialogue(spark, monkeypatch):
    """Stretches and tasks cut a long dialogue anywhere, and change nothing."""
    rnd = random.Random(5)
    roles = rnd.choices(["user", "assistant", "assistant", "system", None], k=3000)
    want = [dialogue.ROLES[s - 1] for s in dialogue.decide([dialogue.role_of(r) for r in roles], 0, dialogue.END)]
    monkeypatch.setattr(dialogue, "STRETCH", 64)
    rows = [(1, t, r, "x") for t, r in enumerate(roles)] + [(2, 0, "user", "y")]
    got = sorted(dialogue.repair(frame(spark, rows)).where("conv_id = 1").collect(), key=lambda r: r.position)
    assert [r.new_role for r in got] == want and [r.turn for r in got] == list(range(3000))


def test_edges(spark):
    rows = [
        (None, 0, "user", "a"), (None, 1, "assistant", None), (1, None, None, None), (2, 0, "user", "q"),
        (2, 0, "user", "q"), (3, 0, "assistant", "x" * 300_000), (4, 1, "user", ""), (4, 2, "assistant", "b"),
    ]
    got = dialogue.repair(frame(spark, rows))
    assert got.count() == len(rows)
    text = {r.conv_id: (r.text, r.cost) for r in dialogue.rendered(got).collect()}
    assert text[None] == ("<|user|>\na\n<|end|>\n<|assistant|>\n\n<|end|>\n", 0)
    assert text[4][1] == 0 and text[2][1] == dialogue.MERGE + dialogue.INSERT
    assert text[3] == ("<|user|>\n<|end|>\n<|assistant|>\n" + "x" * 300_000 + "\n<|end|>\n", dialogue.INSERT)
    assert all(legal(t) for t, _ in text.values())
    assert dialogue.repair(frame(spark, rows).limit(0)).collect() == []
