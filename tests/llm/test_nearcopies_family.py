"""A family whose regions are above ``CROWD``, with the constants of production: no member is lost."""

import random

from parley.llm import nearcopies


def pairs_of(words):
    return set(zip(words, words[1:]))


def test_no_member_of_a_large_family_is_lost(spark):
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    family = [base]
    while len(family) < 5000:
        own = list(base)
        for at in rnd.sample(range(1, 59), 3):
            own[at] = f"x{rnd.randrange(10**9)}"
        family.append(own)
    whole = pairs_of(base)
    assert all(len(whole & s) >= 0.8 * len(whole | s) for s in map(pairs_of, family))
    rows = [(i, " ".join(own)) for i, own in enumerate(family)]
    got = nearcopies.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and len({r[2] for r in got}) == 1
