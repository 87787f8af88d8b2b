"""Chat formatting: minimum-cost repair of roles, then rendering.

Legal dialogues begin with at most one system turn, then user and assistant alternate, the
user first and the assistant last. Each given turn is kept, relabelled, or merged into the
turn before it, and empty turns are inserted where a role is missing; the cheapest way is found
by dynamic programming over the automaton of legal turns. Of ways that cost the same, the one
whose first differing turn has the earlier role (system, user, assistant) is taken.

A stretch of turns acts on the automaton as a matrix of costs from each state to each state,
under minimum and sum. Long dialogues are cut into stretches of ``STRETCH`` turns; their
matrices are composed, which gives each stretch the cost of all that follows; the stretches
say which state they lead to from each state; and with the states they begin in, the turns of
all stretches are decided where they lie. No dialogue is gathered in one task.

Rows: turns are ordered by number, then role, then text, nulls first. Roles are read without
case and blanks around; a null or unknown role is relabelled. A null text is empty; rows that
repeat a turn are turns of their own. Rows without a dialogue id form one dialogue. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import solve_groups, split
from parley.session import stage

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the role of the last turn
MERGE, INSERT, RELABEL = 1, 2, 4  # a changed speaker weighs more than an empty turn
STRETCH = 1024
NEVER = 10**15
#: Empty turns between a state and a next turn; None where no insertion helps.
MISSING = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (ASSISTANT, USER): (),
}
#: Empty turns that end a dialogue.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def role_of(role: str | None) -> int | None:
    """The state of a role's name."""
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else None


def step_costs(role: int | None) -> np.ndarray:
    """Costs of one turn from each state to each state."""
    costs = np.full((4, 4), NEVER, np.int64)
    for after in (SYSTEM, USER, ASSISTANT):
        label = 0 if role == after else RELABEL
        for before in range(4):
            if before == after:
                costs[before, after] = label + MERGE
            elif (before, after) in MISSING:
                costs[before, after] = label + INSERT * len(MISSING[before, after])
    return costs


STEPS = {role: step_costs(role) for role in (None, SYSTEM, USER, ASSISTANT)}
END = np.array([INSERT * len(ENDING[state]) for state in range(4)], np.int64)


def compose(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least costs through two stretches."""
    return np.minimum((left[:, :, None] + right[None, :, :]).min(1), NEVER)


def to_go(roles: list[int | None], after: np.ndarray) -> list[np.ndarray]:
    """Before each turn, the least cost from each state to the end; last the given one."""
    out = [after]
    for role in reversed(roles):
        out.append(np.minimum((STEPS[role] + out[-1]).min(1), NEVER))
    return out[::-1]


def decide(roles: list[int | None], state: int, after: np.ndarray) -> list[int]:
    """The new role of every turn, from a first state."""
    ahead, out = to_go(roles, after), []
    for i, role in enumerate(roles):
        state = int((STEPS[role][state] + ahead[i + 1]).argmin())
        out.append(state)
    return out


def piece(before: int, after: int, text: str, last: bool) -> str:
    """What a turn adds to the rendered dialogue; the pieces in order are the whole."""

    def empty(states):
        return "".join(OPEN.format(ROLES[s - 1]) + CLOSE for s in states)

    if before == after:
        out = "\n" + text
    else:
        out = "" if before == START else "\n" + CLOSE
        out += empty(MISSING[before, after]) + OPEN.format(ROLES[after - 1]) + text
    return out + ("\n" + CLOSE + empty(ENDING[after]) if last else "")


def _placed(turns: DataFrame, kind: str) -> DataFrame:
    """Turns in order, with the stretch they belong to."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"conv {kind}, turn bigint, role string, text string, task int, stretch bigint, place int"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, conv, place = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            for part in split(batch):
                names = part.column("conv").to_pylist()
                places = []
                for name in names:
                    place = place + 1 if name == conv else 0
                    conv = name
                    places.append(place)
                columns = [part.column(c) for c in ("conv", "turn", "role", "text")]
                columns += [
                    pa.array([task] * len(names), pa.int32()),
                    pa.array([p // STRETCH for p in places], pa.int64()),
                    pa.array([p % STRETCH for p in places], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, target)], schema=target
                )

    order = ["conv", "turn", "role", "text"]
    return turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def repair(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per given turn: ``id, turn, position, role, new_role, action, cost, piece``.

    ``action`` is keep, merge, relabel or relabel+merge; ``inserted`` counts empty turns put
    before it, or after the last turn. Costs add up to the least cost of the dialogue, and
    the pieces, in order of position, to its rendered text.
    """
    source = turns.select(
        turns[id_col].alias("conv"),
        turns[turn_col].cast("bigint").alias("turn"),
        turns[role_col].alias("role"),
        turns[text_col].alias("text"),
    )
    kind = source.schema["conv"].dataType.simpleString()
    rows = stage(_placed(source, kind))
    keys = ["conv", "task", "stretch"]
    name = f"conv {kind}, task int, stretch bigint"

    def own(group):
        return tuple(group[0][k] for k in keys)

    def matrices(group):
        whole = STEPS[role_of(group[0]["role"])]
        for row in group[1:]:
            whole = compose(whole, STEPS[role_of(row["role"])])
        yield (*own(group), whole.ravel().tolist(), len(group))

    def suffixes(group):
        after = END
        for row in reversed(group):
            yield (*(row[k] for k in keys), after.tolist(), row is group[-1], row["size"])
            after = np.minimum((np.array(row["costs"]).reshape(4, 4) + after).min(1), NEVER)

    def exits(group):
        roles = [role_of(r["role"]) for r in group]
        after = np.array(group[0]["after"])
        ends = [decide(roles, state, after)[-1] for state in range(4)]
        yield (*own(group), group[0]["after"], group[0]["final"], group[0]["size"], ends)

    def entries(group):
        state, position = START, 0
        for row in group:
            yield (*(row[k] for k in keys), row["after"], row["final"], state, position)
            state, position = row["ends"][state], position + row["size"]

    def decided(group):
        first = group[0]
        roles = [role_of(r["role"]) for r in group]
        states = decide(roles, first["state"], np.array(first["after"]))
        before = first["state"]
        for i, (row, role, state) in enumerate(zip(group, roles, states)):
            last = first["final"] and i + 1 == len(group)
            inserted = len(MISSING.get((before, state), ())) + (len(ENDING[state]) if last else 0)
            parts = ["relabel"] * (role != state) + ["merge"] * (before == state)
            cost = RELABEL * (role != state) + MERGE * (before == state) + INSERT * inserted
            yield (
                row["conv"], row["turn"], first["position"] + i, row["role"], ROLES[state - 1],
                "+".join(parts) or "keep", inserted, cost, piece(before, state, row["text"] or "", last),
            )
            before = state

    slim = rows.drop("text")
    costs = solve_groups(slim, keys, ["place"], f"{name}, costs array<bigint>, size bigint", matrices)
    # stretches are a thousandth of the turns; those of a dialogue are gone through in order
    order = ["task", "stretch"]
    ahead = solve_groups(
        costs, ["conv"], order, f"{name}, after array<bigint>, final boolean, size bigint", suffixes
    )
    ahead = stage(ahead)

    def with_stretch(left, right):
        right = right.select(*(F.col(k).alias(f"own_{k}") for k in keys), *(c for c in right.columns if c not in keys))
        same = F.col("conv").eqNullSafe(F.col("own_conv"))
        for k in keys[1:]:
            same &= F.col(k) == F.col(f"own_{k}")
        return left.join(right, same).drop(*(f"own_{k}" for k in keys))

    ends = solve_groups(
        with_stretch(slim, ahead), keys, ["place"],
        f"{name}, after array<bigint>, final boolean, size bigint, ends array<int>", exits,
    )
    begun = solve_groups(
        ends, ["conv"], order,
        f"{name}, after array<bigint>, final boolean, state int, position bigint", entries,
    )
    return solve_groups(
        with_stretch(rows, stage(begun)), keys, ["place"],
        f"conv {kind}, turn bigint, position bigint, role string, new_role string, action string, "
        "inserted int, cost int, piece string",
        decided,
    ).withColumnRenamed("conv", id_col)


def rendered(repaired: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id, text, cost`` of every dialogue, for dialogues that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "piece")))
    return repaired.groupBy(id_col).agg(
        F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"),
        F.sum("cost").alias("cost"),
    )
