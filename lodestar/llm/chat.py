"""Conversations made legal at least cost, and rendered: dynamic programming over an automaton of turns.

A legal conversation has a system turn at most, first; then user and assistant turns by turns, from a user's to an
assistant's. A turn keeps its role, is given another (RELABEL) or joins the turn before it (MERGE); where a role is missing
an empty turn is put in (INSERT). The cost of a run of turns from one state to another is an entry of a 4 x 4 matrix, and
runs combine by least sums. So a conversation of any length is cut where the sorted table's partitions are: each part gives
its matrix, the matrices of a conversation give the states at the cuts, and each part is then repaired by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.blocks import runs
from lodestar.llm.frames import parts, stored

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, MERGE, INSERT = 2.0, 1.0, 3.0
INFINITE = 1e18
#: Roles put in between two states so that the second may follow; a pair that is missing can't be mended.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
ENDING = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _costs() -> np.ndarray:
    """[role given (3: none of the roles), merge or not, state before, state after]"""
    out = np.full((4, 2, 4, 4), INFINITE)
    for role in range(4):
        for q in (SYSTEM, USER, ASSISTANT):
            named = 0.0 if role == q - 1 else RELABEL
            out[role, 1, q, q] = named + MERGE
            for (p, r), extra in BETWEEN.items():
                if r == q:
                    out[role, 0, p, q] = named + INSERT * len(extra)
    return out


COSTS = _costs()
STEP = COSTS.min(axis=1)
END_COST = np.array([INSERT * len(ENDING[s]) for s in range(4)])


def _codes(roles: list) -> list[int]:
    return [ROLES.index(r) if r in ROLES else 3 for r in roles]


def transfer(codes: list[int]) -> np.ndarray:
    """[state before, state after]: least cost of a run of turns."""
    out = np.where(np.eye(4, dtype=bool), 0.0, INFINITE)
    for c in codes:
        out = np.minimum((out[:, :, None] + STEP[c][None]).min(axis=1), INFINITE)
    return out


def repair(codes: list[int], before: int, after: int) -> list[tuple[int, bool, int]]:
    """(state, merged, state before) of each turn on the first least-cost way between two states."""
    best = np.full(4, INFINITE)
    best[before] = 0
    back = []
    for c in codes:
        ways = best[:, None] + STEP[c]
        back.append(ways.argmin(axis=0))
        best = ways.min(axis=0)
    out, q = [], after
    for c, b in zip(codes[::-1], back[::-1], strict=True):
        p = int(b[q])
        out.append((q, bool(COSTS[c, 1, p, q] <= COSTS[c, 0, p, q]), p))
        q = p
    return out[::-1]


def _summaries(batches):
    for t in runs(batches, 2):
        m = transfer(_codes(t.column(3).to_pylist()))
        yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks()[:1], t.column(1).combine_chunks()[:1], pa.array([t.num_rows], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["conv_id", "part", "n", "m"])


def _cuts(batches):
    """States and places at the cuts of each conversation, from its parts' matrices in order."""
    for t in runs(batches, 1):
        matrices = [np.array(m).reshape(4, 4) for m in t.column(3).to_pylist()]
        forward = [np.where(np.arange(4) == START, 0.0, INFINITE)]
        for m in matrices:
            forward.append((forward[-1][:, None] + m).min(axis=0))
        cost = float((forward[-1] + END_COST).min())
        state = int((forward[-1] + END_COST).argmin())
        states = [state]
        for f, m in zip(forward[-2::-1], matrices[::-1], strict=True):
            state = int((f + m[:, state]).argmin())
            states.append(state)
        states = states[::-1]
        sizes = t.column(2).to_numpy()
        starts = np.cumsum(sizes) - sizes
        k = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [t.column(0).combine_chunks(), t.column(1).combine_chunks(), pa.array(starts), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()), pa.array([i == k - 1 for i in range(k)]), pa.array([cost] * k)],
            names=["conv_id", "part", "start", "before", "after", "last", "cost"],
        )


def _render(role: int, text: str | None) -> str:
    return f"<|{ROLES[role - 1]}|>\n{text or ''}"


def _repaired(batches):
    names = ["conv_id", "position", "turn", "role", "new_role", "action", "cost", "rendered"]
    for t in runs(batches, 2):
        roles, texts, turns = (t.column(k).to_pylist() for k in (3, 4, 2))
        start, before, after, last, cost = (t.column(k)[0].as_py() for k in range(5, 10))
        codes, out = _codes(roles), []
        ways = repair(codes, before, after)
        for k, (c, (q, merged, p)) in enumerate(zip(codes, ways, strict=True)):
            action = ("merge" if merged else "keep") if c == q - 1 else ("merge+relabel" if merged else "relabel")
            if merged:
                piece = f"\n\n{texts[k] or ''}"
            else:
                extra = BETWEEN[p, q]
                action += "+insert" * bool(extra)
                opening = "" if start == 0 and k == 0 else "\n"
                piece = opening + "".join(f"{_render(x, '')}\n" for x in extra) + _render(q, texts[k])
            if last and k == len(codes) - 1:
                piece += "".join(f"\n{_render(x, '')}" for x in ENDING[q]) + "\n<|end|>"
                action += "+close" * bool(ENDING[q])
            out.append((start + k, ROLES[q - 1], action, cost, piece))
        at, new, actions, costs, text = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array(at, pa.int64()), pa.array(turns, pa.int64()), pa.array(roles, pa.string()), pa.array(new), pa.array(actions), pa.array(costs), pa.array(text, pa.string())], names=names)


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, position, turn, role, new_role, action, cost, rendered: a row for each row of conversations(conv_id, turn, role, text).

    The pieces `rendered` of a conversation, joined in order of position, are the repaired conversation; cost is the least
    cost of its repair. Turns are in order of turn (null first), then role, then text; rows that repeat are turns of their
    own. Roles count as they are written, so `User` is an unknown one; a role that is null or unknown is always given another; a null text is an empty one; rows with a null conv_id are
    one conversation. An empty table gives an empty result; more columns are ignored. Where two ways cost the same, the
    lesser of the states in order start, system, user, assistant wins, from the last turn on; and merging wins.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    # the last key parts rows that are equal in all others, so that even those needn't meet in one task
    ranged = rows.withColumn("u", F.monotonically_increasing_id()).repartitionByRange(max(2, parts(rows)), *order, "u").sortWithinPartitions(*order, "u")
    table = stored(ranged.withColumn("part", F.spark_partition_id()).select("conv_id", "part", "turn", "role", "text"), "turns")
    summed = table.repartition(max(2, parts(table)), "conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    summaries = summed.select("conv_id", "part", "turn", "role").mapInArrow(_summaries, "conv_id long, part int, n long, m array<double>")
    cuts = summaries.repartition(max(2, parts(table)), "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_cuts, "conv_id long, part int, start long, before int, after int, last boolean, cost double")
    both = table.join(cuts.withColumnsRenamed({"conv_id": "c", "part": "p"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    ready = both.repartition(max(2, parts(table)), "conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text").select("conv_id", "part", "turn", "role", "text", "start", "before", "after", "last", "cost")
    return ready.mapInArrow(_repaired, "conv_id long, position long, turn long, role string, new_role string, action string, cost double, rendered string")
