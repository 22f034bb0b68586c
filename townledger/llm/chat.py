"""Minimum-cost role repair of conversations, then rendering.

Legal sequences are: an optional system turn, then user and assistant in turn, ending with the assistant. A repair keeps every
text: a turn may be relabelled, merged into the turn before, or preceded by empty turns. Costs add up along a path of the
automaton, so a stretch of turns is a 4 x 4 matrix of least costs; matrices of stretches multiply. A conversation that lies in
several tasks is solved by its matrices, and every task then works out its own turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

# States: role of the turn before, START before the first one.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# Other names of the roles that count as no change.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
MERGE, INSERT, RELABEL, UNKNOWN = 2, 3, 4, 1
FAR = 10 ** 9


def _fillers() -> dict[tuple[int, int], tuple[int, ...]]:
    """For every state and role the fewest empty turns that make the role legal; user first among equals."""
    out = {}
    for s in range(4):
        seen = {s: ()}
        todo = [s]
        for x in todo:
            for r in NEXT[x]:
                if r not in seen:
                    seen[r] = (*seen[x], r)
                    todo.append(r)
        for r in (SYSTEM, USER, ASSISTANT):
            ways = [seen[x] for x in seen if r in NEXT[x]]
            if ways:
                out[s, r] = min(ways, key=lambda w: (len(w), w))
    return out


FILL = _fillers()
# After the last turn: what is missing up to an assistant turn.
CLOSE = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def label_cost(role: str | None, target: int) -> int:
    known = NAMES.get((role or "").strip().lower())
    return UNKNOWN if known is None else 0 if known == target else RELABEL


def choices(role: str | None) -> list[tuple[int, int, int, tuple[int, ...], bool]]:
    """(state, new state, cost, empty turns before, merged) of one turn, the best way for each pair of states."""
    best = {}
    for s in range(4):
        for r in (SYSTEM, USER, ASSISTANT):
            label = label_cost(role, r)
            ways = []
            if s == r:
                ways.append((label + MERGE, 0, (), True))
            if (s, r) in FILL:
                fill = FILL[s, r]
                ways.append((label + INSERT * len(fill), 1, fill, False))
            if ways:
                cost, _, fill, merged = min(ways)
                best[s, r] = (s, r, cost, fill, merged)
    return [best[k] for k in sorted(best)]


_memo: dict[str | None, list] = {}


def _choices(role: str | None) -> list:
    name = (role or "").strip().lower()
    name = name if name in NAMES else None
    if name not in _memo:
        _memo[name] = choices(name)
    return _memo[name]


def forward(costs: np.ndarray, roles: list[str | None]) -> list[np.ndarray]:
    """Least costs of every state before each turn and after the last one."""
    out = [costs]
    for role in roles:
        new = np.full(4, FAR, np.int64)
        for s, r, c, _, _ in _choices(role):
            if out[-1][s] + c < new[r]:
                new[r] = out[-1][s] + c
        out.append(np.minimum(new, FAR))
    return out


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least costs from every state to every state over a stretch of turns."""
    return np.stack([forward(np.where(np.arange(4) == s, 0, FAR), roles)[-1] for s in range(4)])


def backward(costs: list[np.ndarray], roles: list[str | None], end: int) -> list[tuple[int, int, tuple[int, ...], bool]]:
    """(state before, role, empty turns before, merged) of every turn on a least path that ends in ``end``; first state on ties."""
    out = []
    for k in range(len(roles) - 1, -1, -1):
        way = min((x for x in _choices(roles[k]) if x[1] == end and costs[k][x[0]] + x[2] == costs[k + 1][end]), key=lambda x: (x[0], x[4]))
        out.append((way[0], end, way[3], way[4]))
        end = way[0]
    return out[::-1]


def last_state(costs: np.ndarray) -> int:
    return min(range(4), key=lambda s: (costs[s] + INSERT * len(CLOSE[s]), s))


END = "<|im_end|>\n"


def empty(roles: tuple[int, ...]) -> str:
    return "".join(f"<|im_start|>{ROLES[r]}\n{END}" for r in roles)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, position, role, new_role, merged, n_inserted, rendered.

    Concatenated in order of position, ``rendered`` is the repaired conversation. Turns are ordered by number, null first, then
    role and text; rows equal in all of these are turns of their own. A null conversation id is a conversation. A null text is
    an empty turn; roles are compared without case and outer blanks, unknown and null ones may take any role at a lower cost.
    Extra columns are not read; an empty table gives no rows. A conversation may spread over many tasks: only two matrices of
    16 numbers per task go through the driver.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*[F.col(a).alias(b) for a, b in zip((conv_col, turn_col, role_col, text_col), order)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    # ids go through Python as text, so that null or large ones come back as they were
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("n")))
    rows = cut_lineage(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
                       .withColumn("turn_no", F.col("turn").cast("string")).select("conv", "turn_no", "role", "text"))

    def stretches(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list, list]]:
        """Batches of a partition as (conversation, rows of the batch); one conversation may come in several pieces."""
        for pdf in pdfs:
            for conv, part in groupby(pdf.itertuples(index=False, name=None), key=lambda r: r[0]):
                yield conv, list(part)

    def outer(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = None
        conv = m = None
        size = 0
        for c, part in stretches(pdfs):
            own = matrix([r[2] for r in part])
            if c == conv:
                m, size = np.minimum((m[:, :, None] + own[None]).min(axis=1), FAR), size + len(part)
            else:
                if conv is not None and first is None:
                    first = (conv, m, size)
                conv, m, size = c, own, len(part)
        if conv is not None:
            me = TaskContext.get().partitionId()
            found = [(me, 0, *(first or (conv, m, size)))] + ([(me, 1, conv, m, size)] if first else [])
            yield pd.DataFrame([(p, k, c, x.ravel().tolist(), s) for p, k, c, x, s in found], columns=["part", "end", "conv", "costs", "n"])

    ends = rows.select("conv", "turn_no", "role").mapInPandas(outer, "part int, end int, conv string, costs array<long>, n long").collect()
    ends = sorted((r.part, r.end, r.conv, np.array(r.costs, np.int64).reshape(4, 4), r.n) for r in ends) if ends else []
    share = turns.sparkSession.sparkContext.broadcast(_borders(ends))

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        me = TaskContext.get().partitionId()
        enter, leave = share.value.get(me, ({}, {}))
        pending: list = []

        def solve(part: list) -> pd.DataFrame:
            conv, roles = part[0][0], [r[2] for r in part]
            costs, offset = enter.get(conv, (np.where(np.arange(4) == START, 0, FAR), 0))
            table = forward(costs, roles)
            closes = conv not in leave
            end = last_state(table[-1]) if closes else leave[conv]
            out = []
            for k, (r, (_, role, fill, merged)) in enumerate(zip(part, backward(table, roles, end))):
                text = r[3] or ""
                close = END if offset + k else ""
                out.append([conv, r[1], offset + k, r[2], ROLES[role], merged, len(fill), f"\n{text}" if merged else f"{close}{empty(fill)}<|im_start|>{ROLES[role]}\n{text}"])
            if closes:
                out[-1][7] += END + empty(CLOSE[end])
                out[-1][6] += len(CLOSE[end])
            return pd.DataFrame(out, columns=COLUMNS)

        ready = []
        size = 0
        for c, part in stretches(pdfs):
            if pending and pending[0][0] != c:
                ready.append(solve(pending))
                size += len(pending)
                pending = []
            pending.extend(part)
            if size > 5000:
                yield pd.concat(ready)
                ready, size = [], 0
        if pending:
            ready.append(solve(pending))
        if ready:
            yield pd.concat(ready)

    done = rows.mapInPandas(work, "conv string, turn string, position long, role string, new_role string, merged boolean, n_inserted int, rendered string")
    back = F.when(F.col("conv") != "n", F.expr("substring(conv, 2)")).cast(kinds["conv_id"])
    return done.select(back.alias("conv_id"), F.col("turn").cast(kinds["turn"]).alias("turn"), "position", "role", "new_role", "merged", "n_inserted", "rendered")


COLUMNS = ["conv", "turn", "position", "role", "new_role", "merged", "n_inserted", "rendered"]


def _borders(ends: list) -> dict:
    """For every partition: costs and number of turns with which conversations enter it, and the state in which they leave it."""
    chains: dict[str, list] = {}
    for part, _, conv, m, n in ends:
        chain = chains.setdefault(conv, [])
        chain.append((part, m, n))
    out: dict = {}
    for conv, chain in chains.items():
        if len(chain) < 2:
            continue
        costs, offset, table = np.where(np.arange(4) == START, 0, FAR), 0, []
        for part, m, n in chain:
            table.append((part, costs, offset, m))
            costs, offset = np.minimum((costs[:, None] + m).min(axis=0), FAR), offset + n
        state = last_state(costs)
        for k in range(len(table) - 1, -1, -1):
            part, before, offset, m = table[k]
            enter, leave = out.setdefault(part, ({}, {}))
            if k:
                enter[conv] = (before, offset)
            if k < len(table) - 1:
                leave[conv] = state
            state = min((s for s in range(4)), key=lambda s: (before[s] + m[s, state], s))
    return out
