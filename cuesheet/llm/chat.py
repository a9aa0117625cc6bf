"""Chat formatting: role sequences are repaired at the least cost, then rendered.

A legal conversation is an optional system turn, then user and assistant turns by turns, from a user's to an
assistant's. An automaton over the role of the turn before accepts exactly these. Each source turn is kept, relabelled,
or merged into the turn before, and empty turns are inserted where the automaton asks for one; the sequence of least
total cost is found by dynamic programming.

A conversation may be as long as the table. The rows are sorted over all tasks and written as chunks; a chunk is a
4 x 4 matrix of least costs between the state before and after it. Matrices of one conversation multiply (with minimum
for sum), so the chunks' entry and exit states follow from a table of chunks, and every chunk then traces its own turns.
Rendering gives a piece of text per source turn; the pieces of a conversation in order are the rendered conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cuesheet.llm.arrow import slices
from cuesheet.session import stored

ROLES = ("system", "user", "assistant")
RELABEL, INSERT, MERGE = 3, 2, 1
UNKNOWN = 1  # a role that is none of the three has to be relabelled, for less
_FAR = 1 << 50
# States: 0 before the first turn, k + 1 after a turn of ROLES[k].
#: (state before, role): empty turns to insert; a pair that is missing is not legal.
_INSERTS = {
    (0, 0): (), (0, 1): (), (0, 2): (1,),
    (1, 1): (), (1, 2): (1,),
    (2, 1): (2,), (2, 2): (),
    (3, 1): (), (3, 2): (1,),
}
#: Empty turns to insert at the end.
_CLOSING = {0: (), 1: (1, 2), 2: (2,), 3: ()}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _choices() -> dict[tuple[int, int], list[tuple[int, str, int]]]:
    """(state before, source role or -1): what can be done with the turn, as (cost, action, target role)."""
    found = {}
    for state in range(4):
        for source in (-1, 0, 1, 2):
            options = []
            for target in range(3):
                relabel = 0 if source == target else UNKNOWN if source < 0 else RELABEL
                if (state, target) in _INSERTS:
                    options.append((relabel + INSERT * len(_INSERTS[state, target]), "turn", target))
                if state == target + 1:
                    options.append((relabel + MERGE, "merge", target))
            found[state, source] = options
    return found


_CHOICES = _choices()


def _role(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else -1


def steps(role: str | None) -> list[list[int]]:
    """The cost matrix of one turn."""
    matrix = [[_FAR] * 4 for _ in range(4)]
    for state in range(4):
        for cost, _, target in _CHOICES[state, _role(role)]:
            matrix[state][target + 1] = min(matrix[state][target + 1], cost)
    return matrix


def product(one: list[list[int]], other: list[list[int]]) -> list[list[int]]:
    """Least costs of going through one, then the other."""
    return [[min(min(a + other[k][j] for k, a in enumerate(row)), _FAR) for j in range(4)] for row in one]


def closing(state: int) -> int:
    return INSERT * len(_CLOSING[state])


def _forward(roles: list[str | None], costs: list[int]) -> tuple[list[list], list[int]]:
    """From the least costs before some turns: for each turn and state after it the best choice, and the costs after."""
    backs = []
    for role in roles:
        new, back = [_FAR] * 4, [None] * 4
        for state in range(4):
            if costs[state] < _FAR:
                for cost, action, target in _CHOICES[state, _role(role)]:
                    if costs[state] + cost < new[target + 1]:
                        new[target + 1], back[target + 1] = costs[state] + cost, (state, action, target)
        costs = new
        backs.append(back)
    return backs, costs


def trace(roles: list[str | None], costs: list[int], end: int) -> list[tuple[int, str, int]]:
    """The cheapest way to a state, from the least costs before: (state before, action, target role) of each turn.

    Seen from the end, equally cheap ways go by the smaller state before a turn, then by a turn of its own before a
    merge. That does not depend on where a conversation is cut into chunks.
    """
    found, state = [], end
    for back in reversed(_forward(roles, costs)[0]):
        found.append(back[state])
        state = back[state][0]
    return found[::-1]


def _backs(roles: list[str | None], costs: list[int]) -> tuple[list[int], list[int]]:
    """For each state after some turns the state before them (0 where there is no way), and the costs after."""
    backs, after = _forward(roles, costs)
    origin = list(range(4))
    for back in backs:
        origin = [origin[b[0]] if b else 0 for b in back]
    return origin, after


def _turn(role: int) -> str:
    return f"{OPEN}{ROLES[role]}\n"


def piece(text: str | None, state: int, action: str, target: int, last: int | None) -> str:
    """What a source turn adds to the rendered conversation; ``last`` is the state after it if the conversation ends."""
    parts = []
    if action == "merge":
        parts.append("\n")
    else:
        parts.append(CLOSE if state else "")
        parts += [_turn(r) + CLOSE for r in _INSERTS[state, target]]
        parts.append(_turn(target))
    parts.append(text or "")
    if last is not None:
        parts += [CLOSE, *(_turn(r) + CLOSE for r in _CLOSING[last])]
    return "".join(parts)


CHUNK = 1024  # most turns of a chunk


def chunked(conversations: DataFrame) -> DataFrame:
    """The rows in order, cut into chunks: conv_id, turn, role, text, segment, chunk, at.

    Sorted over all tasks by conversation, turn and then role and text, so that ties have an order of their own. Chunks
    are numbered along that order; a segment is a conversation's part in one task, named by its first chunk.
    """
    keys = ["conv_id", "turn", "role", "text"]
    ordered = conversations.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, segment, at, known = (TaskContext.get().partitionId() << 32) - 1, 0, 0, ()
        for part in slices(batches, 4096):
            columns = [], [], []
            for conv in part.column(0).to_pylist():
                if known != (conv,):
                    chunk, at, known = chunk + 1, 0, (conv,)
                    segment = chunk
                elif at == CHUNK - 1:
                    chunk, at = chunk + 1, 0
                else:
                    at += 1
                for column, value in zip(columns, (segment, chunk, at)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(c, pa.int64()) for c in columns)], [*keys, "segment", "chunk", "at"]
            )

    return ordered.mapInArrow(run, "conv_id long, turn long, role string, text string, segment long, chunk long, at long")


def _mapped(rows: DataFrame, make, schema: str) -> DataFrame:
    """``make(row as a dict)`` gives the result rows (dicts) of a row."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [new for row in part.to_pylist() for new in make(row)]
            if found:
                table = pa.Table.from_pylist([{n: f[n] for n in names} for f in found], kinds)
                yield from table.to_batches()

    kinds = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.mapInArrow(run, schema)


def _gathered(rows: DataFrame, by: list[str], *fields: str) -> DataFrame:
    """Lists of the fields by key, ordered by the first field; used where a key has a bounded number of rows."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))


def _square(flat: list[int]) -> list[list[int]]:
    return [flat[k : k + 4] for k in range(0, 16, 4)]


def _flat(matrix: list[list[int]]) -> list[int]:
    return [x for row in matrix for x in row]


_ONE = [[0 if a == b else _FAR for b in range(4)] for a in range(4)]


def _all(matrices) -> list[list[int]]:
    total = _ONE
    for m in matrices:
        total = product(total, m)
    return total


def _chunk_cost(row: dict) -> Iterator[dict]:
    yield {"chunk": row["chunk"], "m": _flat(_all(steps(item["role"]) for item in row["items"]))}


def _segment_cost(row: dict) -> Iterator[dict]:
    yield {"segment": row["segment"], "m": _flat(_all(_square(item["m"]) for item in row["items"]))}


def _entries(name: str):
    """The least costs before each item of a list."""

    def make(row: dict) -> Iterator[dict]:
        costs = row.get("costs") or [0, _FAR, _FAR, _FAR]
        for item in row["items"]:
            yield {name: item[name], "costs": costs}
            costs = product([costs], _square(item["m"]))[0]

    return make


def _chunk_back(row: dict) -> Iterator[dict]:
    """For each state after the chunk, the state before it on the cheapest way."""
    back, total = _backs([item["role"] for item in row["items"]], row["costs"])
    yield {"chunk": row["chunk"], "back": back, "total": total}


def _compose(row: dict) -> Iterator[dict]:
    back = list(range(4))
    for item in reversed(row["items"]):
        back = [item["back"][s] for s in back]
    yield {"segment": row["segment"], "back": back, "total": row["items"][-1]["total"]}


def _exits(name: str):
    """The state after each item of a list, from the state after the last one."""

    def make(row: dict) -> Iterator[dict]:
        state, last = row.get("state"), row.get("last", True)
        if state is None:
            total = row["items"][-1]["total"]
            state = min(range(4), key=lambda s: (total[s] + closing(s), s))
        for item in reversed(row["items"]):
            yield {name: item[name], "state": state, "last": last}
            state, last = item["back"][state], False

    return make


def repair(conversations: DataFrame) -> DataFrame:
    """Per row of ``conversations(conv_id, turn, role, text)``: conv_id, turn, role, new_role, action, inserted, cost,
    piece.

    ``action`` is keep, relabel or merge (into the turn before, with new_role its role); ``inserted`` counts the empty
    turns before and, for a conversation's last row, after it; ``cost`` is what the row adds to the total. The pieces in
    the order of turn, role and text are the rendered conversation. A null or unknown role is relabelled, null texts are
    empty, a null turn comes first, and the rows without a conv_id are one conversation. Further columns are ignored.
    """
    rows = stored(chunked(conversations), "chat-rows")
    roles = _gathered(rows, ["conv_id", "segment", "chunk"], "at", "role")
    roles = stored(roles, "chat-roles")
    matrices = _mapped(roles, _chunk_cost, "chunk long, m array<long>")
    matrices = stored(roles.select("conv_id", "segment", "chunk").join(matrices, "chunk"), "chat-costs")
    # Forward: conversations are lists of segments, segments lists of chunks.
    in_segment = _gathered(matrices, ["conv_id", "segment"], "chunk", "m")
    whole = _mapped(in_segment, _segment_cost, "segment long, m array<long>")
    whole = matrices.select("conv_id", "segment").distinct().join(whole, "segment")
    before = _mapped(_gathered(whole, ["conv_id"], "segment", "m"), _entries("segment"), "segment long, costs array<long>")
    before = _mapped(in_segment.join(before, "segment"), _entries("chunk"), "chunk long, costs array<long>")
    before = stored(before, "chat-before")
    # Backward: which state before a chunk leads to which state after it, and so the state after each chunk.
    backs = _mapped(roles.join(before, "chunk"), _chunk_back, "chunk long, back array<int>, total array<long>")
    backs = stored(roles.select("conv_id", "segment", "chunk").join(backs, "chunk"), "chat-backs")
    in_segment = _gathered(backs, ["conv_id", "segment"], "chunk", "back", "total")
    whole = _mapped(in_segment, _compose, "segment long, back array<int>, total array<long>")
    whole = backs.select("conv_id", "segment").distinct().join(whole, "segment")
    of_segments = _gathered(whole, ["conv_id"], "segment", "back", "total")
    after = _mapped(of_segments, _exits("segment"), "segment long, state int, last boolean")
    after = _mapped(in_segment.join(after, "segment"), _exits("chunk"), "chunk long, state int, last boolean")
    after = after.join(before, "chunk")
    placed = rows.join(after, "chunk").repartition("chunk").sortWithinPartitions("chunk", "at")
    return placed.mapInArrow(_render_all, RESULT)


RESULT = "conv_id long, turn long, role string, new_role string, action string, inserted int, cost int, piece string"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each chunk, from rows that are sorted by chunk and place; a chunk may go on in the next batch."""
    held: list[dict] = []
    for part in slices(batches, CHUNK):
        for row in part.to_pylist():
            if held and row["chunk"] != held[0]["chunk"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _render_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([(n, _ARROW[k]) for n, k in (part.split() for part in RESULT.split(", "))])
    done: list[dict] = []
    for rows in _chunks(batches):
        done += _rendered(rows)
        if len(done) >= CHUNK:
            yield pa.RecordBatch.from_pylist(done, kinds)
            done = []
    if done:
        yield pa.RecordBatch.from_pylist(done, kinds)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _rendered(rows: list[dict]) -> list[dict]:
    """The result rows of one chunk."""
    found, made = trace([r["role"] for r in rows], rows[0]["costs"], rows[0]["state"]), []
    for k, (row, (before, action, target)) in enumerate(zip(rows, found)):
        ends = row["last"] and k == len(rows) - 1
        added = len(_INSERTS[before, target]) if action == "turn" else 0
        added += len(_CLOSING[target + 1]) if ends else 0
        source = _role(row["role"])
        moved = 0 if source == target else UNKNOWN if source < 0 else RELABEL
        made.append(
            {
                "conv_id": row["conv_id"],
                "turn": row["turn"],
                "role": row["role"],
                "new_role": ROLES[target],
                "action": "merge" if action == "merge" else "relabel" if moved else "keep",
                "inserted": added,
                "cost": moved + INSERT * added + (MERGE if action == "merge" else 0),
                "piece": piece(row["text"], before, action, target, target + 1 if ends else None),
            }
        )
    return made
