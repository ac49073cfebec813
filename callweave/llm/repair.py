"""Repair of the turn structure of calls: the cheapest edits, and among them the least audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.session import settle

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3

# Rows of a call that one block holds.
BLOCK_TURNS = 4096

# States of a call while it is read: nothing yet, opened, asked, answered.
_START, _OPENED, _ASKED, _ANSWERED = range(4)
_NEXT = np.array([_ASKED, _ASKED, _ANSWERED, _ASKED])
_FAR = 1 << 40
_ENDS = np.array([0, _FAR, _FAR, 0])
# Edits in the order of their initials; 0 is the end of an audit.
_EDITS = b"\0DIKR"
_DELETE, _INSERT, _KEEP, _REROLE = 1, 2, 3, 4

_ROW_KEY = ["call_id", "turn_idx", "speaker", "digest"]


@dataclass(frozen=True)
class Speakers:
    """Who opens, asks and answers; a turn counts by the first character of its speaker."""

    asking: str = "CUSTOMER"
    answering: str = "AGENT"
    opening: str = "SYSTEM"


@dataclass(frozen=True)
class Repair:
    """`calls`: one row per call. `turns`: the repaired turns (call_id, speaker, text and `place`, their order in the call)."""

    calls: DataFrame
    turns: DataFrame


def repair_calls(turns: DataFrame, speakers: Speakers = Speakers(), block_turns: int = BLOCK_TURNS) -> Repair:
    """Finds the cheapest edits that make the speakers of each call read `(s?(ua)+)?`: opening, then asking and answering by turns.

    `turns` has `call_id` and `turn_idx` of any orderable type, `speaker` and `text`; a null speaker or text reads as one space,
    other columns are ignored. Turns are taken by `turn_idx` (nulls first), ties by speaker and then by the MD5 of the text. The first
    fault of a turn counts: blank (nothing but white space), duplicate (speaker and text were there before in the call), truncated
    (its last character other than white space is not one of `.!?`).

    Edits: Keep (0), Rerole to asking or answering (3), Delete (4; the only one for blank and duplicate turns), Insert an empty
    turn of asking or answering (3); a truncated turn that is not deleted adds 3. Of the cheapest edit sequences the one
    whose initials are ASCII-least is taken. Each initial leads from a state to one other state at most.

    `Repair.calls` has call_id, gaps (turn numbers missing between the least and the largest; 0 if turn_idx is no number or always
    null), blank, duplicate, truncated, illegal (adjacent speakers that do not follow each other), cost and audit. A call is
    there once, null among them; repeated rows are duplicates; an empty table gives empty tables.

    A call is cut in blocks of `block_turns` rows after a range sort, so a call of any share of the rows is spread
    over tasks. Costs run from the end of a call to its start and between blocks as four numbers. Within a block the nodes
    (row, state) on cheapest paths are ranked by the first 1, 2, 4, ... initials of their least audit; the ranks choose the
    next edit, and doubled pointers list the path. The audit is one cell, so a call has 2^31 rows at most.
    """
    plain = _plain_turns(turns)
    blocks = settle(_blocks(plain, speakers, block_turns))
    call_type = blocks.schema["call_id"].dataType
    # calls of one block need nothing from their neighbours
    long_calls = settle(blocks.groupBy("call_id").count().where("count > 1").select("call_id"))
    of_long = settle(_semi(blocks, long_calls).select("call_id", "part", "seq", "codes"))
    rights = settle(_right_costs(of_long, call_type))
    solved = settle(blocks.join(rights, ["part", "seq"], "left").mapInArrow(_solve, _solved_schema(blocks.schema)))
    entries = settle(_entries(_semi(solved, long_calls).select("call_id", "part", "seq", "exits"), call_type))
    state = F.coalesce("state", F.lit(_START))
    pieces = solved.join(entries, ["part", "seq"], "left").withColumn("state", state).withColumns(
        {"piece": F.get("pieces", "state"), "cost": F.get("costs", "state")}
    )
    return Repair(_report(pieces), _repaired(plain, pieces, speakers))


def _plain_turns(turns: DataFrame) -> DataFrame:
    text, speaker = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "speaker"))
    return turns.select("call_id", "turn_idx", speaker.alias("speaker"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))


def _semi(df: DataFrame, calls: DataFrame) -> DataFrame:
    wanted = calls.select(F.col("call_id").alias("_wanted"))
    return df.join(wanted, F.col("call_id").eqNullSafe(F.col("_wanted")), "left_semi")


def _letter(speaker: Column, speakers: Speakers) -> Column:
    """1, 2, 3 for opening, asking, answering; 0 for anybody else."""
    first = F.substring(speaker, 1, 1)
    return (
        F.when(first == speakers.opening[:1], _OPENED).when(first == speakers.asking[:1], _ASKED)
        .when(first == speakers.answering[:1], _ANSWERED).otherwise(0)
    )


def _blocks(plain: DataFrame, speakers: Speakers, block_turns: int) -> DataFrame:
    """One row per block of a call: its turns as codes, in order, with counts and the keys of the turns that may stay."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = (
        plain.select(*_ROW_KEY, blank.alias("blank"), truncated.alias("truncated"))
        .groupBy(*_ROW_KEY)
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("truncated").alias("truncated"))
    )
    rows = settle(rows)
    # a struct compares its nulls first
    first = rows.groupBy("call_id", "speaker", "digest").agg(F.min(F.struct("turn_idx")).alias("_first"))
    first = first.select(F.col("call_id").alias("_c"), F.col("speaker").alias("_s"), F.col("digest").alias("_d"), "_first")
    same = F.col("call_id").eqNullSafe(F.col("_c")) & (F.col("speaker") == F.col("_s")) & (F.col("digest") == F.col("_d"))
    # copies of one turn are dealt out in chunks; only the first copy of the first chunk may stay
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block_turns).cast("bigint")))
    seen = ~F.col("_first.turn_idx").eqNullSafe(F.col("turn_idx")) | (F.col("chunk") > 0)
    coded = (
        rows.join(first, same).withColumn("chunk", chunk)
        .withColumns({"n": F.least(F.lit(block_turns), F.col("n") - F.col("chunk") * block_turns).cast("int"), "seen": seen})
        .select(*_ROW_KEY, "chunk", "n", "blank", "seen", "truncated", _letter(F.col("speaker"), speakers).alias("letter"))
    )
    order = [F.col("call_id").asc_nulls_first(), F.col("turn_idx").asc_nulls_first(), "speaker", "digest", "chunk"]
    ordered = settle(coded).repartitionByRange(*order).sortWithinPartitions(*order).drop("chunk")
    schema = _block_schema(plain.schema)
    return ordered.mapInArrow(lambda batches: _cut_blocks(batches, block_turns), schema)


def _block_schema(turns: T.StructType) -> T.StructType:
    call, turn = turns["call_id"].dataType, turns["turn_idx"].dataType
    counts = [T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "n_turns")]
    return T.StructType(
        [
            T.StructField("call_id", call), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()),
            T.StructField("codes", T.BinaryType()), *counts,
            T.StructField("first_turn", turn), T.StructField("last_turn", turn),
            T.StructField("first_letter", T.IntegerType()), T.StructField("last_letter", T.IntegerType()),
            T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("turns", T.ArrayType(turn)),
            T.StructField("names", T.ArrayType(T.StringType())), T.StructField("digests", T.ArrayType(T.BinaryType())),
            T.StructField("end_turn", turn), T.StructField("end_name", T.StringType()), T.StructField("end_digest", T.BinaryType()),
        ]
    )


_FOLLOWS = np.zeros((4, 4), bool)
_FOLLOWS[_OPENED, _ASKED] = _FOLLOWS[_ASKED, _ANSWERED] = _FOLLOWS[_ANSWERED, _ASKED] = True


def _changes(values: pa.Array) -> np.ndarray:
    """True where a value differs from the one before; nulls are equal to each other."""
    if len(values) < 2:
        return np.ones(len(values), bool)
    before, here = values.slice(0, len(values) - 1), values.slice(1)
    same = pc.equal(before, here).fill_null(False).to_numpy(zero_copy_only=False)
    nulls = values.is_null().to_numpy(zero_copy_only=False)
    return np.concatenate([[True], ~(same | (nulls[1:] & nulls[:-1]))])


def _cut_blocks(batches: Iterator[pa.RecordBatch], block_turns: int) -> Iterator[pa.RecordBatch]:
    """A batch never holds a piece of more than its own rows; calls go on in the next batch as a new block."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        n, letter = columns["n"].to_numpy(), columns["letter"].to_numpy()
        blank, seen, cut_off = (columns[c].to_numpy(zero_copy_only=False) for c in ("blank", "seen", "truncated"))
        new_call = _changes(columns["call_id"])
        # rows of a call from the start of the batch on, to cut it every block_turns
        before = np.cumsum(n) - n
        call_start = np.maximum.accumulate(np.where(new_call, before, 0))
        block_no = (before - call_start) // block_turns
        starts = np.flatnonzero(new_call | (np.diff(block_no, prepend=0) != 0))
        ends = np.append(starts[1:], batch.num_rows)
        turn = columns["turn_idx"]
        new_turn = (_changes(turn) | new_call) & ~turn.is_null().to_numpy(zero_copy_only=False)
        free = ~blank & ~seen
        code = np.where(free, 1 + 2 * letter + cut_off, 0).astype(np.uint8)
        rows = []
        for low, high in zip(starts, ends):
            here = slice(low, high)
            m, mine = n[here], np.flatnonzero(free[here])
            at = np.cumsum(m) - m
            codes = np.zeros(int(m.sum()), np.uint8)
            codes[at] = code[here]
            letters = np.repeat(letter[here], m)
            known = [t for t in turn.slice(low, high - low).to_pylist() if t is not None]
            n_blank = int(m[blank[here]].sum())
            turns_here = np.flatnonzero(new_turn[here])
            # a block may begin inside a turn
            n_turns = len(turns_here) + bool(known and not new_turn[low] and turn[low].as_py() is not None)
            keys = [columns[c].slice(low, high - low).take(pa.array(mine)).to_pylist() for c in ("turn_idx", "speaker", "digest")]
            rows.append(
                (
                    columns["call_id"][low].as_py(), part, seq, codes.tobytes(),
                    n_blank, int(m.sum()) - n_blank - len(mine), int(cut_off[here][mine].sum()),
                    int((~_FOLLOWS[letters[:-1], letters[1:]]).sum()), n_turns,
                    known[0] if known else None, known[-1] if known else None, int(letters[0]), int(letters[-1]),
                    at[mine].tolist(), *keys, *[columns[c][high - 1].as_py() for c in ("turn_idx", "speaker", "digest")],
                )
            )
            seq += 1
        yield _batch(rows, batch.schema)


def _batch(rows: list[tuple], source: pa.Schema) -> pa.RecordBatch:
    call, turn = source.field("call_id").type, source.field("turn_idx").type
    types = [
        call, pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 5, turn, turn, pa.int32(), pa.int32(),
        pa.list_(pa.int32()), pa.list_(turn), pa.list_(pa.string()), pa.list_(pa.binary()), turn, pa.string(), pa.binary(),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.name for f in _BLOCK_FIELDS])


_BLOCK_FIELDS = _block_schema(T.StructType([T.StructField("call_id", T.LongType()), T.StructField("turn_idx", T.LongType())])).fields


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Costs of reading one row by code (inserts before it included), and of inserts alone; from state, to state."""
    inserts = np.full((4, 4), _FAR)
    np.fill_diagonal(inserts, 0)
    for _ in range(2):
        for state in range(4):
            near = inserts[:, state] + INSERT_COST
            inserts[:, _NEXT[state]] = np.minimum(inserts[:, _NEXT[state]], near)
    rows = np.full((9, 4, 4), _FAR)
    for code in range(9):
        for state in range(4):
            rows[code, state, state] = DELETE_COST
            if code:
                extra = TRUNCATED_COST * ((code - 1) % 2)
                to = _NEXT[state]
                rows[code, state, to] = min(rows[code, state, to], REROLE_COST + extra)
                kept = _kept_state(np.array([code]), state)[0]
                if kept >= 0:
                    rows[code, state, kept] = min(rows[code, state, kept], KEEP_COST + extra)
    return np.stack([_min_plus(inserts, r) for r in rows]), inserts


def _kept_state(code: np.ndarray, state: int) -> np.ndarray:
    """Where keeping a row leads; -1 where it may not be kept."""
    letter = (code.astype(np.int64) - 1) // 2
    fits = ((letter == _OPENED) & (state == _START)) | ((letter > 0) & (letter == _NEXT[state]))
    return np.where((code > 0) & fits, letter, -1)


def _min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), _FAR)


_ROW_STEP, _INSERT_STEP = _steps()
_LAST = np.minimum((_INSERT_STEP + _ENDS).min(axis=1), _FAR)


def _right_costs(blocks: DataFrame, call_type: T.DataType) -> DataFrame:
    """For each block of a long call, the cheapest way on from its right edge in each state; null for the last block."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(c.as_py(), np.uint8) for c in batch.column("codes")]
            steps = []
            for code in codes:
                step = _ROW_STEP[code]
                while len(step) > 1:  # neighbours are joined in pairs
                    odd = step[-1:] if len(step) % 2 else step[:0]
                    step = np.concatenate([_min_plus(step[: len(step) - len(odd) : 2], step[1 : len(step) - len(odd) + 1 : 2]), odd])
                steps.append(step[0].ravel().tolist())
            rest = [batch.column(c) for c in ("call_id", "part", "seq")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(steps, pa.list_(pa.int64()))], names=["call_id", "part", "seq", "step"])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, costs, begun = None, None, False
        for batch in batches:
            rights = []
            for key, step in zip(batch.column("call_id").to_pylist(), batch.column("step").to_pylist()):
                if not begun or key != call:
                    call, costs, begun = key, None, True
                rights.append(None if costs is None else costs.tolist())
                onward = _LAST if costs is None else costs
                costs = (np.array(step).reshape(4, 4) + onward).min(axis=1)
            rest = [batch.column(c) for c in ("part", "seq")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(rights, pa.list_(pa.int64()))], names=["part", "seq", "right"])

    key = T.StructType([T.StructField("call_id", call_type), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType())])
    steps = blocks.mapInArrow(whole, T.StructType([*key.fields, T.StructField("step", T.ArrayType(T.LongType()))]))
    last_first = ["call_id", F.desc("part"), F.desc("seq")]
    return (
        steps.repartition("call_id").sortWithinPartitions(*last_first)
        .mapInArrow(backwards, "part int, seq bigint, right array<bigint>")
    )


def _solved_schema(blocks: T.StructType) -> T.StructType:
    return T.StructType(
        [
            *[f for f in blocks.fields if f.name != "codes"],
            T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("exits", T.ArrayType(T.IntegerType())),
            T.StructField("costs", T.ArrayType(T.LongType())),
        ]
    )


# Rows of blocks of like length that are solved together.
_SOLVE_ROWS = 1 << 17


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least cheapest audit of each block from each of the four states, where it ends, and its cost."""
    for batch in batches:
        codes = [np.frombuffer(c.as_py(), np.uint8) for c in batch.column("codes")]
        rights = batch.column("right").to_pylist()
        pieces: list = [None] * len(codes)
        exits, costs = np.zeros((len(codes), 4), np.int32), np.zeros((len(codes), 4), np.int64)
        order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
        start = 0
        while start < len(order):
            end, most = start + 1, len(codes[order[start]])
            while end < len(order):
                longer = len(codes[order[end]])
                if longer > 2 * most or longer * (end + 1 - start) > _SOLVE_ROWS:
                    break
                end += 1
            chosen = order[start:end]
            found = solve_blocks([codes[i] for i in chosen], [rights[i] for i in chosen])
            for i, piece, leaves, cost in zip(chosen, *found):
                pieces[i], exits[i], costs[i] = piece, leaves, cost
            start = end
        kept = [batch.column(c) for c in batch.schema.names if c not in ("codes", "right")]
        names = [c for c in batch.schema.names if c not in ("codes", "right")]
        extra = {
            "pieces": pa.array(pieces, pa.list_(pa.string())), "exits": pa.array(exits.tolist(), pa.list_(pa.int32())),
            "costs": pa.array(costs.tolist(), pa.list_(pa.int64())),
        }
        by_name = dict(zip(names, kept)) | extra
        wanted = [f.name for f in _BLOCK_FIELDS if f.name != "codes"] + list(extra)
        yield pa.RecordBatch.from_arrays([by_name[c] for c in wanted], names=wanted)


def solve_blocks(codes: list[np.ndarray], rights: list[list[int] | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Blocks as codes (0: must go, else 1 + 2 letter + truncated), with the costs at their right edge; null at the end of a call.

    Nodes are (block, row, state); rows are aligned at the right edge.
    """
    count, length = len(codes), max(len(c) for c in codes)
    table = np.zeros((count, length), np.uint8)
    inside = np.zeros((count, length + 1), bool)
    for i, code in enumerate(codes):
        table[i, length - len(code) :] = code
        inside[i, length - len(code) :] = True
    last = np.array([r is None for r in rights])
    edge = np.array([_LAST if r is None else r for r in rights], np.int64)

    cost = np.zeros((count, length + 1, 4), np.int64)
    cost[:, length] = edge
    for row in range(length - 1, -1, -1):
        cost[:, row] = (_ROW_STEP[table[:, row]] + cost[:, row + 1, None, :]).min(axis=2)

    arcs = _optimal_arcs(table, cost, last) & inside[:, :, None, None]
    target = _arc_targets(table)
    letter, pointer, levels = _rank(arcs, target)

    # the node after t edits: pointers of 1, 2, 4, ... edits put together
    shift = np.array([length - len(c) for c in codes])
    starts = ((np.arange(count) * (length + 1) + shift)[:, None] * 4 + np.arange(4)).reshape(-1, 1)
    path = starts
    for level in levels:
        path = np.concatenate([path, level[path]], axis=1)
    initials = np.frombuffer(_EDITS, np.uint8)[letter[path]]
    sizes = (initials != 0).sum(axis=1)
    words = [row[:n].tobytes().decode() for row, n in zip(initials, sizes)]
    leaves = (path[:, -1] % 4).reshape(count, 4)
    spent = cost.reshape(-1)[starts].reshape(count, 4) - np.where(last[:, None], 0, np.take_along_axis(edge, leaves, axis=1))
    return [words[4 * i : 4 * i + 4] for i in range(count)], leaves, spent


def _arc_targets(table: np.ndarray) -> np.ndarray:
    """Node that each edit leads to, by (block, row, state, edit); an edit that is not possible leads nowhere (-1)."""
    count, length = table.shape
    node = (np.arange(count)[:, None] * (length + 1) + np.arange(length + 1)) * 4
    target = np.full((count, length + 1, 4, 5), -1, np.int64)
    for state in range(4):
        after = node[:, 1:]
        target[:, :-1, state, _DELETE] = after + state
        target[:, :, state, _INSERT] = node + _NEXT[state]
        kept = _kept_state(table, state)
        target[:, :-1, state, _KEEP] = np.where(kept >= 0, after + kept, -1)
        target[:, :-1, state, _REROLE] = np.where(table > 0, after + _NEXT[state], -1)
    return target


def _optimal_arcs(table: np.ndarray, cost: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which edits lie on a cheapest way on, by (block, row, state, edit)."""
    count, length = table.shape
    arcs = np.zeros((count, length + 1, 4, 5), bool)
    extra = np.where(table > 0, TRUNCATED_COST * ((table.astype(np.int64) - 1) % 2), 0)
    for state in range(4):
        here, after = cost[:, :-1, state], cost[:, 1:]
        arcs[:, :-1, state, _DELETE] = here == DELETE_COST + after[:, :, state]
        arcs[:, :, state, _INSERT] = cost[:, :, state] == INSERT_COST + cost[:, :, _NEXT[state]]
        kept = _kept_state(table, state)
        onward = np.take_along_axis(after, np.maximum(kept, 0)[:, :, None], axis=2)[:, :, 0]
        arcs[:, :-1, state, _KEEP] = (kept >= 0) & (here == KEEP_COST + extra + onward)
        arcs[:, :-1, state, _REROLE] = (table > 0) & (here == REROLE_COST + extra + after[:, :, _NEXT[state]])
    # inserts at an inner edge belong to the block behind it
    arcs[~last, length, :, :] = False
    return arcs


def _rank(arcs: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ranks nodes by the first 1, 2, 4, ... initials of their least audit, and picks the edit of each node by these ranks.

    Returns initial and next node of every node, and the pointers over 1, 2, 4, ... edits.
    """
    arcs, target = arcs.reshape(-1, 5), target.reshape(-1, 5)
    nodes = np.arange(len(arcs))
    ends = ~arcs.any(axis=1)
    letter = np.where(ends, 0, arcs.argmax(axis=1))
    pointer = np.where(ends, nodes, target[nodes, letter])
    rank, jump = letter, pointer
    while not ends[jump].all():
        # prefixes of twice the length: own prefix first, then that of the node behind it
        pair = rank * (rank.max() + 1) + rank[jump]
        rank = np.unique(pair, return_inverse=True)[1]
        jump = jump[jump]
    # the least edit, and behind equal initials the least rank
    behind = np.where(arcs, rank[np.maximum(target, 0)], 0)
    key = np.where(arcs, np.arange(5) * (int(rank.max()) + 1) + behind, np.iinfo(np.int64).max)
    letter = np.where(ends, 0, key.argmin(axis=1))
    pointer = np.where(ends, nodes, target[nodes, letter])
    levels = [pointer]
    while not ends[levels[-1]].all():
        levels.append(levels[-1][levels[-1]])
    return letter, pointer, levels


def _entries(solved: DataFrame, call_type: T.DataType) -> DataFrame:
    """The state in which each block of a long call begins."""

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, state, begun = None, _START, False
        for batch in batches:
            states = []
            for key, exits in zip(batch.column("call_id").to_pylist(), batch.column("exits").to_pylist()):
                if not begun or key != call:
                    call, state, begun = key, _START, True
                states.append(state)
                state = exits[state]
            rest = [batch.column(c) for c in ("part", "seq")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(states, pa.int32())], names=["part", "seq", "state"])

    return (
        solved.repartition("call_id").sortWithinPartitions("call_id", "part", "seq")
        .mapInArrow(forwards, "part int, seq bigint, state int")
    )


def _report(pieces: DataFrame) -> DataFrame:
    """One row per call, from its blocks in order."""
    block = F.struct("part", "seq", "first_turn", "last_turn", "first_letter", "last_letter", "piece")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "n_turns", "cost")]
    calls = pieces.groupBy("call_id").agg(*sums, F.array_sort(F.collect_list(block)).alias("_b"))
    joints = F.zip_with(
        F.slice("_b", 1, F.greatest(F.size("_b") - 1, F.lit(0))), F.slice("_b", 2, F.size("_b")),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    follows = [(_OPENED, _ASKED), (_ASKED, _ANSWERED), (_ANSWERED, _ASKED)]
    legal = lambda j: F.concat(j["a"]["last_letter"].cast("string"), j["b"]["first_letter"].cast("string")).isin(
        *[f"{x}{y}" for x, y in follows]
    )
    broken = F.size(F.filter(joints, lambda j: ~legal(j)))
    # a turn number on both sides of a joint was counted twice
    shared = F.size(F.filter(joints, lambda j: j["a"]["last_turn"] == j["b"]["first_turn"]))
    least, most = (F.expr(f"{f}(transform(_b, b -> b.{c}))") for f, c in (("array_min", "first_turn"), ("array_max", "last_turn")))
    numbered = isinstance(pieces.schema["first_turn"].dataType, T.IntegralType)
    gaps = F.coalesce(most - least + 1 - (F.col("n_turns") - shared), F.lit(0)) if numbered else F.lit(0)
    audit = F.array_join(F.transform("_b", lambda b: b["piece"]), "")
    return calls.select(
        "call_id", gaps.cast("bigint").alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + broken).alias("illegal"), "cost", audit.alias("audit"),
    )


def _repaired(plain: DataFrame, pieces: DataFrame, speakers: Speakers) -> DataFrame:
    """Kept turns with their speaker after the edits, and inserted ones."""
    call, turn = plain.schema["call_id"], plain.schema["turn_idx"]
    schema = T.StructType(
        [
            T.StructField("call_id", call.dataType), T.StructField("turn_idx", turn.dataType),
            T.StructField("speaker", T.StringType()), T.StructField("digest", T.BinaryType()),
            T.StructField("step", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()),
            T.StructField("becomes", T.StringType()),
        ]
    )
    columns = ["call_id", "part", "seq", "places", "turns", "names", "digests", "end_turn", "end_name", "end_digest", "piece", "state"]
    steps = settle(pieces.select(*columns).mapInArrow(lambda b: _decide(b, speakers), schema))
    place = F.struct("turn_idx", "speaker", "digest", "part", "seq", "step").alias("place")
    added = steps.where("step <> 0").select("call_id", F.col("becomes").alias("_name"), F.lit("").alias("text"), place)
    kept = steps.where("step = 0").select(
        F.col("call_id").alias("_c"), F.col("turn_idx").alias("_t"), F.col("speaker").alias("_s"), F.col("digest").alias("_d"),
        "part", "seq", "step", "becomes",
    )
    same = (
        F.col("call_id").eqNullSafe(F.col("_c")) & F.col("turn_idx").eqNullSafe(F.col("_t"))
        & (F.col("speaker") == F.col("_s")) & (F.col("digest") == F.col("_d"))
    )
    # copies of a kept turn have the same key and text; one of them stays
    found = (
        plain.join(kept, same).groupBy(*_ROW_KEY)
        .agg(*[F.any_value(c).alias(c) for c in ("part", "seq", "step", "becomes", "text")])
        .select("call_id", F.col("becomes").alias("_name"), "text", place)
    )
    return found.unionByName(added).withColumnRenamed("_name", "speaker")


def _decide(batches: Iterator[pa.RecordBatch], speakers: Speakers) -> Iterator[pa.RecordBatch]:
    """Reads the audit of each block: one row per kept turn (step 0) and per inserted one (before a turn below 0, at the end above)."""
    inserted = {_ASKED: speakers.asking, _ANSWERED: speakers.answering}
    for batch in batches:
        rows = []
        for b in batch.to_pylist():
            state, at, mine, waiting = b["state"], 0, 0, []
            for edit in b["piece"]:
                if edit == "I":
                    state = int(_NEXT[state])
                    waiting.append(inserted[state])
                    continue
                is_mine = mine < len(b["places"]) and b["places"][mine] == at
                if edit != "D":
                    key = (b["call_id"], b["turns"][mine], b["names"][mine], b["digests"][mine])
                    rows += [(*key, i - len(waiting), b["part"], b["seq"], w) for i, w in enumerate(waiting)]
                    waiting = []
                    opens = edit == "K" and b["names"][mine][:1] == speakers.opening[:1]
                    state = _OPENED if opens else int(_NEXT[state])
                    rows.append((*key, 0, b["part"], b["seq"], b["names"][mine] if edit == "K" else inserted[state]))
                at, mine = at + 1, mine + is_mine
            key = (b["call_id"], b["end_turn"], b["end_name"], b["end_digest"])
            rows += [(*key, i + 1, b["part"], b["seq"], w) for i, w in enumerate(waiting)]
        call, turn = batch.schema.field("call_id").type, batch.schema.field("end_turn").type
        types = [call, turn, pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        names = [*_ROW_KEY, "step", "part", "seq", "becomes"]
        values = zip(*rows) if rows else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)


def digest_calls(turns: DataFrame) -> DataFrame:
    """SHA-256 of the turns of each call as `speaker:text`, joined by newlines in the order of `place`: (call_id, sha256).

    A digest is read in order, so the turns of a call pass through one task, a batch at a time.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, state = None, None
        for batch in batches:
            done = []
            for key, line in zip(batch.column("call_id").to_pylist(), batch.column("line").to_pylist()):
                if state is None or key != call:
                    if state is not None:
                        done.append((call, state.hexdigest()))
                    call, state = key, hashlib.sha256(line)
                else:
                    state.update(b"\n")
                    state.update(line)
            yield _digests(done, batch.schema)
            schema = batch.schema
        if state is not None:
            yield _digests([(call, state.hexdigest())], schema)

    schema = T.StructType([T.StructField("call_id", turns.schema["call_id"].dataType), T.StructField("sha256", T.StringType())])
    lines = turns.select("call_id", "place", F.concat("speaker", F.lit(":"), "text").cast("binary").alias("line"))
    ordered = lines.repartition("call_id").sortWithinPartitions("call_id", "place")
    return ordered.select("call_id", "line").mapInArrow(fold, schema)


def _digests(rows: list[tuple], source: pa.Schema) -> pa.RecordBatch:
    keys, values = zip(*rows) if rows else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(keys, source.field("call_id").type), pa.array(values, pa.string())], names=["call_id", "sha256"])
