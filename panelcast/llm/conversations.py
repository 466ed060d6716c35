"""Conversation structure repair: cheapest edits by a Viterbi run over pieces of conversations in parallel."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.session import write_and_read

BLANKS = " \t\n\x0b\x0c\r"
PIECE_ROWS = 256
PIECE_BYTES = 1 << 20
FIX_UPS = 2

# States: nothing yet, a system row, a user row last, an assistant row last. Cost of the edits an end still needs.
START, SYSTEM, USER, ASSISTANT = range(4)
END = (0, 10, 5, 0)
COST_DELETE, COST_INSERT, COST_REROLE, COST_TRUNCATED = 2, 5, 1, 5
FAR = 1 << 40
# State after an inserted or re-roled row, and after a kept one whose role starts with s, u, a or else (4: not allowed).
TURN = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.array([[SYSTEM, 4, 4, 4], [USER, USER, 4, USER], [4, 4, ASSISTANT, 4], [4, 4, 4, 4]])
# Kinds of rows: the initial (0 to 3), 4 more if truncated, 8 more if it must go, 12 for a conversation without rows.
TRUNCATED, FORCED, ABSENT = 4, 8, 12
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, copies) of damaged conversations, by crc32 of ``key:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it the user's. A null key,
    turn, role or text is read as one space there; key and turn stay null. A dropped row leaves (conv, null, null,
    null, 0), so that its conversation is known still.
    """
    shown = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(shown(key), F.lit(":"), shown(turn)).cast("binary")), F.lit(20))
    d = rows.select(F.col(f"`{key}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), shown(role).alias("role"), shown(text).alias("text"), fault.alias("fault"))
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    there = F.col("fault") != 0
    return d.select(
        "conv",
        F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(there, said).alias("text"),
        F.when(there, F.when(F.col("fault") == 3, 2).otherwise(1)).otherwise(0).cast("long").alias("copies"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation with their copies and their ``kind``; copies after the first are duplicates.

    Equal rows are counted before anything is sorted. Whether a role and text stood in an earlier turn
    is the least turn of each, aggregated with map-side combining and joined back where it matters.
    """
    g = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    owner = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-"))
    g = g.withColumn("same", F.unhex(F.sha2(F.concat_ws(":", F.length(owner), owner, F.length("role"), "role", "text"), 256)))
    g = g.withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    seen = g.where("copies > 0").groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    left = F.rtrim("text", F.lit(BLANKS))
    blank, again = left == "", F.coalesce(F.col("first") < F.col("at"), F.lit(False))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    late = F.when(F.right(left, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    kind = F.when(F.col("copies") == 0, ABSENT).when(blank | again, code + FORCED).otherwise(code + late)
    return g.join(seen, "same", "left").select("conv", "turn", "role", "text", "copies", kind.cast("int").alias("kind"), (blank & (F.col("copies") > 0)).alias("blank"))


def _before(kind: np.ndarray, deletes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs to the end before a row, one line per lane, from those after it."""
    after = after + COST_DELETE * deletes[:, None]
    initial, late = kind & 3, COST_TRUNCATED * ((kind & TRUNCATED) > 0)[:, None]
    padded = np.concatenate([after, np.full((len(after), 1), FAR)], 1)
    keep = np.take_along_axis(padded, KEPT[initial], 1) + late
    rerole = after[:, TURN] + late + COST_REROLE
    out = np.minimum(np.minimum(after + COST_DELETE, keep), rerole)
    user = np.minimum(out[:, USER], out[:, ASSISTANT] + COST_INSERT)
    out[:, ASSISTANT] = np.minimum(out[:, ASSISTANT], out[:, USER] + COST_INSERT)
    out[:, USER] = user
    out[:, :USER] = np.minimum(out[:, :USER], user[:, None] + COST_INSERT)
    return np.where((kind >= FORCED)[:, None], after, out)


def _lanes(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces by falling length, and how many are longer than 0, 1, 2, ... rows."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    return order, np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")


def backward(kind: np.ndarray, deletes: np.ndarray, starts: np.ndarray, ends: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to the end before every row, all pieces side by side, each from its vector in ``end``."""
    v, lane = np.zeros((len(kind), 4), np.int64), end.copy()
    order, active = _lanes(starts, ends)
    for j, n in enumerate(active):
        k = order[:n]
        row = ends[k] - 1 - j
        lane[k] = v[row] = _before(kind[row], deletes[row], lane[k])
    return v


def _until_parallel(kind: np.ndarray, deletes: np.ndarray, starts: np.ndarray, ends: np.ndarray, old: np.ndarray, new: np.ndarray, reached: np.ndarray) -> np.ndarray:
    """Start vectors of pieces rerun from ``new``; a piece stops where old and new differ by a constant alone."""
    lane, was, out = new.copy(), old.copy(), np.empty_like(new)
    live = np.arange(len(starts))
    j = 0
    while len(live):
        gap = lane[live] - was[live]
        done, over = (gap == gap[:, :1]).all(1), ends[live] - starts[live] == j
        out[live[over]] = lane[live[over]]
        early = done & ~over
        out[live[early]] = reached[live[early]] + gap[early][:, :1]
        live = live[~done & ~over]
        row = ends[live] - 1 - j
        lane[live] = _before(kind[row], deletes[row], lane[live])
        was[live] = _before(kind[row], deletes[row], was[live])
        j += 1
    return out


def trace(kind: np.ndarray, deletes: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: np.ndarray, end: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per row the inserts before it, its edit and the state it meets; per piece the state it leaves.

    Of the edits that keep the total least, D is taken before I, K and R, which makes the whole string
    the ASCII-least, as no two cheapest strings are one another's beginning.
    """
    inserts, edit, met = np.zeros(len(kind), np.int8), np.full(len(kind), ord("D"), np.uint8), np.zeros(len(kind), np.int8)
    state = entry.astype(np.int64).copy()
    order, active = _lanes(starts, ends)
    for j, n in enumerate(active):
        k = order[:n]
        row = starts[k] + j
        inner = row + 1 < ends[k]
        after = np.where(inner[:, None], v[np.minimum(row + 1, len(v) - 1)], end[k]) + COST_DELETE * deletes[row][:, None]
        now, s, lane = v[row], state[k], np.arange(n)
        forced = kind[row] >= FORCED
        while True:
            goes = forced | (after[lane, s] + COST_DELETE == now[lane, s])
            more = ~goes & (now[lane, TURN[s]] + COST_INSERT == now[lane, s])
            if not more.any():
                break
            inserts[row] += more
            s = np.where(more, TURN[s], s)
        late = COST_TRUNCATED * ((kind[row] & TRUNCATED) > 0)
        kept = KEPT[kind[row] & 3, s]
        stays = ~goes & (kept < 4) & (after[lane, np.minimum(kept, 3)] + late == now[lane, s])
        edit[row] = np.where(goes, ord("D"), np.where(stays, ord("K"), ord("R")))
        met[row] = s
        state[k] = np.where(goes, s, np.where(stays, kept, TURN[s]))
    return inserts, edit, met, state


def _piece_starts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, and whether each starts a conversation (open for the first)."""
    conv, n = table.column("conv").combine_chunks(), table.num_rows
    gone = conv.is_null().to_numpy(zero_copy_only=False)
    other = pc.fill_null(pc.not_equal(conv.slice(1), conv.slice(0, n - 1)), False).to_numpy(zero_copy_only=False) | (gone[1:] != gone[:-1])
    run = np.concatenate([[0], np.flatnonzero(other) + 1])
    first = np.repeat(run, np.diff(np.append(run, n)))
    size = np.cumsum(pc.fill_null(pc.binary_length(table.column("text")), 0).to_numpy().astype(np.int64))
    part = (np.arange(n) - first) // PIECE_ROWS + (size - size[first]) // PIECE_BYTES
    new = np.concatenate([[True], other | (part[1:] != part[:-1])])
    starts = np.flatnonzero(new)
    return starts, np.isin(starts, run[1:])


PIECE = (
    "part int, piece int, whole boolean, kinds binary, deletes array<long>, roles array<string>, texts array<string>, n_rows long, blank long, "
    "duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial int, last_initial int, start array<long>"
)


def _vectors(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * 4), pa.array(np.ascontiguousarray(v, np.int64).reshape(-1)))


def _packed(table: pa.Table, starts: np.ndarray, whole: np.ndarray, part: int, number: int) -> pa.RecordBatch:
    """Pieces with their counts and the vector before them, from the speculative one that END is."""
    kind, copies = table.column("kind").to_numpy().astype(np.int64), table.column("copies").to_numpy().astype(np.int64)
    blank, known = table.column("blank").to_numpy(zero_copy_only=False), table.column("turn").is_valid().to_numpy(zero_copy_only=False)
    turn = pc.fill_null(table.column("turn"), 0).to_numpy()
    n, ends = len(kind), np.append(starts[1:], len(kind))
    there, forced = kind != ABSENT, kind >= FORCED
    deletes = np.where(forced, copies, copies - 1)
    inner = np.ones(n, bool)
    inner[starts] = False
    joined = np.concatenate([[False], there[1:] & there[:-1]]) & inner
    seam = joined & ~np.concatenate([[False], LEGAL[kind[:-1] & 3, kind[1:] & 3]])
    new_turn = known & ~(inner & np.concatenate([[False], known[:-1] & (turn[1:] == turn[:-1])]))
    total = lambda x: pa.array(np.add.reduceat(x.astype(np.int64), starts))
    first_row = np.where(there[starts], starts, starts + 1)
    some = first_row < ends
    first_known = np.minimum.reduceat(np.where(known, np.arange(n), n), starts)
    dated = known[ends - 1]
    turn_at = lambda at: pa.array(np.where(dated, turn[np.minimum(at, n - 1)], 0), mask=~dated)
    initial = lambda at: pa.array((kind[np.minimum(at, n - 1)] & 3).astype(np.int32), mask=~some)
    end = np.tile(np.array(END, np.int64), (len(starts), 1))
    offsets = pa.array(np.append(starts, n).astype(np.int32))
    conv = table.column("conv").combine_chunks()
    columns = {
        "conv": conv.take(pa.array(starts)),
        "part": pa.array(np.full(len(starts), part, np.int32)),
        "piece": pa.array(np.arange(number, number + len(starts), dtype=np.int32)),
        "whole": pa.array(whole),
        "kinds": pa.array([kind[a:b].astype(np.uint8).tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        "deletes": pa.ListArray.from_arrays(offsets, pa.array(deletes)),
        "roles": pa.ListArray.from_arrays(offsets, table.column("role").combine_chunks().cast(pa.string())),
        "texts": pa.ListArray.from_arrays(offsets, table.column("text").combine_chunks().cast(pa.string())),
        "n_rows": total(copies),
        "blank": total(np.where(blank, copies, 0)),
        "duplicate": total(np.where(blank, 0, np.where(forced, copies, copies - 1))),
        "truncated": total(~forced & (kind & TRUNCATED > 0)),
        "illegal": total(np.where(there, copies - 1, 0) + seam),
        "turns": total(new_turn),
        "first_turn": turn_at(first_known),
        "last_turn": turn_at(ends - 1),
        "first_initial": initial(first_row),
        "last_initial": initial(ends - 1),
        "start": _vectors(backward(kind, deletes, starts, ends, end)[starts]),
    }
    return pa.RecordBatch.from_pydict(columns)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the conversations in one task's sorted rows; only an unfinished piece is held over.

    A piece is ``whole`` if rows of other conversations stand on both sides of it in this task.
    """
    part, held, head, number = TaskContext.get().partitionId(), None, False, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        starts, fresh = _piece_starts(table)
        fresh[0] = head
        if len(starts) > 1:
            yield _packed(table.slice(0, starts[-1]), starts[:-1], fresh[:-1] & fresh[1:], part, number)
            number += len(starts) - 1
        held, head = table.slice(starts[-1]), bool(fresh[-1])
    if held is not None:
        yield _packed(held, np.array([0]), np.array([False]), part, number)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kinds and deletes of all rows of a batch of pieces, and where each piece starts and ends."""
    kinds = np.frombuffer(b"".join(batch.column("kinds").to_pylist()), np.uint8).astype(np.int64)
    deletes = batch.column("deletes")
    ends = np.cumsum(pc.list_value_length(deletes).to_numpy().astype(np.int64))
    return kinds, deletes.flatten().to_numpy(), np.concatenate([[0], ends[:-1]]), ends


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _put(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    for name, column in columns.items():
        batch = batch.set_column(batch.schema.get_field_index(name), name, column) if name in batch.schema.names else batch.append_column(name, column)
    return batch


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reruns pieces whose vector ``given`` is no longer parallel to the one they ran from."""
    for batch in batches:
        kinds, deletes, starts, ends = _rows(batch)
        old, new, reached = (_matrix(batch.column(c)) for c in ("end", "given", "start"))
        found = _until_parallel(kinds, deletes, starts, ends, old, new, reached)
        yield _put(batch, end=_vectors(new), start=_vectors(found))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece the least costs from each state before it to each state after it: row k of ``product`` ends in k."""
    for batch in batches:
        kinds, deletes, starts, ends = _rows(batch)
        runs = [backward(kinds, deletes, starts, ends, np.tile(np.where(np.arange(4) == k, 0, FAR), (len(starts), 1)))[starts] for k in range(4)]
        flat = np.stack(runs, 1).reshape(-1)
        yield _put(batch, product=pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * 16), pa.array(flat)))


def _chain_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from the last to the first: the vector after each from the products of those behind it."""
    conv, v = object(), None
    for batch in batches:
        given = []
        for row in batch.select(["conv", "product"]).to_pylist():
            if row["conv"] != conv:
                conv, v = row["conv"], np.array(END)
            given.append(v)
            v = (np.array(row["product"]).reshape(4, 4) + v[:, None]).min(0)
            v = np.minimum(v - v.min(), FAR)
        yield _put(batch.drop_columns(["product"]), given=_vectors(np.array(given)))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state each piece leaves, for every state it may be entered in."""
    for batch in batches:
        kinds, deletes, starts, ends = _rows(batch)
        given = _matrix(batch.column("given"))
        v = backward(kinds, deletes, starts, ends, given)
        left = [trace(kinds, deletes, starts, ends, v, given, np.full(len(starts), s))[3] for s in range(4)]
        yield _put(batch.drop_columns(["kinds", "deletes", "start", "end"]), exits=_vectors(np.stack(left, 1)))


def _chain_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from the first to the last: the state each is entered in."""
    conv, state = object(), START
    for batch in batches:
        entry = []
        for row in batch.select(["conv", "exits"]).to_pylist():
            if row["conv"] != conv:
                conv, state = row["conv"], START
            entry.append(state)
            state = row["exits"][state]
        yield _put(batch.drop_columns(["conv", "exits"]), entry=pa.array(entry, pa.int32()))


def settled(loose: DataFrame, key: str) -> DataFrame:
    """(part, piece, given, last, entry) of pieces that may have neighbours: the vector behind each, up to a constant.

    All pieces ran from END. Each now takes the vector of the piece behind it; where that is not
    parallel to the one it ran from, it reruns, until the vectors differ by a constant alone. As long
    as some change, so goes the next pass. A run of rows that all go has rank four and passes every
    difference on, a piece a pass: what FIX_UPS passes leave unsettled is finished by products of
    pieces, computed side by side and chained in one pass over 16 numbers a piece.
    """
    order = Window.partitionBy("conv").orderBy("part", "piece")
    end = F.array(*[F.lit(x).cast("long") for x in END])
    held = loose.withColumn("last", F.lead("part").over(order).isNull()).withColumn("end", end)
    shape = f"conv {key}, part int, piece int, kinds binary, deletes array<long>, start array<long>, last boolean, end array<long>"
    level = lambda c: F.transform(c, lambda x: x - F.element_at(c, 1))
    for passes in range(FIX_UPS + 1):
        held = write_and_read(held, "pieces")
        given = held.withColumn("given", F.coalesce(F.lead("start").over(order), "end"))
        off = level(F.col("given")) != level(F.col("end"))
        if given.where(off).isEmpty():
            break
        if passes == FIX_UPS:
            product = held.mapInArrow(_products, f"{shape}, product array<long>")
            back = product.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("piece"))
            given = back.mapInArrow(_chain_back, f"{shape}, given array<long>")
            break
        again = given.where(off).mapInArrow(_fix_up, f"{shape}, given array<long>")
        held = given.where(~off).unionByName(again).drop("given")
    exits = given.mapInArrow(_exits, f"conv {key}, part int, piece int, last boolean, given array<long>, exits array<long>")
    on = exits.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return on.mapInArrow(_chain_on, "part int, piece int, last boolean, given array<long>, entry int")


def _said(state: int) -> str:
    return "assistant" if state == ASSISTANT else "user"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, cost and repaired rows of every piece."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        kinds, deletes, starts, ends = _rows(batch)
        given, entry = _matrix(batch.column("given")), batch.column("entry").to_numpy()
        v = backward(kinds, deletes, starts, ends, given)
        inserts, edit, met, left = trace(kinds, deletes, starts, ends, v, given, entry)
        cost = v[starts, entry] - given[np.arange(len(starts)), left]
        last = batch.column("last").to_numpy(zero_copy_only=False)
        cost += np.where(last, np.array(END)[left], 0)
        roles, texts = batch.column("roles").flatten().to_pylist(), batch.column("texts").flatten().to_pylist()
        audits, who, what, offsets = [], [], [], [0]
        for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            audit = []
            for i in range(a, b):
                for j in range(int(inserts[i]), 0, -1):
                    audit.append("I")
                    who.append(_said(met[i]) if j == 1 else _said(USER + ASSISTANT - met[i]))
                    what.append("")
                if kinds[i] < FORCED:
                    audit.append(chr(edit[i]))
                    if edit[i] != ord("D"):
                        who.append(roles[i] if edit[i] == ord("K") else _said(TURN[met[i]]))
                        what.append(texts[i])
                audit.append("D" * int(deletes[i]))
            if last[k]:
                more = {0: [], 5: ["assistant"], 10: ["user", "assistant"]}[END[left[k]]]
                audit.append("I" * len(more))
                who, what = who + more, what + [""] * len(more)
            audits.append("".join(audit))
            offsets.append(len(who))
        repaired = pa.StructArray.from_arrays([pa.array(who, pa.string()), pa.array(what, pa.string())], names=["role", "text"])
        batch = batch.drop_columns(["kinds", "deletes", "roles", "texts", "start", "given", "entry", "last"])
        yield _put(batch, cost=pa.array(cost), audit=pa.array(audits, pa.string()), repaired=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), repaired))


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
STATS = "n_rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial int, last_initial int"


def repair(rows: DataFrame) -> DataFrame:
    """Cheapest edits of conversations, from rows (conv, turn, role, text, copies): a row per piece of a conversation.

    Rows are taken by turn (nulls first), then role and text by code point. The first fault of each counts:
    blank, duplicate (role and text stood earlier) or truncated (does not end in ``.!?``). Edits: keep 0,
    re-role to user or assistant 1, delete 2 (required for blank and duplicate rows), insert an empty user or
    assistant row 5; a truncated row that stays costs 5 more. The initials of the roles that remain, in order,
    are ``(s?(ua)+)?``; of the cheapest repairs the one with the ASCII-least string of edits (D, I, K, R) is
    taken. A role that is empty or begins with another letter cannot stay as it is.

    Columns: conv, part and piece (their order within a conversation), whole (the only one), n_rows, counts of
    faults and of illegal neighbours, turns, first and last turn and initial, cost, audit (a letter per edit) and
    ``repaired``, the rows that remain as (role, text).

    Rows are put in order by range, so a conversation of any length lies in as many tasks as it fills, and
    its pieces of at most PIECE_ROWS rows run side by side, each backwards from a speculative vector of the costs
    that remain; see ``settled``. The vectors, right up to a constant, then drive the choice of edits forwards.
    Only vectors and states of pieces are ever chained, never rows or texts.

    A null conversation is one like others; a conversation of which no row is left has one piece without
    rows; repeated rows are duplicates; an empty table gives none. Other columns are not read.
    """
    key = rows.schema["conv"].dataType.simpleString()
    ordered = judged(rows).repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    pieces = write_and_read(ordered.mapInArrow(_cut, f"conv {key}, {PIECE}"), "cut")
    loose = settled(pieces.where("not whole").select("conv", "part", "piece", "kinds", "deletes", "start"), key)
    d = pieces.join(loose, ["part", "piece"], "left")
    end = F.array(*[F.lit(x).cast("long") for x in END])
    d = d.withColumn("given", F.coalesce("given", end)).withColumn("last", F.coalesce("last", F.lit(True))).withColumn("entry", F.coalesce("entry", F.lit(START)))
    d = d.select("conv", *[c for c in d.columns if c != "conv"])
    stats = f"conv {key}, part int, piece int, whole boolean, {STATS}"
    return d.mapInArrow(_edited, f"{stats}, cost long, audit string, repaired array<struct<role string, text string>>")


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """The repaired conversations: conv, part, piece, place, role, text; ordered by the three numbers."""
    return pieces.select("conv", "part", "piece", F.posexplode("repaired").alias("place", "row")).select("conv", "part", "piece", "place", "row.*")


def _lines(repaired: str) -> Column:
    return F.array_join(F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces in order; texts only pass through a digest."""
    conv, total = object(), None

    def ended() -> pa.RecordBatch:
        row = {k: total[k] for k in ("conv", *COUNTS)} | {"gaps": total["gaps"]()}
        row |= {"audit": "".join(total["audit"]), "repaired_sha256": total["digest"].hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    schema = None
    for batch in batches:
        if schema is None:
            numbers = [pa.field(k, pa.int64()) for k in (*COUNTS, "gaps")]
            schema = pa.schema([batch.schema.field("conv"), *numbers, pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])
        for row in batch.to_pylist():
            if total is None or row["conv"] != conv:
                if total is not None:
                    yield ended()
                conv = row["conv"]
                total = {"conv": conv, "audit": [], "digest": hashlib.sha256(), "said": False, "initial": None, "turns": 0, "first": None, "last": None} | dict.fromkeys(COUNTS, 0)
            t = total
            for k in COUNTS:
                t[k] += row[k]
            if row["first_initial"] is not None:
                t["illegal"] += t["initial"] is not None and not LEGAL[t["initial"], row["first_initial"]]
                t["initial"] = row["last_initial"]
            if row["first_turn"] is not None:
                t["turns"] += row["turns"] - (t["last"] == row["first_turn"])
                t["first"] = row["first_turn"] if t["first"] is None else t["first"]
                t["last"] = row["last_turn"]
            t["gaps"] = lambda t=t: 0 if t["first"] is None else t["last"] - t["first"] + 1 - t["turns"]
            t["audit"].append(row["audit"])
            if row["kept"]:
                t["digest"].update(("\n" if t["said"] else "").encode() + row["lines"].encode())
                t["said"] = True
    if total is not None:
        yield ended()


def report(pieces: DataFrame) -> DataFrame:
    """Per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The digest is of the repaired rows as ``role:text`` joined by newlines. A digest is made in order, so
    the pieces of one conversation stream through one task, which holds a single one of them at a time.
    """
    key = pieces.schema["conv"].dataType.simpleString()
    d = pieces.withColumn("lines", _lines("repaired")).withColumn("kept", F.size("repaired") > 0).drop("repaired")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    columns = ["conv", "gaps", *COUNTS, "audit", "repaired_sha256"]
    whole = d.where("whole").withColumn("gaps", gaps).withColumn("repaired_sha256", F.sha2("lines", 256)).select(*columns)
    some = d.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "piece")
    out = f"conv {key}, {', '.join(f'{c} long' for c in COUNTS)}, gaps long, audit string, repaired_sha256 string"
    return whole.unionByName(some.mapInArrow(_merged, out).select(*columns))
