"""Which 64-bit hashes occur more than once: counted in shards, told by bit tables of a fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelcast.llm import text as tx
from panelcast.session import write_and_read

MARK_BITS = 27
SHARD_BITS = 6
SHARD_HASHES = 2_000_000
LEVELS = 2
LEVEL_STEP = 16
SPARSE = 32
SLICE = 6 << 20


def shard_bits(hashes: int, most: int = SHARD_HASHES) -> int:
    """The least power of two of shards, 2^SHARD_BITS or more, of which none gets more than about ``most`` hashes."""
    return min(MARK_BITS - 3, max(SHARD_BITS, (-(-hashes // most) - 1).bit_length() if hashes else 0))


def _count_rows(items_of: Callable[[pa.RecordBatch], np.ndarray], bits: int):
    """Per batch and shard of the hash range: the batch's hashes there, ascending, with their counts.

    Hashes go by their top 40 bits, as differences of few bytes each.
    """

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        items = items_of(part) >> tx.U(24) if part.num_rows else np.zeros(0, tx.U)
        items.sort()
        first = np.flatnonzero(np.append(True, items[1:] != items[:-1])) if len(items) else np.zeros(0, np.int64)
        count = np.minimum(np.diff(np.append(first, len(items))), 65535).astype(np.uint16)
        items = items[first]
        cuts = np.searchsorted(items, np.arange((1 << bits) + 1, dtype=tx.U) << tx.U(40 - bits))
        rows: list[tuple] = []
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                steps = np.diff(items[a:b], prepend=tx.U(s) << tx.U(40 - bits))
                width = max(1, -(-int(steps.max()).bit_length() // 8))
                planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
                rows.append((s, width, planes.tobytes(), count[a:b].tobytes()))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["shard", "width", "steps", "counts"])

    return lambda batches: tx.sliced(batches, "text", one, SLICE)


def _count_shard(shard_bits: int):
    """For every power of two from 2: how many hashes of a shard occur that often, and a bit for each."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        held = np.empty(sum(len(x.as_py()) for x in table.column("counts")) // 2, np.uint64)
        stop = 0
        for width, steps, count in zip(*(table.column(c) for c in ("width", "steps", "counts")), strict=True):
            planes = np.frombuffer(steps.as_py(), np.uint8).reshape(width.as_py(), -1)
            wide = np.zeros((planes.shape[1], 8), np.uint8)
            wide[:, : len(planes)] = planes.T
            start, stop = stop, stop + len(wide)
            # a hash and its count in one number, as 40 and 16 bits
            held[start:stop] = ((np.cumsum(wide.view("<u8")[:, 0]) + (np.uint64(shard) << np.uint64(40 - shard_bits))) << np.uint64(16)) | np.frombuffer(count.as_py(), np.uint16)
        held.sort()
        first = np.flatnonzero(np.append(True, held[1:] >> np.uint64(16) != held[:-1] >> np.uint64(16)))
        total = np.add.reduceat(held & np.uint64(65535), first).astype(np.int64)
        place = (held[first] >> np.uint64(56 - MARK_BITS)).astype(np.int64) & ((1 << (MARK_BITS - shard_bits)) - 1)
        rows, level = [], 2
        while (often := total >= level).any():
            bits = np.zeros(1 << (MARK_BITS - shard_bits), bool)
            bits[place[often]] = True
            rows.append((shard, level, int(often.sum()), np.packbits(bits, bitorder="little").tobytes()))
            level *= 2
        del held, first, total, place
        tx.release()
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["shard", "level", "n", "bits"])

    return run


def _packed(table: np.ndarray) -> np.ndarray:
    """A bit table, or in its place the ascending numbers of the bits set, if few bytes hold any."""
    if np.count_nonzero(table) * SPARSE > len(table):
        return table
    held = np.flatnonzero(table)
    byte, bit = np.nonzero(np.unpackbits(table[held][:, None], axis=1, bitorder="little"))
    return (held[byte] * 8 + bit).astype(np.uint32)


def _marked(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each bit of ``place`` is set in a ``_packed`` table."""
    if table.dtype == np.uint8:
        return (table[place >> 3] >> (place & 7)) & 1 == 1
    if not len(table):
        return np.zeros(len(place), bool)
    return table[np.minimum(np.searchsorted(table, place.astype(np.uint32)), len(table) - 1)] == place


@dataclass(frozen=True)
class Marks:
    """Tables of 2^MARK_BITS bits (16 MB each, less if few are set) over hashes: those that occur ``least`` times or more, and 16 x as often.

    Other hashes may share a bit, so a mark is no proof. If ``least`` is 2, a hash without a mark
    occurs once.
    """

    least: int
    tables: list[np.ndarray]

    def rank(self, items: np.ndarray) -> np.ndarray:
        out = np.zeros(len(items), np.int64)
        place = (items >> tx.U(64 - MARK_BITS)).astype(np.int64)
        on = np.arange(len(items))
        for table in self.tables:
            on = on[_marked(table, place[on])]
            out[on] += 1
        return out


def count_and_mark(rows: DataFrame, items_of: Callable[[pa.RecordBatch], np.ndarray], most: Column, levels: int = LEVELS, shard_hashes: int = SHARD_HASHES) -> Marks:
    """Counts the hashes that ``items_of`` finds in each batch of ``rows`` and marks the repeated ones.

    ``most`` tells how many hashes a row has at most; the number of shards follows from its sum, so a
    task holds about ``shard_hashes`` at most, however large the input. The counts stay in the shards; the driver gets bit tables of a fixed size. ``least`` is the
    smallest power of two for which at most a quarter of the bits are taken, 2 unless there are very
    many repeated hashes; then only the more frequent ones are marked.
    """
    bits = shard_bits(rows.agg(F.coalesce(F.sum(most), F.lit(0)).cast("long")).first()[0], shard_hashes)
    sent = rows.mapInArrow(_count_rows(items_of, bits), "shard long, width long, steps binary, counts binary")
    counted = write_and_read(sent.groupBy("shard").applyInArrow(_count_shard(bits), "shard long, level long, n long, bits binary"), "marks")
    sizes = {r["level"]: r["n"] for r in counted.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    least = 2
    while sizes.get(least, 0) > 1 << (MARK_BITS - 2):
        least *= 2
    tables = []
    for k in range(levels):
        table = np.zeros(1 << (MARK_BITS - 3), np.uint8)
        for r in counted.where(F.col("level") == least * LEVEL_STEP**k).select("shard", "bits").toLocalIterator():
            table[r["shard"] * (len(table) >> bits) : (r["shard"] + 1) * (len(table) >> bits)] = np.frombuffer(r["bits"], np.uint8)
        tables.append(_packed(table))
    return Marks(least, tables)
