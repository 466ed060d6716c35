"""Vectorised text primitives for Arrow batches: words, shingles and their 64-bit hashes.

Texts are read as UTF-8 bytes straight from Arrow buffers, so no Python object is made per row or word.
A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. Words and shingles are
identified by 64-bit hashes (a polynomial over a random byte table, then a bijective mixer): for sets of
n items the chance that any two differ and hash alike is about n^2 / 4e19.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 18
SHINGLE_WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values that depend on ``seed`` alone."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(0x9E3779B97F4A7C15))


BYTE = seeded(1, 256)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
PLACE = seeded(2, 16) | U(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER, UNPOWER = powers(BASE, BLOCK_BYTES), powers(UNBASE, BLOCK_BYTES)


def release() -> None:
    """Gives free memory back to the system, which the pools of Arrow and of the C library would keep for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most ``most`` bytes together, or one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def sliced(batches: Iterator[pa.RecordBatch], column: str, make: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """What ``make`` makes of each of the ``slices`` of a task's batches; without ``column``, of each batch.

    Nothing of a slice is held once it is done, and free memory is given back after each and at the
    end, when the last batch is gone too: a worker that waits for its next task keeps neither.
    """
    for whole in batches:
        for part in slices(whole, column, most) if column in whole.schema.names else [whole]:
            yield make(part)
            release()
        whole = part = None
    release()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and where each row starts (one more entry for the end); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _blocks(cut: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK_BYTES that end only where ``cut`` is true (or at the end)."""
    start = 0
    while start < n:
        stop = start + BLOCK_BYTES
        if stop >= n:
            stop = n
        else:
            back = np.flatnonzero(cut[start + 1 : stop + 1])
            if len(back):
                stop = start + 1 + int(back[-1])
            else:
                ahead = np.flatnonzero(cut[stop + 1 :])
                stop = stop + 1 + int(ahead[0]) if len(ahead) else n
        yield start, stop
        start = stop


def spans(texts: pa.Array, trim: bool = False) -> dict[str, np.ndarray]:
    """All words of all rows, in order: ``hash``, first byte ``at``, ``size`` in bytes; ``offsets`` has each row's first word.

    ``trim`` leaves a full stop or comma at the end off a word if an ASCII letter stands before it,
    and tells it as ``tail`` (its byte, or 0). ``data`` are the bytes.
    """
    data, offsets = raw(texts)
    n = len(data)
    found: dict[str, list] = {"hash": [np.zeros(0, U)], "at": [np.zeros(0, np.int64)], "size": [np.zeros(0, np.int64)], "tail": [np.zeros(0, np.uint8)]}
    if n:
        solid = ~SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | first[1:n]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | first[1:n]
        for a, b in _blocks(first[:n] | ~solid, n):
            s, e = np.flatnonzero(begin[a:b]), np.flatnonzero(end[a:b])
            if not len(s):
                continue
            part = data[a:b]
            if trim:
                last, before = part[e], part[np.maximum(e - 1, s)]
                cut = ((last == 46) | (last == 44)) & (e > s) & (((before | 32) >= 97) & ((before | 32) <= 122))
                found["tail"].append(np.where(cut, last, 0).astype(np.uint8))
                e = e - cut
            up, down = (POWER, UNPOWER) if b - a <= BLOCK_BYTES else (powers(BASE, b - a), powers(UNBASE, b - a))
            sums = np.zeros(b - a + 1, U)
            np.cumsum(BYTE[part] * up[: b - a], out=sums[1:])
            found["hash"].append(mix((sums[e + 1] - sums[s]) * down[s] + (e - s + 1).astype(U)))
            found["at"].append(s + a)
            found["size"].append(e - s + 1)
    out = {k: np.concatenate(v) for k, v in found.items()}
    return out | {"offsets": np.searchsorted(out["at"], offsets).astype(np.int64), "data": data}


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, in order, and where each row's words start (one entry more)."""
    s = spans(texts)
    return s["hash"], s["offsets"]


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Every row's set of word shingles, ascending without repeats; a row of fewer words is one shingle.

    Returns the shingle hashes and where each row's set starts; rows without words have none.
    """
    size = np.diff(offsets)
    count = np.where(size >= width, size - width + 1, (size > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(size)), count)
    at = offsets[:-1][row] + (np.arange(len(row)) - starts[:-1][row])
    left = np.minimum(size[row], width)
    out = left.astype(U) * PLACE[15]
    short = left < width
    for j in range(width):
        if short.any():
            held = at + j < offsets[1:][row]
            out += np.where(held, hashes[np.minimum(at + j, len(hashes) - 1)] * PLACE[j], U(0))
        else:
            out += hashes[at + j] * PLACE[j]
    return distinct(mix(out), starts)


def distinct(items: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's items ascending and without repeats (sorts ``items`` in place)."""
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a > 1:
            items[a:b].sort()
    keep = np.ones(len(items), bool)
    keep[1:] = items[1:] != items[:-1]
    keep[starts[:-1][starts[:-1] < len(items)]] = True
    return items[keep], np.concatenate([[0], np.cumsum(keep)])[starts].astype(np.int64)


def row_sums(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row's items, 0 for a row without any."""
    sums = np.concatenate([np.zeros(1, items.dtype), np.cumsum(items)])
    return sums[starts[1:]] - sums[starts[:-1]]


def lists(items: np.ndarray, starts: np.ndarray) -> pa.Array:
    """An Arrow list<int64> array of each row's items."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(np.ascontiguousarray(items).view(np.int64)))
