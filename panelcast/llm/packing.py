"""Packing documents into token sequences by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelcast.llm import text as tx
from panelcast.session import write_and_read

WINDOW = 2048
BLOCK_PIECES = 50_000
HELD = 1 << 21
PIECE = "key long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer and, by id, whether a token ends a run of letters or signs."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ends = np.zeros(t.get_vocab_size(), bool)
    for token, i in t.get_vocab().items():
        ends[i] = token.endswith("</w>")
    return t, ends


def encode_words(vocabulary: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every word, end to end, and where each word's ids start.

    A word of small letters only is one run for the tokenizer, so such words are encoded many at a
    time, parted by spaces, and told apart by the tokens that end a run. Others go one by one.
    """
    tokenizer, ends = _tokenizer(path)
    ids: list = [None] * len(vocabulary)
    plain, other = [], []
    texts = [w.decode("utf-8", "replace") for w in vocabulary]
    for i, w in enumerate(texts):
        (plain if w.isalpha() and w == w.lower() else other).append(i)
    for a in range(0, len(plain), 512):
        part = plain[a : a + 512]
        got = np.asarray(tokenizer.encode(" ".join([texts[i] for i in part]), add_special_tokens=False).ids, np.int32)
        stops = np.flatnonzero(ends[got]) + 1
        if len(stops) != len(part):
            other += part
            continue
        for i, lo, hi in zip(part, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
            ids[i] = got[lo:hi]
    for a in range(0, len(other), 1024):
        part = other[a : a + 1024]
        for i, e in zip(part, tokenizer.encode_batch([texts[i] for i in part], add_special_tokens=False), strict=True):
            ids[i] = np.asarray(e.ids, np.int32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), starts


class Words:
    """Ids of words met before, by hash: about HELD words and ids, or those of the last slice if it has more."""

    def __init__(self, path: str):
        self.path = path
        self.hash, self.flat, self.starts = np.zeros(0, tx.U), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.signs, self.sign_starts = encode_words([b".", b","], path)

    def find(self, hashes: np.ndarray, spell: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """Places of ascending ``hashes`` among the held words; new ones, as ``spell`` tells them, are encoded and held."""
        at = np.searchsorted(self.hash, hashes)
        met = at < len(self.hash)
        met[met] = self.hash[at[met]] == hashes[met]
        new = np.flatnonzero(~met)
        if len(new):
            flat, starts = encode_words(spell(new), self.path)
            sizes = np.diff(self.starts)
            keep = np.arange(len(sizes)) if len(self.hash) + len(self.flat) + len(new) + len(flat) <= HELD else at[met]
            names = np.concatenate([self.hash[keep], hashes[new]])
            order = np.argsort(names)
            first = np.concatenate([self.starts[:-1][keep], starts[:-1] + len(self.flat)])[order]
            sizes = np.concatenate([sizes[keep], np.diff(starts)])[order]
            self.flat = laid_out(np.concatenate([self.flat, flat]), first, sizes)
            self.hash, self.starts = names[order], np.concatenate([[0], np.cumsum(sizes)])
        return np.searchsorted(self.hash, hashes)


def laid_out(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` end to end: ``sizes`` entries from each of ``first``."""
    reach = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(first - reach[:-1], sizes) + np.arange(reach[-1])]


def encode(texts: pa.Array, path: str, held: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every row, end to end, and where each row's ids start; null is empty.

    The tokenizer drops white space and never joins across it, so each distinct word that is not
    among those ``held`` is encoded once and its ids are laid out per occurrence. Rows with ``<|``,
    which may hold the special tokens' own strings, are encoded whole.
    """
    held = held or Words(path)
    whole = {i for i, x in enumerate(pa.compute.fill_null(pa.compute.match_substring(texts, "<|"), False).to_pylist()) if x}
    w = tx.spans(texts, trim=True)
    hashes, first, which = np.unique(w["hash"], return_index=True, return_inverse=True)
    at, size, data = w["at"][first], w["size"][first], w["data"]
    which = held.find(hashes, lambda new: [data[a : a + n].tobytes().lower() for a, n in zip(at[new].tolist(), size[new].tolist(), strict=True)])[which]
    stop, comma = len(held.hash), len(held.hash) + 1
    flat, starts = np.concatenate([held.flat, held.signs]), np.append(held.starts, held.starts[-1] + held.sign_starts[1:])
    n_ids = np.diff(starts)
    rows, counts = [], []
    offsets = w["offsets"]
    for lo in range(0, len(offsets) - 1, 256):
        hi = min(lo + 256, len(offsets) - 1)
        a, b = offsets[lo], offsets[hi]
        tail = w["tail"][a:b]
        parts = np.empty(2 * (b - a), np.int64)
        parts[0::2] = which[a:b]
        parts[1::2] = np.where(tail == 46, stop, np.where(tail == 44, comma, -1))
        here = parts >= 0
        ends = np.concatenate([[0], np.cumsum(here)])[2 * (offsets[lo : hi + 1] - a)]
        parts = parts[here]
        sizes = n_ids[parts]
        out = laid_out(flat, starts[parts], sizes)
        edge = np.concatenate([[0], np.cumsum(sizes)])[ends]
        for i in range(lo, hi):
            if i in whole:
                got = np.asarray(_tokenizer(path)[0].encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
            else:
                got = out[edge[i - lo] : edge[i - lo + 1]]
            rows.append(got)
            counts.append(len(got))
    return (np.concatenate(rows) if rows else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Tokens of every document and ``end_id``, cut into full windows and a rest: one row per piece.

    Columns: key, start, length, ids_crc32 (of the ids as little-endian 32-bit numbers), doc_tokens
    and ids (null unless asked for). A null or empty text is the one token ``end_id``.
    """

    def one(batch: pa.RecordBatch, held: Words) -> pa.RecordBatch:
        flat, starts = encode(batch.column("text"), tokenizer, held)
        out: list[list] = [[], [], [], [], [], []]
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            doc = np.append(flat[a:b], np.int32(end_id)).astype("<i4")
            for s in range(0, len(doc), window):
                piece = doc[s : s + window]
                row = (i, s, len(piece), zlib.crc32(piece.tobytes()), len(doc), piece.tolist() if ids else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        arrays = [batch.column("key").take(pa.array(out[0], pa.int64())), *[pa.array(c, pa.int64()) for c in out[1:5]], pa.array(out[5], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Words(tokenizer)
        yield from tx.sliced(batches, "text", lambda batch: one(batch, held))

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, PIECE)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over capacities 0..window that counts them."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, sequence: int) -> None:
        self.held[capacity].append(sequence)
        self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the open window of the least capacity that is at least ``need``."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.held[capacity].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece: longest first, each into the tightest window that holds it."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows, n = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        got = windows.tightest(need)
        if got is None:
            capacity, s = window, n
            n += 1
        else:
            capacity, s = got
        sequence[i], offset[i] = s, window - capacity
        if capacity > need:
            windows.put(capacity - need, s)
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1, ids: bool = False, block: int = BLOCK_PIECES) -> DataFrame:
    """Every piece with its sequence and its place there (``sequence_id``, ``offset``).

    Pieces of a full window are sequences by themselves. The others are dealt at random into blocks
    of about ``block`` pieces, each packed by one task on its own, so memory does not grow with the
    input; a block wastes at most a few windows. Pieces never cross blocks. Repeated rows are pieces
    of their own; an empty table gives no pieces. Other columns of ``docs`` are not read.
    """
    cut = write_and_read(pieces(docs, tokenizer, key, text, window, end_id, ids), "pieces")
    cut = cut.withColumn("at", F.monotonically_increasing_id())
    blocks = max(1, round(cut.where(F.col("length") < window).count() / block))

    def run(table: pa.Table) -> pa.Table:
        sequence, offset = best_fit(table.column("length").to_numpy(), window)
        base = table.column("block")[0].as_py() << 32
        return table.drop_columns(["at", "block"]).append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    rest = cut.where(F.col("length") < window).withColumn("block", F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("long"))
    rest = rest.groupBy("block").applyInArrow(run, PIECE + ", sequence_id long, offset long")
    full = cut.where(F.col("length") == window).withColumn("sequence_id", F.lit(1 << 62) + F.col("at")).withColumn("offset", F.lit(0).cast("long")).drop("at")
    return full.unionByName(rest).withColumnRenamed("key", key)
