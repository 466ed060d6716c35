"""Quality scores by a generalised additive model with pairwise interactions.

The score is the logistic of a sum of lookup tables: one per feature over its bins, and some over
pairs of features. The tables are learned by cyclic boosting: in turn, each feature gets a shallow
tree fitted to the current gradient and adds a small part of it to its table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from panelcast.llm import text as tx
from panelcast.llm.sampling import draw, plain, remainder, restored

SAMPLE = 20_000
BINS = 64
GRID = 12
ROUNDS = 250
PAIR_ROUNDS = 120
PAIRS = 12
RATE = 0.08
LEAF_WEIGHT = 4.0
FEATURES = (
    "words", "bytes", "word_size", "word_spread", "longest", "short_words", "distinct_words", "top_word", "distinct_shingles", "capitals",
    "digits", "spaces", "lines", "commas", "stops", "shouts", "bars", "signs", "other_punctuation", "beyond_ascii", "entropy", "single_bytes", "heads", "line_words",
)
_KINDS = np.zeros((256, 10))
for _k, _bytes in enumerate((range(65, 91), range(48, 58), (32, 9, 11, 12, 13), (10,), b",;:", b".", b"!?", b"|", b"#$%&*@^~<>=+_\\/[]{}", b"\"'()-`")):
    _KINDS[list(_bytes), _k] = 1


def _largest_run(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each row's most frequent item stands there (items sorted within rows)."""
    fresh = np.ones(len(items), bool)
    fresh[1:] = items[1:] != items[:-1]
    fresh[starts[:-1][starts[:-1] < len(items)]] = True
    at = np.flatnonzero(fresh)
    run = np.diff(np.append(at, len(items)))
    out = np.zeros(len(starts) - 1, np.int64)
    np.maximum.at(out, np.searchsorted(starts, at, "right") - 1, run)
    return out


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, from the text alone; null counts as empty."""
    s = tx.spans(texts)
    data, offsets, hashes, size = s["data"], s["offsets"], s["hash"], s["size"]
    _, ends = tx.raw(texts)
    n = len(texts)
    byte_rows = np.zeros((n, 256))
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if b > a:
            byte_rows[i] = np.bincount(data[a:b], minlength=256)
    total = np.maximum(np.diff(ends), 1)
    words = np.diff(offsets)
    some = np.maximum(words, 1)
    kinds = byte_rows @ _KINDS / total[:, None]
    share = byte_rows / total[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    mean = tx.row_sums(size.astype(np.float64), offsets) / some
    spread = np.sqrt(np.maximum(tx.row_sums(size.astype(np.float64) ** 2, offsets) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, tx.rows_of(offsets), size)
    sets, set_starts = tx.shingles(hashes, offsets)
    possible = np.maximum(words - tx.SHINGLE_WORDS + 1, (words > 0).astype(np.int64))
    held = hashes.copy()
    unique, starts = tx.distinct(held, offsets)
    top = _largest_run(held, offsets)
    capital = (data[s["at"]] >= 65) & (data[s["at"]] <= 90) if len(size) else np.zeros(0, bool)
    lines = byte_rows[:, 10] + 1
    columns = (
        np.log1p(words), np.log1p(np.diff(ends)), mean, spread, np.log1p(longest), tx.row_sums((size <= 3).astype(np.int64), offsets) / some, np.diff(starts) / some, top / some,
        np.diff(set_starts) / np.maximum(possible, 1), kinds[:, 0], kinds[:, 1], kinds[:, 2], kinds[:, 3], kinds[:, 4], kinds[:, 5], kinds[:, 6], kinds[:, 7], kinds[:, 8], kinds[:, 9],
        byte_rows[:, 128:].sum(1) / total, entropy, tx.row_sums((size == 1).astype(np.int64), offsets) / some, tx.row_sums(capital.astype(np.int64), offsets) / some, np.log1p(words / lines),
    )
    return np.stack(columns, 1)


def _feature_rows(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                x = features(batch.column("text"))
                arrays = [batch.column(c) for c in columns] + [pa.array(np.ascontiguousarray(x[:, j])) for j in range(x.shape[1])]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *FEATURES])

    return run


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A tree over ordered bins with at most ``leaves`` leaves: the Newton step of every bin's leaf."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        cut = np.arange(a + 1, b)
        if not len(cut):
            return 0.0, -1
        gl, hl, gt, ht = cg[cut] - cg[a], ch[cut] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
        gain = gl**2 / (hl + LEAF_WEIGHT) + (gt - gl) ** 2 / (ht - hl + LEAF_WEIGHT) - gt**2 / (ht + LEAF_WEIGHT)
        i = int(gain.argmax())
        return float(gain[i]), int(cut[i])

    parts = [(0, len(g), *best(0, len(g)))]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda k: parts[k][2])
        a, b, gain, cut = parts[i]
        if cut < 0 or gain <= 1e-9:
            break
        parts[i : i + 1] = [(a, cut, *best(a, cut)), (cut, b, *best(cut, b))]
    out = np.zeros(len(g))
    for a, b, *_ in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + LEAF_WEIGHT)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that cuts both features once: its gain and the Newton step of every cell."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    gain, parts = 0.0, []
    for rows in ((0, 1), (1, 0)):
        for cols in ((0, 1), (1, 0)):
            def corner(c, rows=rows, cols=cols):
                top = c[1:-1, :] if rows[1] else c[-1:, :] - c[1:-1, :]
                return top[:, 1:-1] if cols[1] else top[:, -1:] - top[:, 1:-1]
            gain = gain + corner(cg) ** 2 / (corner(ch) + LEAF_WEIGHT)
            parts.append((rows[1], cols[1], corner(cg) / (corner(ch) + LEAF_WEIGHT)))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for low, left, step in parts:
        out[slice(0, i + 1) if low else slice(i + 1, None), slice(0, j + 1) if left else slice(j + 1, None)] = step[i, j]
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + LEAF_WEIGHT)), out


@dataclass(frozen=True)
class AdditiveModel:
    """Bin edges and tables per feature; coarse edges and tables per pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for every row: lookups in the tables, added up."""
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for (j, k), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[j], x[:, j], "right"), np.searchsorted(self.coarse[k], x[:, k], "right")]
        return sigmoid(total)


def boost(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fits the tables to labels 0 and 1; without rows every score is 0.5."""
    cut = lambda column, n: np.unique(np.quantile(column, np.arange(1, n) / n)) if len(column) else np.zeros(0)
    edges, coarse = [cut(c, BINS) for c in x.T], [cut(c, GRID) for c in x.T]
    tables = [np.zeros(len(e) + 1) for e in edges]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    total = np.full(len(y), base)
    for _ in range(ROUNDS if len(y) else 0):
        for j, b in enumerate(bins):
            p = sigmoid(total)
            step = RATE * _tree(np.bincount(b, y - p, len(tables[j])), np.bincount(b, p * (1 - p), len(tables[j])))
            tables[j] += step
            total += step[b]
    cells = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T, strict=True)]
    sizes = [len(e) + 1 for e in coarse]

    def grid(j: int, k: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cells[j] * sizes[k] + cells[k], v, sizes[j] * sizes[k]).reshape(sizes[j], sizes[k])

    p = sigmoid(total)
    gains = {(j, k): _quarters(grid(j, k, y - p), grid(j, k, p * (1 - p)))[0] for j, k in combinations(range(x.shape[1]), 2) if sizes[j] > 1 and sizes[k] > 1}
    pairs = sorted(gains, key=lambda jk: (-gains[jk], jk))[:PAIRS]
    pair_tables = [np.zeros((sizes[j], sizes[k])) for j, k in pairs]
    for _ in range(PAIR_ROUNDS):
        for i, (j, k) in enumerate(pairs):
            p = sigmoid(total)
            step = RATE * _quarters(grid(j, k, y - p), grid(j, k, p * (1 - p)))[1]
            pair_tables[i] += step
            total += step[cells[j], cells[k]]
    return AdditiveModel(base, edges, tables, coarse, pairs, pair_tables)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> AdditiveModel:
    """Fits on at most 1.25 x ``sample`` labelled documents, drawn by a hash of the key.

    Only the drawn keys are joined to the documents, and only their features reach the driver. Null
    labels and keys are not learned from; a document with two labels counts with both.
    """
    chosen = draw(labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")), sample, None, "key")
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    names = ["key", "label"]
    schema = "key " + d.schema["key"].dataType.simpleString() + ", label int, " + ", ".join(f"{f} double" for f in FEATURES)
    got = d.mapInArrow(_feature_rows(names), schema).toArrow().sort_by([("key", "ascending"), ("label", "ascending"), ("bytes", "ascending")])
    x = np.stack([got.column(f).to_numpy() for f in FEATURES], 1) if got.num_rows else np.zeros((0, len(FEATURES)))
    return boost(x, got.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the chance of label 1 to every document; null and empty texts are scored as empty.

    Columns pass through, except one called ``name``, which is replaced.
    """
    d, back = plain(docs.drop(name))
    text = back[text]
    held = d.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, text):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(features(batch.column(text))))], names=[*batch.schema.names, name])

    return restored(d.mapInArrow(run, T.StructType([*d.schema.fields, T.StructField(name, T.DoubleType())])), back)


def train_part(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    return labels.where(remainder(key, 5) != 0)
