"""Language identification by a string kernel.

Two texts are compared by the n-grams they share: the blended-spectrum presence kernel
``|A & B| / sqrt(|A| |B|)`` over their sets of n-grams of 1 to 4 bytes of UTF-8 (A-Z lower-cased, any
white space as one kind). Ridge regression in the span of landmark texts (Nystroem) is fitted one
language against the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from panelcast.llm import text as tx
from panelcast.llm.sampling import draw, plain, remainder, restored
from panelcast.session import write_and_read

LENGTHS = (1, 2, 3, 4)
DIMENSIONS = 1 << 15
LANDMARKS = 256
SAMPLE = 1000
RIDGE = 1e-3
SHARPNESS = 6.0
UNKNOWN = "und"
ROWS = 128
_CODE = tx.seeded(3, 256)
_CODE[65:91] = _CODE[97:123]
_CODE[[*range(0x09, 0x0E)]] = _CODE[0x20]
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0 and 1 per text over hashed n-grams, and whether the text has a letter."""
    data, offsets = tx.raw(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    flat, width = out.reshape(-1), len(data)
    letters = tx.row_sums(_LETTER[data].astype(np.int64), offsets) > 0
    for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)).tolist():
        letters[i] = any(c.isalpha() for c in texts[i].as_py())
    for lo in range(0, width, 1 << 19):
        hi = min(width, lo + (1 << 19))
        code = _CODE[data[lo : min(width, hi + max(LENGTHS) - 1)]]
        row = np.searchsorted(offsets, np.arange(lo, hi), "right") - 1
        left = offsets[row + 1] - np.arange(lo, hi)
        base = row * DIMENSIONS
        gram = np.zeros(hi - lo, tx.U)
        for n in range(1, max(LENGTHS) + 1):
            size = min(hi - lo, len(code) - n + 1)
            gram = gram[:size] + code[n - 1 : n - 1 + size] * tx.PLACE[n]
            if n in LENGTHS:
                inside = left[:size] >= n
                at = (tx.mix(gram) >> tx.U(20)).astype(np.int64) & (DIMENSIONS - 1)
                flat[(base[:size] + at)[inside]] = 1
    return out, letters


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows divided by the root of their number of n-grams, so products are kernel values."""
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` (n-grams x languages) is landmarks' rows times their ridge coefficients.

    A text's kernel with the landmarks times the coefficients is the text's scaled row times
    ``weights``: the same product, taken in the other order.
    """

    languages: tuple[str, ...]
    weights: np.ndarray

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        rows, letters = presence(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margins = SHARPNESS * (scaled(rows) @ self.weights).astype(np.float64)
        chance = np.exp(margins - margins.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters, chance[np.arange(len(best)), best], 0.0)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, grams) of texts: the n-grams that each holds, none for a text without letter."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            rows, letters = presence(batch.column("text"))
            held = [np.flatnonzero(r).astype(np.int32) if ok else None for r, ok in zip(rows, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), batch.column("lang"), pa.array(held, pa.list_(pa.int32()))], names=["key", "lang", "grams"])
        del rows, held
        tx.release()


def _shared_with(landmarks):
    """(key, lang, digest, size, shared): how many n-grams a text has, and has in common with each landmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros((DIMENSIONS, len(landmarks.value)), np.uint8)
        for k, grams in enumerate(landmarks.value):
            marks[grams, k] = 1
        for batch in batches:
            lists = [x.values.to_numpy() for x in batch.column("grams")]
            shared = [marks[x].sum(0, dtype=np.int32) for x in lists]
            arrays = [batch.column(c) for c in ("key", "lang", "digest")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(x) for x in lists], pa.int32()), pa.array(shared, pa.list_(pa.int32()))], names=["key", "lang", "digest", "size", "shared"])

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Fits on at most 1.25 x ``sample`` texts per language, of which ``landmarks`` in all are landmarks.

    The texts are drawn by a hash of the key. Their n-gram sets are made and compared with the
    landmarks' where the texts lie; the driver gets the landmarks' sets, and of each text one count
    per landmark. Rows without language or letter are not learned from.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    order = [(c, "ascending") for c in ("key", "lang", "digest")]
    drawn = draw(known, sample, "lang", "key").mapInArrow(_gram_rows, "key string, lang string, grams array<int>").where("grams is not null")
    drawn = write_and_read(drawn.withColumn("digest", F.xxhash64("grams")), "grams")
    told = drawn.select("key", "lang", "digest").toArrow().sort_by(order)
    languages = tuple(sorted(set(told.column("lang").to_pylist())))
    if not languages:
        return LanguageModel((), np.zeros((DIMENSIONS, 0), np.float32))
    y = np.array([languages.index(x) for x in told.column("lang").to_pylist()])
    turn = np.zeros(len(y), np.int64)
    for k in range(len(languages)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((y, turn))[:landmarks]
    digests = told.column("digest").take(pa.array(chosen)).to_pylist()
    sets = drawn.where(F.col("digest").isin(digests)).dropDuplicates(["digest"]).select("digest", "grams").toArrow()
    by_digest = dict(zip(sets.column("digest").to_pylist(), (x.values.to_numpy() for x in sets.column("grams")), strict=True))
    marks = [by_digest[x] for x in digests]

    held = drawn.sparkSession.sparkContext.broadcast(marks)
    got = drawn.mapInArrow(_shared_with(held), "key string, lang string, digest long, size int, shared array<int>").toArrow().sort_by(order)
    kernel = np.stack([x.values.to_numpy() for x in got.column("shared")]).astype(np.float64)
    root = np.sqrt([len(x) for x in marks])
    kernel /= np.sqrt(got.column("size").to_numpy())[:, None] * root
    goal = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.bincount(y)[y][:, None]
    left = kernel.T @ (weight * kernel) + ridge * kernel[chosen] + 1e-9 * np.eye(len(marks))
    beta = np.linalg.solve(left, kernel.T @ (weight * goal)) / root[:, None]
    weights = np.zeros((DIMENSIONS, len(languages)))
    for grams, share in zip(marks, beta, strict=True):
        weights[grams] += share
    model = LanguageModel(languages, weights.astype(np.float32))
    del told, got, sets, kernel, left
    tx.release()
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1); ``und`` with score 0 for null, empty and letterless texts.

    Columns of ``docs`` pass through, except ones of these two names, which are replaced. Any text
    length is read whole; an empty table stays empty; rows are scored one by one, so repeats agree.
    """
    d, back = plain(docs.drop("lang_pred", "score"))
    text = back[text]
    held = d.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in tx.slices(whole, text):
                for start in range(0, part.num_rows, ROWS):
                    batch = part.slice(start, ROWS)
                    names, score = held.value.score(batch.column(text))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
            tx.release()

    schema = T.StructType([*d.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return restored(d.mapInArrow(run, schema), back)


def train_part(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.where(remainder(key, 5) != 0)
