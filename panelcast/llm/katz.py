"""Language-model scores by Katz backoff: a bigram model over a unigram model over unknown words.

``P(w | h) = d c(hw) / c(h)`` for a pair seen in training and ``alpha(h) P(w)`` otherwise, where ``P(w)``
is ``d c(w) / N`` for a word seen in training and what the discounts leave, for the one class of
unknown words, otherwise. Discounts d are Good-Turing's for counts up to 5. ``alpha(h)`` is the mass that
the discounts leave to h, over the unigram mass of the words not seen after h, so probabilities add
up to 1 exactly after every history. A text starts after a start mark and ends with an end token.

Scoring needs, for every token, counts that lie with its word and with the word before it. Tokens are
sent to shards by word, in one compact block per batch of documents and shard (about 8 bytes for
each pair that a document holds); very common words are spread by the word before, and very common
pairs, whose counts are known beforehand, by batch; a shard holds the rows of the bigram table for its words. It answers with sums per document
and how many seen pairs of each small count these hold, and passes on, by history, the mass that its
pairs take and how much of each small count there is; none of this needs the pairs' discounts. These
follow from the counts of counts of all shards, which are summed first. Shards by history then turn
the masses into alpha and answer for the unseen pairs. No table is ever held whole anywhere.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelcast.llm import text as tx
from panelcast.session import write_and_read

START, END = (tx.U(x) for x in tx.seeded(9, 2))
SMALL = 5
KEPT_BACK = 1e-4
SHARD_TOKENS = 2_000_000
SLICE = 8 << 20
DOCS, SUMS, MASS, UNSEEN, COUNTS = range(5)
BLOCK = "dest long, batch long, kind int, keys array<long>, payload binary"


def discounts(counts: np.ndarray) -> np.ndarray:
    """Factors from the counts of all items, by their counts of counts."""
    return factors_of(np.bincount(np.minimum(counts[counts > 0], SMALL + 2), minlength=SMALL + 3)[: SMALL + 2])


def factors_of(seen: np.ndarray) -> np.ndarray:
    """Factors for counts 0..SMALL + 1, the last for all larger ones; ``seen`` tells how many items have each of the counts 0..SMALL + 1.

    Katz's form of Good-Turing; where the counts of counts do not allow it (a zero among them, or a
    factor outside (0, 1)), absolute discounting by n1 / (n1 + 2 n2) instead. Larger counts give up
    KEPT_BACK of their mass, so that every history leaves some for unseen words.
    """
    n = np.asarray(seen, float)
    r = np.arange(1, SMALL + 1)
    out = np.full(SMALL + 2, 1 - KEPT_BACK)
    with np.errstate(all="ignore"):
        a = (SMALL + 1) * n[SMALL + 1] / n[1]
        d = ((r + 1) * n[2 : SMALL + 2] / (r * n[1 : SMALL + 1]) - a) / (1 - a)
    if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
        by = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = (r - min(max(by, 0.1), 0.9)) / r
    out[1 : SMALL + 1] = d
    return out


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * factors[np.minimum(counts, SMALL + 1)]


@dataclass(frozen=True)
class Unigrams:
    """Size of the training text, discounts, mass of unknown words, and counts of the words and pairs that are spread over shards.

    ``pairs`` are the hashes of the hot pairs, ascending, with the word before, the word and the count of each.
    """

    shards: int
    total: int
    distinct: int
    factors: np.ndarray
    unknown: float
    hot: np.ndarray
    hot_counts: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, tx.U))
    pair_before: np.ndarray = field(default_factory=lambda: np.zeros(0, tx.U))
    pair_word: np.ndarray = field(default_factory=lambda: np.zeros(0, tx.U))
    pair_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def chance(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.factors) / max(self.total, 1), self.unknown)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows with their end tokens, the token before each, and where each row starts."""
    parts = [tx.words(part.column("text")) for part in tx.slices(batch, "text")]
    words = np.concatenate([w for w, _ in parts])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for _, at in parts]))])
    del parts
    n = len(offsets) - 1
    starts = offsets + np.arange(n + 1)
    out = np.empty(len(words) + n, tx.U)
    ends = starts[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = words, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[starts[:-1]] = START
    return out, before, starts


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tx.slices(whole, "text", SLICE):
            items, n = np.unique(_tokens(batch)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(items.view(np.int64)), pa.array(n)], names=["word", "n"])


def unigrams(train: DataFrame, shard_tokens: int = SHARD_TOKENS) -> Unigrams:
    """Counts all words of the training texts, kept as a written table; the driver gets totals.

    Words with more than half a shard's share of all tokens are fewer than twice the shards; only
    those reach the driver by name, since their pairs are spread over all shards.
    """
    table = train.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    table = write_and_read(table, "unigrams")
    total, distinct, rest = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("n") > SMALL, F.col("n"))), F.lit(0))).first()
    shards = max(1, -(-total // shard_tokens))
    small = np.zeros(SMALL + 2, np.int64)
    for r in table.where(F.col("n") <= SMALL + 1).groupBy("n").agg(F.count("*").alias("words")).collect():
        small[r["n"]] = r["words"]
    factors = factors_of(small)
    r = np.arange(1, SMALL + 1)
    left = ((1 - factors[1 : SMALL + 1]) * r * small[1 : SMALL + 1]).sum() + KEPT_BACK * rest
    hot = table.where(F.col("n") > total / (2 * shards)).orderBy("word").toArrow() if shards > 1 else pa.table({"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    words = hot.column("word").to_numpy().view(tx.U)
    order = np.argsort(words)
    return Unigrams(shards, total, distinct, factors, left / total if total else 1.0, words[order], hot.column("n").to_numpy()[order])


def _pair_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return tx.mix(before ^ tx.mix(words))


def _pair_counts(model):
    """How often each pair of two hot words, or of the start and a hot word, stands in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = model.hot
        for whole in batches:
            for batch in tx.slices(whole, "text", SLICE):
                words, before, _ = _tokens(batch)
                on = _among(hot, words)
                words, before = words[on], before[on]
                on = (before == START) | _among(hot, before)
                words, before = words[on], before[on]
                _, first, n = np.unique(_pair_hash(before, words), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(before[first].view(np.int64)), pa.array(words[first].view(np.int64)), pa.array(n)], names=["before", "word", "n"])

    return run


def with_hot_pairs(train: DataFrame, model: Unigrams) -> Unigrams:
    """The model with the pairs that have more than half a shard's share of all tokens, fewer than twice the shards.

    Both words of such a pair are hot (or the first is the start), so no other pairs are counted here.
    """
    if not len(model.hot):
        return model
    table = train.select("text").mapInArrow(_pair_counts(model), "before long, word long, n long").groupBy("before", "word").agg(F.sum("n").alias("n"))
    found = table.where(F.col("n") > model.total / (2 * model.shards)).toArrow()
    before, word = (found.column(c).to_numpy().view(tx.U) for c in ("before", "word"))
    pairs = _pair_hash(before, word)
    order = np.argsort(pairs)
    return replace(model, pairs=pairs[order], pair_before=before[order], pair_word=word[order], pair_counts=found.column("n").to_numpy()[order])


def _find(sorted_items: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Where each item stands, -1 if it does not."""
    if not len(sorted_items):
        return np.full(len(items), -1)
    at = np.minimum(np.searchsorted(sorted_items, items), len(sorted_items) - 1)
    return np.where(sorted_items[at] == items, at, -1)


def _among(sorted_items: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Whether each item is there, found block by block to keep memory low."""
    out = np.zeros(len(items), bool)
    for a in range(0, len(items) if len(sorted_items) else 0, 1 << 20):
        out[a : a + (1 << 20)] = _find(sorted_items, items[a : a + (1 << 20)]) >= 0
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([struct.pack("<i", len(arrays))] + [struct.pack("<2sq", a.dtype.str[1:].encode(), a.nbytes) + a.tobytes() for a in arrays])


def _unpack(payload: bytes) -> list[np.ndarray]:
    out, at = [], 4
    for _ in range(struct.unpack_from("<i", payload)[0]):
        kind, size = struct.unpack_from("<2sq", payload, at)
        at += 10
        out.append(np.frombuffer(payload, "<" + kind.decode(), size // int(kind[1:2]), at))
        at += size
    return out


def _narrow(x: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """Whole numbers below ``top`` as a low and a high part that together take few bytes."""
    high = (x >> 16).astype(np.uint8 if top <= 1 << 24 else np.uint32) if top > 1 << 16 else np.zeros(0, np.uint8)
    return (x & 0xFFFF).astype(np.uint16), high


def _widen(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) if not len(high) else low.astype(np.int64) | (high.astype(np.int64) << 16)


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the least type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["dest", "batch", "kind", "keys", "payload"])


def _send(model):
    """Per batch of documents: its keys, and one block for each shard: pairs, the documents that hold each, how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, number = model.value, TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in tx.slices(whole, "text", SLICE):
                words, before, starts = _tokens(batch)
                doc = np.repeat(np.arange(len(starts) - 1, dtype=np.uint32), np.diff(starts))
                train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
                yield _rows([(-1 - number, number, DOCS, batch.column("key").to_pylist(), _pack(np.diff(starts)))])
                spread = np.flatnonzero(_among(m.hot, words))
                order = tx.mix(words)
                order[spread] = _pair_hash(before[spread], words[spread])
                # a hot pair goes to another shard from each batch
                spread = spread[_among(m.pairs, order[spread])]
                order[spread] = tx.mix(order[spread] + tx.mix(np.array([number], tx.U)))
                order >>= tx.U(32)
                order *= tx.U(m.shards)
                order >>= tx.U(32)
                shard = order.astype(np.uint16 if m.shards <= 1 << 16 else np.uint32)
                del order, spread
                by = np.argsort(shard, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=m.shards))])
                del shard
                for s in range(m.shards):
                    at = by[cuts[s] : cuts[s + 1]]
                    if not len(at):
                        continue
                    w, of_w = np.unique(words[at], return_inverse=True)
                    names, of_h = np.unique(before[at], return_inverse=True)
                    pairs, of_pair = np.unique(of_w.astype(np.int64) * len(names) + of_h, return_inverse=True)
                    entries, n = np.unique(of_pair.astype(np.int64) * len(starts) + doc[at], return_counts=True)
                    per_word = np.bincount(pairs // len(names), minlength=len(w)).astype(np.uint32)
                    per_pair = _small(np.bincount(entries // len(starts), minlength=len(pairs)))
                    body = _pack(w, per_word, names, *_narrow(pairs % len(names), len(names)), per_pair, *_narrow(entries % len(starts), len(starts)), _small(n), train)
                    yield _rows([(s, number, SUMS, None, body)])
                number += 1
            tx.release()

    return run


def _shard(model):
    """A shard of the bigram table from all its blocks: sums per document, mass by history, unseen pairs, counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        m, shard = model.value, table.column("dest")[0].as_py()
        if shard < 0:
            return table
        tx.release()
        batch = table.column("batch").to_pylist()
        parts = [_unpack(p.as_py()) for p in table.column("payload")]
        del table
        words, wid = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        names, hid = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        w_cut, h_cut = (np.cumsum([0] + [len(p[k]) for p in parts]) for k in (0, 2))
        w = np.concatenate([np.repeat(wid[a:b], p[1]) for a, b, p in zip(w_cut[:-1], w_cut[1:], parts, strict=True)])
        pair = np.concatenate([hid[a:b][_widen(p[3], p[4])] for a, b, p in zip(h_cut[:-1], h_cut[1:], parts, strict=True)]).astype(np.int64)
        pair += w.astype(np.int64) * len(names)
        learnt = np.concatenate([np.bincount(np.repeat(np.arange(len(p[5])), p[5]), p[8] * p[9][_widen(p[6], p[7])].astype(np.int64), len(p[5])) for p in parts]).astype(np.int64)
        counts = np.bincount(w, learnt, len(words)).astype(np.int64)
        hot = _find(m.hot, words)
        counts[hot >= 0] = m.hot_counts[hot[hot >= 0]]
        common = _find(m.pairs, _pair_hash(names[pair % len(names)], words[w])) if len(m.pairs) else np.full(len(pair), -1)
        own = (learnt > 0) & (common < 0)
        kinds, at = np.unique(pair[own], return_inverse=True)
        seen_kind = np.bincount(at, learnt[own], len(kinds)).astype(np.int64)
        at = _find(kinds, pair)
        c_pair = np.where(at >= 0, seen_kind[at] if len(kinds) else 0, 0)
        c_pair[common >= 0] = m.pair_counts[common[common >= 0]]
        del at, own, learnt, common
        chance = m.chance(counts)
        with np.errstate(divide="ignore"):
            value = np.where(c_pair > 0, np.log10(np.maximum(c_pair, 1)), np.log10(chance)[w])
            value -= np.where((counts > 0) & (words != END), np.log10(np.maximum(counts, 1)), 0.0)[w]
        base, known = np.log10(counts + 0.1), counts > 0
        rows, start = [], 0
        for number, p in zip(batch, parts, strict=True):
            of, n = start + np.repeat(np.arange(len(p[5])), p[5]), p[8].astype(np.int64)
            start += len(p[5])
            docs, doc = np.unique(_widen(p[6], p[7]), return_inverse=True)
            sums = [np.bincount(doc, n * x, len(docs)) for x in (value[of], base[w[of]])]
            size = np.bincount(doc * (SMALL + 2) + np.minimum(c_pair[of], SMALL + 1), n, len(docs) * (SMALL + 2)).astype(np.int64).reshape(-1, SMALL + 2)
            of_known = np.bincount(doc, n * known[w[of]], len(docs)).astype(np.int64)
            rows.append((-1 - number, number, SUMS, None, _pack(_small(docs), *sums, _small(of_known), *[_small(size[:, r]) for r in range(1, SMALL + 2)])))
            unseen = np.flatnonzero(c_pair[of] == 0)
            if len(unseen):
                h = names[pair[of[unseen]] % len(names)]
                to = _history_shard(h, m.shards)
                for s in np.unique(to).tolist():
                    mine = to == s
                    rows.append((s, number, UNSEEN, None, _pack(h[mine], docs[doc[unseen[mine]]].astype(np.uint32), _small(n[unseen[mine]]))))
        h = kinds % max(len(names), 1)
        taken = np.bincount(h, chance[kinds // max(len(names), 1)], len(names))
        mass = _mass(h, seen_kind, len(names))
        some = np.flatnonzero(mass.any(1))
        to = _history_shard(names[some], m.shards)
        for s in range(m.shards):
            mine = some[to == s]
            if len(mine):
                rows.append((s, 0, MASS, None, _pack(names[mine], taken[mine], *[_small(x) for x in mass[mine].T])))
        rows.append((shard, 0, COUNTS, _counts_of(seen_kind).tolist(), _pack()))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _counts_of(counts: np.ndarray) -> np.ndarray:
    """How many items have each of the counts 0..SMALL + 1."""
    return np.bincount(np.minimum(counts, SMALL + 2), minlength=SMALL + 3)[: SMALL + 2]


def _mass(h: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Per history, the summed counts of its pairs of count 1, 2, ..., SMALL, and more."""
    return np.bincount(h * (SMALL + 1) + np.minimum(counts, SMALL + 1) - 1, counts, n * (SMALL + 1)).astype(np.int64).reshape(-1, SMALL + 1)


def _history_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((tx.mix(h + tx.U(77)) >> tx.U(32)) * tx.U(shards)) >> tx.U(32)


def _backoff(model, factors: np.ndarray):
    """By history: alpha(h) c(h) from all shards' masses and the hot pairs', added up per document for the unseen pairs."""

    def run(table: pa.Table) -> pa.Table:
        kind, payload = table.column("kind").to_pylist(), [_unpack(p.as_py()) for p in table.column("payload")]
        m, mass = model.value, [p for k, p in zip(kind, payload, strict=True) if k == MASS]
        mine = np.flatnonzero(_history_shard(m.pair_before, m.shards) == tx.U(table.column("dest")[0].as_py()))
        hot_chance = m.chance(m.hot_counts[_find(m.hot, m.pair_word[mine])])
        mass.append([m.pair_before[mine], hot_chance, *_mass(np.arange(len(mine)), m.pair_counts[mine], len(mine)).T])
        names, at = np.unique(np.concatenate([p[0] for p in mass]), return_inverse=True)
        taken, *sizes = (np.bincount(at, np.concatenate([p[k] for p in mass]), len(names)) for k in range(1, SMALL + 3))
        left = sum((x * (1 - f) for x, f in zip(sizes, factors[1:], strict=True)), np.zeros(len(names)))
        alpha = np.append(np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(1 - taken, 1e-12)), 0.0)
        blocks: dict[int, list] = {}
        for number, k, p in zip(table.column("batch").to_pylist(), kind, payload, strict=True):
            if k == UNSEEN:
                blocks.setdefault(number, []).append((p[1], alpha[_find(names, p[0])] * p[2]))
        rows = []
        for number, found in blocks.items():
            docs, doc = np.unique(np.concatenate([d for d, _ in found]), return_inverse=True)
            rows.append((0, number, UNSEEN, None, _pack(_small(docs), np.bincount(doc, np.concatenate([x for _, x in found]), len(docs)))))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _finish(model, factors: np.ndarray, n_train: int):
    def run(table: pa.Table) -> pa.Table:
        m, kind = model.value, table.column("kind").to_pylist()
        payload = [_unpack(p.as_py()) for p in table.column("payload")]
        head, logs = kind.index(DOCS), np.log10(factors)
        tokens = payload[head][0]
        value, base, known = np.zeros(len(tokens)), np.zeros(len(tokens)), np.zeros(len(tokens), np.int64)
        for k, p in zip(kind, payload, strict=True):
            if k == SUMS:
                value[p[0]] += p[1] + sum(logs[r] * p[3 + r] for r in range(1, SMALL + 2))
                base[p[0]] += p[2]
                known[p[0]] += p[3]
            elif k == UNSEEN:
                value[p[0]] += p[1]
        value = value - (np.log10(n_train) if n_train else 0.0)
        return pa.table({"key": pa.array(table.column("keys")[head].as_py(), pa.int64()), "n_tokens": pa.array(tokens), "n_known": pa.array(known),
                         "train_tokens": pa.array(np.full(len(tokens), m.total)), "base_score": pa.array(base - tokens * np.log10(m.total + 0.1 * (m.distinct + 1))), "score": pa.array(value)})

    return run


def score(docs: DataFrame, train: str, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per document: n_tokens, n_known, train_tokens, base_score and score (log10 of its probability).

    ``train`` names a boolean column: true where the model learns from the row. base_score is that of
    the additive unigram model. ``docs`` should be a stored table, as it is read twice and a lost part
    must come back in the same order. Null and empty texts are the end token alone; repeated rows
    count as often as they stand there; a null key stays null; a null in ``train`` is not learned from.
    Without training rows every word is unknown. An empty table gives none. Good-Turing factors of
    pairs come from all shards' counts of counts, so scores do not depend on the number of shards.
    """
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    known = d.where("train")
    n_train = known.select("key").count()
    model = d.sparkSession.sparkContext.broadcast(with_hot_pairs(known, unigrams(known, shard_tokens)))
    sent = d.mapInArrow(_send(model), BLOCK)
    shards = write_and_read(sent.groupBy("dest").applyInArrow(_shard(model), BLOCK), "shards")
    seen = _counts_of(model.value.pair_counts)
    for r in shards.where(F.col("kind") == COUNTS).select(F.posexplode("keys").alias("count", "n")).groupBy("count").agg(F.sum("n").alias("n")).collect():
        seen[r["count"]] += r["n"]
    factors = factors_of(seen)
    masses = shards.where(F.col("kind").isin(MASS, UNSEEN)).groupBy("dest").applyInArrow(_backoff(model, factors), BLOCK)
    masses = shards.where(F.col("kind").isin(DOCS, SUMS)).unionByName(masses)
    out = masses.groupBy("batch").applyInArrow(_finish(model, factors, n_train), "key long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)
