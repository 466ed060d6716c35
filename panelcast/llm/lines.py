"""Fuzzy deduplication of lines: MinHash over character shingles, exact check, one line per component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelcast.llm import text as tx
from panelcast.llm.components import common, components, in_groups, sized, star_links
from panelcast.llm.marks import count_and_mark
from panelcast.llm.sampling import plain
from panelcast.session import write_and_read

WIDTH = 10
BANDS = 8
ROWS = 4
PERCENT = 80
_CODE = tx.seeded(5, 1 << 16)
_CODE[65:91] = _CODE[97:123]
_SOLID = np.ones(1 << 16, bool)
_SOLID[[*range(9, 14), *range(28, 33), 0x85, 0xA0]] = False
_A = (tx.seeded(6, BANDS * ROWS) >> tx.U(32)).astype(np.uint32) | np.uint32(1)
_B = (tx.seeded(7, BANDS * ROWS) >> tx.U(32)).astype(np.uint32)
_FIRST_KEY = -(1 << 63)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and where each row starts (one entry more); null is empty."""
    data, offsets = tx.raw(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):  # a byte each
        return points, offsets
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, lead[offsets]


def _mixed(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """``tx.mix`` in place; ``held`` is room of the same size."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, tx.U(shift), out=held)
        np.bitwise_xor(x, held, out=x)
        if factor:
            np.multiply(x, tx.U(factor), out=x)
    return x


def _grams(sums: np.ndarray, down: np.ndarray, s: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of lines at ``s`` of ``m`` characters, given running sums; where each line's start.

    Windows are taken at every place, which needs no gathering, and those across a line's end are left out.
    """
    n = len(sums) - 1
    every, held = np.zeros(n, tx.U), np.empty(n, tx.U)
    if n >= WIDTH:
        part = every[: n + 1 - WIDTH]
        np.subtract(sums[WIDTH:], sums[:-WIDTH], out=part)
        np.multiply(part, down[: len(part)], out=part)
        _mixed(part, held[: len(part)])
    short = m < WIDTH
    at = s[short]
    every[at] = tx.mix((sums[at + m[short]] - sums[at]) * down[at])
    count = np.maximum(m - WIDTH + 1, 1)
    step = np.zeros(n + 1, np.int8)
    step[s] += 1
    step[s + count] -= 1
    return every[np.cumsum(step[:-1], dtype=np.int8).view(bool)], np.concatenate([[0], np.cumsum(count)])


def line_blocks(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Lines in blocks: blank (white space alone), row, number in its row, line hash, shingle hashes, where each line's start.

    A line is what stands between line feeds; a line shorter than WIDTH is one shingle; empty lines
    are left out.
    """
    n = len(points)
    feed = points == 10
    begin = np.concatenate([offsets[:-1], np.flatnonzero(feed) + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, np.flatnonzero(feed), "right") - 1])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end = np.where(last, offsets[row + 1], np.append(begin[1:], n + 1) - 1)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    size = end - begin
    keep = size > 0
    begin, size, row, number = begin[keep], size[keep], row[keep], number[keep]
    start = 0
    while start < len(begin):
        stop = max(start + 1, int(np.searchsorted(begin + size, begin[start] + tx.BLOCK_BYTES // 2, "right")))
        a, b = int(begin[start]), int(begin[stop - 1] + size[stop - 1])
        part = points[a:b]
        place = np.minimum(part, 65535)
        code, rare = _CODE[place], np.flatnonzero(part > 65535)
        code[rare] = tx.mix(part[rare].astype(tx.U))
        up, down = (tx.POWER, tx.UNPOWER) if b - a <= tx.BLOCK_BYTES else (tx.powers(tx.BASE, b - a), tx.powers(tx.UNBASE, b - a))
        sums = np.zeros(b - a + 1, tx.U)
        np.multiply(code, up[: b - a], out=code)
        np.cumsum(code, out=sums[1:])
        s, m = begin[start:stop] - a, size[start:stop]
        whole = tx.mix((sums[s + m] - sums[s]) * down[s] + m.astype(tx.U))
        grams, starts = _grams(sums, down, s, m)
        blank = ~np.logical_or.reduceat(_SOLID[place], s)
        yield blank, row[start:stop], number[start:stop], whole, grams, starts
        start = stop


def band_keys(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys per line from BANDS x ROWS minima of its shingles under as many permutations."""
    x = (grams >> tx.U(32)).astype(np.uint32)
    out = np.zeros((BANDS, len(starts) - 1), tx.U)
    held = np.empty_like(x)
    for band in range(BANDS):
        key = np.full(len(starts) - 1, band + 1, tx.U)
        for r in range(band * ROWS, (band + 1) * ROWS):
            np.multiply(x, _A[r], out=held)
            np.add(held, _B[r], out=held)
            key = tx.mix(key + np.minimum.reduceat(held, starts[:-1]).astype(tx.U))
        out[band] = key
    return out.T


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tx.slices(whole, "text"):
            key, version = batch.column("key").to_numpy(), batch.column("version").to_numpy()
            for blank, row, number, line, grams, starts in line_blocks(*characters(batch.column("text"))):
                bands = band_keys(grams, starts)
                _, first = np.unique(line, return_index=True)
                fresh = np.zeros(len(line), bool)
                fresh[first] = True
                fresh &= ~blank
                ends = np.concatenate([[0], np.cumsum(fresh * BANDS)])
                keys = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bands[fresh].reshape(-1).view(np.int64)))
                solid = np.flatnonzero(~blank)
                arrays = [pa.array(key[row]), pa.array(version[row]), pa.array(number), pa.array(line.view(np.int64)), keys]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "version", "number", "line", "bands"]).take(pa.array(solid))
        tx.release()


def _bands_of(batch: pa.RecordBatch) -> np.ndarray:
    return pa.compute.list_flatten(batch.column("bands")).to_numpy().view(tx.U).copy()


def _repeated_bands(marks):
    """(key, id) for the bands of each line that other lines may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = _bands_of(batch), np.repeat(batch.column("line").to_numpy(), pa.compute.list_value_length(batch.column("bands")).to_numpy(zero_copy_only=False))
            if marks.value.least == 2:
                on = marks.value.rank(keys) > 0
                keys, ids = keys[on], ids[on]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids)], names=["key", "id"])

    return run


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingle set of every text, taken as one line."""
    parts = [(grams, np.diff(starts)) for _, _, _, _, grams, starts in line_blocks(*characters(texts))]
    sizes = np.concatenate([n for _, n in parts])
    return tx.distinct(np.concatenate([g for g, _ in parts]), np.concatenate([[0], np.cumsum(sizes)]))


def _sets_by(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``_sets`` of texts of which those of one id are the same: each is made once."""
    _, first, at = np.unique(ids.to_numpy(), return_index=True, return_inverse=True)
    items, starts = _sets(texts.take(pa.array(first)))
    size = np.diff(starts)[at]
    ends = np.concatenate([[0], np.cumsum(size)])
    return items[np.arange(ends[-1]) + np.repeat(starts[:-1][at] - ends[:-1], size)], ends


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of lines whose sets of shingles are similar enough."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            (x, x_at), (y, y_at) = _sets(batch.column("ta")), _sets_by(batch.column("b"), batch.column("tb"))
            ends = x_at + y_at
            both = np.empty(len(x) + len(y), tx.U)
            both[np.arange(len(x)) + np.repeat(y_at[:-1], np.diff(x_at))] = x
            both[np.arange(len(y)) + np.repeat(x_at[1:], np.diff(y_at))] = y
            union = np.diff(tx.distinct(both, ends)[1])
            near = 100 * (np.diff(ends) - union) >= PERCENT * union
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_alike, "a long, b long")


def _open_entries(keys: np.ndarray, pair: np.ndarray, root: np.ndarray, side: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries whose key, in their pair of groups, other components hold too, on the other side unless ``same``.

    They come by pair and key, with a mark at the first of each.
    """
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.lexsort((keys, pair))
    k, p, r, s = keys[order], pair[order], root[order], side[order]
    new = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1]))
    starts = np.flatnonzero(new)
    mixed = np.minimum.reduceat(r, starts) != np.maximum.reduceat(r, starts)
    mixed &= same[order][starts] | (np.minimum.reduceat(s, starts) != np.maximum.reduceat(s, starts))
    on = np.repeat(mixed, np.diff(np.append(starts, len(keys))))
    return new[on], order[on]


def _compare(table: pa.Table) -> pa.RecordBatch:
    """Links between the lines of two groups that share a key, for some pairs of groups (ga, gb), each in a run of rows.

    A line's set is made once for all its pairs. Two components are joined by one link.
    """
    ga, gb, ids, root, side = (table.column(c).to_numpy(zero_copy_only=False) for c in ("ga", "gb", "id", "root", "side"))
    begin = np.append(True, (ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1]))[: len(ga)]
    pair = np.cumsum(begin) - 1
    lists = table.column("keys").combine_chunks()
    keys = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(table.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    at, entry = _open_entries(keys, pair[row], root[row], side[row], (ga == gb)[row])
    row = row[entry]
    _, first, line = np.unique(ids[row], return_index=True, return_inverse=True)
    items, starts = _sets(table.column("text").combine_chunks().take(pa.array(row[first]))) if len(row) else (None, None)
    sizes, ids = np.diff(starts).tolist() if len(row) else [], ids[row[first]].tolist() if len(row) else []
    same, side, root = (ga == gb)[row].tolist(), side[row].tolist(), root[row].tolist()
    a, b = [], []
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen = set()
    line, others = line.tolist(), []
    for p, (i, new) in enumerate(zip(line, at.tolist(), strict=True)):
        if new:
            others = []
        for q in others:
            j = line[q]
            if (same[p] or side[p] != side[q]) and (i, j) not in seen and find(root[p]) != find(root[q]):
                seen.add((i, j))
                if 100 * min(sizes[i], sizes[j]) >= PERCENT * max(sizes[i], sizes[j]):
                    both = common(items[starts[i] : starts[i + 1]], items[starts[j] : starts[j + 1]])
                    if 100 * both >= PERCENT * (sizes[i] + sizes[j] - both):
                        parent[find(root[p])] = find(root[q])
                        a.append(ids[i])
                        b.append(ids[j])
        others.append(p)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_compare`` for rows in order of (ga, gb): whole pairs of groups, of about SLICE_BYTES of text at once."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        ga, gb = table.column("ga").to_numpy(), table.column("gb").to_numpy()
        ends = np.flatnonzero((ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1])) + 1
        size = np.cumsum(pa.compute.binary_length(table.column("text")).to_numpy().astype(np.int64))
        start = 0
        while start < (ends[-1] if len(ends) else 0):
            far = int(np.searchsorted(size, (size[start - 1] if start else 0) + tx.SLICE_BYTES, "right"))
            stop = int(ends[max(np.searchsorted(ends, far, "right") - 1, np.searchsorted(ends, start, "right"))])
            yield _compare(table.slice(start, stop - start))
            start = stop
        rest = table.slice(start)
    if rest is not None:
        yield _compare(rest)
    tx.release()


def _across(shared: DataFrame, roots: DataFrame, texts: DataFrame, count: int) -> DataFrame:
    """Links between lines that share a key and are still in different components.

    Lines lie in groups of about GROUP: parts of a large component, or of the small ones whose keys
    lead to the same head. Pairs of groups that share a key and hold different components are compared
    in one place each, so a family's rows are shipped once per pair of its groups, not once per pair.
    """
    place = shared.groupBy("id").agg(F.min("head").alias("family")).join(roots, F.col("id") == F.col("node"), "left")
    place = place.select("id", "family", F.coalesce("root", "id").alias("root"))
    place = in_groups(place, "id")
    tokens = shared.select("key", "id").join(sized(place, count), "id").repartition("key")
    mixed = tokens.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    tokens = write_and_read(tokens.join(mixed.hint("shuffle_hash"), "key"), "tokens")
    held = tokens.groupBy("key", "group").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    other = held.select("key", F.col("group").alias("gb"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    pairs = held.withColumnRenamed("group", "ga").join(other, "key").where("ga <= gb and least(lo, lo_b) < greatest(hi, hi_b)").select("ga", "gb").distinct()
    pairs = write_and_read(pairs, "group-pairs")
    lines = tokens.groupBy("group", "id", "root").agg(F.collect_list("key").alias("keys")).join(texts, "id")
    left = pairs.join(lines, F.col("ga") == F.col("group")).withColumn("side", F.lit(0))
    right = pairs.where("ga < gb").join(lines, F.col("gb") == F.col("group")).withColumn("side", F.lit(1))
    return left.unionByName(right).drop("group").repartition("ga", "gb").sortWithinPartitions("ga", "gb").mapInArrow(_compared, "a long, b long")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, version, drop): the numbers of the lines that a document loses; version tells its text.

    Two lines are alike if their sets of WIDTH-character shingles (A-Z as a-z) have a Jaccard
    similarity of 0.8 or more. Candidates share one of BANDS keys of ROWS minima each: at a
    similarity of 0.8 a pair is found with a chance of 98.5 %, and each is compared exactly. Lines
    that share a key are first compared with the key's least line; lines that are then still in
    different components are compared with each other. Of every component the first line by key and
    number stays. Lines of white space alone are no lines here. Different lines are told apart by
    64-bit hashes.
    """
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_FIRST_KEY)).alias("key"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    lines = d.mapInArrow(_signature_rows, "key long, version long, number long, line long, bands array<long>")
    lines = write_and_read(lines, "lines")
    bands = lines.where(F.size("bands") > 0).select("line", "bands")
    marks = d.sparkSession.sparkContext.broadcast(count_and_mark(bands.select("bands"), _bands_of, F.size("bands"), levels=1))
    shared, pairs = star_links(bands.mapInArrow(_repeated_bands(marks), "key long, id long").distinct())

    wanted = write_and_read(shared.select("id").distinct(), "wanted")
    count = wanted.count()
    place = lines.join(sized(wanted, count), F.col("line") == F.col("id")).groupBy("id").agg(F.min(F.struct("key", "version", "number")).alias("at"))
    place = place.groupBy("at.key", "at.version").agg(F.collect_list(F.struct(F.col("at.number").cast("int").alias("number"), "id")).alias("wanted"))
    some = d.join(sized(write_and_read(place, "wanted"), count), ["key", "version"]).select(F.split("text", "\n", -1).alias("parts"), "wanted")
    one = some.select(F.explode(F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), F.get(F.col("parts"), w["number"]).alias("text")))).alias("w"))
    texts = write_and_read(one.select("w.id", "w.text"), "texts")
    roots = components(write_and_read(_verify(pairs.drop("c"), texts), "links"))

    more = write_and_read(_across(shared, roots, texts, count), "links")
    found = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    placed = lines.select("key", "version", "number", "line").join(sized(found, count), F.col("line") == F.col("node"), "left")
    placed = placed.select("key", "version", "number", F.coalesce("root", "line").alias("root"))
    first = placed.groupBy("root").agg(F.min(F.struct("key", "version", "number")).alias("first"), F.max(F.struct("key", "version", "number")).alias("last")).where("first <> last")
    drops = placed.join(first.select("root", "first").hint("shuffle_hash"), "root").where(F.struct("key", "version", "number") != F.col("first"))
    return drops.groupBy("key", "version").agg(F.array_sort(F.collect_set("number")).alias("drop"))


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without their repeated lines, with n_lines (of the given text) and n_removed.

    A document keeps its other lines in order, and its text as it was if it loses none. A text whose
    lines all repeat earlier ones is left empty. Null stays null and has no lines; an empty text has
    one, empty line. Rows that repeat both key and text are the same document and lose the same
    lines; a null key counts as the least. Columns pass through, except n_lines and n_removed, which
    are replaced. An empty table stays empty.
    """
    drops = write_and_read(repeated_lines(docs, key, text), "drops")
    total = drops.agg(F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()[0]
    drops = drops.select(F.col("key").alias("_key"), F.col("version").alias("_version"), F.col("drop").alias("_drop"))
    d, back = plain(docs.drop("n_lines", "n_removed"))
    key, text = back[key], back[text]
    d = d.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(_FIRST_KEY))).withColumn("_version", F.xxhash64(text))
    d = d.join(sized(drops, total), ["_key", "_version"], "left")

    def without(parts):
        left = F.array_except(F.sequence(F.lit(0), F.size(parts).cast("long") - 1), F.col("_drop"))
        return F.array_join(F.transform(left, lambda i: F.get(parts, i.cast("int"))), "\n")

    # the lines are bound as one variable: named in the inner function, the text would be split again for every line
    kept = F.transform(F.array(F.split(F.col(text), "\n", -1)), without)[0]
    lines = F.when(F.col(text).isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"))) + 1)
    new = {text: F.when(F.col("_drop").isNull(), F.col(text)).otherwise(kept), "n_lines": lines.cast("long"), "n_removed": F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long")}
    return d.select([new.get(c, F.col(c)).alias(name) for name, c in back.items()] + [new[c].alias(c) for c in ("n_lines", "n_removed")])
