"""Similarity join of documents on word shingles with a token-group matrix.

Documents whose sets of 5-word shingles have a Jaccard similarity of at least 0.8 are linked. Similar
documents form groups; of each group the union of its members' shingles is kept (a row of the
token-group matrix). A document opens only the groups whose union holds enough of its shingles to
make 0.8 possible with any member, and is compared with the members of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelcast.llm import text as tx
from panelcast.llm.components import components, in_groups, sized, star_links
from panelcast.llm.marks import count_and_mark
from panelcast.session import write_and_read

PERCENT = 80
SLICE = 1 << 20
SET = "key long, n long, d1 long, d2 long, items array<long>"


def _shingles_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([tx.shingles(*tx.words(part.column("text")))[0] for part in tx.slices(batch, "text")])


def needed(n: np.ndarray | Column) -> np.ndarray | Column:
    """Shingles that a set of ``n`` must share with any partner: the least whole number >= 0.8 n."""
    up = PERCENT * n + 99
    return F.floor(up / 100).cast("long") if isinstance(n, Column) else up // 100


def _set_rows(marks):
    """Rows of SET per document: size, digests of the set, and of its prefix the items that others may hold.

    In the order of ``marks``, any two linked sets share an item among the first ``n - needed(n) + 1``
    of each: the prefix. Without ``marks``, all items.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, starts = tx.shingles(*tx.words(batch.column("text")))
        n = np.diff(starts)
        d1, d2 = tx.row_sums(tx.mix(items ^ tx.U(0x5851F42D4C957F2D)), starts), tx.row_sums(tx.mix(items + tx.U(0x14057B7EF767814F)), starts)
        if marks is None:
            out = tx.lists(items, starts)
        else:
            rank = marks.value.rank(items)
            row = tx.rows_of(starts)
            order = np.lexsort((rank, row))
            items, rank = items[order], rank[order]
            length = np.where(n > 0, n - needed(n) + 1, 0)
            take = np.arange(len(items)) - starts[:-1][row] < length[row]
            if marks.value.least == 2:
                take &= rank > 0
            out = tx.lists(items[take], np.concatenate([[0], np.cumsum(take)])[starts])
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), out], names=["key", "n", "d1", "d2", "items"])

    return lambda batches: tx.sliced(batches, "text", one, SLICE)


def _enough(c: Column, a: Column, b: Column, less: int = 0) -> Column:
    """Whether sets of sizes ``a`` and ``b`` that share ``c`` items of their prefixes can be linked.

    A link needs 4/9 of both sizes in common. Of the set whose prefix ends first, what is common
    lies in both prefixes or behind its own, where it has ``needed - 1`` items. ``less`` lowers what
    they must share.
    """
    return _close(a, b) & (c >= F.floor((4 * (a + b) + 8) / 9) - F.greatest(needed(a), needed(b)) + 1 - less)


def _may_hold(c: Column, a: Column, lo: Column, hi: Column) -> Column:
    """Whether a set of size ``a`` can be linked with a member, of ``lo`` to ``hi`` items, of a group that shares ``c`` of its prefix.

    What a link needs is least for the members that differ most in size, but for steps of one among
    the larger ones.
    """
    least, most = F.greatest(lo, needed(a)), F.least(hi, F.floor(a * 100 / PERCENT).cast("long"))
    return _enough(c, a, least) | _enough(c, a, most, 1)


def _first_may_be(at: Column, a: Column, lo: Column, reach: Column) -> Column:
    """Whether an item, at place ``at`` of a set of size ``a``, can be the first it shares with a linked member of a group.

    In the common order, what two sets share lies at and behind the first such item in both, and is
    4/9 of both sizes: 9 at <= 5 a - 4 b, and so for the other set. Of the members that hold the item,
    ``lo`` is the least size and ``reach`` the most of 5 b - 9 times its place there.
    """
    return (9 * at <= 5 * a - 4 * F.greatest(lo, needed(a))) & (4 * a <= reach)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by exact comparison."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= PERCENT * (F.size("ia") + F.size("ib") - both)).select("a", "b")


def _close(a: Column, b: Column) -> Column:
    """Whether sets of sizes ``a`` and ``b`` can be similar enough."""
    return (a * 100 >= b * PERCENT) & (b * 100 >= a * PERCENT)


def drawn_links(shared: DataFrame, sizes: DataFrame, sets: DataFrame, roots: DataFrame, count: int) -> DataFrame:
    """Links of each document with a head drawn for each of its keys, if that is of another component.

    The keys of a family mostly have the same least document, but other drawn ones, so a document that
    is not like the least meets about as many others as it has keys: one pair a key at most.
    """
    place = sizes.join(shared.select("id").distinct(), "id", "left_semi").join(roots, F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("root", "id").alias("root"))
    tokens = shared.select("key", "id").join(sized(write_and_read(place, "roots"), count), "id").repartition("key")
    heads = tokens.groupBy("key").agg(F.min_by(F.struct("id", "n", "root"), F.xxhash64("id", "key")).alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    pairs = tokens.join(heads.hint("shuffle_hash"), "key").where((F.col("root") != F.col("head.root")) & _close(F.col("n"), F.col("head.n")))
    return verify(pairs.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")).distinct(), sets)


def _open(table: pa.Table) -> pa.Table:
    """One group and the documents that ask for it: the links found, a document's first to each component.

    The group's items stand in one ascending run with the member of each, so a document is compared
    with all members at once: those that hold an item of its are counted.
    """
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    ids, root = table.column("id").to_numpy(), table.column("root").to_numpy()
    lists = table.column("items").combine_chunks()
    flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
    members = np.flatnonzero(~asks)
    size = np.diff(starts)
    n = size[members]
    held = np.concatenate([flat[starts[i] : starts[i + 1]] for i in members.tolist()])
    order = np.argsort(held)
    held, holder = held[order], np.repeat(np.arange(len(members)), n)[order]
    a, b = [], []
    for i in np.flatnonzero(asks).tolist():
        mine = flat[starts[i] : starts[i + 1]]
        low = np.searchsorted(held, mine)
        times = np.searchsorted(held, mine, "right") - low
        if np.count_nonzero(times) < needed(len(mine)):
            continue
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        both = np.bincount(holder[at], minlength=len(members))
        linked = {root[i]}
        for j in members[100 * both >= PERCENT * (len(mine) + n - both)].tolist():
            if root[j] not in linked:
                linked.add(root[j])
                a.append(ids[i])
                b.append(ids[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def open_groups(shared: DataFrame, sizes: DataFrame, sets: DataFrame, roots: DataFrame, count: int) -> DataFrame:
    """Links between documents of different components, by the token-group matrix.

    A group is a part of a large component, or of the small components whose prefixes lead to the same
    head, of sqrt(GROUP x n) of their n documents and at most some hundred thousand shingles. A document asks for a
    group that holds other components if an item of both may be the first that it shares with a linked
    member; the group opens if the union of its members' sets holds at least ``needed(n)`` of the
    document's. Of two groups, the documents of the lesser one ask.
    """
    place = shared.groupBy("id").agg(F.min("head").alias("family")).join(sizes, "id")
    place = place.join(roots, F.col("id") == F.col("node"), "left").select("id", "n", "family", F.coalesce("root", "id").alias("root"))
    place = write_and_read(in_groups(place, "id", "n", wide=True).select("id", "n", "root", "group"), "groups")
    tokens = shared.select("key", "id", "at").join(sized(place, count), "id").repartition("key")
    mixed = tokens.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    tokens = write_and_read(tokens.join(mixed.hint("shuffle_hash"), "key"), "tokens")
    matrix = tokens.groupBy("key", F.col("group").alias("gb")).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(F.expr("5 * n - 9 * at")).alias("reach")
    )
    asks = tokens.select("key", F.col("id").alias("a"), F.col("n").alias("na"), "at", F.col("root").alias("ra"), F.col("group").alias("ga"))
    asked = asks.join(matrix, "key").where("ga <= gb and (r0 <> ra or r1 <> ra) and na * 100 >= lo * 80 and hi * 100 >= na * 80")
    asked = asked.where(_first_may_be(F.col("at"), F.col("na"), F.col("lo"), F.col("reach")))
    asked = write_and_read(asked.select("ga", "gb", F.col("a").alias("id"), F.col("ra").alias("root"), F.lit(True).alias("asks")).distinct(), "asked")
    members = asked.select("ga", "gb").distinct().join(place, F.col("gb") == F.col("group")).select("ga", "gb", "id", "root", F.lit(False).alias("asks"))
    return asked.unionByName(members).join(sets, "id").groupBy("ga", "gb").applyInArrow(_open, "a long, b long")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_shingles and component_id, the least key reachable by links.

    Documents with equal sets are one class from the start (the set's size and two 64-bit digests),
    so copies cost one row each and none is compared with another. Classes that share a prefix item
    are first compared with the item's least class, then, if still apart, with one drawn for the item:
    two comparisons per item at most bring large families together. What is left apart is searched
    exactly by ``open_groups``.

    Documents without words (null or empty texts) have no shingles and are linked with nothing; their
    component is their own key. Repeated rows and keys are rows of their own; of repeated keys with
    different texts, each has the component of its text. Null keys stay null and never name a
    component of others. An empty table gives none. Other columns of ``docs`` are not read.
    """
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    marks = d.sparkSession.sparkContext.broadcast(count_and_mark(d.select("text"), _shingles_of, F.octet_length("text") / 2 + 1))
    held = write_and_read(d.mapInArrow(_set_rows(marks), SET), "sets")
    marks.unpersist()
    classes = held.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "items")).alias("first"))
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", "n", F.col("first.key").alias("key"), F.col("first.items").alias("prefix"))
    classes = write_and_read(classes, "classes")
    before = F.col("n") - needed(F.col("n")) + 1 - F.size("prefix")
    placed = classes.select(F.posexplode("prefix").alias("at", "key"), "id", before.alias("before"))
    shared, pairs = star_links(placed.select("key", "id", (F.col("before") + F.col("at")).alias("at")))
    sizes = classes.select("id", "n")
    pairs = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    pairs = pairs.where(_close(F.col("na"), F.col("nb"))).select("a", "b")

    wanted = write_and_read(classes.select("id", "key", "d1", "d2").join(shared.select("id").distinct(), "id"), "wanted")
    count = wanted.count()
    some = d.join(sized(wanted.select("key").distinct(), count), "key", "left_semi")
    sets = some.mapInArrow(_set_rows(None), SET).join(sized(wanted, count), ["key", "d1", "d2"]).select("id", "items")
    sets = write_and_read(sets, "sets")
    links = write_and_read(verify(pairs, sets), "links")
    roots = components(links)
    links = write_and_read(links.unionByName(drawn_links(shared, sizes, sets, roots, count)), "links")
    roots = components(links)
    more = write_and_read(open_groups(shared, sizes, sets, roots, count), "links")
    found = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    ids = classes.join(found, F.col("id") == F.col("node"), "left").select("d1", "d2", "n", "key", F.coalesce("root", "id").alias("root"))
    named = ids.join(ids.groupBy("root").agg(F.min("key").alias("component_id")), "root").select("d1", "d2", "n", "component_id")
    out = held.drop("items").join(named, ["d1", "d2", "n"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
