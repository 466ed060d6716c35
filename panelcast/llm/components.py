"""Connected components, joins behind a size check, and links found through shared keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelcast.session import write_and_read

BROADCAST_ROWS = 1_000_000
GROUP = 64
FEW_EDGES = 500_000
GROUP_ITEMS = 200_000


def sized(small: DataFrame, rows: int) -> DataFrame:
    """``small`` marked for broadcast if ``rows`` narrow rows are few enough, else for a shuffled hash join."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("shuffle_hash")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one batch: each node with the least node it reaches there."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x: int, parent=parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = np.array([find(x) for x in range(len(nodes))], np.int64)
        far = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[roots[far]])], names=["u", "v"])


def _one_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of all batches of one task."""
    held = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())])).combine_chunks()
    yield from _forest(iter(held.to_batches()))


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of an edge that is not the least of its component; root is the least.

    Distributed union-find: the edges of each batch are first reduced to a forest where they lie;
    then every node's neighbours are hung on the least of them, larger ones and smaller ones in turn,
    until every node hangs on its root. Only minima are aggregated per node, so a node with very many
    edges is no list in one task. Each round is a written table, so lost executors cost one round.
    Once FEW_EDGES or fewer are left (16 bytes each), the rest is one small task in place of rounds.
    Edges that are found in Python should be written first: else each core holds two workers, and the
    idle ones stay with their memory for the stages that follow.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v")
    e = write_and_read(e.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if now[0] <= few:
            return write_and_read(e.coalesce(1).mapInArrow(_one_forest, "u long, v long"), "edges").select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = write_and_read(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")


def star_links(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``keys`` (key, id) whose key is shared, with the key's least id as head, and pairs (a, b, c): ids, the least id of keys of theirs, how many.

    The pairs are as many as the rows at most, however many rows share a key. Rows must not repeat.
    """
    by_key = keys.repartition("key")
    heads = by_key.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").drop("last")
    shared = write_and_read(by_key.join(heads.hint("shuffle_hash"), "key"), "shared")
    pairs = shared.where("id <> head").groupBy(F.col("id").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("c"))
    return shared, pairs


def in_groups(place: DataFrame, key: str, weight: str | None = None, wide: bool = False) -> DataFrame:
    """Adds ``group`` to rows with a family and a root: parts of about GROUP rows (or GROUP_ITEMS of ``weight``).

    With ``wide``, parts of n rows have about sqrt(GROUP x n), so each row meets that many fewer of them. A root with GROUP rows or more has groups of its own; the rows of smaller ones are grouped by family.
    """
    large = place.groupBy("root").agg(F.count("*").alias("_n")).where(F.col("_n") >= GROUP).select("root", F.lit(True).alias("_large"))
    dealt = place.join(large, "root", "left").withColumn("_bucket", F.when(F.col("_large"), F.col("root")).otherwise(F.col("family")))
    size = F.count("*") / GROUP
    size = F.sqrt(size) if wide else size
    extent = dealt.groupBy("_bucket").agg(F.ceil(F.greatest(size, F.sum(weight) / GROUP_ITEMS) if weight else size).alias("_parts"))
    part = F.pmod(F.xxhash64(key), F.col("_parts")).cast("long")
    return dealt.join(extent, "_bucket").withColumn("group", F.xxhash64("_bucket", part)).drop("_bucket", "_large", "_parts")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many items two ascending sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())
