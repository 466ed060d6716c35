"""Near-duplicate vectors: int8 tile products with error bounds, full precision only where they leave doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelcast.llm.components import components
from panelcast.llm.vectors import blocks, unpack, usable
from panelcast.session import write_and_read

THRESHOLD = 0.93
TILE = 2048
CHUNK = 100_000
_SLACK = 1e-5


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 times a scale per vector, the length of that product and of the error it leaves."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    kept = q * scale[:, None]
    return q, scale, np.linalg.norm(kept, axis=1), np.linalg.norm(x - kept, axis=1)


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of x, j of y) with a cosine of at least ``threshold``; i < j if both are the same tile.

    For unit vectors u = u' + e and v = v' + f, u.v differs from u'.v' by at most |e| + |u'| |f|. Pairs
    whose int8 product plus that bound stays below the threshold are out for certain; the others are
    computed again in double precision. Products of int8 are summed exactly in float32 up to 1,040
    dimensions, beyond that in float64.
    """
    norm_x, norm_y = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    (qx, sx, kx, ex), (qy, sy, _, ey) = quantise(x / norm_x[:, None]), quantise(y / norm_y[:, None])
    exact = np.float32 if x.shape[1] <= 1040 else np.float64
    for a in range(0, len(x), 512):
        b = min(a + 512, len(x))
        product = qx[a:b].astype(exact) @ qy.astype(exact).T
        top = product * (sx[a:b, None] * sy[None, :]) + ex[a:b, None] + kx[a:b, None] * ey[None, :]
        i, j = np.nonzero(top >= threshold - _SLACK)
        i += a
        if same:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), CHUNK):
            p, q = i[c : c + CHUNK], j[c : c + CHUNK]
            cosine = (x[p] * y[q]).sum(1) / (norm_x[p] * norm_y[q])
            near = cosine >= threshold
            if near.any():
                yield p[near], q[near]


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]], parent: list[int]) -> None:
    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)


def _tile_pairs(threshold: float):
    """Per pair of tiles: how many vectors each is linked with, and edges that span the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["i"] == row["j"]
                ids, weights, x = unpack({k: row[f"{k}_i"] for k in ("n", "dim", "ids", "weights", "vectors")})
                other, heavy, y = (ids, weights, x) if same else unpack({k: row[f"{k}_j"] for k in ("n", "dim", "ids", "weights", "vectors")})
                shift = 0 if same else len(ids)
                links, parent = np.zeros(len(ids) + (0 if same else len(other)), np.int64), list(range(len(ids) + (0 if same else len(other))))
                for i, j in close_pairs(x, y, threshold, same):
                    np.add.at(links, i, heavy[j])
                    np.add.at(links, j + shift, weights[i])
                    _forest(len(parent), [(i, j + shift)], parent)
                names = ids if same else np.concatenate([ids, other])
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[np.array(parent, np.int64)[some]]), pa.array(links[some])], names=["a", "b", "links"])

    return run


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per vector: n_links (others with equal label and cosine >= threshold), component_id, kept.

    Equal vectors of a label are one class, compared once and counted as many. Classes are dealt at
    random into tiles of about TILE within their label; every pair of tiles of a label is one unit of
    work, whose links leave it as counts and a spanning forest, so a family of n near copies gives
    rows in proportion to n. The products themselves grow with the square of a label, which is the
    method; tile pairs spread them over all tasks.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null
    label, have no links; vectors of different lengths are never linked. Rows that repeat a key are
    vectors of their own; a null key is never the least of a component unless it is alone. An empty
    table gives none. Other columns are not read.
    """
    d = rows.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    good = F.col("label").isNotNull() & usable("vector")
    classes = d.where(good).groupBy("label", "vector").agg(F.min("key").alias("least"), F.count("*").alias("weight"))
    classes = classes.select(F.monotonically_increasing_id().alias("id"), "label", "vector", F.size("vector").alias("dim"), "least", "weight")
    classes = write_and_read(classes, "classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = classes.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiles = write_and_read(blocks(placed.select("label", F.col("dim").alias("size"), "tile", "id", "weight", "vector"), ["label", "size", "tile"]), "tiles")
    pairs = sizes.select("label", F.col("dim").alias("size"), "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"))
    pairs = pairs.select("label", "size", "i", F.explode(F.sequence(F.col("i"), F.col("tiles") - 1)).alias("j"))
    held = ["n", "dim", "ids", "weights", "vectors"]
    left = tiles.select("label", "size", F.col("tile").alias("i"), *[F.col(c).alias(f"{c}_i") for c in held])
    right = tiles.select("label", "size", F.col("tile").alias("j"), *[F.col(c).alias(f"{c}_j") for c in held])
    work = pairs.join(left, ["label", "size", "i"]).join(right, ["label", "size", "j"]).repartition("label", "i", "j")
    found = write_and_read(work.drop("label", "size").mapInArrow(_tile_pairs(threshold), "a long, b long, links long"), "links")
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    named = classes.join(components(found), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).join(links, "id", "left")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = d.withColumn("label", F.when(good, F.col("label"))).join(named, ["label", "vector"], "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
