"""Embedding rows that can be compared, and blocks of them packed into one row each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components, and with one that is not 0."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weights and vectors (double) of a block."""
    n, dim = row["n"], row["dim"]
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(n, dim)


def blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per value of ``keys`` with the ids, weights and vectors of (id, weight, vector) as bytes."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("id", "ascending")])
        x = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out = {k: t.column(k).slice(0, 1) for k in keys}
        out |= {"n": pa.array([t.num_rows], pa.int64()), "dim": pa.array([len(x) // t.num_rows], pa.int64())}
        out |= {c: pa.array([t.column(f).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c, f in (("ids", "id"), ("weights", "weight"))}
        return pa.table(out | {"vectors": pa.array([x.tobytes()], pa.binary())})

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInArrow(run, f"{types}, n long, dim long, ids binary, weights binary, vectors binary")
