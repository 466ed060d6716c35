"""Bounded, repeatable samples of rows for fitting, and the fixed split into training and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; 0 (held out) for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def draw(rows: DataFrame, most: int, by: str | None = None, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """About ``most`` rows (per value of ``by``), and never more than 1.25 x that in all.

    Rows whose hash of the key lies below a share of the hash range; the share follows from the count.
    The values of ``by`` come to the driver with their counts.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
    if by is None:
        n = rows.count()
        return rows.where(place < int(min(1.0, most / max(n, 1)) * (1 << 40))).limit(most * 5 // 4)
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, most / n) * (1 << 40)))])
    return rows.where(place < F.element_at(share, F.col(by))).limit(most * len(counts) * 5 // 4)


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns named by number, and each column's new name."""
    names = {c: f"_in{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Undoes ``plain``; columns added since come last."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()], *[c for c in df.columns if c not in names.values()])
