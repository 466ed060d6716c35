"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
BANDS_PER_DOUBLING = 16
SALTS = 16


def with_size(docs: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """Adds the number of words of every text; null and empty count 0."""
    return docs.withColumn(name, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def source_key(source: str) -> Column:
    """A source as a text that is never null and sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("~"))


def targets(docs: DataFrame, source: str, size: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: its size, its target size and the copies each of its documents is due.

    Sources in the order of ``source`` (see ``source_key``) weigh ``weights`` in turn and share
    ``share`` x all sizes; a target ends at ``most`` x its source's size and the excess is shared
    again by weight among the rest. That is min(cap, level x weight) for one level. With sources by
    cap / weight, the first k are capped, and the level of the others is what the capped leave over
    the others' weight; k is the number of sources whose own cap lies below the level so found. These
    windows run over one row per source, never over documents.
    """
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"))
    turn = F.row_number().over(Window.orderBy("_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    s = s.withColumn("_level", level).withColumn("_open", F.col("_cap") >= F.col("_level") * F.col("_w"))
    s = s.withColumn("_first", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("l")))).over(whole)["l"])
    s = s.withColumn("target", F.least("_cap", F.coalesce(F.col("_first") * F.col("_w"), F.col("_cap"))))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("_source", "source_size", "target", due.alias("due"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Adds size, source_size, target and the number of copies the mixture takes of each document.

    All documents of a source are due the same number of copies, target / source_size, at most
    ``most``. In a fixed order within the source their prefix sums, moved by one offset drawn per
    source from ``seed``, are compared with whole numbers: a document is taken once per whole number
    that its step crosses. The order is by band of size first, so every band gives its share and the
    words taken stay near the target; then by a hash of the key and the text, so reruns agree.

    Prefix sums need ranks within a source, and a source may hold a third of all rows. Ranks are
    taken within cells (source, band, salt), and cells start at the running count of the cells before
    them, from one aggregate row per cell: no task sees a whole source.

    Null and empty texts have size 0 and take part like others; null is a source of its own; repeated
    rows are documents of their own; an empty table gives none; other columns pass through.
    """
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    d = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    d = with_size(d, names[text], "_size")
    d = d.withColumn("_tie", F.xxhash64(names[key], names[text])).withColumn("_s", source_key(names[source]))
    d = d.withColumn("_band", F.floor(F.log2(F.col("_size") + 1) * BANDS_PER_DOUBLING)).withColumn("_salt", F.pmod(F.col("_tie"), F.lit(SALTS)))
    goal = targets(d.select("_s", "_size"), "_s", "_size", weights, share, most)
    cells = d.groupBy("_s", "_band", "_salt").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_s").orderBy("_band", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    cells = cells.join(goal, F.col("_s") == F.col("_source")).drop("_source", "_n")
    within = Window.partitionBy("_s", "_band", "_salt").orderBy("_tie", names[key])
    d = d.withColumn("_rank", F.row_number().over(within))
    d = d.join(cells, ["_s", "_band", "_salt"])
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("_s")), F.lit(1 << 30)) / float(1 << 30)
    upto = lambda step: F.floor(F.col("due") * (F.col("_start") + F.col("_rank") - step) + offset)
    added = {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": upto(0) - upto(1)}
    return d.select([F.col(n).alias(c) for c, n in names.items() if c not in added] + [c.alias(n) for n, c in added.items()])


def emit(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mixture itself: each document once per copy."""
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").select(*[F.col(f"`{c}`") for c in columns], copy.alias("_copy")).drop("_copy")
