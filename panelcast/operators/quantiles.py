"""Exact quantiles of groups of any size, by repeated refinement of histograms.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here a group's values are only
counted: in bins between its least and greatest value, then in bins of the bin that holds the wanted rank,
until few values are left or all are equal. Counts are combined where rows lie, so a task holds as
many rows as there are groups and bins, also for a group with a third of all rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelcast.session import write_and_read

BINS = 1024
FEW = 10_000


def _counts(rows: DataFrame, ranges: DataFrame, bins: int) -> DataFrame:
    """(g, lo, hi, bin, n, least, greatest, before): the bins of every range, with the values below them counted."""
    part = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
    share = F.coalesce(part, F.when(F.col("v") > F.col("lo"), 1.0).otherwise(0.0))  # halves of the least numbers are 0
    place = F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")
    inside = rows.join(ranges, "g").where("v >= lo AND v <= hi")
    held = inside.groupBy("g", "lo", "hi", place).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    earlier = Window.partitionBy("g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], bins: int = BINS, few: int = FEW
) -> DataFrame:
    """The quantiles of ``value`` per group: (keys, quantile, value), as ``percentile`` gives them, between two values by their distance.

    Nulls and NaN are no values; groups without any have a null. Groups of more than ``few`` values
    are refined: each round keeps, for each wanted rank, the bin that holds it and that bin's own least and greatest
    values, which shrinks it whatever the values, and ends for the rank when these are equal or ``few`` values
    are left. Those are numbered within the range, at most ``few`` in a task's group. A round is a written table.
    """
    g = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(g.alias("g"), F.when(~F.isnan(v), v + F.lit(0.0)).alias("v"))
    groups = write_and_read(rows.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    rows = rows.where("v IS NOT NULL")
    at = F.col("q") * (F.col("n") - 1)
    wanted = groups.where("n > 0").withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    wanted = wanted.select("g", "n", "lo", "hi", "q", F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part"))
    state = wanted.select("g", "n", "lo", "hi", F.explode(F.array("low", "high")).alias("rank")).distinct().withColumn("k", F.col("rank"))
    state = write_and_read(state, "ranks")
    large = F.expr(f"lo < hi AND n > {int(few)}")
    while not state.where(large).isEmpty():
        still = state.where(large)
        counts = _counts(rows, still.select("g", "lo", "hi").distinct(), bins).withColumnRenamed("n", "held")
        found = still.join(counts, ["g", "lo", "hi"]).where("k >= before AND k < before + held")
        found = found.select("g", F.col("held").alias("n"), F.col("least").alias("lo"), F.col("greatest").alias("hi"), "rank", (F.col("k") - F.col("before")).alias("k"))
        state = write_and_read(state.where(~large).unionByName(found), "ranks")
    small = state.where("lo < hi")
    inside = rows.join(small.select("g", "lo", "hi").distinct(), "g").where("v >= lo AND v <= hi")
    place = F.row_number().over(Window.partitionBy("g", "lo", "hi").orderBy("v")) - 1
    picked = small.join(inside.withColumn("k", place), ["g", "lo", "hi", "k"]).select("g", "rank", F.col("v").alias("x"))
    known = picked.unionByName(state.where("lo = hi").select("g", "rank", F.col("lo").alias("x")))
    low = known.select("g", F.col("rank").alias("low"), F.col("x").alias("a"))
    high = known.select("g", F.col("rank").alias("high"), F.col("x").alias("b"))
    between = F.when(F.col("low") == F.col("high"), F.col("a")).otherwise((F.lit(1.0) - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    full = wanted.join(low, ["g", "low"]).join(high, ["g", "high"]).select("g", F.col("q").alias("quantile"), between.alias("value"))
    none = groups.where("n = 0").select("g", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile"), F.lit(None).cast("double").alias("value"))
    return full.unionByName(none).select(*[F.col(f"g.`{k}`").alias(k) for k in keys], "quantile", "value")
