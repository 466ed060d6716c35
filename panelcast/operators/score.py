"""Truth tables, error measures and score tables."""

from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.functions.columns import abs_ratio, ape_ratio
from panelcast.operators.panel import complete_case, drop_absent
from panelcast.operators.seasonal import day_list, in_days
from panelcast.session import write_and_read
from panelcast.spec import PanelSpec


def smape_official(actual: Column, predicted: Column) -> Column:
    """2*mean(|a-p|/(a+p)) over known actuals, 0 where a+p is 0; NULL if one lacks its forecast."""
    unanswered = F.count_if(actual.isNotNull() & predicted.isNull())
    return F.when(unanswered == 0, 2 * F.avg(ape_ratio(actual, predicted)))


def smape_skip_missing(actual: Column, predicted: Column) -> Column:
    """The same ratio over the complete pairs only."""
    return 2 * F.avg(ape_ratio(actual, predicted))


def smape_loss(actual: Column, predicted: Column) -> Column:
    """2*mean(|p-a|/(|p|+|a|)); terms of 0/0 are left out."""
    return 2 * F.avg(abs_ratio(actual, predicted))


def mae(actual: Column, predicted: Column, clip: float | None = None) -> Column:
    """Mean absolute error, each term at most ``clip`` if given."""
    error = F.abs(actual - predicted)
    if clip is not None:
        error = F.when(error > clip, F.lit(float(clip))).otherwise(error)
    return F.avg(error)


METRICS = {
    "smape": smape_official,
    "smape_skip_missing": smape_skip_missing,
    "smape_loss": smape_loss,
    "mae": mae,
}


def truth(
    df: DataFrame,
    spec: PanelSpec,
    origins: Sequence,
    gap_days: int = 0,
    days_ahead: int = 2,
    complete: bool = False,
) -> DataFrame:
    """Readings of the days after each origin: (origin, station, horizon, measures).

    Horizon 0 is the first step of the day ``gap_days`` after the origin. A reading is handed to
    the few origins it can serve by its day alone, so no range join is needed. ``complete`` keeps
    only rows with every measure known; by default each measure counts for itself.
    """
    days = day_list(origins)
    span = in_days(df, spec, days[0] + gap_days, days[-1] + gap_days + days_ahead - 1)
    known = complete_case(span, spec) if complete else span
    lead = F.explode(F.sequence(F.lit(0), F.lit(days_ahead - 1))).alias("_lead")
    served = known.select("*", spec.day().alias("_day"), lead).withColumn(
        "_origin", F.col("_day") - F.col("_lead") - gap_days
    )
    return served.where(F.col("_origin").isin(days)).select(
        F.date_from_unix_date("_origin").alias("origin"),
        spec.station,
        (F.col("_lead") * spec.seasons + spec.season()).alias("horizon"),
        *spec.measures,
    )


def score_grid(
    actual: DataFrame,
    predicted: DataFrame,
    spec: PanelSpec,
    by: Sequence[str] = ("origin",),
    on: Sequence[str] | None = None,
    metric: str = "smape",
    two_is_missing: bool = False,
    ignore_stations: Sequence[str] = (),
) -> DataFrame:
    """Error per group, station and measure: (*by, station, measure, score).

    ``on`` are the columns both tables share, by default origin, station and horizon; label columns
    of the forecasts (family, method, ...) may be named in ``by``, and forecasts then hold a row
    per label and horizon. Truth without any forecast row is kept, with missing forecasts. On request
    (``two_is_missing``) a score of exactly 2 is no score. Cells of ``ignore_stations`` are reported
    as missing.
    """
    on = list(on or ["origin", spec.station, "horizon"])
    answers = actual.select(*on, *[F.col(m).alias(f"_a_{m}") for m in spec.measures])
    # Forecasts multiply their history by origins and settings, which size estimates do not see,
    # so they are never to be broadcast on an estimate.
    return score_pairs(answers.join(predicted.hint("merge"), on, "left"), spec, by, metric, two_is_missing, ignore_stations)


def score_pairs(
    pairs: DataFrame,
    spec: PanelSpec,
    by: Sequence[str] = ("origin",),
    metric: str = "smape",
    two_is_missing: bool = False,
    ignore_stations: Sequence[str] = (),
) -> DataFrame:
    """The scores of rows that hold truth (``_a_<measure>``) and forecast (``<measure>``) side by side."""
    cells = pairs.groupBy(*by, spec.station).agg(
        *[METRICS[metric](F.col(f"_a_{m}"), F.col(m)).alias(m) for m in spec.measures]
    )
    # exploded, not unpivoted, which would hide how the cells are dealt and have them dealt again
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("score")) for m in spec.measures]))
    long = drop_absent(cells.select(*by, spec.station, each.alias("_cell")).select(*by, spec.station, "_cell.*"), spec)
    score = F.col("score")
    if two_is_missing:
        score = F.nullif(score, F.lit(2.0))
    if ignore_stations:
        score = F.when(~F.col(spec.station).isin(list(ignore_stations)), score)
    return long.withColumn("score", score)


def mean_scores(scores: DataFrame, by: Sequence[str] = ("origin",)) -> DataFrame:
    """Mean over the known cells of each group."""
    return scores.groupBy(*by).agg(F.avg("score").alias("score"))


def common_cells(scores: DataFrame, setting: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """Scores of the cells that every setting with any score scores, so that means over settings compare like with like."""
    known = scores.where(F.col("score").isNotNull())
    settings = known.agg(F.count_distinct(F.struct(*setting))).scalar()
    shared = known.groupBy(*cell).agg(F.count_distinct(F.struct(*setting)).alias("_n")).where(F.col("_n") == settings)
    return known.join(shared.select(*cell), list(cell), "left_semi")


def leaderboard(
    scores: DataFrame, setting: Sequence[str], day: str = "origin", cell: Sequence[str] = ("station", "measure")
) -> DataFrame:
    """Mean of daily means per setting over the cells that all settings score, best first.

    ``cell`` are the columns that with ``day`` name a scored cell, as far as ``scores`` has them. A
    cell that one setting fails to score counts for none; how many count is told as ``cells``.
    """
    place = [day, *[c for c in cell if c in scores.columns]]
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in place])
    scorers = F.collect_set(F.when(F.col("score").isNotNull(), F.struct(*setting))).over(Window.partitionBy(*place))
    met = F.when(named, F.size(scorers)).otherwise(0).alias("_met")
    # Sums per number of settings that score a cell, so that one pass does: how many there are is known at its end.
    sums = scores.select("*", met).groupBy(*setting, day, "_met").agg(F.sum("score").alias("_sum"), F.count("score").alias("cells"))
    sums = write_and_read(sums, "sums")
    settings = sums.where("cells > 0").agg(F.count_distinct(F.struct(*setting))).scalar()
    daily = sums.where((F.col("_met") == settings) & (F.col("cells") > 0)).withColumn("score", F.col("_sum") / F.col("cells"))
    means = daily.groupBy(*setting).agg(F.avg("score").alias("score"), F.sum("cells").alias("cells"))
    board = sums.select(*setting).distinct().join(means, list(setting), "left")
    return board.orderBy(F.col("score").asc_nulls_last(), *setting)


def best_setting(board: DataFrame, setting: Sequence[str]) -> DataFrame:
    """The single setting of least score; ties go to the first by name."""
    ranked = F.struct("score", *setting)
    return board.where("score IS NOT NULL").agg(F.min(ranked).alias("_best")).select("_best.*")


def merge_scores(*tables: DataFrame, day: str = "origin") -> DataFrame:
    """All score tables together, exact duplicates once, by date."""
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return together.distinct().orderBy(day)


def wide_scores(scores: DataFrame, spec: PanelSpec, cells: Sequence[str], day: str = "origin") -> DataFrame:
    """One row per date: the mean score, then one column per named ``station-measure`` cell."""
    named = scores.withColumn("_cell", F.concat_ws("-", spec.station, "measure"))
    cell_columns = [F.max(F.when(F.col("_cell") == c, F.col("score"))).alias(c) for c in cells]
    return named.groupBy(day).agg(F.avg("score").alias("smape"), *cell_columns)


def bootstrap(daily: DataFrame, reps: int, days: int = 25, seed: int = 0, day: str = "origin") -> DataFrame:
    """Mean score of ``days`` dates drawn without replacement, for each replicate.

    The draw orders dates by a hash of seed, replicate and date, so it can be repeated anywhere.
    A replicate holds one row per scored date.
    """
    drawn = daily.select(day, "score", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col(day).cast("string"))
    order = Window.partitionBy("rep").orderBy(F.md5(text))
    sampled = drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= days)
    return sampled.groupBy("rep").agg(F.avg("score").alias("score"))


def _poisson(text, greatest: int = 12):
    """How often a thing is drawn, Poisson with mean 1, from the first 32 bits of the text's md5."""
    uniform = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
    term, total, draws = math.exp(-1), 0.0, []
    for k in range(greatest):
        term = term / k if k else term
        total += term
        draws.append(F.when(uniform >= total, 1).otherwise(0))
    return reduce(lambda a, b: a + b, draws)


def bootstrap_difference(
    daily: DataFrame, setting: str, a, b, reps: int, level: float = 0.9, seed: int = 0, day: str = "origin"
) -> DataFrame:
    """How much lower ``a`` scores than ``b``: (difference, low, high, days), with a percentile interval of replicates.

    Each replicate takes every date as often as a Poisson number from a hash of seed, replicate and date, the
    same for both settings, so days need no order and no replicate more than a sum: all replicates are
    one aggregation, which a task combines over its own dates. Only dates that both settings score count;
    replicates that draw none are left out. ``daily`` has one score per setting and date.
    """
    scores = daily.where(F.col(setting).isin(a, b) & F.col("score").isNotNull()).groupBy(day)
    signed = scores.agg(
        F.avg(F.when(F.col(setting) == a, F.col("score"))).alias("_a"), F.avg(F.when(F.col(setting) == b, F.col("score"))).alias("_b")
    ).where("_a IS NOT NULL AND _b IS NOT NULL")
    drawn = signed.select(day, (F.col("_a") - F.col("_b")).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(reps))).alias("rep"))
    times = _poisson(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col(day).cast("string")))
    drawn = drawn.withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(times))  # replicate 0 is the sample itself
    means = drawn.groupBy("rep").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"), F.count("*").alias("n"))
    sample, tail = F.col("rep") == 0, (1 - level) / 2
    share = lambda q: F.percentile(F.when(~sample, F.col("m")), F.lit(q))
    return means.agg(
        F.max(F.when(sample, F.col("m"))).alias("difference"), share(tail).alias("low"), share(1 - tail).alias("high"), F.max("n").alias("days")
    )
