"""Training sets from panels: lag arrays, median features, scaling, folds, indicators, calendar."""

from __future__ import annotations

from typing import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.operators.panel import series_arrays
from panelcast.operators.seasonal import day_list, in_days, median_features
from panelcast.session import write_and_read
from panelcast.spec import PanelSpec, day_number


def shifted_splits(last, num_shifts: int, shift_step: int = 1) -> list[int]:
    """Split days stepping back from ``last``, which is the first of them."""
    first = last if isinstance(last, int) else day_number(last)
    return [first - shift_step * i for i in range(num_shifts)]


def _whole(values, start, end, spec: PanelSpec):
    """The values, if there is one for every step of their span; fails where steps are missing or repeat."""
    steps = F.timestamp_diff(spec.step, start, end) + 1
    why = F.concat(F.lit("the panel is not on its spine between "), start.cast("string"), F.lit(" and "), end.cast("string"))
    return F.when(F.size(values) != steps, F.raise_error(why).cast("array<double>")).otherwise(values)


def history_label_split(
    df: DataFrame,
    spec: PanelSpec,
    splits: Sequence,
    history_days: int,
    gap_days: int = 1,
    horizon: int = 48,
    labels: bool = True,
) -> DataFrame:
    """Per series and split day: ``x``, the history before it, and ``y``, the steps after the gap.

    Every split is a slice of the series' one array, so the panel is shuffled once for any number
    of splits. ``df`` must be on its spine. Splits without the whole history (or, with ``labels``,
    without the whole label span) on the spine are left out.
    """
    steps = spec.seasons
    days = day_list(splits)
    label_days = gap_days + -(-horizon // steps) if labels else 0
    needed = in_days(df, spec, days[0] - history_days, days[-1] + label_days)
    arrays = series_arrays(needed, spec).withColumn(
        "split_day", F.explode(F.array(*[F.lit(d) for d in days]))
    )
    arrays = arrays.withColumn("values", _whole(F.col("values"), F.col("start"), F.col("end"), spec))
    split_ts = F.date_from_unix_date("split_day").cast("timestamp_ntz")
    placed = arrays.withColumn("_at", F.timestamp_diff(spec.step, F.col("start"), split_ts).cast("int"))
    length, label_at = history_days * steps, F.col("_at") + gap_days * steps + 1
    placed = placed.where(F.col("_at") >= length)
    x = F.slice("values", F.col("_at") - length + 1, length).alias("x")
    out = [spec.station, "measure", "split_day", x]
    if labels:
        placed = placed.where(F.size("values") >= label_at + horizon - 1)
        out.append(F.slice("values", label_at, horizon).alias("y"))
    else:
        placed = placed.where(F.size("values") >= F.col("_at"))
    return placed.select(*out)


def median_arrays(
    df: DataFrame, spec: PanelSpec, splits: Sequence, windows: Sequence[int], median_shifts: int = 1
) -> DataFrame:
    """Per series and split: medians of ``median_shifts`` successive earlier days as one array.

    Order of the array: shift, window, season.
    """
    days = day_list(splits)
    needed = sorted({d - k for d in days for k in range(median_shifts)})
    medians = median_features(df, spec, needed, windows)
    long = medians.unpivot(
        [spec.station, "target_day", "season", "window"], list(spec.measures), "measure", "value"
    )
    shift = F.explode(F.sequence(F.lit(0), F.lit(median_shifts - 1))).alias("_shift")
    moved = long.select("*", shift).withColumn("split_day", F.col("target_day") + F.col("_shift"))
    cells = F.array_sort(F.collect_list(F.struct("_shift", "window", "season", "value")))
    return (
        moved.where(F.col("split_day").isin(days))
        .groupBy(spec.station, "measure", "split_day")
        .agg(cells.alias("_cells"))
        .select(spec.station, "measure", "split_day", F.col("_cells.value").alias("med"))
    )


def indicators(df: DataFrame, spec: PanelSpec, group: Column | None = None) -> DataFrame:
    """0/1 columns ``is_<measure>`` for a table with a ``measure`` column, and ``is_group``."""
    flags = {f"is_{m}": (F.col("measure") == m).cast("int") for m in spec.measures}
    if group is not None:
        flags["is_group"] = F.coalesce(group.cast("int"), F.lit(0))
    return df.withColumns(flags)


def supervised(
    df: DataFrame,
    spec: PanelSpec,
    splits: Sequence,
    history_days: int,
    windows: Sequence[int],
    median_shifts: int = 1,
    gap_days: int = 1,
    horizon: int = 48,
    labels: bool = True,
    group: Column | None = None,
) -> DataFrame:
    """One row per (station, measure, split): x, y, med arrays and the 0/1 indicator columns."""
    rows = history_label_split(df, spec, splits, history_days, gap_days, horizon, labels)
    medians = median_arrays(df, spec, splits, windows, median_shifts)
    joined = rows.join(medians, [spec.station, "measure", "split_day"], "left")
    return indicators(joined, spec, group)


def standardize(df: DataFrame, spec: PanelSpec) -> tuple[DataFrame, DataFrame]:
    """Measures to mean 0 and population deviation 1 per station, and the table of scalers.

    Scalers are (station, <measure>_mean, <measure>_std). A constant series becomes NULL.
    """
    stats = []
    for m in spec.measures:
        stats += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    scalers = df.groupBy(spec.station).agg(*stats)
    scaled = {m: F.try_divide(F.col(m) - F.col(f"{m}_mean"), F.col(f"{m}_std")) for m in spec.measures}
    return df.join(scalers, spec.station, "left").withColumns(scaled).select(*df.columns), scalers


def inverse(df: DataFrame, scalers: DataFrame, spec: PanelSpec) -> DataFrame:
    """Undo ``standardize``."""
    back = {m: F.col(f"{m}_mean") + F.col(f"{m}_std") * F.col(m) for m in spec.measures}
    return df.join(scalers, spec.station, "left").withColumns(back).select(*df.columns)


def deal(sizes: Iterable[tuple[int, int]], k: int) -> Iterator[tuple[int, list[int], list[list[int]]]]:
    """How groups of falling sizes go to the lightest of ``k`` folds: (size, starts, folds) per (size, count).

    Of equally light folds the first takes the next group. A run of equal sizes is dealt by arithmetic: a
    fold that holds q sizes and a rest takes part from level q on, one group a level, in order of
    rests. So the order repeats itself until the next fold joins; from the start-th group of the run on
    the folds listed take turns.
    """
    loads = [0] * k
    for size, count in sizes:
        levels, rests = zip(*[divmod(load, size) for load in loads])
        order = sorted(range(k), key=lambda i: (rests[i], i))
        starts, turns, start = [], [], 0
        joins = sorted(set(levels))
        for level, after in zip(joins, [*joins[1:], None]):
            held = [i for i in order if levels[i] <= level]
            starts.append(start)
            turns.append(held)
            end = count if after is None else min(count, start + len(held) * (after - level))
            for place, i in enumerate(held):
                loads[i] += size * max(0, -(-(end - start - place) // len(held)))
            start = end
            if start == count:
                break
        yield size, starts, turns


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Fold 0..k-1 per group, so that a group is never in two folds and folds hold about as many rows.

    From the largest group to the smallest each goes to the fold with the fewest rows so far. Which
    fold the n-th group of a size gets follows from the histogram of sizes alone (``deal``); as sizes add up to
    the rows, there are at most sqrt(2 x rows) of them, and only these reach the driver. Groups of a
    size are numbered within hash prefixes and over these, so no task sees all groups. Result: (group, fold).
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    keyed = write_and_read(sizes.withColumn("_prefix", F.substring(F.md5(F.coalesce(F.col(group).cast("string"), F.lit(""))), 1, 3)), "sizes")
    bucket = ["_size", "_prefix"]
    counts = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_groups"))
    earlier = Window.partitionBy("_size").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*bucket, F.coalesce(F.sum("_groups").over(earlier), F.lit(0)).alias("_before"))
    histogram = keyed.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("_size").desc()).collect()
    schema = "_size long, _starts array<long>, _turns array<array<int>>"
    turns = df.sparkSession.createDataFrame(list(deal([(r["_size"], r["n"]) for r in histogram], k)), schema)
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy(group)) + F.col("_before") - 1
    placed = keyed.join(offsets, bucket).withColumn("_place", place).join(turns, "_size")
    part = F.size(F.filter("_starts", lambda s: s <= F.col("_place")))
    held = F.element_at("_turns", part)
    turn = (F.col("_place") - F.element_at("_starts", part)) % F.size(held)
    return placed.select(group, F.element_at(held, (turn + 1).cast("int")).alias("fold"))


def calendar(spark, days: Mapping[str, Sequence[str]]) -> DataFrame:
    """Calendar table (day, holiday) from kinds and their dates; a date of two kinds joins both."""
    rows = [(d, kind) for kind, dates in days.items() for d in dates]
    table = spark.createDataFrame(rows, "day string, holiday string")
    return table.groupBy(F.to_date("day").alias("day")).agg(
        F.array_join(F.array_sort(F.collect_set("holiday")), "+").alias("holiday")
    )


def with_calendar(df: DataFrame, spec: PanelSpec, days: DataFrame) -> DataFrame:
    """The holiday of each row's date, NULL on other days."""
    return (
        df.withColumn("day", F.col(spec.ts).cast("date")).join(days, "day", "left").drop("day")
    )
