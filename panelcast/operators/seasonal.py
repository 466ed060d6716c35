"""Rolling same-season summaries over many window sizes, and the median-of-medians forecast.

Two ways to the same numbers:

* ``window_summaries`` - the rows of each station brought together once, then every window and target
  day computed on day x season matrices, many stations at a time. The history is shuffled once,
  however many windows and origins are asked for. Rows stream through a task in pieces of whole
  stations, so its memory follows neither its stations nor the size of its batches.
* ``rolling_seasonal_summary`` - RANGE frames in SQL, one result per row of the panel.
"""

from __future__ import annotations

from typing import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelcast.operators.impute import fill_within
from panelcast.spec import PanelSpec, day_number

# How a window of w days lies before its target day: days target-(w+extra) .. target-gap.
FORECAST = {"extra": 1, "gap": 3}
FEATURE = {"extra": 0, "gap": 1}

# Cells gathered at a time per window: bounds the memory of a task when many targets are asked for.
MAX_CELLS = 4_000_000
# Rows gathered at a time, but for a station that has more.
MAX_ROWS = 250_000


def middle(values: np.ndarray, axis: int) -> np.ndarray:
    """Median along an axis, NaN skipped; NaN where nothing is known."""
    ordered = np.sort(values, axis=axis)
    known = (~np.isnan(values)).sum(axis=axis, keepdims=True)
    low, high = np.maximum((known - 1) // 2, 0), np.minimum(known // 2, values.shape[axis] - 1)
    both = np.take_along_axis(ordered, low, axis) + np.take_along_axis(ordered, high, axis)
    return np.squeeze(np.where(known > 0, both / 2, np.nan), axis)


def average(values: np.ndarray, axis) -> np.ndarray:
    """Mean along an axis or axes, NaN skipped; NaN where nothing is known."""
    known = (~np.isnan(values)).sum(axis=axis)
    return np.where(known > 0, np.nansum(values, axis=axis) / np.maximum(known, 1), np.nan)


SUMMARIES = {"median": middle, "mean": average}


def _whole_stations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows in pieces that end with a station; ``_n`` numbers the rows of each from 1."""
    held, count = [], 0
    for batch in batches:
        starts = np.flatnonzero(batch.column("_n").to_numpy() == 1)
        if len(starts) and count + starts[-1] >= MAX_ROWS:
            yield _joined([*held, batch.slice(0, starts[-1])])
            held, count, batch = [], 0, batch.slice(starts[-1])
        held.append(batch)
        count += batch.num_rows
    if count:
        yield _joined(held)


def _joined(batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _cubes(rows: pa.RecordBatch, measures: Sequence[str], first: int, days: int, seasons: int):
    """Per run of stations: their first rows, values (station, season, measure, day), row mask.

    Days come last, so that a window is one contiguous run.
    """
    day, season = rows.column("_day").to_numpy() - first, rows.column("_season").to_numpy()
    values = np.column_stack([rows.column(m).to_numpy(zero_copy_only=False) for m in measures])
    ends = np.append(np.flatnonzero(rows.column("_n").to_numpy() == 1), rows.num_rows)
    lengths = np.diff(ends)
    run = max(1, MAX_CELLS // (days * seasons * len(measures)))
    for start in range(0, len(lengths), run):
        stop = min(start + run, len(lengths))
        cut = slice(ends[start], ends[stop])
        row = np.repeat(np.arange(stop - start), lengths[start:stop])
        cube = np.full((stop - start, seasons, len(measures), days), np.nan)
        has_row = np.zeros((stop - start, seasons, days), dtype=bool)
        cube[row, season[cut], :, day[cut]] = values[cut]
        has_row[row, season[cut], day[cut]] = True
        if has_row.sum() != len(row):
            raise ValueError("the panel holds a station and time twice; dedupe it first")
        yield ends[start:stop], cube, has_row


def in_days(df: DataFrame, spec: PanelSpec, first: int, last: int) -> DataFrame:
    """Rows of the day numbers first..last, by bounds on the time itself, which reach the scan."""
    bounds = [F.date_from_unix_date(F.lit(d)).cast("timestamp_ntz") for d in (first, last + 1)]
    return df.where((F.col(spec.ts) >= bounds[0]) & (F.col(spec.ts) < bounds[1]))


def day_list(days) -> list[int]:
    """Sorted day numbers, each once, of dates or day numbers."""
    return sorted({d if isinstance(d, int) else day_number(d) for d in days})


def _summaries_of(
    df: DataFrame, spec: PanelSpec, targets: Sequence[int], windows: Sequence[int], extra: int, gap: int,
    methods: Sequence[str], window_mean: bool, groups: Sequence[Sequence[int]] | None,
):
    """The needed history, its rows numbered by station, and what summarises batches of it.

    The latter yields, for some stations and target days at a time, (names, days, summaries by label, method,
    station, season, measure and target); all days of the same stations follow each other.
    """
    measures, seasons, station = list(spec.measures), spec.seasons, spec.station
    first = targets[0] - (max(windows) + extra)
    span = targets[-1] - gap - first + 1

    def one_window(cube, has_row, days, w):
        """Summaries of some target days for one window: (method, station, season, measure, target)."""
        at = (days - (w + extra) - first)[:, None] + np.arange(w + extra - gap + 1)
        part = cube[..., at]
        if window_mean:
            mean = average(part, axis=(1, 4))[:, None, :, :, None]
            part = np.where(has_row[..., at][:, :, None] & np.isnan(part), mean, part)
        return np.stack([SUMMARIES[method](part, axis=4) for method in methods])

    def stacks(batches):
        for rows in _whole_stations(batches):
            for numbers, cube, has_row in _cubes(rows, measures, first, span, seasons):
                names = rows.column(station).take(pa.array(numbers))
                step = max(1, MAX_CELLS // (len(numbers) * max(windows) * seasons * len(measures)))
                for i in range(0, len(targets), step):
                    days = np.asarray(targets[i : i + step])
                    stack = np.stack([one_window(cube, has_row, days, w) for w in windows])
                    if groups is not None:
                        stack = np.stack([middle(stack[g], axis=0) for g in groups])
                    yield names, days, stack

    relevant = in_days(df, spec, first, targets[-1] - gap).select(
        station,
        spec.day().alias("_day"),
        spec.season().alias("_season"),
        *[F.col(m).cast("double").alias(m) for m in measures],
    )
    numbered = F.row_number().over(Window.partitionBy(station).orderBy("_day", "_season")).alias("_n")
    return relevant.select("*", numbered), stacks


def window_summaries(
    df: DataFrame,
    spec: PanelSpec,
    targets: Sequence,
    windows: Sequence[int],
    extra: int = FORECAST["extra"],
    gap: int = FORECAST["gap"],
    methods: Sequence[str] = ("median",),
    window_mean: bool = False,
    across: Sequence[Sequence[int]] | None = None,
) -> DataFrame:
    """Summary per station, target day, season and window of the days target-(w+extra)..target-gap.

    ``targets`` are dates or day numbers. ``window_mean`` first fills the missing cells of each
    window with the station's mean over that window, all seasons together. With ``across``, lists
    of window sizes, the result holds per list the median of its windows' summaries instead of
    one row per window; the column ``windows`` then numbers the lists from 0.

    Keys must be unique. Result: (station, target_day, season, method, window | windows, measures).
    """
    unknown = set(methods) - set(SUMMARIES)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    spec.check(df)
    targets, windows, measures = day_list(targets), sorted(set(windows)), list(spec.measures)
    groups = [[windows.index(w) for w in g] for g in across] if across is not None else None
    label = "window" if groups is None else "windows"
    station = spec.station
    methods = list(methods)
    labels = windows if groups is None else range(len(groups))

    def result(names, stack, days) -> pa.RecordBatch:
        stack = np.moveaxis(stack, 4, 0)  # measures first
        flat = stack.reshape(len(measures), -1)
        label_at, method_at, station_at, season_at, target_at = np.indices(stack.shape[1:], dtype="int32").reshape(5, -1)
        columns = {
            station: names.take(pa.array(station_at)),
            "target_day": pa.array(days.astype("int32")[target_at]),
            "season": pa.array(season_at),
            "method": pa.array(methods).take(pa.array(method_at)),
            label: pa.array(np.asarray(labels, dtype="int32")[label_at]),
            **{m: pa.array(flat[i], from_pandas=True) for i, m in enumerate(measures)},
        }
        return pa.RecordBatch.from_pydict(columns)

    history, stacks = _summaries_of(df, spec, targets, windows, extra, gap, methods, window_mean, groups)

    def summarise(batches):
        for names, days, stack in stacks(batches):
            yield result(names, stack, days)

    kind = dict(df.dtypes)[station]
    schema = f"`{station}` {kind}, target_day int, season int, method string, {label} int, " + ", ".join(
        f"`{m}` double" for m in measures
    )
    return history.mapInArrow(summarise, schema)


def rolling_seasonal_summary(
    df: DataFrame,
    spec: PanelSpec,
    windows: Sequence[int],
    extra: int = FORECAST["extra"],
    gap: int = FORECAST["gap"],
    method: str = "median",
) -> DataFrame:
    """For every row, taken as a target, the summary of the same season in each window.

    Adds the columns ``<measure>_w<window>``. All windows share one exchange and one sort.
    """
    call = {"median": "percentile({m}, 0.5)", "mean": "avg({m})"}[method]
    base = Window.partitionBy(spec.station, "_season").orderBy("_day")
    keyed = df.withColumns({"_day": spec.day(), "_season": spec.season()})
    frames = {w: base.rangeBetween(-(w + extra), -gap) for w in windows}
    return keyed.withColumns(
        {f"{m}_w{w}": F.expr(call.format(m=f"`{m}`")).over(frames[w]) for w in windows for m in spec.measures}
    ).drop("_day", "_season")


def median_features(df: DataFrame, spec: PanelSpec, splits: Sequence, windows: Sequence[int]) -> DataFrame:
    """Same-season medians over the w days before each split day, one row per window."""
    return window_summaries(df, spec, splits, windows, **FEATURE).drop("method")


def forecast_grid(stations: DataFrame, spec: PanelSpec, horizon: int = 48) -> DataFrame:
    """Every station at every horizon 0..horizon-1."""
    names = stations.select(spec.station).distinct()
    return names.select(spec.station, F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("horizon"))


def median_of_medians(
    df: DataFrame,
    spec: PanelSpec,
    origins: Sequence,
    families: dict[str, Sequence[int]],
    methods: Sequence[str] = ("median",),
    fill: str | None = None,
    days_ahead: int = 2,
) -> DataFrame:
    """Forecast each origin's next days as the median over windows of same-season summaries.

    The target day T, be it the first or second day ahead, uses the days T-(w+1)..T-3. ``fill``
    is None, 'day' (forward/backward within the day) or 'day+mean' (then the window's station
    mean). All origins, families and methods come from one pass over the history.

    Result: (origin date, station, horizon, family, method, measures).
    """
    days, windows, source = _forecast_history(df, spec, origins, families, fill, days_ahead)
    names = list(families)
    summaries = window_summaries(
        source,
        spec,
        sorted({d + k for d in days for k in range(days_ahead)}),
        windows,
        methods=methods,
        window_mean=fill == "day+mean",
        across=[families[n] for n in names],
    )
    lead = F.explode(F.sequence(F.lit(0), F.lit(days_ahead - 1))).alias("_lead")
    per_origin = summaries.select("*", lead).withColumn("_origin", F.col("target_day") - F.col("_lead"))
    return per_origin.where(F.col("_origin").isin(days)).select(
        F.date_from_unix_date("_origin").alias("origin"),
        spec.station,
        (F.col("_lead") * spec.seasons + F.col("season")).alias("horizon"),
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("windows") + 1).alias("family"),
        "method",
        *spec.measures,
    )


def _forecast_history(df, spec, origins, families, fill, days_ahead):
    """Origins and windows in order, and the panel that summaries of the fill are made of."""
    if fill not in (None, "day", "day+mean"):
        raise ValueError("fill must be None, 'day' or 'day+mean'")
    days = day_list(origins)
    windows = sorted({w for f in families.values() for w in f})
    if not fill:
        return days, windows, df
    # whole days only, so the range can be cut first
    history = in_days(df, spec, days[0] - windows[-1] - FORECAST["extra"], days[-1] + days_ahead)
    return days, windows, fill_within(history, spec, by="day")


def packed_medians(
    df: DataFrame,
    spec: PanelSpec,
    origins: Sequence,
    families: dict[str, Sequence[int]],
    methods: Sequence[str] = ("median",),
    fill: str | None = None,
    days_ahead: int = 2,
) -> DataFrame:
    """The forecasts of ``median_of_medians``, all of an origin and station in one row.

    Result: (origin date, station, measures), each measure an array over horizon, family and method,
    the method running fastest. Joins by origin and station thus move a row where the long form
    moves one per horizon, family and method.
    """
    unknown = set(methods) - set(SUMMARIES)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    spec.check(df)
    days, windows, source = _forecast_history(df, spec, origins, families, fill, days_ahead)
    groups = [[windows.index(w) for w in f] for f in families.values()]
    targets = sorted({d + k for d in days for k in range(days_ahead)})
    # where in the targets the days of each origin lie
    place = np.array([[targets.index(d + k) for k in range(days_ahead)] for d in days])
    measures, station = list(spec.measures), spec.station
    history, stacks = _summaries_of(source, spec, targets, windows, *FORECAST.values(), list(methods), fill == "day+mean", groups)

    def pack(names, parts) -> pa.RecordBatch:
        stack = np.concatenate(parts, axis=5)[..., place]  # label, method, station, season, measure, origin, lead
        stack = stack.transpose(4, 2, 5, 6, 3, 0, 1).reshape(len(measures), len(names) * len(days), -1)
        cells = stack.shape[2]
        offsets = pa.array(np.arange(stack.shape[1] + 1, dtype="int32") * cells)
        columns = {
            "origin": pa.array(np.tile(np.asarray(days, dtype="int32"), len(names))).cast(pa.date32()),
            station: names.take(pa.array(np.repeat(np.arange(len(names)), len(days)))),
            **{m: pa.ListArray.from_arrays(offsets, pa.array(stack[i].ravel(), from_pandas=True)) for i, m in enumerate(measures)},
        }
        return pa.RecordBatch.from_pydict(columns)

    def forecasts(batches):
        parts, done = [], 0
        for names, at, stack in stacks(batches):
            parts.append(stack)
            done += len(at)
            if done == len(targets):
                packed = pack(names, parts)
                step = max(1, MAX_ROWS // (place.size * len(groups)))  # small batches, as rows are long
                yield from (packed.slice(i, step) for i in range(0, packed.num_rows, step))
                parts, done = [], 0

    kind = dict(df.dtypes)[station]
    schema = f"origin date, `{station}` {kind}, " + ", ".join(f"`{m}` array<double>" for m in measures)
    return history.mapInArrow(forecasts, schema)
