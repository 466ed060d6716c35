"""Cleaning and shaping of panels: dedupe, spine, merge, reshape, time ranges."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.functions.columns import number, shift_hours
from panelcast.spec import PanelSpec


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def clean(
    df: DataFrame,
    spec: PanelSpec,
    rename: Mapping[str, str] | None = None,
    utc_offset_hours: int = 0,
) -> DataFrame:
    """Rename, parse the time, move it to UTC by a fixed offset, make the measures doubles or NULL."""
    df = df.withColumnsRenamed(dict(rename or {}))
    spec.check(df)
    ts = F.col(spec.ts).cast("timestamp_ntz")
    if utc_offset_hours:
        ts = shift_hours(ts, -utc_offset_hours)
    return df.withColumns({spec.ts: ts, **{m: number(_quoted(m)) for m in spec.measures}})


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key: the first or last by ``order``.

    The order must decide: if rows that differ share a key's first (or last) place, the job fails
    rather than choose by value. Equal rows are one row, so keys that repeat nothing but whole rows
    need no order.

    Minima over structs, not a ranked window: copies of one key collapse on the map side, so a key
    holding a third of all rows never meets in one task. The places of the least and the greatest
    hash of the other columns show whether the order decided.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    rest = [c for c in df.columns if c not in keys and c not in order]
    place, content = [_quoted(c) for c in order], F.xxhash64(*[_quoted(c) for c in rest]) if rest else F.lit(0).cast("long")
    row = F.struct(*place, *[_quoted(c) for c in rest])
    pick = F.min if keep == "first" else F.max
    kept = df.groupBy(*[_quoted(c) for c in keys]).agg(
        pick(row).alias("_row"),
        pick(F.struct(*place, content.alias("_h"))).alias("_a"),
        pick(F.struct(*place, F.bitwise_not(content).alias("_h"))).alias("_b"),
    )
    undecided = F.col("_a._h") != F.bitwise_not(F.col("_b._h"))
    why = F.concat(F.lit("the order does not decide between rows of key "), F.to_json(F.struct(*[_quoted(c) for c in keys])))
    kept = kept.withColumn("_row", F.when(undecided, F.raise_error(why).cast(df.select(row).schema[0].dataType)).otherwise(F.col("_row")))
    return kept.select(*[_quoted(c) for c in keys], "_row.*").select(*[_quoted(c) for c in df.columns])


def union_sources(*sources: DataFrame, rank: str | None = None) -> DataFrame:
    """All rows of all sources, missing columns as NULL; ``rank`` names a column numbering them."""
    if rank:
        sources = tuple(s.withColumn(rank, F.lit(i)) for i, s in enumerate(sources))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def merge_sources(primary: DataFrame, secondary: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows of the primary source, its missing measures filled from the secondary one."""
    other = secondary.select(*spec.keys, *[F.col(m).alias(f"_{m}") for m in spec.measures])
    joined = primary.join(other, spec.keys, "left")
    return joined.withColumns({m: F.coalesce(F.col(m), F.col(f"_{m}")) for m in spec.measures}).drop(
        *[f"_{m}" for m in spec.measures]
    )


def scatter_update(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Write non-null update cells over the matching cells of the target."""
    new = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(new, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).drop(
        *[f"_{c}" for c in columns]
    )


def _bounds(df: DataFrame, spec: PanelSpec, start: Column | None, end: Column | None) -> tuple[Column, Column]:
    """First time of the grid and number of its last step; bounds not given are scalar subqueries."""
    ts = F.col(spec.ts)
    lo = start if start is not None else df.agg(F.min(ts)).scalar()
    hi = end if end is not None else df.agg(F.max(ts)).scalar()
    return lo, F.timestamp_diff(spec.step, lo, hi)


def spine(
    df: DataFrame,
    spec: PanelSpec,
    start: Column | None = None,
    end: Column | None = None,
    stations: DataFrame | None = None,
) -> DataFrame:
    """Every station of ``df`` at every step from ``start`` to ``end``, both inclusive.

    The bounds default to the least and greatest time over all stations, read by scalar
    subqueries; giving bounds and a station table saves those passes over ``df``. Stations are
    spread before the steps are generated, since generating multiplies each row by the length of
    the calendar.
    """
    lo, last = _bounds(df, spec, start, end)
    names = (stations if stations is not None else df).select(spec.station).distinct()
    spread = names.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = spread.select(spec.station, lo.alias("_lo"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_k"))
    return numbered.where("_k >= 0").select(spec.station, (F.col("_lo") + spec.steps("_k")).alias(spec.ts))


def to_spine(
    df: DataFrame,
    spec: PanelSpec,
    order: Sequence[str] | None = None,
    start: Column | None = None,
    end: Column | None = None,
    stations: DataFrame | None = None,
) -> DataFrame:
    """Put readings on the complete station x time grid.

    With ``order`` the keys are made unique first (keep-first); without it they must be unique
    already. Readings off the grid disappear, absent ones become NULL.

    Only readings are shuffled, by station: each then fills the steps up to the station's next one,
    and an empty head per station those before its first. The grid, many times as long, is never
    joined, so its size is never guessed, and it comes out clustered by station.
    """
    spec.check(df)
    unique = dedupe(df, spec.keys, order) if order is not None else df
    lo, last = _bounds(df, spec, start, end)
    rest = [c for c in df.columns if c not in spec.keys]
    names = (stations if stations is not None else df).select(spec.station).distinct()
    if stations is not None:
        unique = unique.join(names, spec.station, "left_semi")
    numbered = unique.withColumn("_k", F.timestamp_diff(spec.step, lo, F.col(spec.ts)))
    on_grid = F.col(spec.station).isNotNull() & F.col("_k").between(0, last) & (lo + spec.steps("_k") == F.col(spec.ts))
    readings = numbered.where(on_grid).select(spec.station, "_k", *[_quoted(c) for c in rest])
    kinds = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in rest]
    heads = names.select(spec.station, F.lit(-1).cast("long").alias("_k"), *kinds)
    following = F.coalesce(F.lead("_k").over(Window.partitionBy(spec.station).orderBy("_k")), last + 1)
    steps = F.sequence("_k", F.greatest("_k", F.col("_next") - 1))
    full = readings.unionByName(heads).withColumn("_next", following).withColumn("_at", F.explode(steps)).where("_at >= 0")
    here = {c: F.when(F.col("_at") == F.col("_k"), _quoted(c)) for c in rest}
    return full.withColumns({**here, spec.ts: lo + spec.steps("_at")}).select(*[_quoted(c) for c in df.columns])


def in_range(
    df: DataFrame, spec: PanelSpec, start: str | None = None, end: str | None = None, closed: bool = False
) -> DataFrame:
    """Rows with start <= ts < end, or <= end if ``closed``; an open side is not checked."""
    ts = F.col(spec.ts)
    if start is not None:
        df = df.where(ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bound = F.lit(end).cast("timestamp_ntz")
        df = df.where(ts <= bound if closed else ts < bound)
    return df


def history_cut(df: DataFrame, spec: PanelSpec, origin: str, history_days: int, cut_hours: int = 9) -> DataFrame:
    """Training rows of an origin: up to ``cut_hours`` before it, then the last ``history_days``.

    The lower bound counts back from the latest remaining time over all stations, inclusive.
    """
    last = F.lit(origin).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(cut_hours))
    known = df.where(F.col(spec.ts) <= last)
    lowest = known.agg(F.max(spec.ts) - F.make_dt_interval(days=F.lit(history_days))).scalar()
    return known.where(F.col(spec.ts) >= lowest)


def complete_case(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows with every measure known that the station reports at all."""
    known = [F.col(m).isNotNull() | ~spec.reports(m) for m in spec.measures]
    return df.where(reduce(lambda a, b: a & b, known))


def keep_stations(df: DataFrame, stations: DataFrame, spec: PanelSpec, member: bool = True) -> DataFrame:
    """Rows whose station is (or, with ``member=False``, is not) in the station table."""
    return df.join(stations.select(spec.station).distinct(), spec.station, "left_semi" if member else "left_anti")


def new_rows(landed: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Landed rows whose key the known table does not hold yet."""
    return landed.join(known.select(*keys).distinct(), list(keys), "left_anti")


def series(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Fully long form: (station, ts, measure, value), without series a station never reports."""
    long = df.unpivot(spec.keys, list(spec.measures), "measure", "value")
    return drop_absent(long, spec)


def drop_absent(long: DataFrame, spec: PanelSpec) -> DataFrame:
    """Drop the (station, measure) series that the spec declares absent."""
    for measure, stations in spec.absent.items():
        long = long.where(~((F.col("measure") == measure) & F.col(spec.station).isin(list(stations))))
    return long


def series_arrays(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per (station, measure): all values in time order as one array, gaps kept as NULL.

    The array is as long as the calendar, whatever the number of stations. Wide tables with one
    column per timestamp are never built.
    """
    rows = F.collect_list(F.struct(spec.ts, *spec.measures))
    packed = df.groupBy(spec.station).agg(F.array_sort(rows).alias("_rows"))
    long = packed.select(
        spec.station,
        F.col("_rows")[0][spec.ts].alias("start"),
        F.element_at("_rows", -1)[spec.ts].alias("end"),
        F.explode(
            F.create_map(*[x for m in spec.measures for x in (F.lit(m), F.col(f"_rows.{m}"))])
        ).alias("measure", "values"),
    )
    return drop_absent(long, spec)


def station_columns_to_rows(
    wide: DataFrame,
    spec: PanelSpec,
    stations: Iterable[str],
    type_column: str = "type",
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Raw layout with one column per station and one row per (ts, type) -> panel.

    ``types`` maps type values to measures; rows of other types are dropped. Station columns that
    a file lacks are NULL. One reading per cell is expected (dedupe on (type, ts) first).
    """
    types = dict(types or {m: m for m in spec.measures})
    present = [s for s in stations if s in wide.columns]
    rows = (
        wide.where(F.col(type_column).isin(list(types)))
        .select(spec.ts, type_column, *[number(_quoted(s)).alias(s) for s in present])
        .unpivot([spec.ts, type_column], [_quoted(s) for s in present], spec.station, "_value")
    )
    cells = [F.max(F.when(F.col(type_column) == t, F.col("_value"))).alias(m) for t, m in types.items()]
    return rows.groupBy(spec.station, spec.ts).agg(*cells).select(*spec.columns)


def rows_to_station_columns(df: DataFrame, spec: PanelSpec, stations: Sequence[str]) -> DataFrame:
    """Panel -> raw layout: one row per (ts, measure), one column per named station."""
    long = df.unpivot(spec.keys, list(spec.measures), "type", "value")
    return long.groupBy(spec.ts, "type").pivot(spec.station, list(stations)).agg(F.max("value"))
