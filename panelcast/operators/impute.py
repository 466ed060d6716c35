"""Filling missing cells of a panel on its spine.

Every step leaves known values alone. Steps are chained by ``impute`` in the order given.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelcast.operators.boosted import fill_from_boosted, fit_boosted
from panelcast.operators.normal import fill_from_normal, fit_normal
from panelcast.operators.panel import in_range
from panelcast.session import counted_side
from panelcast.spec import PanelSpec

Step = Callable[[DataFrame, PanelSpec], DataFrame]


def fill_within(df: DataFrame, spec: PanelSpec, by: str = "day", direction: str = "both") -> DataFrame:
    """Carry the last known value forward, then the next known one backward, within groups.

    ``by='day'`` groups by station and calendar day, ``by='season'`` by station and position in
    the day. ``direction='forward'`` looks only back, as a backtest needs. Both directions are
    running frames (the backward one over descending time), so cost grows linearly with a group.
    """
    if by not in ("day", "season"):
        raise ValueError("by must be 'day' or 'season'")
    if direction not in ("both", "forward"):
        raise ValueError("direction must be 'both' or 'forward'")
    if by == "day" and spec.step == "day":
        return df  # a day of a daily panel is one row
    df = df.withColumn("_group", spec.day() if by == "day" else spec.season())
    groups = Window.partitionBy(spec.station, "_group")
    running = (Window.unboundedPreceding, Window.currentRow)
    back = groups.orderBy(spec.ts).rowsBetween(*running)
    ahead = groups.orderBy(F.col(spec.ts).desc()).rowsBetween(*running)
    seen = {m: F.last(m, ignorenulls=True).over(back) for m in spec.measures}
    if direction == "both":
        seen = {m: F.coalesce(seen[m], F.last(m, ignorenulls=True).over(ahead)) for m in spec.measures}
    return df.withColumns(seen).drop("_group")


def fill_mean(df: DataFrame, spec: PanelSpec, by: Sequence[str] | None = None, before: str | None = None) -> DataFrame:
    """Fill with the mean of the station (or of other group columns) over the whole panel, or its part ``before`` a time.

    Means are aggregated and joined back rather than windowed, so no task holds a whole group.
    """
    by = list(by or [spec.station])
    means = in_range(df, spec, None, before).groupBy(*by).agg(*[F.avg(m).alias(f"_mean_{m}") for m in spec.measures])
    filled = {m: F.coalesce(F.col(m), F.col(f"_mean_{m}")) for m in spec.measures}
    return df.join(means, by, "left").withColumns(filled).select(*df.columns)


def fill_zero(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.fillna(0.0, subset=list(spec.measures))


def with_neighbors(df: DataFrame, spec: PanelSpec, within: Sequence[str] = ()) -> DataFrame:
    """Per row and measure: mean of the other stations at the same time, and missing stations.

    Adds ``<m>_others`` (leave-one-out mean, NULL if no other station reports), ``<m>_stations`` (how
    many report the measure at all) and ``<m>_missing`` (those of them without a reading, this one
    included). Stations for which the spec calls a measure absent are no neighbours in it. ``within``
    names columns that confine the neighbourhood, e.g. a city. Sums per time are aggregated and
    joined back.
    """
    keys = [*within, spec.ts]
    totals = []
    for m in spec.measures:
        known = F.when(spec.reports(m), F.col(m))
        totals += [F.sum(known).alias(f"_sum_{m}"), F.count(known).alias(f"_cnt_{m}"), F.count_if(spec.reports(m)).alias(f"_all_{m}")]
    joined = df.join(counted_side(df.groupBy(*keys).agg(*totals), "totals"), keys, "left")
    added = {}
    for m in spec.measures:
        own = F.when(spec.reports(m), F.col(m))
        others = F.col(f"_cnt_{m}") - own.isNotNull().cast("int")
        rest = F.col(f"_sum_{m}") - F.coalesce(own, F.lit(0.0))
        added[f"{m}_others"] = F.when(others > 0, rest / F.nullif(others, F.lit(0)))
        added[f"{m}_stations"] = F.col(f"_all_{m}")
        added[f"{m}_missing"] = F.col(f"_all_{m}") - F.col(f"_cnt_{m}")
    return joined.withColumns(added).select(*df.columns, *added)


def fit_neighbor_lines(df: DataFrame, spec: PanelSpec, within: Sequence[str] = ()) -> DataFrame:
    """One line per station and measure: value ~ slope * mean of the others + intercept.

    All models come from a single aggregation over the panel, whatever their number. Measures that a
    station never reports get no line there.
    """
    return _lines(with_neighbors(df, spec, within), spec)


def _lines(viewed: DataFrame, spec: PanelSpec) -> DataFrame:
    fits = []
    for m in spec.measures:
        y, x = F.when(spec.reports(m), F.col(m)), F.col(f"{m}_others")
        fits += [F.regr_slope(y, x).alias(f"{m}_slope"), F.regr_intercept(y, x).alias(f"{m}_intercept")]
    return viewed.groupBy(spec.station).agg(*fits)


def fill_from_neighbors(
    df: DataFrame,
    spec: PanelSpec,
    max_missing: float,
    within: Sequence[str] = (),
    models: DataFrame | None = None,
) -> DataFrame:
    """Fill a missing cell from the other stations where fewer than ``max_missing`` lack a reading.

    ``max_missing`` of 1 or more counts stations, below 1 it is a fraction of them. ``models`` is a
    table from ``fit_neighbor_lines``; by default it is fitted on ``df`` itself. Values used are
    always those before imputation.
    """
    viewed = with_neighbors(df, spec, within)
    models = models if models is not None else _lines(viewed, spec)
    joined = viewed.join(counted_side(models, "lines"), spec.station, "left")
    filled = {}
    for m in spec.measures:
        limit = F.col(f"{m}_stations") * max_missing if max_missing < 1 else F.lit(max_missing)
        guess = F.col(f"{m}_slope") * F.col(f"{m}_others") + F.col(f"{m}_intercept")
        filled[m] = F.coalesce(F.col(m), F.when(F.col(f"{m}_missing") < limit, guess))
    return joined.withColumns(filled).select(*df.columns)


def step(
    name: str,
    max_missing: float = 0.48,
    within: Sequence[str] = (),
    models: DataFrame | None = None,
    before: str | None = None,
) -> Step:
    """A named step: neighbors, normal, boosted, day, season, mean or zero.

    ``models`` are those of the neighbors, normal or boosted step. With ``before`` no cell learns from later ones: lines, normals, trees and means come from rows before that time
    alone, and values are carried forward only. Forecasts of an origin and backtests need this.
    """
    direction = "forward" if before else "both"

    def neighbors(df: DataFrame, spec: PanelSpec) -> DataFrame:
        known = models
        if known is None and before is not None:
            known = fit_neighbor_lines(in_range(df, spec, None, before), spec, within)
        return fill_from_neighbors(df, spec, max_missing, within, known)

    def normal(df: DataFrame, spec: PanelSpec) -> DataFrame:
        known = models if models is not None else fit_normal(in_range(df, spec, None, before), spec)
        return fill_from_normal(df, spec, max_missing, known)

    def boosted(df: DataFrame, spec: PanelSpec) -> DataFrame:
        known = models if models is not None else fit_boosted(in_range(df, spec, None, before), spec)
        return fill_from_boosted(df, spec, max_missing, known)

    steps: dict[str, Step] = {
        "neighbors": neighbors,
        "normal": normal,
        "boosted": boosted,
        "day": lambda df, spec: fill_within(df, spec, "day", direction),
        "season": lambda df, spec: fill_within(df, spec, "season", direction),
        "mean": lambda df, spec: fill_mean(df, spec, before=before),
        "zero": fill_zero,
    }
    if name not in steps:
        raise ValueError(f"unknown imputation step {name!r}")
    return steps[name]


def impute(df: DataFrame, spec: PanelSpec, steps: Sequence[str | Step], **options) -> DataFrame:
    """Apply steps in order; names are resolved by ``step`` with ``options``."""
    chosen = [step(s, **options) if isinstance(s, str) else s for s in steps]
    return reduce(lambda acc, fill: fill(acc, spec), chosen, df)


def main_residual_steps(main: str = "mean", residual: str = "mean") -> list[str]:
    """Steps of the two-part form: a main filler and what closes the remaining gaps."""
    mains = {"day": ["day"], "fwbw_day": ["day"], "hour": ["season"], "fwbw_hour": ["season"], "mean": []}
    if main not in mains:
        raise ValueError(f"unknown main method {main!r}")
    if residual not in ("mean", "zero"):
        raise ValueError(f"unknown residual method {residual!r}")
    steps = list(mains[main])
    if "mean" in (main, residual):
        steps.append("mean")
    if residual == "zero":
        steps.append("zero")
    return steps
