"""History builds: from several sources to one gap-free panel per city."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelcast.operators.impute import impute
from panelcast.operators.panel import clean, dedupe, in_range, merge_sources, to_spine, union_sources
from panelcast.session import write_and_read
from panelcast.spec import PanelSpec


def build_history(
    sources: Sequence[DataFrame],
    spec: PanelSpec,
    start: str | None = None,
    rename: Mapping[str, str] | None = None,
    keep: str = "first",
    order: Sequence[str] = (),
) -> DataFrame:
    """Union of the sources, the earlier one winning, on the spine, from ``start`` on.

    Sources may differ in columns; those outside the panel are projected away. Where a source holds a
    key twice with different values, ``order`` names the columns of all sources that tell which row
    came first (for landed files ``arrival``); without them such a source is refused. The unique
    readings are stored once, as bounds, stations and cells of the spine are read from them.
    """
    cleaned = [clean(s, spec, rename).select(*spec.columns, *order) for s in sources]
    ranked = union_sources(*cleaned, rank="_rank")
    unique = write_and_read(dedupe(ranked, spec.keys, ["_rank", *order], keep).select(*spec.columns), "readings")
    return in_range(to_spine(unique, spec), spec, start)


def build_from_readings(
    readings: DataFrame,
    spec: PanelSpec,
    start: str,
    end: str,
    closed: bool = False,
    secondary: DataFrame | None = None,
) -> DataFrame:
    """Unique landed readings cut to their range, put on the spine, completed from a second panel."""
    panel = to_spine(write_and_read(in_range(readings, spec, start, end, closed), "readings"), spec)
    return panel if secondary is None else merge_sources(panel, secondary, spec)


def refresh(
    history: DataFrame, window: DataFrame, spec: PanelSpec, start: str, end: str | None = None, partial: bool = False
) -> DataFrame:
    """History plus unique readings of a newly landed window, which win where both have a row.

    With ``partial`` the window may end early: its upper bound is not checked.
    """
    fresh = to_spine(write_and_read(in_range(window, spec, start, None if partial else end, closed=True), "readings"), spec)
    return dedupe(union_sources(history, fresh, rank="_rank"), spec.keys, ["_rank"], "last").drop("_rank")


def imputed_history(
    history: DataFrame,
    spec: PanelSpec,
    city: str,
    steps: Sequence[str] = ("neighbors",),
    before: str | None = None,
    stations: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """History of complete days of the named stations, imputed, tagged with its city."""
    cut = in_range(history, spec, None, before)
    if stations is not None:
        cut = cut.where(F.col(spec.station).isin(list(stations)))
    return impute(cut, spec, list(steps), **options).withColumn("city", F.lit(city))
