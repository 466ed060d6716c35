"""Names and grain of a panel: one row per (station, ts), one nullable double per measure."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Mapping, Sequence

from pyspark.sql import Column, functions as F

EPOCH = date(1970, 1, 1)


def day_number(day: str | date | datetime) -> int:
    """Days since 1970-01-01 of a date given as text, date or datetime."""
    if isinstance(day, str):
        day = date.fromisoformat(day[:10])
    elif isinstance(day, datetime):
        day = day.date()
    return (day - EPOCH).days


@dataclass(frozen=True)
class PanelSpec:
    """Column names, time step and per-measure exclusions of a panel.

    ``absent`` maps a measure to the stations that never report it; those series
    are neither trained, forecast nor scored.
    """

    station: str = "station"
    ts: str = "ts"
    measures: Sequence[str] = ("pm25", "pm10", "o3")
    step: str = "hour"
    absent: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def __post_init__(self):
        if self.step not in ("hour", "day"):
            raise ValueError(f"step must be 'hour' or 'day', not {self.step!r}")
        if not self.measures:
            raise ValueError("a panel needs at least one measure")

    @property
    def keys(self) -> list[str]:
        return [self.station, self.ts]

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.measures]

    @property
    def seasons(self) -> int:
        """Steps per day: 24 for an hourly panel, 1 for a daily one."""
        return 24 if self.step == "hour" else 1

    def steps(self, count: str | Column) -> Column:
        """The interval of ``count`` steps."""
        count = (F.col(count) if isinstance(count, str) else count).cast("int")
        return F.make_dt_interval(hours=count) if self.step == "hour" else F.make_dt_interval(days=count)

    def season(self) -> Column:
        """Position of the row within its day."""
        return F.hour(self.ts) if self.step == "hour" else F.lit(0)

    def day(self) -> Column:
        """Integer day index of the row."""
        return F.unix_date(F.col(self.ts).cast("date"))

    def check(self, df) -> None:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"panel lacks columns {missing}")

    def reports(self, measure: str) -> Column:
        """True where the station reports the measure."""
        stations = list(self.absent.get(measure, ()))
        return ~F.col(self.station).isin(stations) if stations else F.lit(True)
