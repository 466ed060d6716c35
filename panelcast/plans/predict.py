"""The daily forecast jobs: one setting per city, merged on the grid, clipped, written."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from panelcast.fixed import CITY_OF, CITY_PRESETS, EXCLUDED_FROM_TRAINING, MAX_MISSING_NEIGHBORS, window_family
from panelcast.operators.curve import curve_forecast, to_wide
from panelcast.operators.features import group_folds, shifted_splits, supervised
from panelcast.operators.impute import impute
from panelcast.operators.net import NetSetting, net_forecast, train_net
from panelcast.operators.pooled import pooled_panel_forecast
from panelcast.operators.seasonal import median_of_medians
from panelcast.plans.backtest import on_grid
from panelcast.session import write_and_read
from panelcast.sources.stores import to_submission, write_submission
from panelcast.spec import EPOCH, PanelSpec, day_number


@dataclass(frozen=True)
class CitySetting:
    """Parameters of one city for the three forecasters."""

    windows: Sequence[int]
    max_missing: float
    method: str = "median"
    fill: str | None = "day+mean"
    history_days: int = 475
    strength: float = 0.003
    changepoints: int = 67
    lag_history_days: int = 360
    shifts: int = 60
    median_shifts: int = 2
    folds: int = 5
    exclude: Sequence[str] = field(default_factory=tuple)
    net: NetSetting = NetSetting()
    lag_windows: Sequence[int] | None = None  # of the pooled and net models, if not ``windows``

    @property
    def feature_windows(self) -> Sequence[int]:
        return self.windows if self.lag_windows is None else self.lag_windows


def city_settings() -> dict[str, CitySetting]:
    """The settings of the daily jobs by city."""
    out = {}
    for city, p in CITY_PRESETS.items():
        out[city] = CitySetting(
            windows=window_family(p["windows"]),
            max_missing=MAX_MISSING_NEIGHBORS[city],
            method=p["method"],
            history_days=p["history_days"],
            strength=p["strength"],
            changepoints=p["changepoints"],
            lag_history_days=p["lag_history_days"],
            exclude=(EXCLUDED_FROM_TRAINING,) if CITY_OF[EXCLUDED_FROM_TRAINING] == city else (),
            net=NetSetting(units=p["units"], dropout=p["dropout"], batch_rows=p["batch"]),
            lag_windows=window_family(p["lag_windows"]),
        )
    return out


def medians_job(panel: DataFrame, spec: PanelSpec, origin: str, s: CitySetting) -> DataFrame:
    """Neighbours filled, then medians of medians with in-window fill."""
    filled = impute(panel, spec, ["neighbors"], max_missing=s.max_missing, before=origin)
    forecast = median_of_medians(filled, spec, [origin], {"all": s.windows}, [s.method], s.fill)
    return forecast.drop("family", "method")


def curve_job(panel: DataFrame, spec: PanelSpec, origin: str, s: CitySetting) -> DataFrame:
    """Neighbours filled, then one curve per series."""
    filled = impute(panel, spec, ["neighbors"], max_missing=s.max_missing, before=origin)
    curves = curve_forecast(filled, spec, [origin], s.history_days, s.strength, s.changepoints)
    return to_wide(curves, spec)


def pooled_job(panel: DataFrame, spec: PanelSpec, origin: str, s: CitySetting, estimator=None) -> DataFrame:
    """Neighbours, same-season and mean fill, then the pooled ensemble.

    The split day is the day before the origin; training splits end three days before it, so their
    labels are known.
    """
    filled = impute(panel, spec, ["neighbors", "season", "mean"], max_missing=s.max_missing, before=origin)
    split = day_number(origin) - 1
    forecast, _ = pooled_panel_forecast(
        filled, spec, split, shifted_splits(split - 3, s.shifts), s.lag_history_days, s.feature_windows,
        s.median_shifts, k=s.folds, estimator=estimator, exclude=s.exclude,
    )
    return to_wide(forecast.withColumn("origin", F.date_from_unix_date(F.col("split_day") + 1)), spec)


def net_job(panel: DataFrame, spec: PanelSpec, origin: str, s: CitySetting) -> DataFrame:
    """The same training set and splits, learned by the shortcut net, one net per fold."""
    filled = write_and_read(
        impute(panel, spec, ["neighbors", "season", "mean"], max_missing=s.max_missing, before=origin).select(*spec.columns), "panel"
    )
    split = day_number(origin) - 1
    shape = (s.lag_history_days, s.feature_windows, s.median_shifts)
    known = filled.where(~F.col(spec.station).isin(list(s.exclude))) if s.exclude else filled
    rows = write_and_read(supervised(known, spec, shifted_splits(split - 3, s.shifts), *shape), "rows")
    train = write_and_read(rows.join(group_folds(rows, spec.station, s.folds), spec.station), "training")
    net = train_net(train, spec, s.net, s.folds)
    forecast = net_forecast(net, supervised(filled, spec, [split], *shape, labels=False), spec)
    return to_wide(forecast.withColumn("origin", F.date_from_unix_date(F.col("split_day") + 1)), spec)


JOBS = {"medians": medians_job, "curve": curve_job, "pooled": pooled_job, "net": net_job}


def predict_cities(
    panels: dict[str, DataFrame], spec: PanelSpec, origin: str, settings: dict[str, CitySetting], model: str
) -> DataFrame:
    """Forecast every city by its own setting; all cities together on the clipped grid."""
    if model not in JOBS:
        raise ValueError(f"unknown model {model!r}")
    per_city = [
        on_grid(JOBS[model](panel, spec, origin, settings[city]), panel, spec, origin).withColumn("city", F.lit(city))
        for city, panel in panels.items()
    ]
    return reduce(DataFrame.unionByName, per_city)


def daily_job(panels, spec, origin, settings, model, path) -> DataFrame:
    """Forecast, write the submission of the day, and return it as stored.

    The prediction date is the day before the origin, the first forecast day.
    """
    submission = to_submission(predict_cities(panels, spec, origin, settings, model), spec)
    pred_date = (EPOCH + timedelta(days=day_number(origin) - 1)).isoformat()
    folder = write_submission(submission, path, pred_date, model)
    return submission.sparkSession.read.schema(submission.schema).option("header", True).csv(folder)
