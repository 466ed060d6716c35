"""Experiment settings, and running many of them in few jobs."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import asdict, dataclass
from datetime import timedelta
from functools import reduce
from itertools import product
from typing import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.fixed import CITY_PRESETS, CURVE_HISTORY_DAYS, MAX_MISSING_NEIGHBORS, WINDOW_FAMILIES, window_family
from panelcast.operators.curve import CurveShape, curve_models, predict_curves, to_wide
from panelcast.operators.features import shifted_splits
from panelcast.operators.impute import impute
from panelcast.operators.pooled import pooled_panel_forecast
from panelcast.operators.score import common_cells, mean_scores
from panelcast.operators.seasonal import day_list
from panelcast.plans.backtest import backtest, backtest_fills
from panelcast.session import write_and_read
from panelcast.sources.stores import append_scores, append_settings
from panelcast.spec import EPOCH, PanelSpec

CITIES = ("beijing", "london")

# --- fixed values: the grids of the curve experiments ---
CURVE_STRENGTHS = {"by history": [0.005, 0.05, 0.5], "by changepoints": [0.001, 0.003, 0.007, 0.01], "last": [0.005]}
CURVE_CHANGEPOINTS = {"by history": [25], "by changepoints": [13, 25, 49, 67, 99], "last": [13, 49, 67, 99]}


@dataclass(frozen=True)
class MediansSetting:
    num: int
    city: str
    learned: bool
    fill: bool
    method: str
    family: str


@dataclass(frozen=True)
class CurveSetting:
    num: int
    city: str
    history_days: int
    strength: float
    changepoints: int


@dataclass(frozen=True)
class NetExperiment:
    """Setting of a pooled experiment; ``batch_size`` is the number of rows of a step of the net."""

    num: int
    city: str
    history_days: int
    family: str
    dropout: float
    units: Sequence[int]
    batch_size: int
    shifts: int = 60
    median_shifts: int = 2
    l2: float = 0.0001


def medians_settings(cities: Sequence[str] = CITIES) -> list[MediansSetting]:
    """City x learned fill x in-window fill x summary x family, numbered from 1."""
    grid = product(cities, (True, False), (True, False), ("median", "mean"), WINDOW_FAMILIES)
    return [MediansSetting(n, *values) for n, values in enumerate(grid, 1)]


def curve_settings(cities: Sequence[str] = CITIES) -> list[CurveSetting]:
    """Histories at one changepoint count, then strengths and changepoints at the longest history."""
    longest = CURVE_HISTORY_DAYS[:1]
    blocks = [
        product(cities, days, CURVE_STRENGTHS[part], CURVE_CHANGEPOINTS[part])
        for part, days in (("by history", CURVE_HISTORY_DAYS), ("by changepoints", longest), ("last", longest))
    ]
    return [CurveSetting(n, *values) for n, values in enumerate((v for b in blocks for v in b), 1)]


def net_settings() -> list[NetExperiment]:
    return [
        NetExperiment(n, city, p["lag_history_days"], p["lag_windows"], p["dropout"], p["units"], p["batch"])
        for n, (city, p) in enumerate((c, CITY_PRESETS[c]) for c in ("london", "beijing"))
    ]


def chosen(settings: Iterable, numbers: Iterable[int] | None):
    """The settings of the given numbers; all of them for None."""
    wanted = None if numbers is None else set(numbers)
    return [s for s in settings if wanted is None or s.num in wanted]


def settings_table(spark: SparkSession, settings: Sequence) -> DataFrame:
    return spark.createDataFrame([asdict(s) for s in settings])


def first_day(origins: Sequence) -> str:
    """The first origin's date: what learned fills may know ends there."""
    return (EPOCH + timedelta(days=day_list(origins)[0])).isoformat()


def run_medians(
    panels: dict[str, DataFrame],
    spec: PanelSpec,
    settings: Sequence[MediansSetting],
    origins: Sequence,
    max_missing: dict[str, float] = MAX_MISSING_NEIGHBORS,
    align: str = "target",
    complete: bool = False,
) -> DataFrame:
    """Daily scores of every setting: (num, origin, score).

    Settings of a city and learned fill share the truth and one pass over the history, but for fills
    that change it. Truth is always the raw
    panel; the learned fill is fitted on rows before the first origin alone.
    """
    runs = defaultdict(list)
    for s in settings:
        runs[s.city, s.learned].append(s)
    raw = {city: write_and_read(panels[city].select(*spec.columns), "panel") for city, _ in runs}
    scored = []
    for (city, learned), group in runs.items():
        panel = raw[city]
        if learned:
            filled = impute(panel, spec, ["neighbors"], max_missing=max_missing[city], before=first_day(origins))
            panel = write_and_read(filled, "imputed")
        families = {s.family: window_family(s.family) for s in group}
        methods = sorted({s.method for s in group})
        fills = {s.fill: "day+mean" if s.fill else None for s in group}
        scores = backtest_fills(
            panel, raw[city], spec, origins, families, methods, list(fills.values()), align, complete=complete
        )
        number = F.create_map(*[x for s in group for x in (F.lit(f"{s.family}|{s.method}|{fills[s.fill] or 'none'}"), F.lit(s.num))])
        numbered = scores.withColumn("num", F.try_element_at(number, F.concat_ws("|", "family", "method", "fill")))
        scored.append(mean_scores(numbered.where("num IS NOT NULL"), ["num", "origin"]))
    return reduce(DataFrame.unionByName, scored)


def run_curves(
    panels: dict[str, DataFrame],
    spec: PanelSpec,
    settings: Sequence[CurveSetting],
    origins: Sequence,
    max_missing: dict[str, float] = MAX_MISSING_NEIGHBORS,
    align: str = "target",
) -> DataFrame:
    """Daily scores of every curve setting: (num, origin, score); all settings of a city share one pass."""
    cities = {s.city for s in settings}
    raw = {c: write_and_read(panels[c].select(*spec.columns), "panel") for c in cities}
    filled = {
        c: write_and_read(impute(raw[c], spec, ["neighbors"], max_missing=max_missing[c], before=first_day(origins)), "imputed")
        for c in cities
    }
    scored = []
    for c in sorted(cities):
        shapes = {s.num: CurveShape(s.history_days, s.strength, s.changepoints) for s in settings if s.city == c}
        curves = predict_curves(curve_models(filled[c], spec, origins, shapes), spec)
        wide = to_wide(curves, spec, by=("num", "origin"))
        scores = backtest(wide, raw[c], spec, origins, by=["num", "origin"], align=align)
        scored.append(mean_scores(scores, ["num", "origin"]))
    return reduce(DataFrame.unionByName, scored)


def run_pooled(
    panels: dict[str, DataFrame],
    spec: PanelSpec,
    settings: Sequence[NetExperiment],
    origins: Sequence,
    max_missing: dict[str, float] = MAX_MISSING_NEIGHBORS,
    exclude: Sequence[str] = (),
    folds: int = 5,
    estimator=None,
) -> DataFrame:
    """Daily scores of pooled forecasts: (num, origin, score).

    Every origin is a split day of its own, with training splits from three days before it; its
    forecast starts a day later and is scored there. Stations of ``exclude`` are neither trained on
    nor scored.
    """
    scored = []
    for s in settings:
        raw = write_and_read(panels[s.city].select(*spec.columns), "panel")
        steps = ["neighbors", "season", "mean"]
        filled = write_and_read(impute(raw, spec, steps, max_missing=max_missing[s.city], before=first_day(origins)), "imputed")
        for day in day_list(origins):
            forecast, _ = pooled_panel_forecast(
                filled, spec, day, shifted_splits(day - 3, s.shifts), s.history_days, window_family(s.family),
                s.median_shifts, k=folds, estimator=estimator, exclude=exclude,
            )
            wide = to_wide(forecast.withColumn("origin", F.date_from_unix_date("split_day")), spec)
            scores = backtest(wide, raw, spec, [day], gap_days=1, ignore_stations=exclude)
            scored.append(mean_scores(scores).withColumn("num", F.lit(s.num)))
    return reduce(DataFrame.unionByName, scored)


def record(scores: DataFrame, settings: Sequence, path: str) -> DataFrame:
    """Append the scores and the settings behind them below ``path``; return mean scores per setting, best first.

    Settings are compared on the origins that all of them score; one that scores none of these comes last.
    """
    append_scores(scores, f"{path}/scores")
    append_settings(scores.sparkSession, f"{path}/settings", [asdict(s) for s in settings], f"{path}/scores")
    stored = scores.sparkSession.read.parquet(f"{path}/scores").distinct().where(F.col("num").isin([s.num for s in settings]))
    means = common_cells(stored, ["num"], ["origin"]).groupBy("num").agg(F.avg("score").alias("score"))
    board = stored.select("num").distinct().join(means, "num", "left")
    return board.orderBy(F.col("score").asc_nulls_last(), "num")
