"""Forecast tables on the grid, rolling-origin backtests and setting boards."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from panelcast.fixed import window_family
from panelcast.functions.columns import clip_missing
from panelcast.operators.score import leaderboard, score_grid, score_pairs, truth
from panelcast.operators.seasonal import forecast_grid, packed_medians
from panelcast.session import write_and_read
from panelcast.spec import PanelSpec

SETTING = ["family", "method", "fill"]


def on_grid(
    forecast: DataFrame, stations: DataFrame, spec: PanelSpec, origin: str, horizon: int = 48, clip: bool = True
) -> DataFrame:
    """The forecast of one origin on the whole station x horizon grid, missing ones 0 if clipped."""
    grid = forecast_grid(stations, spec, horizon)
    keys = ["origin", spec.station, "horizon"]
    values = forecast.where(F.col("origin") == F.lit(origin).cast("date")).select(*keys[1:], *spec.measures)
    joined = grid.join(values.hint("merge"), keys[1:], "left").withColumn("origin", F.lit(origin).cast("date"))
    if clip:
        joined = joined.withColumns({m: clip_missing(m) for m in spec.measures})
    return joined.select(*keys, *spec.measures)


def backtest(
    forecast: DataFrame,
    raw: DataFrame,
    spec: PanelSpec,
    origins: Sequence,
    by: Sequence[str] = ("origin",),
    gap_days: int = 0,
    align: str = "target",
    **scoring,
) -> DataFrame:
    """Score the forecasts of many origins against raw (unimputed) readings, all in one job.

    ``gap_days`` says how many days after its origin a forecast's horizon 0 lies. ``align='target'``
    compares equal times; ``'legacy'`` compares horizons with the truth of one day after the
    origin, whatever the forecast was made for.
    """
    if align not in ("target", "legacy"):
        raise ValueError("align must be 'target' or 'legacy'")
    complete = scoring.pop("complete", False)
    actual = truth(raw, spec, origins, gap_days=gap_days if align == "target" else 1, complete=complete)
    return score_grid(actual, forecast, spec, by=by, **scoring)


def backtest_medians(
    train: DataFrame,
    raw: DataFrame,
    spec: PanelSpec,
    origins: Sequence,
    families: dict[str, Sequence[int]],
    methods: Sequence[str] = ("median",),
    fill: str | None = None,
    align: str = "target",
    **scoring,
) -> DataFrame:
    """Backtest the median-of-medians forecaster: (origin, family, method, station, measure, score)."""
    return backtest_fills(train, raw, spec, origins, families, methods, [fill], align, **scoring).drop("fill")


def backtest_fills(
    train: DataFrame,
    raw: DataFrame,
    spec: PanelSpec,
    origins: Sequence,
    families: dict[str, Sequence[int]],
    methods: Sequence[str] = ("median",),
    fills: Sequence[str | None] = (None,),
    align: str = "target",
    complete: bool = False,
    **scoring,
) -> DataFrame:
    """The backtests of several fills: (origin, family, method, fill, station, measure, score); no fill is 'none'.

    Truth and packed forecasts meet by origin and station, and are unpacked there. Scores stay where they
    met, so all settings' scores of a cell lie together and only packed rows are moved.
    """
    if align not in ("target", "legacy"):
        raise ValueError("align must be 'target' or 'legacy'")
    place, measures, days_ahead = ["origin", spec.station], list(spec.measures), 2
    gap_days = 0 if align == "target" else 1
    answers = truth(raw, spec, origins, gap_days=gap_days, days_ahead=days_ahead, complete=complete)
    step = F.struct("horizon", *[F.col(m).alias(f"_a_{m}") for m in measures])
    # A set number of parts, as unpacking multiplies what sizes of packed parts would tell.
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = answers.repartition(parts, *place).groupBy(*place).agg(F.collect_list(step).alias("_steps"))
    for i, fill in enumerate(fills):
        packed = packed_medians(train, spec, origins, families, methods, fill, days_ahead)
        row = F.struct(F.lit(fill or "none").alias("fill"), *measures).alias(f"_f{i}")
        met = met.join(packed.repartition(parts, *place).select(*place, row).hint("merge"), place, "left")
    # A fill without forecasts for origin and station still is a row, without labels.
    run = [F.coalesce(F.col(f"_f{i}"), F.struct(F.lit(fill or "none").alias("fill"), *[F.lit(None).cast("array<double>").alias(m) for m in measures]))
           for i, fill in enumerate(fills)]
    labels = [(f, m) for f in families for m in methods]
    known = F.sequence(F.lit(0), F.lit(len(labels) - 1))
    label = F.explode(F.when(F.col(f"_run.{measures[0]}").isNotNull(), known).otherwise(F.array(F.lit(None).cast("int")))).alias("_label")
    steps = met.select(*place, "_steps", F.explode(F.array(*run)).alias("_run")).select("*", label)
    pairs = steps.select(*place, "_run", "_label", F.explode("_steps").alias("_step")).select(
        *place,
        *[F.get(F.array(*[F.lit(lab[k]) for lab in labels]), F.col("_label")).alias(n) for k, n in enumerate(("family", "method"))],
        F.col("_run.fill").alias("fill"),
        *[F.col(f"_step._a_{m}").alias(f"_a_{m}") for m in measures],
        *[F.get(F.col(f"_run.{m}"), F.col("_step.horizon") * len(labels) + F.col("_label")).alias(m) for m in measures],
    )
    return score_pairs(pairs, spec, ["origin", "family", "method", "fill"], **scoring)


def settings_board(
    panel: DataFrame,
    spec: PanelSpec,
    origins: Sequence,
    families: Sequence[str],
    methods: Sequence[str] = ("median", "mean"),
    fills: Sequence[str | None] = (None, "day+mean"),
) -> DataFrame:
    """Mean backtest score of every family x method x fill, best first.

    Families, methods and fills share the truth and one pass over the history, but for fills that change it.
    The panel is stored first, as training and truth of every fill read it.
    """
    panel = write_and_read(panel.select(*spec.columns), "panel")
    windows = {f: window_family(f) for f in families}
    return leaderboard(backtest_fills(panel, panel, spec, origins, windows, methods, fills), SETTING)
