"""Additive trend-and-season curves fitted per series, and their plain SQL relative.

The curve follows the published additive model: a linear trend whose slope may change at points
spread over the first 80 % of the history, plus Fourier terms for day, week and, given two years
of history, year. ``penalty='laplace'`` puts a Laplace prior on the slope changes, solved by coordinate descent to a duality gap,
``penalty='ridge'`` a normal one with a closed-form solution for each level of noise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelcast.operators.panel import series
from panelcast.operators.seasonal import day_list
from panelcast.spec import PanelSpec

# --- fixed values: periods in days with Fourier order and least history, and prior widths ---
PERIODS = [(1.0, 4, 2), (7.0, 3, 14), (365.25, 10, 730)]
RANGE_OF_CHANGES = 0.8
TREND_WIDTH = 5.0
SEASON_WIDTH = 10.0

NOISE_ROUNDS = 3
LEAST_NOISE = 1e-8
SWEEPS = 10_000
GAP = 1e-10


@dataclass(frozen=True)
class CurveShape:
    """What a curve sees and how freely its slope may change."""

    history_days: int = 475
    strength: float = 0.003
    changepoints: int = 67
    penalty: str = "laplace"

    def __post_init__(self):
        if self.penalty not in ("laplace", "ridge"):
            raise ValueError("penalty must be 'laplace' or 'ridge'")


def _fourier(days: np.ndarray, history_days: float, seasons: int) -> np.ndarray:
    columns = []
    for period, order, least in PERIODS:
        if history_days < least or (period == 1.0 and seasons == 1):
            continue
        angle = 2 * np.pi * np.outer(days / period, np.arange(1, order + 1))
        columns += [np.sin(angle), np.cos(angle)]
    return np.hstack(columns) if columns else np.empty((len(days), 0))


def _design(days, start, length, changes, seasons):
    t = (days - start) / length
    hinges = np.maximum(t[:, None] - changes[None, :], 0.0)
    return np.hstack([np.ones((len(t), 1)), t[:, None], hinges, _fourier(days, length, seasons)])


def duality_gap(rest: np.ndarray, slope: np.ndarray, moment_fit: float, weight: float, size: float) -> float:
    """Primal minus dual of 1/2 |y - x d|^2 + weight |d|_1, from r = y - x d, x'r, d'x'r and |d|_1.

    r shrunk until no entry of x'r exceeds the weight is a feasible point of the dual problem.
    """
    energy, largest = rest @ rest, np.abs(slope).max(initial=0.0)
    shrink = 1.0 if largest <= weight else weight / largest
    along = energy + moment_fit  # y'r
    return 0.5 * energy + weight * size - (shrink * along - 0.5 * shrink**2 * energy)


def _along_face(x: np.ndarray, y: np.ndarray, weight: float, d: np.ndarray) -> np.ndarray:
    """From ``d`` to the minimum over coefficients of the same signs; what reaches 0 on the way stays there."""
    d = d.copy()
    while len(on := np.flatnonzero(d)):
        signs = np.sign(d[on])
        u, size, v = np.linalg.svd(x[:, on], full_matrices=False)
        held = size > 1e-12 * size[0]
        u, size, v = u[:, held], size[held], v[held]
        free = signs - v.T @ (v @ signs)  # columns that depend on one another: less of |d| for the same fit
        if np.linalg.norm(free) > 1e-9 * np.sqrt(len(on)):
            step, most = -free, np.inf
        else:
            step, most = v.T @ ((u.T @ y - weight * (v @ signs) / size) / size) - d[on], 1.0
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(step * signs < 0, -d[on] / step, np.inf)
        far = min(most, reach.min())
        d[on] = np.where(reach <= far, 0.0, d[on] + far * step)
        if not (reach <= far).any():
            break
    return d


def lasso(x: np.ndarray, y: np.ndarray, weight: float) -> tuple[np.ndarray, float]:
    """Least 1/2 |y - x d|^2 + weight |d|_1 by coordinate descent, and the duality gap, relative to 1 + |y|^2 / 2.

    The coordinate that violates the conditions of the minimum most is moved to its own minimum;
    as columns that lie close together would make this creep, all coefficients then go to the minimum
    with their signs (``_along_face``). Both lower the objective, and there are finitely many patterns of signs. The
    gap bounds the distance to the minimum, whatever the condition of ``x``, and ends the search.
    """
    scale = 1 + 0.5 * (y @ y)
    if len(x) > x.shape[1]:  # the same problem in as many rows as columns
        q, x = np.linalg.qr(x)
        y, beyond = q.T @ y, y - q @ (q.T @ y)
    else:
        beyond = np.zeros(1)
    d, square = np.zeros(x.shape[1]), (x * x).sum(0)
    usable = square > 1e-24 * max(square.max(initial=0.0), 1e-300)
    best, least = d, np.inf
    for _ in range(SWEEPS):
        rest = y - x @ d
        slope = x.T @ rest
        gap = duality_gap(np.concatenate([rest, beyond]), slope, rest @ (x @ d), weight, np.abs(d).sum()) / scale
        if gap < least:
            best, least = d, gap
        off = np.where(usable, np.where(d == 0, np.abs(slope) - weight, np.abs(slope - weight * np.sign(d))), -np.inf)
        k = int(off.argmax())
        if gap <= GAP or off[k] <= 0:
            break
        z = slope[k] + square[k] * d[k]
        moved = d.copy()
        moved[k] = np.sign(z) * max(abs(z) - weight, 0.0) / square[k]
        moved = _along_face(x, y, weight, moved)
        if np.array_equal(moved, d):
            break
        d = moved
    return best, max(least, 0.0)


def fit_model(days: np.ndarray, values: np.ndarray, shape: CurveShape, seasons: int) -> dict:
    """The curve of one series (times in days, at least two known values): its coefficients and how sure they are.

    Trend and seasons have normal priors, slope changes a Laplace one (or normal, for ``ridge``). For
    a given noise the normal part is projected out by an orthogonal decomposition, which leaves a lasso
    problem in the slope changes. The noise is the residual variance, taken NOISE_ROUNDS times.
    """
    start, length = float(days[0]), float(max(days[-1] - days[0], 1e-9))
    scale = float(np.abs(values).max()) or 1.0
    y, n = values / scale, len(values)
    n_changes = min(shape.changepoints, max(int(n * RANGE_OF_CHANGES) - 1, 0))
    changes = np.linspace(0, RANGE_OF_CHANGES, n_changes + 1)[1:]
    x = _design(days, start, length, changes, seasons)
    is_change = np.zeros(x.shape[1], dtype=bool)
    is_change[2 : 2 + n_changes] = True
    smooth = ~is_change if shape.penalty == "laplace" else np.ones(x.shape[1], dtype=bool)
    width = np.where(is_change, shape.strength, np.where(np.arange(x.shape[1]) < 2, TREND_WIDTH, SEASON_WIDTH))
    beta, noise, gap, weight = np.zeros(x.shape[1]), max(float(y.var()), LEAST_NOISE), 0.0, 0.0
    for _ in range(NOISE_ROUNDS):
        ridge = noise / width**2
        free = np.vstack([x[:, smooth], np.diag(np.sqrt(ridge[smooth]))])
        q, r = np.linalg.qr(free)
        pad = np.zeros(smooth.sum())
        whole = np.concatenate([y, pad])
        beta = np.zeros(x.shape[1])
        if not smooth.all():
            hinges = np.vstack([x[:, ~smooth], np.zeros((len(pad), n_changes))])
            out = lambda v: (w := v - q @ (q.T @ v)) - q @ (q.T @ w)
            weight = noise / shape.strength
            beta[~smooth], gap = lasso(out(hinges), out(whole), weight)
            whole = whole - hinges @ beta[~smooth]
        beta[smooth] = np.linalg.solve(r, q.T @ whole)
        used, noise = noise, max(float(np.mean((y - x @ beta) ** 2)), LEAST_NOISE)
    return {
        "n": n, "start": start, "length": length, "scale": scale, "noise": used, "gap": float(gap),
        "changes": changes.tolist(), "beta": beta.tolist(),
    }


def curve_at(model: dict, days: np.ndarray, seasons: int) -> np.ndarray:
    """The curve of ``fit_model`` at other times."""
    x = _design(np.asarray(days, float), model["start"], model["length"], np.asarray(model["changes"], float), seasons)
    return x @ np.asarray(model["beta"]) * model["scale"]


def fit_curve(days, values, future_days, strength, n_changes, seasons, penalty="laplace"):
    """Fit one series (times in days, known values only) and predict the future days."""
    return curve_at(fit_model(days, values, CurveShape(0, strength, n_changes, penalty), seasons), future_days, seasons)


MODEL = (
    "num int, _origin int, status string, n int, start double, length double, scale double, noise double, gap double, "
    "changes array<double>, beta array<double>"
)


def curve_models(
    df: DataFrame, spec: PanelSpec, origins: Sequence, shapes: Mapping[int, CurveShape], cut_hours: int = 9
) -> DataFrame:
    """One curve per shape, origin and series: (num, origin, station, measure, status, n, ..., beta).

    An origin sees readings up to ``cut_hours`` before it and ``history_days`` of the shape back from the
    latest of these. Series without two readings there get a row with the status 'few readings', others
    are 'fitted', or 'not settled' if the gap stayed above GAP; no series ends the job. ``shapes`` are numbered;
    all of them are fitted in one pass over one list per series, which is as long as the calendar
    that the origins span.
    """
    days, seasons, station = day_list(origins), spec.seasons, spec.station
    longest = max(s.history_days for s in shapes.values())

    def fits(t, v):
        for i, origin in enumerate(days):
            past = t <= origin - cut_hours / 24 + 1e-9
            latest = t[past].max() if past.any() else -np.inf
            known = past & ~np.isnan(v)
            for num, shape in shapes.items():
                seen = known & (t >= latest - shape.history_days - 1e-9)
                row = {"num": num, "_origin": int(days[i]), "status": "few readings"}
                if seen.sum() >= 2:
                    row |= fit_model(t[seen], v[seen], shape, seasons)
                    row["status"] = "fitted" if row["gap"] <= GAP else "not settled"
                yield row

    kind = dict(df.dtypes)[station]
    fields = [f.split(" ") for f in MODEL.split(", ")]
    types = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}

    def fit(batches):
        for batch in batches:
            lists = batch.column("_rows")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            cells = lists.flatten()
            t = cells.field("_t").to_numpy() / 24.0
            v = cells.field("value").to_numpy(zero_copy_only=False).astype(float)
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                rows = list(fits(t[a:b], v[a:b]))
                owner = pa.array(np.full(len(rows), k))
                columns = {c: batch.column(c).take(owner) for c in (station, "measure")}
                columns |= {name: pa.array([r.get(name) for r in rows], types[kind]) for name, kind in fields}
                yield pa.RecordBatch.from_pydict(columns)

    # The history counts back from the latest reading that the first origin sees; of stations whose
    # feeds ended at different times the earliest bounds the scan.
    cut = F.lit(str(np.datetime64(days[0], "D"))).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(cut_hours))
    latest = df.where(F.col(spec.ts) <= cut).groupBy(station).agg(F.max(spec.ts).alias("ts"))
    low = latest.agg(F.min("ts") - F.make_dt_interval(days=F.lit(longest), hours=F.lit(1))).scalar()
    high = str(np.datetime64(days[-1], "D"))
    known = df.where((F.col(spec.ts) < F.lit(high).cast("timestamp_ntz")) & F.coalesce(F.col(spec.ts) >= low, F.lit(True)))
    long = series(known, spec).select(station, "measure", hours_since_epoch(spec).alias("_t"), "value")
    rows = F.array_sort(F.collect_list(F.struct("_t", "value"))).alias("_rows")
    fitted = long.groupBy(station, "measure").agg(rows).mapInArrow(fit, f"`{station}` {kind}, measure string, {MODEL}")
    return fitted.withColumn("origin", F.date_from_unix_date("_origin")).drop("_origin")


def hours_since_epoch(spec: PanelSpec) -> Column:
    return F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(spec.ts))


def predict_curves(models: DataFrame, spec: PanelSpec, horizon: int = 48) -> DataFrame:
    """The next ``horizon`` steps after each model's origin: (num, origin, station, measure, horizon, value)."""
    seasons, keys = spec.seasons, ["num", "origin", spec.station, "measure"]

    def run(batches):
        steps = np.arange(horizon) / seasons
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                origin = part.column("origin").cast(pa.int32()).to_numpy()
                rows = part.drop_columns(keys).to_pylist()
                values = [curve_at(m, o + steps, seasons) if m["beta"] else np.full(horizon, np.nan) for m, o in zip(rows, origin)]
                owner = pa.array(np.repeat(np.arange(len(rows)), horizon))
                columns = {k: part.column(k).take(owner) for k in keys}
                columns["horizon"] = pa.array(np.tile(np.arange(horizon, dtype="int32"), len(rows)))
                columns["value"] = pa.array(np.concatenate(values), from_pandas=True)
                yield pa.RecordBatch.from_pydict(columns)

    kind = dict(models.dtypes)[spec.station]
    schema = f"num int, origin date, `{spec.station}` {kind}, measure string, horizon int, value double"
    return models.select(*keys, "start", "length", "scale", "changes", "beta").mapInArrow(run, schema)


def curve_forecast(
    df: DataFrame,
    spec: PanelSpec,
    origins: Sequence,
    history_days: int = 475,
    strength: float = 0.003,
    changepoints: int = 67,
    horizon: int = 48,
    cut_hours: int = 9,
    penalty: str = "laplace",
) -> DataFrame:
    """Forecast every series at every origin: (origin, station, measure, horizon, value); see ``curve_models``."""
    shape = CurveShape(history_days, strength, changepoints, penalty)
    return predict_curves(curve_models(df, spec, origins, {0: shape}, cut_hours), spec, horizon).drop("num")


def optimality(models: DataFrame, df: DataFrame, spec: PanelSpec, shapes: Mapping[int, CurveShape], cut_hours: int = 9) -> DataFrame:
    """How far each model is from meeting the conditions of a minimum, from the readings alone, in SQL.

    At the minimum the residuals' product with a column is its ridge weight times its coefficient; for a slope
    change under a Laplace prior it is the prior's weight with the coefficient's sign, or no more than that where
    the coefficient is 0. Result: (num, origin, station, measure, n, violation), the largest deviation per reading.
    """
    numbers = lambda f: F.element_at(F.create_map(*[F.lit(x) for n, s in shapes.items() for x in (n, f(s))]), F.col("num"))
    known = series(df, spec).select(spec.station, "measure", (hours_since_epoch(spec) / 24.0).alias("_t"), "value")
    m = models.where("status <> 'few readings'").withColumn("_end", F.unix_date("origin") - cut_hours / 24 + 1e-9)
    seen = m.join(known.where("value IS NOT NULL"), [spec.station, "measure"]).where("_t <= _end AND _t >= start - 1e-9")
    unit = (F.col("_t") - F.col("start")) / F.col("length")
    columns = [F.array(F.lit(1.0), unit), F.transform("changes", lambda c: F.greatest(unit - c, F.lit(0.0)))]
    for period, order, least in PERIODS:
        if period == 1.0 and spec.seasons == 1:
            continue
        angles = [2 * math.pi * k * F.col("_t") / period for k in range(1, order + 1)]
        waves = F.array(*[F.sin(a) for a in angles], *[F.cos(a) for a in angles])
        columns.append(F.when(F.col("length") >= least, waves).otherwise(F.array().cast("array<double>")))
    seen = seen.withColumn("_x", F.concat(*columns))
    fit = F.aggregate(F.arrays_zip("_x", "beta"), F.lit(0.0), lambda a, z: a + z["_x"] * z["beta"])
    keys = ["num", "origin", spec.station, "measure"]
    seen = seen.withColumn("_rest", F.col("value") / F.col("scale") - fit)
    parts = seen.select(*keys, "noise", "n", F.size("changes").alias("_k"), "_rest", F.posexplode(F.arrays_zip("_x", "beta")).alias("_j", "_z"))
    sums = parts.groupBy(*keys, "noise", "n", "_k", "_j", F.col("_z.beta").alias("_b")).agg(F.sum(F.col("_rest") * F.col("_z._x")).alias("_g"))
    change = (F.col("_j") >= 2) & (F.col("_j") < F.col("_k") + 2)
    width = F.when(change, numbers(lambda s: s.strength)).when(F.col("_j") < 2, TREND_WIDTH).otherwise(SEASON_WIDTH)
    normal = F.abs(F.col("_g") - F.col("noise") / (width * width) * F.col("_b"))
    weight = F.col("noise") / width
    laplace = F.when(F.col("_b") == 0, F.greatest(F.abs("_g") - weight, F.lit(0.0))).otherwise(F.abs(F.col("_g") - weight * F.signum("_b")))
    off = F.when(change & (numbers(lambda s: s.penalty) == "laplace"), laplace).otherwise(normal)
    return sums.groupBy(*keys, "n").agg((F.max(off) / F.col("n")).alias("violation"))


def trend_and_season(df: DataFrame, spec: PanelSpec, start) -> DataFrame:
    """Straight trend plus mean residual per season, in SQL alone.

    ``start`` is the zero of the trend's time axis. Result: (station, season, per measure
    ``<m>_slope``, ``<m>_intercept`` and ``<m>_season``); a step ``t`` after ``start`` forecasts
    intercept + slope*t + season.
    """
    t = F.timestamp_diff(spec.step, F.lit(start).cast("timestamp_ntz"), F.col(spec.ts)).cast("double")
    timed = df.withColumns({"_t": t, "season": spec.season()})
    lines = []
    for m in spec.measures:
        lines += [
            F.regr_slope(F.col(m), F.col("_t")).alias(f"{m}_slope"),
            F.regr_intercept(F.col(m), F.col("_t")).alias(f"{m}_intercept"),
        ]
    trends = timed.groupBy(spec.station).agg(*lines)
    fitted = timed.join(trends, spec.station)
    kept = [F.first(f"{m}_{p}").alias(f"{m}_{p}") for m in spec.measures for p in ("slope", "intercept")]
    residuals = [
        F.avg(F.col(m) - F.col(f"{m}_intercept") - F.col(f"{m}_slope") * F.col("_t")).alias(f"{m}_season")
        for m in spec.measures
    ]
    return fitted.groupBy(spec.station, "season").agg(*kept, *residuals)


def to_wide(forecast: DataFrame, spec: PanelSpec, by: Sequence[str] = ("origin",)) -> DataFrame:
    """Long forecasts (by, station, measure, horizon, value) with one column per measure."""
    cells = [F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in spec.measures]
    return forecast.groupBy(*by, spec.station, "horizon").agg(*cells)
