"""Training sets, scaling, folds and the learned forecasters."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from panelcast.operators import curve as C, features as X, net as N, pooled as P, score as S
from panelcast.operators.impute import impute
from panelcast.plans import experiments as E
from panelcast.plans.backtest import backtest
from panelcast.session import write_and_read
from registry.forecasting import summary_cte
from registry.panels import (
    DAILY, HOURLY, SQL_PANEL_D, SQL_PANEL_H, SQL_PANEL_S, T, panel_d, panel_h, panel_s, r, read, rounded, sql,
)

M = ("m1", "m2", "m3")
SPLIT = "2024-01-26"
HISTORY = 3
WINDOWS = [3, 5]
SHIFTS = 4


def _day(df):
    return df.withColumn("split", F.date_from_unix_date("split_day").cast("string")).drop("split_day")


def _unfold(df, **arrays):
    """Arrays as rows (part, pos, value), so that each cell can be compared."""
    frames = [
        df.select("station", "measure", "split", F.lit(name).alias("part"), F.posexplode(column).alias("pos", "value"))
        for name, column in arrays.items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return rounded(out, "value")


def history_label_split(spark, sf):
    return _unfold(_day(X.history_label_split(panel_h(spark, sf), HOURLY, [SPLIT], HISTORY)), x="x", y="y")


def shifted_training_set(spark, sf):
    splits = X.shifted_splits(SPLIT, SHIFTS)
    return _unfold(_day(X.history_label_split(panel_h(spark, sf), HOURLY, splits, HISTORY)), x="x", y="y")


def supervised_medians(spark, sf):
    """The median arrays of the full training set, two shifts, every split."""
    splits = X.shifted_splits(SPLIT, SHIFTS)
    rows = X.supervised(panel_h(spark, sf), HOURLY, splits, HISTORY, WINDOWS, median_shifts=2)
    return _unfold(_day(rows), med="med")


def indicators(spark, sf):
    rows = X.supervised(
        panel_h(spark, sf), HOURLY, [SPLIT], HISTORY, WINDOWS, group=F.col("station").isin("click", "view")
    )
    return _day(rows).select("station", "measure", "split", "is_m1", "is_m2", "is_m3", "is_group")


def standardize(spark, sf):
    return rounded(X.standardize(panel_h(spark, sf), HOURLY)[0], *M)


def scaler_table(spark, sf):
    scalers = X.standardize(panel_s(spark, sf), DAILY)[1]
    return rounded(scalers, *[c for c in scalers.columns if c != "station"])


def scaler_inverse(spark, sf):
    scaled, scalers = X.standardize(panel_h(spark, sf), HOURLY)
    return rounded(X.inverse(scaled, scalers, HOURLY), *M)


def group_kfold(spark, sf):
    """Five folds of the suppliers by their line items."""
    items = read(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("station"))
    return X.group_folds(items, "station", 5)


def fold_ensemble(spark, sf):
    """Mean of per-fold forecasts, each the station medians of the other folds' days."""
    fold = F.pmod(DAILY.day(), F.lit(5))
    medians = [F.median(F.when(fold != f, F.col(m))).alias(f"{m}_{f}") for f in range(5) for m in M]
    base = panel_s(spark, sf)
    known = base.where(" OR ".join(f"{m} IS NOT NULL" for m in M)).groupBy("station").agg(*medians)
    # All folds in one pass, stored, so that the panel is not built again per fold.
    stored = write_and_read(base.select("station").distinct().join(known, "station", "left"), "medians")
    per_fold = [stored.select("station", *[F.col(f"{m}_{f}").alias(m) for m in M]) for f in range(5)]
    return rounded(P.ensemble(per_fold, ["station"], M), *M)


def fold_score_spread(spark, sf):
    """Mean and deviation of the folds' scores of the previous value as forecast."""
    base = write_and_read(panel_s(spark, sf).where("m1 IS NOT NULL").select("station", "ts", "m1"), "known")
    folds = X.group_folds(base, "station", 5)
    before = base.select("station", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.col("m1").alias("p"))
    pairs = base.join(before.hint("merge"), ["station", "ts"]).join(folds, "station")
    scores = pairs.groupBy("fold").agg(S.smape_official(F.col("m1"), F.col("p")).alias("score"))
    return rounded(P.fold_spread(scores), "mean", "std", "least")


def holidays(spark, sf):
    """The orders panel on the dates of a yearly calendar."""
    years = range(1995, 2002)
    kinds = {"new_year": [f"{y}-01-{d:02d}" for y in years for d in (1, 2)],
             "labor_day": [f"{y}-05-{d:02d}" for y in years for d in (1, 2, 3)]}
    days = X.calendar(spark, kinds)
    return rounded(X.with_calendar(panel_d(spark, sf), DAILY, days).where("holiday IS NOT NULL"), *M)


def trend_season_linear(spark, sf):
    out = C.trend_and_season(panel_h(spark, sf), HOURLY, "2024-01-01")
    return rounded(out, *[c for c in out.columns if c not in ("station", "season")])


def curve_forecast(spark, sf):
    """Two days ahead of three origins per series, slope changes under a Laplace prior."""
    filled = impute(panel_h(spark, sf), HOURLY, ["neighbors"], max_missing=3, before="2024-01-24")
    out = C.curve_forecast(filled, HOURLY, ["2024-01-24", "2024-01-25", "2024-01-26"], 20, 0.05, 13)
    return rounded(C.to_wide(out, HOURLY), *M)


def curve_ridge(spark, sf):
    """The smooth variant over the daily supplier panel."""
    out = C.curve_forecast(
        panel_s(spark, sf), DAILY, ["2001-06-01"], 475, 0.05, 25, horizon=2, penalty="ridge"
    )
    return rounded(C.to_wide(out, DAILY), *M)


def _imputed(spark, sf):
    return impute(panel_h(spark, sf), HOURLY, ["neighbors", "season", "mean"], max_missing=3, before=SPLIT)


CURVES = {1: C.CurveShape(20, 0.05, 13), 2: C.CurveShape(20, 0.003, 67), 3: C.CurveShape(12, 0.5, 25), 4: C.CurveShape(20, 0.05, 25, "ridge")}
CURVE_ORIGINS = ["2024-01-24", "2024-01-26"]


def curve_conditions(spark, sf):
    """Every model of four shapes against the conditions of its minimum."""
    base = write_and_read(panel_h(spark, sf), "panel")
    models = write_and_read(C.curve_models(base, HOURLY, CURVE_ORIGINS, CURVES), "models")
    return rounded(C.optimality(models, base, HOURLY, CURVES), "violation", places=5)


def curve_backtest(spark, sf):
    """Curves of three origins, scored against the raw panel."""
    base = write_and_read(panel_h(spark, sf), "panel")
    origins = ["2024-01-24", "2024-01-25", "2024-01-26"]
    filled = impute(base, HOURLY, ["neighbors"], max_missing=3, before=origins[0])
    curves = C.to_wide(C.curve_forecast(filled, HOURLY, origins, 20, 0.05, 13), HOURLY)
    return rounded(backtest(curves, base, HOURLY, origins), "score")


def curve_settings_board(spark, sf):
    """Mean scores of all 72 curve settings, one pass per city."""
    base = panel_h(spark, sf)
    panels = {"beijing": base.where("station < 'p'"), "london": base.where("station >= 'p'")}
    scores = E.run_curves(panels, HOURLY, E.curve_settings(), ["2024-01-25", "2024-01-26"], {"beijing": 2, "london": 2})
    return rounded(scores.groupBy("num").agg(F.avg("score").alias("score")), "score")


def pooled_forecast(spark, sf):
    """Ensemble of five grouped-fold models over all series, two days ahead."""
    forecast, _ = P.pooled_panel_forecast(
        _imputed(spark, sf), HOURLY, SPLIT, X.shifted_splits("2024-01-23", SHIFTS), HISTORY, WINDOWS, k=5
    )
    return rounded(C.to_wide(_as_forecast(forecast), HOURLY), *M)


def pooled_fold_scores(spark, sf):
    _, scores = P.pooled_panel_forecast(
        _imputed(spark, sf), HOURLY, SPLIT, X.shifted_splits("2024-01-23", SHIFTS), HISTORY, WINDOWS, k=5
    )
    return rounded(scores, "score")


def _as_forecast(df):
    """A split's horizon 0 is the day after it."""
    return df.withColumn("origin", F.date_from_unix_date(F.col("split_day") + 1))


NET = N.NetSetting(units=(24, 24, 24, 24), batch_rows=22, patience=6, slow_after=3)


def pooled_net(spark, sf):
    """The shortcut net, five folds trained until held-out losses stop falling, forecasting two days ahead."""
    base = write_and_read(_imputed(spark, sf), "panel")
    rows = write_and_read(X.supervised(base, HOURLY, X.shifted_splits("2024-01-23", SHIFTS), HISTORY, WINDOWS), "rows")
    train = write_and_read(rows.join(X.group_folds(rows, "station", 5), "station"), "training")
    net = N.train_net(train, HOURLY, NET, k=5)
    test = X.supervised(base, HOURLY, [SPLIT], HISTORY, WINDOWS, labels=False)
    return rounded(C.to_wide(_as_forecast(N.net_forecast(net, test, HOURLY)), HOURLY), *M)


def neighbor_gbt_impute(spark, sf):
    """Gated cells filled by one boosted model per measure."""
    base = panel_h(spark, sf)
    models = P.fit_neighbor_trees(base, HOURLY, maxIter=3, maxDepth=3)
    return rounded(P.fill_from_trees(base, HOURLY, models, max_missing=3), *M)


QUERIES = {
    f.__name__: f
    for f in (
        history_label_split, shifted_training_set, supervised_medians, indicators, standardize, scaler_table,
        scaler_inverse, group_kfold, fold_ensemble, fold_score_spread, holidays, trend_season_linear, curve_forecast,
        curve_ridge, curve_conditions, curve_backtest, curve_settings_board, pooled_forecast, pooled_fold_scores, pooled_net, neighbor_gbt_impute,
    )
}


# --- SQL ----------------------------------------------------------------------------------------

SQL_SERIES = """
series AS (
  SELECT station, ts, 'm1' AS measure, m1 AS value FROM panel_h
  UNION ALL SELECT station, ts, 'm2', m2 FROM panel_h
  UNION ALL SELECT station, ts, 'm3', m3 FROM panel_h WHERE station <> 'error'
)"""

SPLITS = [(date.fromisoformat(SPLIT) - timedelta(days=i)).isoformat() for i in range(SHIFTS)]


def _splits(days):
    values = ", ".join(f"('{d}')" for d in days)
    return sql(
        SQL_PANEL_H,
        SQL_SERIES,
        select=f"""
        SELECT station, measure, split, 'x' AS part,
          datediff('hour', CAST(split AS DATE) - {HISTORY}, ts) AS pos, round(value, 6) AS value
        FROM (VALUES {values}) s(split) JOIN series
          ON ts >= CAST(split AS DATE) - {HISTORY} AND ts < CAST(split AS DATE)
        UNION ALL
        SELECT station, measure, split, 'y', datediff('hour', CAST(split AS DATE) + 1, ts), round(value, 6)
        FROM (VALUES {values}) s(split) JOIN series
          ON ts >= CAST(split AS DATE) + 1 AND ts < CAST(split AS DATE) + 3""",
    )


_TARGETS = sorted({(date.fromisoformat(d) - timedelta(days=k)).isoformat() for d in SPLITS for k in (0, 1)})
_SCALERS = ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in M)
_FOLDS = """
sizes AS ({source}),
dealt AS (SELECT station, size, row_number() OVER (ORDER BY size DESC, substr(md5(station), 1, 3), station) AS n FROM sizes),
walk(n, station, fold, loads) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, 0::INT, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL
  SELECT d.n, d.station, list_position(loads, list_min(loads))::INT - 1,
    list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN d.size ELSE 0 END)
  FROM walk w JOIN dealt d ON d.n = w.n + 1
),
folds AS (SELECT station, fold FROM walk WHERE n > 0)"""
_FIT = ", ".join(
    f"regr_slope({m}, t) AS {m}_slope, regr_intercept({m}, t) AS {m}_intercept" for m in M
)

SQL = {
    "history_label_split": _splits([SPLIT]),
    "shifted_training_set": _splits(SPLITS),
    "supervised_medians": sql(
        SQL_PANEL_H,
        summary_cte("summaries", "panel_h", _TARGETS, WINDOWS, extra=0, gap=1),
        """
cells AS (
  SELECT station, target, season, "window", 'm1' AS measure, m1 AS value FROM summaries
  UNION ALL SELECT station, target, season, "window", 'm2', m2 FROM summaries
  UNION ALL SELECT station, target, season, "window", 'm3', m3 FROM summaries WHERE station <> 'error')""",
        select=f"""
        SELECT station, measure, split, 'med' AS part,
          row_number() OVER (PARTITION BY station, measure, split ORDER BY k, "window", season) - 1 AS pos,
          round(value, 6) AS value
        FROM (VALUES {', '.join(f"('{d}')" for d in SPLITS)}) s(split) CROSS JOIN (VALUES (0), (1)) k(k)
        JOIN cells ON CAST(target AS DATE) = CAST(split AS DATE) - k""",
    ),
    "indicators": sql(
        SQL_PANEL_H,
        SQL_SERIES,
        select=f"""SELECT DISTINCT station, measure, '{SPLIT}' AS split, CAST(measure = 'm1' AS INT) AS is_m1,
        CAST(measure = 'm2' AS INT) AS is_m2, CAST(measure = 'm3' AS INT) AS is_m3,
        CAST(station IN ('click', 'view') AS INT) AS is_group FROM series""",
    ),
    "standardize": sql(
        SQL_PANEL_H,
        select=f"SELECT station, {T}, "
        + ", ".join(
            f"round(({m} - avg({m}) OVER s) / nullif(stddev_pop({m}) OVER s, 0), 6) AS {m}" for m in M
        )
        + " FROM panel_h WINDOW s AS (PARTITION BY station)",
    ),
    "scaler_table": sql(
        SQL_PANEL_S,
        f"\nscalers AS (SELECT station, {_SCALERS} FROM panel_s GROUP BY 1)",
        select=f"SELECT station, {r(*[f'{m}_{p}' for m in M for p in ('mean', 'std')])} FROM scalers",
    ),
    "scaler_inverse": sql(SQL_PANEL_H, select=f"SELECT station, {T}, {r(*M)} FROM panel_h"),
    "group_kfold": sql(
        _FOLDS.format(source="SELECT l_suppkey::VARCHAR AS station, count(*) AS size FROM lineitem GROUP BY 1"),
        select="SELECT station, fold FROM folds",
    ),
    "fold_ensemble": sql(
        SQL_PANEL_S,
        f"""
per_fold AS (
  SELECT station, f.f, {', '.join(f'median({m}) AS {m}' for m in M)}
  FROM panel_s CROSS JOIN (SELECT unnest(range(5)) AS f) f
  WHERE datediff('day', DATE '1970-01-01', ts) % 5 <> f.f GROUP BY 1, 2
)""",
        select="SELECT station, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in M) + " FROM per_fold GROUP BY 1",
    ),
    "fold_score_spread": sql(
        SQL_PANEL_S,
        _FOLDS.format(source="SELECT station, count(m1) AS size FROM panel_s WHERE m1 IS NOT NULL GROUP BY 1"),
        """
scores AS (
  SELECT fold, 2 * avg(abs(a.m1 - p.m1) / nullif(a.m1 + p.m1, 0)) AS score
  FROM panel_s a JOIN panel_s p ON p.station = a.station AND p.ts = a.ts - INTERVAL 1 DAY
  JOIN folds ON folds.station = a.station WHERE a.m1 IS NOT NULL AND p.m1 IS NOT NULL GROUP BY 1
)""",
        select="""SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS least
        FROM scores""",
    ),
    "trend_season_linear": sql(
        SQL_PANEL_H,
        "\ntimed AS (SELECT *, datediff('hour', TIMESTAMP '2024-01-01', ts) AS t FROM panel_h)",
        f"\nlines AS (SELECT station, {_FIT} FROM timed GROUP BY 1)",
        select="SELECT station, hour(ts) AS season, "
        + ", ".join(
            f"round(first({m}_slope), 6) AS {m}_slope, round(first({m}_intercept), 6) AS {m}_intercept, "
            f"round(avg({m} - {m}_intercept - {m}_slope * t), 6) AS {m}_season"
            for m in M
        )
        + " FROM timed JOIN lines USING (station) GROUP BY 1, 2",
    ),
    "curve_conditions": sql(
        SQL_PANEL_H,
        SQL_SERIES,
        select=f"""SELECT num::INT AS num, CAST(origin AS VARCHAR) AS origin, station, measure, count(value)::INT AS n, 0.0::DOUBLE AS violation
        FROM (VALUES {', '.join(f"({n}, {c.history_days})" for n, c in CURVES.items())}) c(num, days)
        CROSS JOIN (VALUES {', '.join(f"(DATE '{d}')" for d in CURVE_ORIGINS)}) o(origin)
        JOIN series ON ts <= origin - INTERVAL 9 HOUR AND ts >= origin - INTERVAL 9 HOUR - INTERVAL 1 DAY * days
        GROUP BY 1, 2, 3, 4 HAVING count(value) >= 2""",
    ),
    "holidays": sql(
        SQL_PANEL_D,
        select=f"""SELECT station, ts::VARCHAR AS ts, {r(*M)},
    CASE WHEN month(ts) = 1 THEN 'new_year' ELSE 'labor_day' END AS holiday
    FROM panel_d WHERE year(ts) BETWEEN 1995 AND 2001 AND
      ((month(panel_d.ts) = 1 AND day(panel_d.ts) <= 2) OR (month(panel_d.ts) = 5 AND day(panel_d.ts) <= 3))""",
    ),
}
