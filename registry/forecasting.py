"""Rolling summaries, median of medians, truth, scores and backtests."""

from __future__ import annotations

import math
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelcast.fixed import FIB_WINDOWS, GOLDEN_WINDOWS, WINDOW_FAMILIES, window_family
from panelcast.operators import score as S, seasonal as R
from panelcast.operators.quantiles import exact_quantiles
from panelcast.plans import backtest as B, experiments as E
from panelcast.session import shared_folder, write_and_read
from registry.imputing import GATE, SQL_LINES, SQL_NEIGHBORS, SQL_VIEWED, fill_cte
from registry.panels import (
    DAILY, HOURLY, ORIGIN_D, ORIGIN_H, ORIGINS_H, SQL_PANEL_H, SQL_PANEL_S, SQL_PANEL_W, T, WIDE, WINDOWS_H,
    panel_h, panel_s, panel_w, r, read, rounded, sql,
)

M = ("m1", "m2", "m3")
TARGETS_H = ["2024-01-26", "2024-01-27"]
ORIGINS_D = [f"2001-{m:02d}-{d:02d}" for m in (3, 4, 5) for d in (1, 8, 15, 22)]


def _texts(days) -> str:
    return ", ".join(f"('{d}')" for d in days)


# --- rolling summaries --------------------------------------------------------------------------


def seasonal_median(spark, sf):
    base = panel_h(spark, sf).groupBy("station", F.hour("ts").alias("hour"))
    return rounded(base.agg(*[F.median(m).alias(m) for m in M]), *M)


def seasonal_mean(spark, sf):
    base = panel_h(spark, sf).groupBy("station", F.hour("ts").alias("hour"))
    return rounded(base.agg(*[F.avg(m).alias(m) for m in M]), *M)


def pivot_hour_medians(spark, sf):
    hours = panel_h(spark, sf).withColumn("hour", F.hour("ts"))
    wide = hours.groupBy("station").pivot("hour", list(range(24))).agg(F.median("m1"))
    return rounded(wide.toDF("station", *[f"h{i}" for i in range(24)]), *[f"h{i}" for i in range(24)])


def _windowed(df, spec, targets, windows, **kw):
    out = R.window_summaries(df, spec, targets, windows, **kw)
    return out.withColumn("target", F.date_from_unix_date("target_day").cast("string")).drop("target_day")


def rolling_summary_anchored(spark, sf):
    return rounded(_windowed(panel_h(spark, sf), HOURLY, TARGETS_H, WINDOWS_H).drop("method"), *M)


def rolling_summary_mean(spark, sf):
    out = _windowed(panel_h(spark, sf), HOURLY, TARGETS_H, WINDOWS_H, methods=["mean"])
    return rounded(out.drop("method"), *M)


def rolling_summary_frame(spark, sf):
    out = R.rolling_seasonal_summary(panel_h(spark, sf), HOURLY, WINDOWS_H).drop(*M)
    return rounded(out, *[c for c in out.columns if c not in HOURLY.keys])


def rolling_summary_imputed(spark, sf):
    """Day fill, then the station mean of each window, then the medians."""
    filled = R.fill_within(panel_h(spark, sf), HOURLY, by="day")
    return rounded(_windowed(filled, HOURLY, TARGETS_H, WINDOWS_H, window_mean=True).drop("method"), *M)


def rolling_summary_golden(spark, sf):
    """Eight long windows over every supplier's daily history."""
    return rounded(_windowed(panel_s(spark, sf), DAILY, [ORIGIN_D], GOLDEN_WINDOWS).drop("method", "season"), *M)


def rolling_summary_hourly(spark, sf):
    """Eight long windows for two target days over every hour of the 35 grouped stations."""
    out = _windowed(panel_w(spark, sf), WIDE, ["2001-06-01", "2001-06-02"], GOLDEN_WINDOWS)
    return rounded(out.drop("method"), *M)


def median_of_medians_hourly(spark, sf):
    """Forty-eight hours ahead of 47 successive origins, 35 stations, eight windows."""
    origins = [R.day_number("2001-06-01") - i for i in range(47)]
    out = R.median_of_medians(panel_w(spark, sf), WIDE, origins, {"golden_8": GOLDEN_WINDOWS})
    return rounded(out.drop("method", "family"), *M)


def median_features(spark, sf):
    out = R.median_features(panel_h(spark, sf), HOURLY, [ORIGIN_H], WINDOWS_H)
    return rounded(out.drop("target_day"), *M)


def median_features_shifted(spark, sf):
    """The same features at two successive earlier days."""
    out = R.median_features(panel_h(spark, sf), HOURLY, ["2024-01-26", "2024-01-25"], WINDOWS_H)
    shift = (F.lit(R.day_number("2024-01-26")) - F.col("target_day")).alias("shift")
    return rounded(out.select("station", shift, "season", "window", *M), *M)


# --- forecasts ----------------------------------------------------------------------------------


def median_of_medians(spark, sf):
    """Forty-eight hours ahead of one origin on the whole grid, clipped at 0."""
    base = panel_h(spark, sf)
    forecast = R.median_of_medians(base, HOURLY, [ORIGIN_H], {"all": WINDOWS_H})
    return rounded(B.on_grid(forecast, base, HOURLY, ORIGIN_H), *M, places=8)


def median_of_medians_imputed(spark, sf):
    base = panel_h(spark, sf)
    forecast = R.median_of_medians(base, HOURLY, [ORIGIN_H], {"all": WINDOWS_H}, methods=["mean"], fill="day+mean")
    return rounded(B.on_grid(forecast, base, HOURLY, ORIGIN_H), *M, places=8)


def median_of_medians_daily(spark, sf):
    """Two days ahead of twelve origins for every supplier, two window families."""
    families = {"golden_8": GOLDEN_WINDOWS, "fib_9": FIB_WINDOWS}
    out = R.median_of_medians(panel_s(spark, sf), DAILY, ORIGINS_D, families)
    return rounded(out.drop("method"), *M)


def forecast_grid(spark, sf):
    return R.forecast_grid(panel_h(spark, sf), HOURLY)


# --- truth and scores ---------------------------------------------------------------------------


def truth_complete(spark, sf):
    return rounded(S.truth(panel_h(spark, sf), HOURLY, ORIGINS_H, gap_days=1, complete=True), *M)


def _naive_pairs(spark, sf):
    """Each cell against the same hour a day earlier."""
    base = panel_h(spark, sf)
    before = base.select("station", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), *M)
    return base, before


def _naive_score(spark, sf, metric):
    actual, predicted = _naive_pairs(spark, sf)
    scores = S.score_grid(actual, predicted, HOURLY, by=[], on=HOURLY.keys, metric=metric)
    return rounded(scores, "score")


def smape_official(spark, sf):
    """The day before as forecast, on rows where it is known."""
    actual, predicted = _naive_pairs(spark, sf)
    known = predicted.where("m1 IS NOT NULL")
    paired = actual.join(known.select("station", "ts"), HOURLY.keys, "left_semi")
    scores = S.score_grid(paired, known, HOURLY, by=[], on=HOURLY.keys)
    return rounded(scores, "score")


def smape_missing_forecast(spark, sf):
    return _naive_score(spark, sf, "smape")


def smape_skipna(spark, sf):
    return _naive_score(spark, sf, "smape_skip_missing")


def smape_loss(spark, sf):
    return _naive_score(spark, sf, "smape_loss")


def mae_clipped(spark, sf):
    actual, predicted = _naive_pairs(spark, sf)
    pairs = actual.join(predicted.withColumnsRenamed({m: f"p_{m}" for m in M}), HOURLY.keys)
    errors = pairs.groupBy("station").agg(
        *[S.mae(F.col(m), F.col(f"p_{m}"), clip=50.0).alias(m) for m in M]
    )
    return rounded(errors, *M)


def _scores(spark, sf, align="target", origins=ORIGINS_H, **kw):
    base = panel_h(spark, sf)
    return B.backtest_medians(base, base, HOURLY, origins, {"all": WINDOWS_H}, align=align, **kw)


def backtest_rolling(spark, sf):
    return rounded(_scores(spark, sf).select("origin", "station", "measure", "score"), "score")


def backtest_legacy_align(spark, sf):
    scores = _scores(spark, sf, "legacy", complete=True)
    return rounded(scores.select("origin", "station", "measure", "score"), "score")


def score_grid(spark, sf):
    """One origin; the cells of one station are masked."""
    scores = _scores(spark, sf, origins=[ORIGIN_H], ignore_stations=["view"])
    return rounded(scores.select("station", "measure", "score"), "score")


def daily_score(spark, sf):
    return rounded(S.mean_scores(_scores(spark, sf)), "score")


def overall_score(spark, sf):
    return rounded(S.mean_scores(S.mean_scores(_scores(spark, sf)), by=[]), "score")


CELLS = ["click-m1", "click-m2", "click-m3", "view-m1"]


def score_wide(spark, sf):
    wide = S.wide_scores(_scores(spark, sf), HOURLY, CELLS)
    return rounded(wide, "smape", *CELLS)


def bootstrap_score(spark, sf):
    """Twenty replicates of five of the ten scored days."""
    daily = S.mean_scores(_scores(spark, sf)).withColumn("origin", F.col("origin").cast("string"))
    return rounded(S.bootstrap(daily, reps=20, days=5, seed=7), "score")


def bootstrap_interval(spark, sf):
    """All windows against the shortest two over the scored days: the difference, and 200 replicates' interval."""
    base = write_and_read(panel_h(spark, sf), "panel")
    scores = B.backtest_medians(base, base, HOURLY, ORIGINS_H, {"all": WINDOWS_H, "short": WINDOWS_H[:2]})
    daily = S.mean_scores(scores, ["family", "origin"]).withColumn("origin", F.col("origin").cast("string"))
    return rounded(S.bootstrap_difference(daily, "family", "all", "short", 200, seed=3), "difference", "low", "high")


def exact_event_quantiles(spark, sf):
    """Quantiles of every raw event's value per type, by histograms of at most 64 bins."""
    out = exact_quantiles(read(spark, sf, "events"), ["event_type"], "value", [0.1, 0.5, 0.9], bins=64, few=200)
    return rounded(out, "value")


def score_table_merge(spark, sf):
    """Two runs over overlapping dates; equal rows count once."""
    scores = write_and_read(S.mean_scores(_scores(spark, sf)), "scores")
    early, late = scores.where("origin <= '2024-01-24'"), scores.where("origin >= '2024-01-20'")
    return rounded(S.merge_scores(early, late), "score")


def settings_leaderboard(spark, sf):
    """Every family, summary and fill on the daily supplier panel, ranked."""
    return rounded(B.settings_board(panel_s(spark, sf), DAILY, ORIGINS_D, WINDOW_FAMILIES), "score")


def best_setting(spark, sf):
    board = B.settings_board(panel_s(spark, sf), DAILY, ORIGINS_D, WINDOW_FAMILIES)
    return rounded(S.best_setting(board, ["family", "method", "fill"]), "score")


CITY_GATE = 20  # missing suppliers of fifty


def settings_grid(spark, sf):
    """All 160 settings: two cities, learned fill, in-window fill, summary and family, mean daily score."""
    base = panel_s(spark, sf)
    even = F.col("station").cast("int") % 2 == 0
    panels = {"beijing": base.where(even), "london": base.where(~even)}
    settings = E.medians_settings()
    daily = write_and_read(E.run_medians(panels, DAILY, settings, ORIGINS_D, dict.fromkeys(panels, CITY_GATE)), "daily")
    boards = []
    for city in panels:  # an origin that only the other city scores counts
        own = [s for s in settings if s.city == city]
        boards.append(E.record(daily.where(F.col("num").isin([s.num for s in own])), own, shared_folder(spark, "experiment")))
    return rounded(reduce(DataFrame.unionByName, boards).join(E.settings_table(spark, settings), "num"), "score")


QUERIES = {
    f.__name__: f
    for f in (
        seasonal_median, seasonal_mean, pivot_hour_medians, rolling_summary_anchored, rolling_summary_mean,
        rolling_summary_frame, rolling_summary_imputed, rolling_summary_golden, rolling_summary_hourly,
        median_of_medians_hourly, median_features,
        median_features_shifted, median_of_medians, median_of_medians_imputed, median_of_medians_daily, forecast_grid,
        truth_complete, smape_official, smape_missing_forecast, smape_skipna, smape_loss, mae_clipped,
        backtest_rolling, backtest_legacy_align, score_grid, daily_score, overall_score, score_wide, bootstrap_score,
        bootstrap_interval, exact_event_quantiles,
        score_table_merge, settings_leaderboard, settings_grid, best_setting,
    )
}


# --- SQL ----------------------------------------------------------------------------------------


def summary_cte(name, source, targets, windows, call="quantile_cont({m}, 0.5)", season="hour(ts)", extra=1, gap=3):
    """SQL of the windowed summaries: (station, target, season, window, measures)."""
    ws = ", ".join(f"({w})" for w in windows)
    cells = ", ".join(f"{call.format(m=m)} AS {m}" for m in M)
    return f"""
{name} AS (
  SELECT station, t.target, {season} AS season, w."window", {cells}
  FROM (VALUES {_texts(targets)}) t(target) CROSS JOIN (VALUES {ws}) w("window")
  JOIN {source} ON CAST(ts AS DATE) BETWEEN CAST(t.target AS DATE) - (w."window" + {extra})
                                        AND CAST(t.target AS DATE) - {gap}
  GROUP BY 1, 2, 3, 4
)"""


def imputed_summary_cte(name, source, targets, windows, call="quantile_cont({m}, 0.5)"):
    """The same with each window's station mean in its missing cells."""
    ws = ", ".join(f"({w})" for w in windows)
    cells = ", ".join(f"{call.format(m=m)} AS {m}" for m in M)
    means = ", ".join(
        f'coalesce({m}, avg({m}) OVER (PARTITION BY station, t.target, w."window")) AS {m}' for m in M
    )
    return f"""
{name}_cells AS (
  SELECT station, ts, t.target, w."window", {means}
  FROM (VALUES {_texts(targets)}) t(target) CROSS JOIN (VALUES {ws}) w("window")
  JOIN {source} ON CAST(ts AS DATE) BETWEEN CAST(t.target AS DATE) - (w."window" + 1) AND CAST(t.target AS DATE) - 3
),
{name} AS (
  SELECT station, target, hour(ts) AS season, "window", {cells} FROM {name}_cells GROUP BY 1, 2, 3, 4
)"""


def forecast_cte(name, summaries, origins, steps=24, families=None, label="'all'"):
    """SQL of the median over windows per origin and horizon."""
    cells = ", ".join(f"median({m}) AS {m}" for m in M)
    return f"""
{name} AS (
  SELECT o.origin, s.station, l.lead * {steps} + s.season AS horizon, {cells}
  FROM (VALUES {_texts(origins)}) o(origin) CROSS JOIN (VALUES (0), (1)) l(lead)
  JOIN {summaries} s ON CAST(s.target AS DATE) = CAST(o.origin AS DATE) + l.lead
  GROUP BY 1, 2, 3
)"""


def truth_cte(name, origins, gap):
    return f"""
{name} AS (
  SELECT o.origin, station, datediff('hour', CAST(o.origin AS DATE) + {gap}, ts) AS horizon, m1, m2,
         CASE WHEN station <> 'error' THEN m3 END AS m3, m3 AS raw3
  FROM (VALUES {_texts(origins)}) o(origin)
  JOIN panel_h ON ts >= CAST(o.origin AS DATE) + {gap} AND ts < CAST(o.origin AS DATE) + {gap + 2}
)"""


def _official(a, p):
    return f"""CASE WHEN count(*) FILTER (WHERE {a} IS NOT NULL AND {p} IS NULL) = 0
      THEN 2 * avg(CASE WHEN {a} + {p} = 0 THEN 0 ELSE abs({a} - {p}) / ({a} + {p}) END) END"""


def scores_cte(name, truth, forecast, metric=_official, where="TRUE"):
    """SQL of the score grid in long form."""
    parts = [
        f"""SELECT t.origin, t.station, '{m}' AS measure, {metric('t.' + m, 'f.' + m)} AS score
    FROM {truth} t LEFT JOIN {forecast} f USING (origin, station, horizon)
    WHERE {where} {"AND t.station <> 'error'" if m == 'm3' else ''} GROUP BY 1, 2"""
        for m in M
    ]
    return f"\n{name} AS (" + "\n  UNION ALL ".join(parts) + ")"


def _days_before(last, n):
    return [(date.fromisoformat(last) - timedelta(days=i)).isoformat() for i in range(n)]


def _next_days(origins):
    days = {date.fromisoformat(o) + timedelta(days=k) for o in origins for k in (0, 1)}
    return sorted(d.isoformat() for d in days)


def _backtest(select, gap=0, where="TRUE", origins=ORIGINS_H):
    return sql(
        SQL_PANEL_H,
        summary_cte("summaries", "panel_h", _next_days(origins), WINDOWS_H),
        forecast_cte("forecast", "summaries", origins),
        truth_cte("truth", origins, gap),
        scores_cte("scores", "truth", "forecast", where=where),
        select=select,
    )


def _naive(metric, join="LEFT JOIN", extra=""):
    parts = [
        f"""SELECT a.station, '{m}' AS measure, round({metric('a.' + m, 'p.' + m)}, 6) AS score
        FROM panel_h a {join} panel_h p ON p.station = a.station AND p.ts = a.ts - INTERVAL 1 DAY {extra}
        {"WHERE a.station <> 'error'" if m == 'm3' else ''} GROUP BY 1"""
        for m in M
    ]
    return sql(SQL_PANEL_H, select=" UNION ALL ".join(parts))


def _settings(families, fills, select, prefix=(SQL_PANEL_S,), train="panel_s", raw="panel_s", origins=ORIGINS_D, ranked=True):
    """Long SQL: summaries for all windows, family medians, scores per setting."""
    members = ", ".join(f"('{f}', {w})" for f in families for w in window_family(f))
    windows = sorted({w for f in families for w in window_family(f)})
    targets = _next_days(origins)
    ws = ", ".join(f"({w})" for w in windows)
    both = []
    for fill in fills:
        for method, call in (("median", "quantile_cont({m}, 0.5)"), ("mean", "avg({m})")):
            cells = ", ".join(f"{call.format(m=m)} AS {m}" for m in M)
            both.append(
                f"SELECT '{fill}' AS fill, '{method}' AS method, station, target, \"window\", {cells} "
                f"FROM cells_{'raw' if fill == 'none' else 'mean'} GROUP BY station, target, \"window\""
            )
    means = ", ".join(f'coalesce({m}, avg({m}) OVER (PARTITION BY station, target, "window")) AS {m}' for m in M)
    parts = [
        f"""SELECT f.fill, f.method, f.family, t.origin, t.station, '{m}' AS measure, {_official('t.' + m, 'f.' + m)} AS score
    FROM truth t JOIN forecast f USING (origin, station, horizon) GROUP BY 1, 2, 3, 4, 5"""
        for m in M
    ]
    return sql(
        *prefix,
        f"""
cells_raw AS MATERIALIZED (
  SELECT station, t.target, w."window", m1, m2, m3
  FROM (VALUES {_texts(targets)}) t(target) CROSS JOIN (VALUES {ws}) w("window")
  JOIN {train} ON CAST(ts AS DATE) BETWEEN CAST(t.target AS DATE) - (w."window" + 1) AND CAST(t.target AS DATE) - 3
)""",
        f'\ncells_mean AS MATERIALIZED (SELECT station, target, "window", {means} FROM cells_raw)',
        "\nsummaries AS MATERIALIZED (" + " UNION ALL ".join(both) + ")",
        f"""
forecast AS MATERIALIZED (
  SELECT s.fill, s.method, m.family, o.origin, s.station, l.lead AS horizon,
         {', '.join(f'median(s.{m}) AS {m}' for m in M)}
  FROM (VALUES {_texts(origins)}) o(origin) CROSS JOIN (VALUES (0), (1)) l(lead)
  JOIN summaries s ON CAST(s.target AS DATE) = CAST(o.origin AS DATE) + l.lead
  JOIN (VALUES {members}) m(family, "window") ON m."window" = s."window"
  GROUP BY 1, 2, 3, 4, 5, 6
)""",
        f"""
truth AS (
  SELECT o.origin, station, datediff('day', CAST(o.origin AS DATE), ts) AS horizon, m1, m2, m3
  FROM (VALUES {_texts(origins)}) o(origin)
  JOIN {raw} ON ts >= CAST(o.origin AS DATE) AND ts < CAST(o.origin AS DATE) + 2
)""",
        "\nscores AS (" + " UNION ALL ".join(parts) + ")",
        """
common AS (
  SELECT origin, station, measure FROM scores WHERE score IS NOT NULL GROUP BY 1, 2, 3
  HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT fill, method, family FROM scores))
)""",
        f"""
daily AS (
  SELECT fill, method, family, origin, avg(score) AS score, count(score) AS cells
  FROM scores {"SEMI JOIN common USING (origin, station, measure)" if ranked else ""} GROUP BY 1, 2, 3, 4
)""",
        "\nboard AS (SELECT family, method, fill, avg(score) AS score, sum(cells)::BIGINT AS cells FROM daily GROUP BY 1, 2, 3)",
        select=select,
    )


def _city_settings(city, even, learned, first_num):
    """The forty settings of one city and one kind of training panel."""
    where = "= 0" if even else "= 1"
    prefix = [SQL_PANEL_S, f"\npanel_h AS MATERIALIZED (SELECT * FROM panel_s WHERE station::INT % 2 {where})"]
    if learned:
        gate = SQL_NEIGHBORS.replace(f"_missing < {GATE} ", f"_missing < {CITY_GATE} ").replace(
            "neighbors AS (", "neighbors AS MATERIALIZED ("
        )
        past = SQL_LINES.replace("FROM viewed", f"FROM viewed WHERE ts < TIMESTAMP '{min(ORIGINS_D)}'")
        prefix += [SQL_VIEWED, past, gate]
    numbers = " ".join(
        f"WHEN fill = '{fill}' AND method = '{method}' AND family = '{family}' THEN {first_num + i}"
        for i, (fill, method, family) in enumerate(
            (f, m, w) for f in ("day+mean", "none") for m in ("median", "mean") for w in WINDOW_FAMILIES
        )
    )
    select = f"""SELECT CASE {numbers} END AS num, round(score, 6) AS score, '{city}' AS city,
    {str(learned).lower()} AS learned, fill = 'day+mean' AS fill, method, family FROM board"""
    return _settings(
        WINDOW_FAMILIES, ["none", "day+mean"], select, prefix, "neighbors" if learned else "panel_h", "panel_h",
        ORIGINS_D, False,
    )


_H24 = ", ".join(f"round(median(m1) FILTER (WHERE hour(ts) = {h}), 6) AS h{h}" for h in range(24))
_SUMMARY = f'SELECT station, target, season, "window", {r(*M)} FROM summaries'
_GRID = f"""SELECT g.origin, g.station, g.horizon,
  {', '.join(f'round(greatest(0, coalesce(f.{m}, 0)), 8) AS {m}' for m in M)}
  FROM (SELECT DISTINCT '{ORIGIN_H}' AS origin, station, h.horizon FROM panel_h,
        (SELECT unnest(range(48)) AS horizon) h) g
  LEFT JOIN forecast f USING (origin, station, horizon)"""
_FRAMES = ", ".join(
    f"round(quantile_cont({m}, 0.5) OVER w{w}, 6) AS {m}_w{w}" for w in WINDOWS_H for m in M
)
_FRAME_DEFS = ", ".join(
    f"w{w} AS (PARTITION BY station, hour(ts) ORDER BY datediff('day', DATE '1970-01-01', ts) "
    f"RANGE BETWEEN {w + 1} PRECEDING AND 3 PRECEDING)"
    for w in WINDOWS_H
)
_SCORE = "SELECT origin, station, measure, round(score, 6) AS score FROM scores"
_DRAWS = " + ".join(
    f"CASE WHEN u >= {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r} THEN 1 ELSE 0 END" for k in range(12)
)
_DAILY = "SELECT origin, avg(score) AS score FROM scores GROUP BY 1"

SQL = {
    "seasonal_median": sql(
        SQL_PANEL_H,
        select="SELECT station, hour(ts) AS hour, "
        + ", ".join(f"round(median({m}), 6) AS {m}" for m in M) + " FROM panel_h GROUP BY 1, 2",
    ),
    "seasonal_mean": sql(
        SQL_PANEL_H,
        select="SELECT station, hour(ts) AS hour, "
        + ", ".join(f"round(avg({m}), 6) AS {m}" for m in M) + " FROM panel_h GROUP BY 1, 2",
    ),
    "pivot_hour_medians": sql(SQL_PANEL_H, select=f"SELECT station, {_H24} FROM panel_h GROUP BY 1"),
    "rolling_summary_anchored": sql(
        SQL_PANEL_H, summary_cte("summaries", "panel_h", TARGETS_H, WINDOWS_H), select=_SUMMARY
    ),
    "rolling_summary_mean": sql(
        SQL_PANEL_H, summary_cte("summaries", "panel_h", TARGETS_H, WINDOWS_H, "avg({m})"), select=_SUMMARY
    ),
    "rolling_summary_frame": sql(
        SQL_PANEL_H, select=f"SELECT station, {T}, {_FRAMES} FROM panel_h WINDOW {_FRAME_DEFS}"
    ),
    "rolling_summary_imputed": sql(
        SQL_PANEL_H,
        fill_cte("filled", "panel_h", "day"),
        imputed_summary_cte("summaries", "filled", TARGETS_H, WINDOWS_H),
        select=_SUMMARY,
    ),
    "rolling_summary_golden": sql(
        SQL_PANEL_S,
        summary_cte("summaries", "panel_s", [ORIGIN_D], GOLDEN_WINDOWS, season="0"),
        select=f'SELECT station, target, "window", {r(*M)} FROM summaries',
    ),
    "rolling_summary_hourly": sql(
        SQL_PANEL_W,
        summary_cte("summaries", "panel_w", ["2001-06-01", "2001-06-02"], GOLDEN_WINDOWS),
        select=_SUMMARY,
    ),
    "median_of_medians_hourly": sql(
        SQL_PANEL_W,
        summary_cte("summaries", "panel_w", _days_before("2001-06-02", 48), GOLDEN_WINDOWS),
        forecast_cte("forecast", "summaries", _days_before("2001-06-01", 47)),
        select=f"SELECT origin, station, horizon, {r(*M)} FROM forecast",
    ),
    "median_features": sql(
        SQL_PANEL_H,
        summary_cte("summaries", "panel_h", [ORIGIN_H], WINDOWS_H, extra=0, gap=1),
        select=f'SELECT station, season, "window", {r(*M)} FROM summaries',
    ),
    "median_features_shifted": sql(
        SQL_PANEL_H,
        summary_cte("summaries", "panel_h", ["2024-01-26", "2024-01-25"], WINDOWS_H, extra=0, gap=1),
        select=f"""SELECT station, datediff('day', CAST(target AS DATE), DATE '2024-01-26') AS shift, season, "window",
        {r(*M)} FROM summaries""",
    ),
    "median_of_medians": sql(
        SQL_PANEL_H,
        summary_cte("summaries", "panel_h", TARGETS_H, WINDOWS_H),
        forecast_cte("forecast", "summaries", [ORIGIN_H]),
        select=_GRID,
    ),
    "median_of_medians_imputed": sql(
        SQL_PANEL_H,
        fill_cte("filled", "panel_h", "day"),
        imputed_summary_cte("summaries", "filled", TARGETS_H, WINDOWS_H, "avg({m})"),
        forecast_cte("forecast", "summaries", [ORIGIN_H]),
        select=_GRID,
    ),
    "median_of_medians_daily": sql(
        SQL_PANEL_S,
        summary_cte(
            "summaries", "panel_s", _next_days(ORIGINS_D), sorted({*GOLDEN_WINDOWS, *FIB_WINDOWS}), season="0"
        ),
        f"""
forecast AS (
  SELECT m.family, o.origin, s.station, l.lead AS horizon, {', '.join(f'median(s.{m}) AS {m}' for m in M)}
  FROM (VALUES {_texts(ORIGINS_D)}) o(origin) CROSS JOIN (VALUES (0), (1)) l(lead)
  JOIN summaries s ON CAST(s.target AS DATE) = CAST(o.origin AS DATE) + l.lead
  JOIN (VALUES {', '.join([f"('golden_8', {w})" for w in GOLDEN_WINDOWS] + [f"('fib_9', {w})" for w in FIB_WINDOWS])})
    m(family, "window") ON m."window" = s."window"
  GROUP BY 1, 2, 3, 4
)""",
        select=f"SELECT family, origin, station, horizon, {r(*M)} FROM forecast",
    ),
    "forecast_grid": """SELECT DISTINCT event_type AS station, h.horizon FROM events,
        (SELECT unnest(range(48)) AS horizon) h""",
    "truth_complete": sql(
        SQL_PANEL_H,
        truth_cte("truth", ORIGINS_H, 1),
        select=f"""SELECT origin, station, horizon, {r('m1', 'm2')}, round(raw3, 6) AS m3 FROM truth
        WHERE m1 IS NOT NULL AND m2 IS NOT NULL AND (m3 IS NOT NULL OR station = 'error')""",
    ),
    "smape_official": _naive(_official, "JOIN", "AND p.m1 IS NOT NULL"),
    "smape_missing_forecast": _naive(_official),
    "smape_skipna": _naive(lambda a, p: f"2 * avg(CASE WHEN {a} + {p} = 0 THEN 0 ELSE abs({a} - {p}) / ({a} + {p}) END)"),
    "smape_loss": _naive(lambda a, p: f"2 * avg(abs({p} - {a}) / nullif(abs({p}) + abs({a}), 0))"),
    "mae_clipped": sql(
        SQL_PANEL_H,
        select="SELECT a.station, "
        + ", ".join(
            f"round(avg(CASE WHEN abs(a.{m} - p.{m}) > 50 THEN 50 ELSE abs(a.{m} - p.{m}) END), 6) AS {m}" for m in M
        )
        + " FROM panel_h a JOIN panel_h p ON p.station = a.station AND p.ts = a.ts - INTERVAL 1 DAY GROUP BY 1",
    ),
    "backtest_rolling": _backtest(_SCORE),
    "backtest_legacy_align": _backtest(
        _SCORE, gap=1, where="t.m1 IS NOT NULL AND t.m2 IS NOT NULL AND (t.m3 IS NOT NULL OR t.station = 'error')"
    ),
    "score_grid": _backtest(
        "SELECT station, measure, CASE WHEN station <> 'view' THEN round(score, 6) END AS score FROM scores",
        origins=[ORIGIN_H],
    ),
    "daily_score": _backtest(f"SELECT origin, round(score, 6) AS score FROM ({_DAILY})"),
    "overall_score": _backtest(f"SELECT round(avg(score), 6) AS score FROM ({_DAILY})"),
    "score_wide": _backtest(
        "SELECT origin, round(avg(score), 6) AS smape, "
        + ", ".join(
            f"round(max(score) FILTER (WHERE station || '-' || measure = '{c}'), 6) AS \"{c}\"" for c in CELLS
        )
        + " FROM scores GROUP BY 1"
    ),
    "bootstrap_score": _backtest(
        f"""SELECT rep, round(avg(score), 6) AS score FROM (
          SELECT rep, score, row_number() OVER (PARTITION BY rep ORDER BY md5('7|' || rep || '|' || origin)) AS n
          FROM ({_DAILY}) d CROSS JOIN (SELECT unnest(range(1, 21)) AS rep)) WHERE n <= 5 GROUP BY 1"""
    ),
    "bootstrap_interval": sql(
        SQL_PANEL_H,
        summary_cte("summaries", "panel_h", _next_days(ORIGINS_H), WINDOWS_H),
        forecast_cte("f_all", "summaries", ORIGINS_H),
        forecast_cte("f_short", f'(SELECT * FROM summaries WHERE "window" <= {WINDOWS_H[1]})', ORIGINS_H),
        truth_cte("truth", ORIGINS_H, 0),
        scores_cte("s_all", "truth", "f_all"),
        scores_cte("s_short", "truth", "f_short"),
        f"""
daily AS (
  SELECT origin, a.score - b.score AS d FROM (SELECT origin, avg(score) AS score FROM s_all GROUP BY 1) a
  JOIN (SELECT origin, avg(score) AS score FROM s_short GROUP BY 1) b USING (origin) WHERE a.score IS NOT NULL AND b.score IS NOT NULL
),
hashed AS (
  SELECT rep, d, ('0x' || substr(md5('3|' || rep || '|' || origin), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u
  FROM daily CROSS JOIN (SELECT unnest(range(1, 201)) AS rep)
),
drawn AS (SELECT rep, d, {_DRAWS} AS w FROM hashed),
means AS (SELECT rep, sum(w * d) / nullif(sum(w), 0) AS m FROM drawn GROUP BY 1)""",
        select="""SELECT round((SELECT avg(d) FROM daily), 6) AS difference, round(quantile_cont(m, 0.05), 6) AS low,
        round(quantile_cont(m, 0.95), 6) AS high, (SELECT count(*) FROM daily) AS days FROM means""",
    ),
    "exact_event_quantiles": """SELECT event_type, q AS quantile, round(CASE q WHEN 0.1 THEN quantile_cont(value, 0.1) WHEN 0.5 THEN quantile_cont(value, 0.5)
    ELSE quantile_cont(value, 0.9) END, 6) AS value FROM events CROSS JOIN (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(q) GROUP BY 1, 2""",
    "score_table_merge": _backtest(f"SELECT origin, round(score, 6) AS score FROM ({_DAILY})"),
    "settings_leaderboard": _settings(
        WINDOW_FAMILIES,
        ["none", "day+mean"],
        "SELECT family, method, fill, round(score, 6) AS score, cells FROM board",
    ),
    "settings_grid": " UNION ALL ".join(
        f"SELECT * FROM ({_city_settings(city, even, learned, first)})"
        for city, even, learned, first in (
            ("beijing", True, True, 1), ("beijing", True, False, 41),
            ("london", False, True, 81), ("london", False, False, 121),
        )
    ),
    "best_setting": _settings(
        WINDOW_FAMILIES,
        ["none", "day+mean"],
        "SELECT round(score, 6) AS score, family, method, fill FROM board ORDER BY score, family, method, fill LIMIT 1",
    ),
}
