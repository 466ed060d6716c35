"""Ingestion from landed files, history builds, stores, the daily job, and the streaming jobs.

Files are landed by Spark from the given tables, then read back by the jobs under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions.columns import hour_of
from panelcast.operators import panel as P, score as S
from panelcast.operators.impute import fill_from_neighbors, fit_neighbor_lines
from panelcast.operators.seasonal import median_features, median_of_medians
from panelcast.plans import histories as H, predict as D
from panelcast.session import shared_folder, write_and_read
from panelcast.sources import landed as L, stores as K
from panelcast.streaming import jobs as J
from registry.forecasting import _scores, forecast_cte, summary_cte, SQL as FORECAST_SQL
from registry.imputing import SQL as IMPUTE_SQL, SQL_LINES, SQL_NEIGHBORS, SQL_VIEWED
from registry.learning import NET
from registry.panels import (
    HOURLY, ORIGIN_H, ORIGINS_H, SQL_PANEL_H, SQL_READINGS_H, T, WINDOWS_H, panel_h, r, read, readings_h,
    rounded, sql,
)

M = ("m1", "m2", "m3")
TYPES = ["click", "error", "purchase", "signup", "view"]
HEADERS = {"点击": "click", "错误": "error", "购买": "purchase", "注册": "signup", "浏览": "view"}


# --- landed files -------------------------------------------------------------------------------


def _land_station_wide(spark, sf):
    """Two feeds of files in UTC+8 wall time, one with foreign headers."""
    wide = P.rows_to_station_columns(panel_h(spark, sf), HOURLY, TYPES)
    local = wide.withColumn("ts", F.col("ts") + F.expr("INTERVAL 8 HOURS"))
    rows = local.select(
        F.date_format("ts", "yyyyMMdd").alias("date"), F.hour("ts").alias("hour"), "type", *TYPES
    )
    foreign = rows.withColumnsRenamed({v: k for k, v in HEADERS.items()})
    root = shared_folder(spark, "feeds")
    foreign.where("type IN ('m1', 'm2')").write.option("header", True).csv(f"{root}/all")
    rows.where("type = 'm3'").write.option("header", True).csv(f"{root}/extra")
    return [f"{root}/all", f"{root}/extra"]


TYPE_MAP = {m: m for m in M}


def ingest_station_wide(spark, sf):
    feeds = _land_station_wide(spark, sf)
    readings = L.read_station_wide(spark, feeds, HOURLY, TYPES, HEADERS, TYPE_MAP, utc_offset_hours=8)
    return rounded(H.build_from_readings(readings, HOURLY, "2024-01-01", "2024-02-01"), *M)


SITE_HEADERS = {"MeasurementDateGMT": "utc_time", "First (ug/m3)": "m1", "Second (ug/m3)": "m2"}


def ingest_station_files(spark, sf):
    """One folder per station, headers with a site name; the third measure is never reported."""
    rows = readings_h(spark, sf).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("MeasurementDateGMT"),
        F.col("m1").alias("Site: First (ug/m3)"),
        F.col("m2").alias("Site: Second (ug/m3)"),
        "station",
    )
    root = shared_folder(spark, "sites")
    rows.write.partitionBy("station").option("header", True).csv(root)
    readings = L.read_station_files(
        spark, f"{root}/station=*", HOURLY, r"station=([^/]+)/", SITE_HEADERS, {"m1": "m1", "m2": "m2"}
    )
    return rounded(H.build_from_readings(readings, HOURLY, "2024-01-02", "2024-01-29 23:00:00", closed=True), *M)


def ingest_city_feed(spark, sf):
    """Eight columns by position behind an id."""
    rows = readings_h(spark, sf).selectExpr(
        "0 AS id", "station AS a", "ts AS b", "m1 AS c", "m2 AS d", "0 AS e", "0 AS f", "m3 AS g", "0 AS h"
    )
    root = shared_folder(spark, "feed")
    rows.write.option("header", True).csv(root)
    columns = ["station", "ts", "m1", "m2", "no2", "co", "m3", "so2"]
    return rounded(P.to_spine(L.read_city_feed(spark, root, HOURLY, columns), HOURLY), *M)


def ingest_incremental(spark, sf):
    """Three overlapping landings; the last, incomplete day is held back."""
    rows, root = readings_h(spark, sf), shared_folder(spark, "landing")
    for start, end in (("2024-01-01", "2024-01-12"), ("2024-01-08", "2024-01-20"), ("2024-01-15", "2024-02-01")):
        K.land(P.in_range(rows, HOURLY, start, end), root, HOURLY.keys, complete_before="2024-01-30")
    return rounded(spark.read.parquet(root), *M)


def history_build(spark, sf):
    """Three sources with other columns and overlapping times, the first one winning."""
    base = readings_h(spark, sf).withColumn("no2", F.lit(0.0))
    early = P.in_range(base, HOURLY, None, "2024-01-20")
    late = P.in_range(base, HOURLY, "2024-01-10", None).withColumn("m1", F.col("m1") * 2).drop("no2")
    rest = late.withColumn("m1", F.col("m1") * 5)
    return rounded(H.build_history([early, late, rest], HOURLY, start="2024-01-02"), *M)


def history_repeats(spark, sf):
    """A source that holds keys twice: first the reading, later NULL or a smaller value. The first row stays."""
    base = readings_h(spark, sf).withColumn("seq", F.lit(0))
    gone = base.where("hour(ts) % 2 = 0").withColumns({m: F.lit(None).cast("double") for m in M}).withColumn("seq", F.lit(1))
    less = base.where("hour(ts) % 2 = 1").withColumns({m: F.col(m) / 2 for m in M}).withColumn("seq", F.lit(2))
    source = write_and_read(P.union_sources(less, gone, base), "source")
    return rounded(H.build_history([source], HOURLY, order=["seq"]), *M)


def landed_corrections(spark, sf):
    """Keys corrected downwards in the file that lands later; the last to arrive is stored."""
    root = shared_folder(spark, "corrections")
    rows = readings_h(spark, sf)
    rows.coalesce(1).write.option("header", True).csv(f"{root}/in")
    lower = rows.where("hour(ts) < 6").withColumns({m: F.col(m) - 100 for m in M})
    lower.coalesce(1).write.mode("append").option("header", True).csv(f"{root}/in")
    schema = "station string, ts timestamp_ntz, m1 double, m2 double, m3 double"
    landed = spark.read.schema(schema).option("header", True).csv(f"{root}/in").select("*", L.arrival().alias("arrival"))
    K.land(landed, f"{root}/out", HOURLY.keys, order=["arrival"])
    return rounded(spark.read.parquet(f"{root}/out"), *M)


def history_backfilled(spark, sf):
    """Readings of strong events alone on the spine, gaps filled from the full panel."""
    events = read(spark, sf, "events").where(F.col("value") >= 50)
    strong = events.groupBy(F.col("event_type").alias("station"), hour_of("ts").alias("ts")).agg(
        F.avg("value").alias("m1"), F.max("value").alias("m2"), F.lit(None).cast("double").alias("m3")
    )
    out = H.build_from_readings(strong, HOURLY, "2024-01-02", "2024-01-29", secondary=readings_h(spark, sf))
    return rounded(out, *M)


def history_refresh(spark, sf):
    base = readings_h(spark, sf)
    old = P.to_spine(P.in_range(base, HOURLY, None, "2024-01-20"), HOURLY)
    window = P.in_range(base, HOURLY, "2024-01-18").withColumn("m2", F.col("m2") + 1)
    return rounded(H.refresh(old, window, HOURLY, "2024-01-18", "2024-01-25 23:00:00"), *M)


def history_stored(spark, sf):
    """Panels of two cities stored by city, one read back with fresh rows."""
    base = panel_h(spark, sf).withColumn("city", F.when(F.col("station") < "p", "beijing").otherwise("london"))
    root = shared_folder(spark, "history")
    K.write_panel(P.in_range(base, HOURLY, None, "2024-01-25"), root, HOURLY)
    fresh = P.in_range(base, HOURLY, "2024-01-25").where("city = 'beijing'")
    return rounded(L.read_city_history(spark, root, "beijing", HOURLY, fresh), *M)


def history_fresh(spark, sf):
    """The load of a city: fresh readings correct stored ones, those that land later win, only its stations stay, hours filled."""
    base = panel_h(spark, sf).withColumn("city", F.when(F.col("station") < "p", "beijing").otherwise("london"))
    root = shared_folder(spark, "history")
    K.write_panel(P.in_range(base, HOURLY, None, "2024-01-25"), root, HOURLY)
    fresh = P.in_range(base, HOURLY, "2024-01-23").where("city = 'london'").withColumn("seq", F.lit(0))
    later = fresh.where("hour(ts) < 6").withColumns({"m1": F.col("m1") - 100, "seq": F.lit(1)})
    unreadable = fresh.where("hour(ts) = 9").withColumns({"m2": F.lit(float("nan")), "seq": F.lit(1)})
    every = P.union_sources(fresh, later, unreadable)
    out = L.read_city_history(spark, root, "london", HOURLY, every, stations=["signup", "view"], order=["seq"], fill=_zero_m2)
    return rounded(out, *M)


def _zero_m2(df):
    return df.withColumn("m2", F.coalesce("m2", F.lit(0.0)))


def imputed_history(spark, sf):
    out = H.imputed_history(panel_h(spark, sf), HOURLY, "all", before="2024-01-30", max_missing=3)
    return rounded(out, *M, places=4)


def stored_neighbor_models(spark, sf):
    """Lines fitted once, stored as a table, applied from there."""
    base, root = panel_h(spark, sf), shared_folder(spark, "models")
    fit_neighbor_lines(base, HOURLY).write.parquet(root)
    filled = fill_from_neighbors(base, HOURLY, 3, models=spark.read.parquet(root))
    return rounded(filled, *M, places=4)


# --- sinks and the daily job --------------------------------------------------------------------


def city_merge_forecast(spark, sf):
    """Two cities, each with its own windows and summary, on one clipped grid as test_id rows."""
    base = panel_h(spark, sf)
    panels = {"a": base.where("station < 'p'"), "b": base.where("station >= 'p'")}
    settings = {
        "a": D.CitySetting(WINDOWS_H[:3], max_missing=0.0, fill=None),
        "b": D.CitySetting(WINDOWS_H, max_missing=0.0, method="mean", fill=None),
    }
    root = shared_folder(spark, "submission")
    D.daily_job(panels, HOURLY, ORIGIN_H, settings, "medians", root)
    stored = L.read_csv(spark, f"{root}/pred_date=2024-01-25/model=medians")
    return rounded(stored.withColumns({m: F.col(m).cast("double") for m in M}), *M, places=8)


def curve_city_forecast(spark, sf):
    base = panel_h(spark, sf)
    settings = {"a": D.CitySetting([], 3, history_days=20, strength=0.05, changepoints=13)}
    return rounded(D.predict_cities({"a": base}, HOURLY, ORIGIN_H, settings, "curve"), *M)


def pooled_city_forecast(spark, sf):
    """The daily job of the pooled ensemble: five folds, four shifts of training splits."""
    base = panel_h(spark, sf)
    settings = {"a": D.CitySetting([3, 5], 3, lag_history_days=3, shifts=4, median_shifts=2, folds=5)}
    return rounded(D.predict_cities({"a": base}, HOURLY, ORIGIN_H, settings, "pooled"), *M)


def net_city_forecast(spark, sf):
    """The daily job of the shortcut net."""
    settings = {"a": D.CitySetting([3, 5], 3, lag_history_days=3, shifts=4, median_shifts=2, folds=5, net=NET)}
    return rounded(D.predict_cities({"a": panel_h(spark, sf)}, HOURLY, ORIGIN_H, settings, "net"), *M)


def score_store(spark, sf):
    """Two overlapping runs appended, read back without duplicates, with their log."""
    scores, root = S.mean_scores(_scores(spark, sf)), shared_folder(spark, "scores")
    K.append_scores(scores.where("origin <= '2024-01-24'"), f"{root}/scores")
    K.append_scores(scores.where("origin >= '2024-01-20'"), f"{root}/scores")
    K.append_settings(spark, f"{root}/settings", [{"windows": WINDOWS_H}], f"{root}/scores")
    return rounded(K.read_scores(spark, f"{root}/scores"), "score")


def feature_cache(spark, sf):
    """Built on the first call, read on the second."""
    root, key = shared_folder(spark, "features"), {"city": "a", "windows": WINDOWS_H, "split": ORIGIN_H}

    def build():
        return median_features(panel_h(spark, sf), HOURLY, [ORIGIN_H], WINDOWS_H).drop("target_day")

    K.cached_features(spark, root, key, build)
    return rounded(K.cached_features(spark, root, key, build), *M)


# --- streams ------------------------------------------------------------------------------------


def _events_stream(spark, sf):
    schema = read(spark, sf, "events").schema
    return J.landed_stream(spark, sf, schema, pathGlobFilter="events.parquet")


def _panel_stream(spark, sf, days_per_batch=8):
    """The hourly panel landed as one folder per day, streamed in date order."""
    root = shared_folder(spark, "panel-landed")
    panel = panel_h(spark, sf).withColumn("day", F.col("ts").cast("date"))
    for_each_day = panel.repartitionByRange("day").sortWithinPartitions("day", *HOURLY.keys)
    for_each_day.write.partitionBy("day").parquet(root)
    schema = panel.schema
    return J.landed_stream(spark, root, schema, files_per_trigger=days_per_batch)


def stream_ingest(spark, sf):
    return rounded(J.run_to_table(_events_stream(spark, sf), shared_folder(spark, "stream")), "value")


def stream_dedupe(spark, sf):
    """Each (station, hour) once."""
    events = _events_stream(spark, sf).select(F.col("event_type").alias("station"), hour_of("ts").alias("ts"))
    once = J.dedupe_stream(events, ["station", "ts"], "ts", "2 days")
    return rounded(J.run_to_table(once, shared_folder(spark, "stream")))


def stream_hourly(spark, sf):
    """Hourly station summaries of all closed windows."""
    out = J.window_summary(_events_stream(spark, sf), "event_type", "ts", "value", "1 hour")
    return rounded(J.run_to_table(out, shared_folder(spark, "stream")), "mean", "greatest", "total")


def stream_sliding(spark, sf):
    """Five-day windows starting every day."""
    out = J.window_summary(_events_stream(spark, sf), "event_type", "ts", "value", "5 days", "1 day")
    return rounded(J.run_to_table(out, shared_folder(spark, "stream")), "mean", "greatest", "total", places=4)


def stream_daily_median(spark, sf):
    """All days but the last two; days land in any order, so the watermark waits for the whole month."""
    out = J.median_summary(_panel_stream(spark, sf, days_per_batch=100), "station", "ts", "m1", "1 day", delay="1 hour")
    return rounded(J.run_to_table(out, shared_folder(spark, "stream")), "median")


def stream_ffill(spark, sf):
    """Forward fill within the day, several batches of landed days."""
    filled = J.forward_fill_stream(_panel_stream(spark, sf), HOURLY, "31 days")
    return rounded(J.run_to_table(filled, shared_folder(spark, "stream")), *M)


def stream_correction(spark, sf):
    """Rows and their corrections, downwards, in one micro-batch: the file that landed later wins."""
    root = shared_folder(spark, "corrections")
    rows = readings_h(spark, sf)
    rows.coalesce(1).write.parquet(f"{root}/a")
    lower = rows.where("hour(ts) < 6").withColumns({m: F.col(m) - 100 for m in M})
    lower.coalesce(1).write.mode("append").parquet(f"{root}/a")
    stream = J.landed_stream(spark, f"{root}/a", rows.schema, arrival=True)
    return rounded(J.run_upserts(stream, f"{root}/table", HOURLY.keys, ["arrival"]), *M)


def stream_upsert(spark, sf):
    """The same key landed again in a later batch replaces the earlier row."""
    root = shared_folder(spark, "upserts")
    rows = readings_h(spark, sf)
    rows.write.parquet(f"{root}/a")
    stream = J.landed_stream(spark, f"{root}/a", rows.schema, files_per_trigger=1)
    first = J.run_upserts(stream, f"{root}/table", HOURLY.keys)
    first.createOrReplaceTempView("first_state")
    P.in_range(rows, HOURLY, "2024-01-20").withColumn("m1", F.col("m1") + 1).write.mode("append").parquet(f"{root}/a")
    return rounded(J.run_upserts(stream, f"{root}/table", HOURLY.keys), *M)


def stream_upsert_merged(spark, sf):
    """Three landings, batches merged after each but the last: readers take the merge and what came since."""
    root = shared_folder(spark, "upserts")
    rows = readings_h(spark, sf)
    steps = [(None, 0, 1), ("2024-01-20", 1, 1), ("2024-01-25", 2, 1000)]
    for since, added, merge_after in steps:
        P.in_range(rows, HOURLY, since).withColumn("m1", F.col("m1") + added).write.mode("append").parquet(f"{root}/a")
        stream = J.landed_stream(spark, f"{root}/a", rows.schema, files_per_trigger=1000)
        out = J.run_upserts(stream, f"{root}/table", HOURLY.keys, merge_after=merge_after)
    return rounded(out, *M)


def stream_scores(spark, sf):
    """Forecasts of ten origins and the readings they foretold, both streamed, scored where they met."""
    base = write_and_read(panel_h(spark, sf), "panel")
    root = shared_folder(spark, "forecasts")
    forecast = median_of_medians(base, HOURLY, ORIGINS_H, {"all": WINDOWS_H}).select("origin", "station", "horizon", *M)
    forecast.repartition(4, "origin").write.parquet(root)
    ahead = J.landed_stream(spark, root, spark.read.parquet(root).schema, files_per_trigger=1)
    met = J.forecasts_met(ahead, _panel_stream(spark, sf), HOURLY, delay="62 days")
    pairs = J.run_to_table(met, shared_folder(spark, "met"))
    return rounded(S.score_pairs(pairs, HOURLY).select("origin", "station", "measure", "score"), "score")


QUERIES = {
    f.__name__: f
    for f in (
        ingest_station_wide, ingest_station_files, ingest_city_feed, ingest_incremental, history_build,
        history_repeats, landed_corrections, history_backfilled, history_refresh, history_stored, history_fresh, imputed_history, stored_neighbor_models, city_merge_forecast,
        curve_city_forecast, pooled_city_forecast, net_city_forecast, score_store, feature_cache, stream_ingest, stream_dedupe, stream_hourly, stream_sliding,
        stream_daily_median, stream_ffill, stream_correction, stream_upsert, stream_upsert_merged, stream_scores,
    )
}


# --- SQL ----------------------------------------------------------------------------------------

_ROWS = f"station, {T}, {r(*M)}"


def _spined(select: str, source: str, rows: str) -> str:
    """SQL of readings on the spine between their own first and last times."""
    return sql(
        SQL_READINGS_H,
        f"\nsource AS ({source})",
        f"""
spined AS (
  SELECT s.station, t.ts, {rows}
  FROM (SELECT DISTINCT station FROM source) s
  CROSS JOIN (SELECT unnest(generate_series(
    (SELECT min(ts) FROM source), (SELECT max(ts) FROM source), INTERVAL 1 HOUR)) AS ts) t
  LEFT JOIN source r ON r.station = s.station AND r.ts = t.ts
)""",
        select=select,
    )


_HISTORY = """
  SELECT station, ts, m1, m2, m3 FROM readings_h WHERE ts < TIMESTAMP '2024-01-20'
  UNION ALL SELECT station, ts, m1 * 2, m2, m3 FROM readings_h WHERE ts >= TIMESTAMP '2024-01-20'"""
_CORRECTED = f"SELECT station, {T}, " + ", ".join(
    f"round(CASE WHEN hour(ts) < 6 THEN {m} - 100 ELSE {m} END, 6) AS {m}" for m in M
) + " FROM readings_h"
_REFRESHED = """
  SELECT station, ts, m1, m2, m3 FROM readings_h WHERE ts < TIMESTAMP '2024-01-18'
  UNION ALL SELECT station, ts, m1, m2 + 1, m3 FROM readings_h
  WHERE ts >= TIMESTAMP '2024-01-18' AND ts <= TIMESTAMP '2024-01-25 23:00:00'"""
_MERGED_GRID = f"""SELECT g.station || '#' || g.horizon AS test_id,
  {', '.join(f'round(greatest(0, coalesce(f.{m}, 0)), 8) AS {m}' for m in M)}
  FROM (SELECT DISTINCT station, h.horizon FROM panel_h, (SELECT unnest(range(48)) AS horizon) h) g
  LEFT JOIN (SELECT * FROM forecast_a WHERE station < 'p' UNION ALL SELECT * FROM forecast_b WHERE station >= 'p') f
  USING (station, horizon)"""
_TARGETS = ["2024-01-26", "2024-01-27"]
_FORWARD = ", ".join(
    f"round(last_value({m} IGNORE NULLS) OVER (PARTITION BY station, CAST(ts AS DATE) ORDER BY ts "
    f"ROWS UNBOUNDED PRECEDING), 6) AS {m}"
    for m in M
)

SQL = {
    "ingest_station_wide": sql(
        SQL_PANEL_H, select=f"SELECT {_ROWS} FROM panel_h"
    ),
    "ingest_station_files": _spined(
        f"SELECT station, {T}, {r('m1', 'm2')}, NULL::DOUBLE AS m3 FROM spined",
        "SELECT * FROM readings_h WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-29 23:00:00'",
        "r.m1, r.m2",
    ),
    "ingest_city_feed": _spined(f"SELECT {_ROWS} FROM spined", "SELECT * FROM readings_h", "r.m1, r.m2, r.m3"),
    "ingest_incremental": sql(
        SQL_READINGS_H, select=f"SELECT {_ROWS} FROM readings_h WHERE readings_h.ts < TIMESTAMP '2024-01-30'"
    ),
    "history_build": _spined(
        f"SELECT {_ROWS} FROM spined WHERE spined.ts >= TIMESTAMP '2024-01-02'", _HISTORY, "r.m1, r.m2, r.m3"
    ),
    "history_repeats": _spined(f"SELECT {_ROWS} FROM spined", "SELECT * FROM readings_h", "r.m1, r.m2, r.m3"),
    "landed_corrections": sql(SQL_READINGS_H, select=_CORRECTED),
    "stream_correction": sql(SQL_READINGS_H, select=_CORRECTED),
    "history_backfilled": sql(
        SQL_READINGS_H,
        """
strong AS (
  SELECT event_type AS station, date_trunc('hour', ts) AS ts, avg(value) AS m1, max(value) AS m2 FROM events
  WHERE value >= 50 AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-29' GROUP BY 1, 2)""",
        """
grid AS (
  SELECT s.station, t.ts FROM (SELECT DISTINCT station FROM strong) s
  CROSS JOIN (SELECT unnest(generate_series(
    (SELECT min(ts) FROM strong), (SELECT max(ts) FROM strong), INTERVAL 1 HOUR)) AS ts) t)""",
        select="""SELECT g.station, strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(s.m1, h.m1), 6) AS m1,
        round(coalesce(s.m2, h.m2), 6) AS m2, round(h.m3, 6) AS m3
        FROM grid g LEFT JOIN strong s ON s.station = g.station AND s.ts = g.ts
        LEFT JOIN readings_h h ON h.station = g.station AND h.ts = g.ts""",
    ),
    "history_refresh": _spined(f"SELECT {_ROWS} FROM spined", _REFRESHED, "r.m1, r.m2, r.m3"),
    "history_stored": sql(SQL_PANEL_H, select=f"SELECT {_ROWS} FROM panel_h WHERE station < 'p'"),
    "history_fresh": sql(
        SQL_PANEL_H,
        select=f"""SELECT station, {T}, round(CASE WHEN ts >= TIMESTAMP '2024-01-23' AND hour(ts) < 6 THEN m1 - 100 ELSE m1 END, 6) AS m1,
        CASE WHEN ts >= TIMESTAMP '2024-01-23' AND hour(ts) = 9 THEN 0.0 ELSE round(coalesce(m2, 0.0), 6) END AS m2, {r('m3')}
        FROM panel_h WHERE station IN ('signup', 'view')""",
    ),
    "imputed_history": sql(
        SQL_PANEL_H.replace("panel_h AS", "panel_all AS"),
        "\npanel_h AS (SELECT * FROM panel_all WHERE ts < TIMESTAMP '2024-01-30')",
        SQL_VIEWED,
        SQL_LINES,
        SQL_NEIGHBORS,
        select=f"SELECT station, {T}, {r(*M, places=4)}, 'all' AS city FROM neighbors",
    ),
    "stored_neighbor_models": IMPUTE_SQL["neighbor_regression_impute"],
    "city_merge_forecast": sql(
        SQL_PANEL_H,
        summary_cte("summaries_a", "panel_h", _TARGETS, WINDOWS_H[:3]),
        forecast_cte("forecast_a", "summaries_a", [ORIGIN_H]),
        summary_cte("summaries_b", "panel_h", _TARGETS, WINDOWS_H, "avg({m})"),
        forecast_cte("forecast_b", "summaries_b", [ORIGIN_H]),
        select=_MERGED_GRID,
    ),
    "score_store": FORECAST_SQL["daily_score"],
    "feature_cache": FORECAST_SQL["median_features"],
    "stream_ingest": "SELECT event_id, ts::VARCHAR AS ts, user_id, event_type, round(value, 6) AS value, props FROM events",
    "stream_dedupe": sql(SQL_READINGS_H, select=f"SELECT station, {T} FROM readings_h"),
    "stream_hourly": """
        SELECT event_type AS station, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
        count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS greatest, round(sum(value), 6) AS total
        FROM events GROUP BY event_type, date_trunc('hour', ts)
        HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_sliding": """
        SELECT event_type AS station, strftime(date_trunc('day', ts) - INTERVAL 1 DAY * k, '%Y-%m-%d %H:%M:%S')
        AS window_start, strftime(date_trunc('day', ts) - INTERVAL 1 DAY * k + INTERVAL 5 DAY, '%Y-%m-%d %H:%M:%S')
        AS window_end, count(*) AS n, round(avg(value), 4) AS mean, round(max(value), 4) AS greatest,
        round(sum(value), 4) AS total
        FROM events CROSS JOIN (SELECT unnest(range(5)) AS k)
        GROUP BY event_type, date_trunc('day', ts) - INTERVAL 1 DAY * k
        HAVING date_trunc('day', ts) - INTERVAL 1 DAY * k + INTERVAL 5 DAY
               <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_daily_median": sql(
        SQL_PANEL_H,
        select="""SELECT station, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
        round(median(m1), 6) AS median FROM panel_h GROUP BY station, date_trunc('day', ts)
        HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM panel_h) - INTERVAL 1 HOUR""",
    ),
    "stream_ffill": sql(SQL_PANEL_H, select=f"SELECT station, {T}, {_FORWARD} FROM panel_h"),
    "stream_upsert": sql(
        SQL_READINGS_H,
        select=f"""SELECT station, {T},
        round(CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN m1 + 1 ELSE m1 END, 6) AS m1, {r('m2', 'm3')} FROM readings_h""",
    ),
    "stream_upsert_merged": sql(
        SQL_READINGS_H,
        select=f"""SELECT station, {T}, round(m1 + CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 2
          WHEN ts >= TIMESTAMP '2024-01-20' THEN 1 ELSE 0 END, 6) AS m1, {r('m2', 'm3')} FROM readings_h""",
    ),
    "stream_scores": FORECAST_SQL["backtest_rolling"],
}
