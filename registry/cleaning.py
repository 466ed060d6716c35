"""Cleaning, joins, reshapes and time ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions.columns import clip_missing, hour_of, number, shift_hours, at_hour
from panelcast.operators import panel as P
from registry.panels import (
    DAILY, HOURLY, SQL_PANEL_D, SQL_PANEL_H, SQL_PANEL_S, SQL_READINGS_H, T,
    panel_d, panel_h, panel_s, r, read, readings_h, rounded, sql,
)

M = ("m1", "m2", "m3")


def panel_hourly(spark, sf):
    return rounded(readings_h(spark, sf), *M)


def panel_spine(spark, sf):
    return rounded(panel_h(spark, sf), *M)


def panel_spine_daily(spark, sf):
    return rounded(panel_s(spark, sf), *M)


def _two_feeds(spark, sf):
    """Readings of each event, sent by two feeds: the second one only knows odd events."""
    events = read(spark, sf, "events").select(
        F.col("event_type").alias("station"), hour_of("ts").alias("ts"), "event_id", "value"
    )
    odd = events.where(F.col("event_id") % 2 == 1).withColumn("value", F.col("value") * 10)
    return P.union_sources(events, odd, rank="source_rank")


SQL_FEEDS = """
feeds AS (
  SELECT event_type AS station, date_trunc('hour', ts) AS ts, event_id, value, 0 AS source_rank FROM events
  UNION ALL
  SELECT event_type, date_trunc('hour', ts), event_id, value * 10, 1 FROM events WHERE event_id % 2 = 1
)"""


def dedupe_keep_first(spark, sf):
    return rounded(P.dedupe(_two_feeds(spark, sf), HOURLY.keys, ["source_rank", "event_id"], "first"), "value")


def dedupe_keep_last(spark, sf):
    return rounded(P.dedupe(_two_feeds(spark, sf), HOURLY.keys, ["source_rank", "event_id"], "last"), "value")


def _sql_dedupe(direction):
    return sql(
        SQL_FEEDS,
        select=f"""
        SELECT station, {T}, event_id, round(value, 6) AS value, source_rank FROM (
          SELECT *, row_number() OVER (
            PARTITION BY station, ts ORDER BY source_rank {direction}, event_id {direction}) AS n
          FROM feeds) WHERE n = 1""",
    )


def union_missing_cols(spark, sf):
    hourly = readings_h(spark, sf)
    late = hourly.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).drop("m3")
    return rounded(P.union_sources(hourly, late), *M)


def source_coalesce(spark, sf):
    """Purchases-only readings completed from the full panel of the same hour."""
    events = read(spark, sf, "events").where(F.col("value") >= 100)
    strong = events.groupBy(F.col("event_type").alias("station"), hour_of("ts").alias("ts")).agg(
        F.avg("value").alias("m1"), F.max("value").alias("m2"), F.sum("value").alias("m3")
    )
    grid = panel_h(spark, sf).select(*HOURLY.keys)
    return rounded(P.merge_sources(grid.join(strong, HOURLY.keys, "left"), readings_h(spark, sf), HOURLY), *M)


def scatter_update(spark, sf):
    """Cells of the hours 0-5 replaced by ten times their maximum."""
    base = panel_h(spark, sf)
    night = base.where(F.hour("ts") < 6).select(*HOURLY.keys, (F.col("m2") * 10).alias("m1"))
    return rounded(P.scatter_update(base, night, HOURLY.keys, ["m1"]), *M)


TYPES = ["click", "error", "purchase", "signup", "view"]


def _raw_wide(spark, sf):
    return P.rows_to_station_columns(panel_h(spark, sf), HOURLY, TYPES)


def station_wide_to_long(spark, sf):
    return rounded(P.station_columns_to_rows(_raw_wide(spark, sf), HOURLY, TYPES), *M)


def long_to_station_matrix(spark, sf):
    return rounded(_raw_wide(spark, sf), *TYPES)


def long_to_series_arrays(spark, sf):
    """Series arrays unfolded again, position by position."""
    arrays = P.series_arrays(panel_h(spark, sf), HOURLY)
    cells = arrays.select("station", "measure", "start", F.posexplode("values").alias("pos", "value"))
    return rounded(cells, "value")


def series_long(spark, sf):
    return rounded(P.series(panel_h(spark, sf), HOURLY), "value")


SQL_SERIES = """
series AS (
  SELECT station, ts, measure, value FROM (
    SELECT station, ts, 'm1' AS measure, m1 AS value FROM panel_h
    UNION ALL SELECT station, ts, 'm2', m2 FROM panel_h
    UNION ALL SELECT station, ts, 'm3', m3 FROM panel_h WHERE station <> 'error')
)"""


def rename_map_project(spark, sf):
    named = {"event_type": "station", "value": "m1", "nothing": "never"}
    events = read(spark, sf, "events").withColumnsRenamed(named)
    return rounded(events.drop("props", "user_id").select("event_id", "station", "ts", "m1"), "m1")


def positional_rename(spark, sf):
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return rounded(items.toDF("id", "line", "ts", "m1").drop("id"))


def tz_shift_fixed(spark, sf):
    """Date and hour columns of wall time at UTC+8 back to UTC."""
    events = read(spark, sf, "events")
    local = events.select("event_id", F.date_format("ts", "yyyyMMdd").alias("date"), F.hour("ts").alias("hour"))
    return rounded(local.select("event_id", shift_hours(at_hour("date", "hour"), -8).alias("ts")))


def time_range_half_open(spark, sf):
    return rounded(P.in_range(panel_h(spark, sf), HOURLY, "2024-01-05", "2024-01-20"), *M)


def time_range_closed(spark, sf):
    return rounded(P.in_range(panel_h(spark, sf), HOURLY, "2024-01-05", "2024-01-20", closed=True), *M)


def history_cut_relative_max(spark, sf):
    return rounded(P.history_cut(panel_h(spark, sf), HOURLY, "2024-01-26", history_days=14), *M)


def complete_case(spark, sf):
    return rounded(P.complete_case(panel_h(spark, sf), HOURLY), *M)


def constant_columns(spark, sf):
    """A source without the third measure, tagged with its origin."""
    base = readings_h(spark, sf).withColumn("source", F.lit("feed")).withColumn("m3", F.lit(None).cast("double"))
    return rounded(base, *M)


def clip_missing_zero(spark, sf):
    """Deviations from the station mean, clipped at 0, missing ones 0."""
    base = panel_h(spark, sf)
    means = base.groupBy("station").agg(F.avg("m1").alias("mean"))
    moved = base.join(means, "station").select("station", "ts", clip_missing(F.col("m1") - F.col("mean")).alias("m1"))
    return rounded(moved, "m1", places=4)


def not_a_number_clean(spark, sf):
    """Values that arrive as text with 'NaT' and 'nan' in them."""
    events = read(spark, sf, "events")
    text = F.when(F.col("value") < 5, "NaT").when(F.col("value") > 150, "nan").otherwise(F.col("value").cast("string"))
    return rounded(events.select("event_id", number(text).alias("value")), "value")


def null_predicates(spark, sf):
    base = panel_h(spark, sf)
    return base.groupBy("station").agg(
        F.count_if(F.col("m1").isNull()).alias("missing"), F.count_if(F.col("m1").isNotNull()).alias("known")
    )


def _asian_suppliers(spark, sf):
    nations = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asian = nations.where(F.col("r_name") == "ASIA").select(F.col("n_nationkey").alias("s_nationkey"))
    suppliers = read(spark, sf, "supplier").join(asian, "s_nationkey", "left_semi")
    return suppliers.select(F.col("s_suppkey").cast("string").alias("station"))


def semi_station_filter(spark, sf):
    return rounded(P.keep_stations(panel_s(spark, sf), _asian_suppliers(spark, sf), DAILY), *M)


def city_split(spark, sf):
    """Known cells per region ('city') of the stations."""
    base = panel_s(spark, sf)
    dim = (
        read(spark, sf, "supplier")
        .join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").cast("string").alias("station"), F.col("r_name").alias("city"))
    )
    split = base.join(dim, "station").groupBy("city")
    return rounded(split.agg(F.count("m1").alias("known"), F.avg("m1").alias("mean")), "mean")


def new_keys_anti(spark, sf):
    """Hours that the panel of small events lacks."""
    small = read(spark, sf, "events").where(F.col("value") < 50)
    known = small.select(F.col("event_type").alias("station"), hour_of("ts").alias("ts"))
    return rounded(P.new_rows(readings_h(spark, sf), known, HOURLY.keys), *M)


def distinct_stations(spark, sf):
    return panel_s(spark, sf).select("station").distinct()


def time_bounds(spark, sf):
    bounds = readings_h(spark, sf).groupBy("station").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return rounded(bounds)


def latest_rows(spark, sf):
    """The ten latest readings."""
    return rounded(readings_h(spark, sf).orderBy(F.col("ts").desc(), "station").limit(10), *M)


def key_round_trip(spark, sf):
    """Compose station#measure#date keys and take them apart again."""
    rows = P.series(panel_d(spark, sf), DAILY).where(F.col("value").isNotNull())
    keyed = rows.select(F.concat_ws("#", "station", "measure", F.date_format("ts", "yyyy-MM-dd")).alias("key"))
    parts = [F.split_part("key", F.lit("#"), F.lit(i)) for i in (1, 2, 3)]
    return keyed.select("key", *[p.alias(n) for p, n in zip(parts, ("station", "measure", "day"))])


def date_parts(spark, sf):
    rows = readings_h(spark, sf)
    return rows.select(
        "station",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.hour("ts").alias("hour"),
        F.lower(F.date_format("ts", "MMM")).alias("month"),
        F.date_format("ts", "yyyyMMdd").alias("compact"),
    )


def calendar_join(spark, sf):
    """Orders per day with the kind of a yearly calendar day, where there is one."""
    days = read(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")
    calendar = (
        read(spark, sf, "orders")
        .select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
        .where(F.substring("day", 6, 5).isin("01-01", "01-02", "05-01", "05-02", "05-03"))
        .distinct()
        .withColumn("holiday", F.when(F.substring("day", 6, 2) == "01", "new_year").otherwise("labor_day"))
    )
    joined = days.join(calendar, "day", "left").groupBy("day", "holiday")
    return rounded(joined.agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total")), "total", places=2)


QUERIES = {
    f.__name__: f
    for f in (
        panel_hourly, panel_spine, panel_spine_daily, dedupe_keep_first, dedupe_keep_last, union_missing_cols,
        source_coalesce, scatter_update, station_wide_to_long, long_to_station_matrix, long_to_series_arrays,
        series_long, rename_map_project, positional_rename, tz_shift_fixed, time_range_half_open, time_range_closed,
        history_cut_relative_max, complete_case, constant_columns, clip_missing_zero, not_a_number_clean,
        null_predicates, semi_station_filter, city_split, new_keys_anti, distinct_stations, time_bounds, latest_rows,
        key_round_trip, date_parts, calendar_join,
    )
}

_ROWS = f"station, {T}, {r(*M)}"
_PIVOT = ", ".join(f"round(max(value) FILTER (WHERE station = '{s}'), 6) AS {s}" for s in TYPES)
_RANGE = "FROM panel_h WHERE ts >= TIMESTAMP '2024-01-05'"

SQL = {
    "panel_hourly": sql(SQL_READINGS_H, select=f"SELECT {_ROWS} FROM readings_h"),
    "panel_spine": sql(SQL_PANEL_H, select=f"SELECT {_ROWS} FROM panel_h"),
    "panel_spine_daily": sql(SQL_PANEL_S, select=f"SELECT {_ROWS} FROM panel_s"),
    "dedupe_keep_first": _sql_dedupe("ASC"),
    "dedupe_keep_last": _sql_dedupe("DESC"),
    "union_missing_cols": sql(
        SQL_READINGS_H,
        select=f"""SELECT {_ROWS} FROM readings_h UNION ALL
        SELECT station, {T}, {r('m1', 'm2')}, NULL AS m3 FROM readings_h WHERE ts >= TIMESTAMP '2024-01-15'""",
    ),
    "source_coalesce": sql(
        SQL_PANEL_H,
        """
strong AS (
  SELECT event_type AS station, date_trunc('hour', ts) AS ts, avg(value) AS m1, max(value) AS m2, sum(value) AS m3
  FROM events WHERE value >= 100 GROUP BY 1, 2)""",
        select="""SELECT p.station, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(s.m1, p.m1), 6) AS m1,
        round(coalesce(s.m2, p.m2), 6) AS m2, round(coalesce(s.m3, p.m3), 6) AS m3
        FROM panel_h p LEFT JOIN strong s USING (station, ts)""",
    ),
    "scatter_update": sql(
        SQL_PANEL_H,
        select=f"""SELECT station, {T}, round(CASE WHEN hour(ts) < 6 THEN coalesce(m2 * 10, m1) ELSE m1 END, 6) AS m1,
        {r('m2', 'm3')} FROM panel_h""",
    ),
    "station_wide_to_long": sql(SQL_PANEL_H, select=f"SELECT {_ROWS} FROM panel_h"),
    "long_to_station_matrix": sql(
        SQL_PANEL_H,
        """
cells AS (SELECT station, ts, 'm1' AS type, m1 AS value FROM panel_h
  UNION ALL SELECT station, ts, 'm2', m2 FROM panel_h UNION ALL SELECT station, ts, 'm3', m3 FROM panel_h)""",
        select=f"SELECT {T}, type, {_PIVOT} FROM cells GROUP BY cells.ts, type",
    ),
    "long_to_series_arrays": sql(
        SQL_PANEL_H,
        SQL_SERIES,
        select="""SELECT station, measure, strftime(min(ts) OVER (), '%Y-%m-%d %H:%M:%S') AS start,
        row_number() OVER (PARTITION BY station, measure ORDER BY ts) - 1 AS pos, round(value, 6) AS value FROM series""",
    ),
    "series_long": sql(
        SQL_PANEL_H, SQL_SERIES, select=f"SELECT station, {T}, measure, round(value, 6) AS value FROM series"
    ),
    "rename_map_project": f"SELECT event_id, event_type AS station, ts::VARCHAR AS ts, round(value, 6) AS m1 FROM events",
    "positional_rename": "SELECT l_linenumber AS line, l_shipdate::VARCHAR AS ts, l_quantity AS m1 FROM lineitem",
    "tz_shift_fixed": """SELECT event_id,
        strftime(date_trunc('hour', ts) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS ts FROM events""",
    "time_range_half_open": sql(
        SQL_PANEL_H, select=f"SELECT {_ROWS} {_RANGE} AND panel_h.ts < TIMESTAMP '2024-01-20'"
    ),
    "time_range_closed": sql(
        SQL_PANEL_H, select=f"SELECT {_ROWS} {_RANGE} AND panel_h.ts <= TIMESTAMP '2024-01-20'"
    ),
    "history_cut_relative_max": sql(
        SQL_PANEL_H,
        """
known AS (SELECT * FROM panel_h WHERE ts <= TIMESTAMP '2024-01-26' - INTERVAL 9 HOUR)""",
        select=f"SELECT {_ROWS} FROM known WHERE known.ts >= (SELECT max(ts) FROM known) - INTERVAL 14 DAY",
    ),
    "complete_case": sql(
        SQL_PANEL_H,
        select=f"""SELECT {_ROWS} FROM panel_h
        WHERE m1 IS NOT NULL AND m2 IS NOT NULL AND (m3 IS NOT NULL OR station = 'error')""",
    ),
    "constant_columns": sql(
        SQL_READINGS_H,
        select=f"SELECT station, {T}, {r('m1', 'm2')}, NULL::DOUBLE AS m3, 'feed' AS source FROM readings_h",
    ),
    "clip_missing_zero": sql(
        SQL_PANEL_H,
        select=f"""SELECT station, {T}, round(greatest(0, coalesce(m1 - avg(m1) OVER (PARTITION BY station), 0)), 4)
        AS m1 FROM panel_h""",
    ),
    "not_a_number_clean": """SELECT event_id,
        round(CASE WHEN value < 5 OR value > 150 THEN NULL ELSE value END, 6) AS value FROM events""",
    "null_predicates": sql(
        SQL_PANEL_H,
        select="""SELECT station, count(*) FILTER (WHERE m1 IS NULL) AS missing, count(m1) AS known
        FROM panel_h GROUP BY 1""",
    ),
    "semi_station_filter": sql(
        SQL_PANEL_S,
        select=f"""SELECT {_ROWS} FROM panel_s WHERE station IN (
          SELECT s_suppkey::VARCHAR FROM supplier JOIN nation ON s_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""",
    ),
    "city_split": sql(
        SQL_PANEL_S,
        select="""SELECT r_name AS city, count(m1) AS known, round(avg(m1), 6) AS mean
        FROM panel_s JOIN supplier ON station = s_suppkey::VARCHAR JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    ),
    "new_keys_anti": sql(
        SQL_READINGS_H,
        select=f"""SELECT {_ROWS} FROM readings_h h WHERE NOT EXISTS (
          SELECT 1 FROM events e WHERE e.value < 50 AND e.event_type = h.station AND date_trunc('hour', e.ts) = h.ts)""",
    ),
    "distinct_stations": "SELECT DISTINCT l_suppkey::VARCHAR AS station FROM lineitem",
    "time_bounds": sql(
        SQL_READINGS_H,
        select="""SELECT station, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM readings_h GROUP BY 1""",
    ),
    "latest_rows": sql(
        SQL_READINGS_H, select=f"SELECT {_ROWS} FROM readings_h ORDER BY readings_h.ts DESC, station LIMIT 10"
    ),
    "key_round_trip": sql(
        SQL_PANEL_D,
        """
cells AS (SELECT station, ts, 'm1' AS measure, m1 AS value FROM panel_d
  UNION ALL SELECT station, ts, 'm2', m2 FROM panel_d UNION ALL SELECT station, ts, 'm3', m3 FROM panel_d)""",
        select="""SELECT station || '#' || measure || '#' || strftime(ts, '%Y-%m-%d') AS key, station, measure,
        strftime(ts, '%Y-%m-%d') AS day FROM cells WHERE value IS NOT NULL""",
    ),
    "date_parts": sql(
        SQL_READINGS_H,
        select="""SELECT station, strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS hour, lower(strftime(ts, '%b')) AS month,
        strftime(ts, '%Y%m%d') AS compact FROM readings_h""",
    ),
    "calendar_join": """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day,
        CASE WHEN strftime(o_orderdate, '%m-%d') IN ('01-01', '01-02') THEN 'new_year'
             WHEN strftime(o_orderdate, '%m-%d') IN ('05-01', '05-02', '05-03') THEN 'labor_day' END AS holiday,
        count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""",
}
