"""Panels that the queries derive from the given tables, in Spark and as SQL prefixes.

panel_h   hourly, station = event type, from every event
panel_d   daily, station = order priority, from every order
panel_s   daily, station = supplier, from every line item
panel_w   hourly, 35 stations = groups of suppliers, from every line item

Readings are stored once, one row per station and step; stations, time bounds and cells of the
spine are read from the stored table, so each query scans its raw table a single time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.functions.columns import hour_of
from panelcast.operators.panel import to_spine
from panelcast.session import write_and_read
from panelcast.spec import PanelSpec

HOURLY = PanelSpec(measures=("m1", "m2", "m3"), absent={"m3": ("error",)})
WIDE = PanelSpec(measures=("m1", "m2", "m3"))
DAILY = PanelSpec(measures=("m1", "m2", "m3"), step="day")

ORIGIN_H = "2024-01-26"
ORIGINS_H = [f"2024-01-{d}" for d in range(18, 28)]
WINDOWS_H = [3, 5, 8, 13]
ORIGIN_D = "2001-06-01"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def readings_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings with the natural gaps: hours without events have no row."""
    events = read(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("station"), hour_of("ts").alias("ts")).agg(
        F.avg("value").alias("m1"), F.max("value").alias("m2"), F.sum("value").alias("m3")
    )


def panel_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly panel over whole days."""
    readings = write_and_read(readings_h(spark, sf_dir), "readings")
    first, last = F.date_trunc("day", F.min("ts")), F.date_trunc("day", F.max("ts"))
    return to_spine(
        readings,
        HOURLY,
        start=readings.agg(first.cast("timestamp_ntz")).scalar(),
        end=readings.agg(last.cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS")).scalar(),
    )


def panel_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    daily = orders.groupBy(F.col("o_orderpriority").alias("station"), F.col("o_orderdate").alias("ts")).agg(
        F.avg("o_totalprice").alias("m1"),
        F.max("o_totalprice").alias("m2"),
        F.count("*").cast("double").alias("m3"),
    )
    return to_spine(write_and_read(daily, "readings"), DAILY)


def panel_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    daily = items.groupBy(F.col("l_suppkey").cast("string").alias("station"), F.col("l_shipdate").alias("ts")).agg(
        F.avg("l_quantity").alias("m1"),
        F.max("l_extendedprice").alias("m2"),
        F.count("*").cast("double").alias("m3"),
    )
    return to_spine(write_and_read(daily, "readings"), DAILY)


def panel_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    ts = F.col("l_shipdate") + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
    hourly = items.groupBy((F.col("l_suppkey") % 35).cast("string").alias("station"), ts.alias("ts")).agg(
        F.avg("l_quantity").alias("m1"), F.max("l_extendedprice").alias("m2"), F.avg("l_extendedprice").alias("m3")
    )
    return to_spine(write_and_read(hourly, "readings"), WIDE)


SQL_READINGS_H = """
readings_h AS (
  SELECT event_type AS station, date_trunc('hour', ts) AS ts,
         avg(value) AS m1, max(value) AS m2, sum(value) AS m3
  FROM events GROUP BY 1, 2
)"""

SQL_PANEL_H = SQL_READINGS_H + """,
panel_h AS (
  SELECT s.station, t.ts, r.m1, r.m2, r.m3
  FROM (SELECT DISTINCT station FROM readings_h) s
  CROSS JOIN (
    SELECT unnest(generate_series(
      (SELECT date_trunc('day', min(ts)) FROM events)::TIMESTAMP,
      (SELECT date_trunc('day', max(ts)) FROM events)::TIMESTAMP + INTERVAL 23 HOUR,
      INTERVAL 1 HOUR)) AS ts
  ) t
  LEFT JOIN readings_h r ON r.station = s.station AND r.ts = t.ts
)"""


def _spined(name: str, grouped: str, step: str = "DAY") -> str:
    return f"""
{name}_raw AS ({grouped}),
{name} AS (
  SELECT s.station, t.ts, r.m1, r.m2, r.m3
  FROM (SELECT DISTINCT station FROM {name}_raw) s
  CROSS JOIN (
    SELECT unnest(generate_series(
      (SELECT min(ts) FROM {name}_raw), (SELECT max(ts) FROM {name}_raw), INTERVAL 1 {step})) AS ts
  ) t
  LEFT JOIN {name}_raw r ON r.station = s.station AND r.ts = t.ts
)"""


SQL_PANEL_D = _spined(
    "panel_d",
    "SELECT o_orderpriority AS station, o_orderdate AS ts, avg(o_totalprice) AS m1, "
    "max(o_totalprice) AS m2, count(*)::DOUBLE AS m3 FROM orders GROUP BY 1, 2",
)
SQL_PANEL_S = _spined(
    "panel_s",
    "SELECT l_suppkey::VARCHAR AS station, l_shipdate AS ts, avg(l_quantity) AS m1, "
    "max(l_extendedprice) AS m2, count(*)::DOUBLE AS m3 FROM lineitem GROUP BY 1, 2",
)
SQL_PANEL_W = _spined(
    "panel_w",
    "SELECT (l_suppkey % 35)::VARCHAR AS station, l_shipdate + INTERVAL 1 HOUR * (l_orderkey % 24)::INT AS ts, "
    "avg(l_quantity) AS m1, max(l_extendedprice) AS m2, avg(l_extendedprice) AS m3 FROM lineitem GROUP BY 1, 2",
    "HOUR",
)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Shape of a checked result: the named doubles rounded, timestamps and dates as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in columns:
            c = F.round(c, places)
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def sql(*ctes: str, select: str) -> str:
    """WITH RECURSIVE <ctes> <select>."""
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + select


def r(*columns: str, places: int = 6, table: str = "") -> str:
    """SQL list of rounded columns."""
    t = f"{table}." if table else ""
    return ", ".join(f"round({t}{c}, {places}) AS {c}" for c in columns)


T = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
