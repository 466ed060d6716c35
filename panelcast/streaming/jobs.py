"""Streaming relatives of the batch operators, run to the end of what has landed.

Each builder turns a streaming DataFrame into another; ``run_to_table`` and ``run_upserts`` drive
one to completion (``availableNow``) into files, with checkpoints next to them, so that a lost
executor or a restart resumes where it stopped.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from panelcast.functions.columns import as_instant, as_wall_time
from panelcast.operators.panel import dedupe
from panelcast.sources.landed import arrival as place_of_arrival
from panelcast.sources.stores import read_if_any
from panelcast.spec import PanelSpec


def landed_stream(
    spark: SparkSession,
    path: str,
    schema: str | StructType,
    fmt: str = "parquet",
    files_per_trigger: int = 100,
    arrival: bool = False,
    **options,
) -> DataFrame:
    """Files as they land below ``path``; files seen before are not read again.

    With ``arrival`` a column of that name tells each row's place in the order of landing.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.options(**options).load(path)
    return rows.select("*", place_of_arrival(lines=False).alias("arrival")) if arrival else rows


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time with its watermark: rows later than ``delay`` are dropped by stateful operators.

    Watermarks need instants; zone-free times are read as UTC, so days start at their midnight.
    """
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        df = df.withColumn(ts, as_instant(ts))
    return df.withWatermark(ts, delay)


def dedupe_stream(df: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 day") -> DataFrame:
    """First row per key; a key is remembered for ``delay`` only."""
    once = event_time(df, ts, delay).dropDuplicatesWithinWatermark(list(keys))
    return once.withColumn(ts, as_wall_time(ts))


def window_summary(
    df: DataFrame, station: str, ts: str, value: str, size: str, slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Count, mean, greatest and total per station and window, tumbling or (with ``slide``) sliding.

    All of these combine partially, so a busy station costs one row of state per window.
    """
    windowed = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = event_time(df, ts, delay).groupBy(windowed.alias("w"), F.col(station).alias("station"))
    aggregated = grouped.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.max(value).alias("greatest"),
        F.sum(value).alias("total"),
    )
    return aggregated.select(
        "station",
        as_wall_time("w.start").alias("window_start"),
        as_wall_time("w.end").alias("window_end"),
        "n",
        "mean",
        "greatest",
        "total",
    )


def median_summary(df: DataFrame, station: str, ts: str, value: str, size: str, delay: str = "1 hour") -> DataFrame:
    """Exact median per station and window of an hourly panel, whose windows hold a bounded number of rows."""
    grouped = event_time(df, ts, delay).groupBy(F.window(ts, size).alias("w"), F.col(station).alias("station"))
    return grouped.agg(F.percentile(value, F.lit(0.5)).alias("median")).select(
        "station", as_wall_time("w.start").alias("window_start"), "median"
    )


def forward_fill_stream(df: DataFrame, spec: PanelSpec, delay: str = "2 days") -> DataFrame:
    """Carry each measure's last known value forward within the station's day.

    A row is filled from values known at earlier times of its day, whichever batch brought them, never
    from later ones. State is one row per station and day with the day's known values by time step; it
    ends once the watermark, ``delay`` behind the latest time, has passed the day. Rows later than
    that are dropped. Days are grouped apart, so a station's history spreads over tasks.
    """
    measures, steps = list(spec.measures), spec.seasons
    schema = f"{spec.station} string, {spec.ts} timestamp, day date, " + ", ".join(f"{m} double" for m in measures)
    state_schema = ", ".join(f"{m} array<double>" for m in measures)

    def fill(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else [[None] * steps for _ in measures]
        known = {m: pd.Series(list(v), dtype="float64") for m, v in zip(measures, held)}
        rows = pd.concat(list(frames)).sort_values(spec.ts, kind="stable")
        at = rows[spec.ts].dt.hour.to_numpy() if steps > 1 else rows[spec.ts].dt.hour.to_numpy() * 0
        for m in measures:
            for i, v in zip(at, rows[m]):
                if pd.notna(v):
                    known[m][i] = v
            rows[m] = rows[m].astype("float64").fillna(pd.Series(known[m].ffill().to_numpy()[at], index=rows.index))
        state.update(tuple([None if pd.isna(x) else float(x) for x in known[m]] for m in measures))
        end = int(pd.Timestamp(key[1], tz="UTC").timestamp() * 1000) + 86_400_000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield rows[[spec.station, spec.ts, "day", *measures]]

    keyed = df.select(
        spec.station,
        as_instant(spec.ts).alias(spec.ts),
        F.col(spec.ts).cast("date").alias("day"),
        *measures,
    ).withWatermark(spec.ts, delay)
    filled = keyed.groupBy(spec.station, "day").applyInPandasWithState(
        fill, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout
    )
    return filled.withColumn(spec.ts, as_wall_time(spec.ts)).drop("day")


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process all that has landed into parquet files below ``path`` and read them."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .option("path", f"{path}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_upserts(
    stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (), merge_after: int = 32
) -> DataFrame:
    """Apply batches of rows as upserts; the last row to arrive for a key wins.

    Batches count first, then ``order`` within a batch (for landed files the column that
    ``landed_stream`` adds on ``arrival=True``) and the place in the file; without ``order`` a batch that holds a key twice with
    different values fails. Each batch is written to its own folder, replaced if the
    batch is repeated after a failure, and never rewritten later. Reading resolves the batches since the
    last merge against its result; ``merge_after`` or more of them are merged at the end of the run.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("_line", F.monotonically_increasing_id()) if order else batch
        by = [*order, "_line"] if order else []
        last = dedupe(numbered, keys, by, keep="last").drop(*by)
        last.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    merge_batches(stream.sparkSession, path, keys, merge_after)
    return current_rows(stream.sparkSession, path, keys)


def _merged(spark: SparkSession, path: str) -> int:
    """The last batch that a finished merge holds, -1 if none."""
    log = read_if_any(spark, f"{path}/merges")
    return -1 if log is None else log.agg(F.max("upto")).first()[0]


def merge_batches(spark: SparkSession, path: str, keys: Sequence[str], at_least: int = 1) -> int:
    """Write the latest row per key as one table that readers start from, if ``at_least`` batches came since the last merge.

    A merge counts once its line in the log is written, after its rows, so one that breaks off is
    repeated and readers never see half of it; a merge that counts is not written again. Returns
    the last batch merged. The batch folders stay, as the record of what arrived.
    """
    batches, done = read_if_any(spark, f"{path}/rows"), _merged(spark, path)
    if batches is None:
        return done
    last = batches.agg(F.max("batch")).first()[0]
    if last is None or last - done < max(at_least, 1):
        return done
    current_rows(spark, path, keys).write.mode("overwrite").parquet(f"{path}/merged/upto={last}")
    spark.createDataFrame([(last,)], "upto int").coalesce(1).write.mode("append").parquet(f"{path}/merges")
    return last


def current_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The latest row per key: the last merge and the batches after it, older batches are not read."""
    done = _merged(spark, path)
    rows = spark.read.parquet(f"{path}/rows").where(F.col("batch") > done)
    if done >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{path}/merged/upto={done}").withColumn("batch", F.lit(done)))
    return dedupe(rows, keys, ["batch"], keep="last").drop("batch")


def forecasts_met(
    forecasts: DataFrame, readings: DataFrame, spec: PanelSpec, gap_days: int = 0, delay: str = "3 days"
) -> DataFrame:
    """Forecast rows beside the readings they foretold, as truth arrives: (origin, station, horizon, due, _a_<measure>..., measures).

    Both are streams: forecasts (origin, station, horizon, measures), horizon 0 being the first step of
    the day ``gap_days`` after the origin, and readings, unique per station and time (``dedupe_stream``
    or landed rows). They meet on station and due time, whichever comes first; either side waits until
    the watermark, ``delay`` behind the later of its times, has passed the due time, and is then
    forgotten, so state holds the forecasts not yet due and the readings of ``delay``. A forecast of two
    origins for one time meets its reading twice; a reading nobody foretold is no row.
    """
    day = F.col("origin").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(gap_days))
    ahead = forecasts.select(
        "origin", spec.station, "horizon", as_instant(day + spec.steps("horizon")).alias("due"), *spec.measures
    ).withWatermark("due", delay)
    truth = readings.select(
        F.col(spec.station).alias("_station"), as_instant(spec.ts).alias("_at"), *[F.col(m).alias(f"_a_{m}") for m in spec.measures]
    ).withWatermark("_at", delay)
    met = ahead.join(truth, (F.col(spec.station) == F.col("_station")) & (F.col("due") == F.col("_at")))
    return met.withColumn("due", as_wall_time("due")).drop("_station", "_at")
