"""Readers of landed files: station-wide daily files, per-station files, city feeds, histories."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelcast.fixed import CITY_FEED_COLUMNS, LONDON_HEADERS, MEASURE_NAMES
from panelcast.functions.columns import at_hour, number, shift_hours
from panelcast.operators.panel import clean, dedupe, station_columns_to_rows, union_sources
from panelcast.session import write_and_read
from panelcast.spec import PanelSpec


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """CSV with header; without a schema every column is text, to be parsed by name."""
    reader = spark.read.option("header", True)
    if schema:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(paths)


def arrival(lines: bool = True) -> Column:
    """Place of a row in the order of landing: file time, file, and (with ``lines``) place in the file.

    For use in the first projection over files. Streams cannot number lines there.
    """
    place = [
        F.col("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    ]
    return F.struct(*place, *([F.monotonically_increasing_id().alias("line")] if lines else []))


def read_station_wide(
    spark: SparkSession,
    feeds: Sequence[str | Sequence[str]],
    spec: PanelSpec,
    stations: Sequence[str],
    headers: Mapping[str, str] | None = None,
    types: Mapping[str, str] = MEASURE_NAMES,
    utc_offset_hours: int = 0,
) -> DataFrame:
    """Daily files with a column per station -> unique readings (station, ts, measures) in UTC.

    Each feed is one path or list of paths whose files share a header; feeds may differ in their
    columns and types. Rows are (date yyyymmdd, hour, type, stations...) in local time. Of rows with
    equal type and time the last to arrive stays: by feed, then by file time, file and line.
    """
    frames = []
    for rank, paths in enumerate(feeds):
        raw = read_csv(spark, paths).withColumnsRenamed(dict(headers or {}))
        names = [s for s in stations if s in raw.columns]
        ts = shift_hours(at_hour(F.col("date").cast("int"), F.col("hour")), -utc_offset_hours)
        frames.append(
            raw.where(F.col("type").isin(list(types))).select(
                ts.alias(spec.ts),
                "type",
                F.lit(rank).alias("_feed"),
                arrival().alias("_arrival"),
                *[number(F.col(f"`{s}`")).alias(s) for s in names],
            )
        )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    unique = dedupe(rows, [spec.ts, "type"], ["_feed", "_arrival"], keep="last").drop("_feed", "_arrival")
    return station_columns_to_rows(unique, spec, stations, types=types)


def _cells(value: Column, width: int) -> Column:
    """The cells of a CSV line as an array of text, missing ones NULL."""
    schema = ", ".join(f"_{i} string" for i in range(width))
    line = F.from_csv(value, schema, {"ignoreLeadingWhiteSpace": "true"})
    return F.array(*[line[f"_{i}"] for i in range(width)])


def read_station_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    spec: PanelSpec,
    station_pattern: str = r"([^/_]+)_[^/]*\.csv$",
    headers: Mapping[str, str] = LONDON_HEADERS,
    names: Mapping[str, str] = MEASURE_NAMES,
    time_header: str = "MeasurementDateGMT",
) -> DataFrame:
    """One file per station (and month), each with its own header -> unique (station, ts, measures).

    Headers read ``<site>: <quantity>``; the text after the last ': ' names the column. Order and
    number of columns may differ per file. Files are read once, as lines, into the shared folder; a
    file's first line that is not blank is its header, which is joined back to the file's lines by
    Spark, so the driver sees no line and a large file is split like any other. The station is taken
    from the path. A file without the time column adds nothing; if none has it, the call fails. Lines
    are rows, so quoted cells hold no line ends. Where rows overlap the last to arrive wins.
    """
    wanted = {names.get(short, short): header for header, short in headers.items() if header != time_header}
    read = spark.read.text(paths).select(F.regexp_replace("value", "^\ufeff", "").alias("value"), arrival().alias("_arrival"))
    lines = write_and_read(read.where(F.trim("value") != ""), "station-lines")
    at = F.struct("_arrival.block", "_arrival.line")
    heads = lines.groupBy(F.col("_arrival.file").alias("_file")).agg(F.min(at).alias("_at"), F.min_by("value", at).alias("_head"))
    heads = write_and_read(heads, "station-heads")
    width = heads.agg(F.max(F.size(F.split("_head", ",")))).first()[0] or 1
    titles = F.transform(_cells(F.col("_head"), width), lambda t: F.trim(F.element_at(F.split(t, ": "), -1)))
    place = {spec.ts: time_header, **{m: wanted[m] for m in spec.measures if m in wanted}}
    heads = heads.withColumn("_titles", titles).select(
        "_file", "_at", *[(F.array_position("_titles", h) - 1).cast("int").alias(f"_at_{c}") for c, h in place.items()]
    )
    heads = heads.where(F.col(f"_at_{spec.ts}") >= 0)
    if heads.isEmpty():
        raise ValueError(f"no file has a column {time_header!r}")
    rows = lines.join(heads, F.col("_arrival.file") == F.col("_file")).where(at != F.col("_at"))
    rows = rows.withColumn("_cells", _cells(F.col("value"), width))
    cell = {c: F.get("_cells", F.col(f"_at_{c}")) for c in place}
    readings = rows.select(
        F.regexp_extract("_file", station_pattern, 1).alias(spec.station),
        F.try_to_timestamp(cell[spec.ts]).cast("timestamp_ntz").alias(spec.ts),
        "_arrival",
        *[(number(cell[m]) if m in cell else F.lit(None).cast("double")).alias(m) for m in spec.measures],
    )
    return dedupe(readings.where(F.col(spec.ts).isNotNull()), spec.keys, ["_arrival"], keep="last").drop("_arrival")


def read_city_feed(
    spark: SparkSession, paths: str | Sequence[str], spec: PanelSpec, columns: Sequence[str] = CITY_FEED_COLUMNS
) -> DataFrame:
    """Feed whose columns count by position once ``id`` is gone."""
    named = read_csv(spark, paths).drop("id").toDF(*columns)
    return named.select(
        spec.station,
        F.try_to_timestamp(spec.ts).cast("timestamp_ntz").alias(spec.ts),
        *[number(m).alias(m) for m in spec.measures],
    )


def read_city_history(
    spark: SparkSession,
    path: str,
    city: str,
    spec: PanelSpec,
    fresh: DataFrame | None = None,
    cities=("beijing", "london"),
    stations: Sequence[str] | None = None,
    order: Sequence[str] = (),
    fill: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Stored panel of one city, with fresh readings added if given: unique, clean rows of its stations.

    ``city`` is the partition column of the stored panel, so other cities are not read. Rows without a
    time are left out, measures that are no numbers are NULL, and only ``stations`` stay, if named. A
    fresh reading replaces the stored one of its station and time; among fresh ones the last by
    ``order`` (columns of ``fresh``) does. ``fill`` is applied to the result: a learned fill, say.
    """
    if city not in cities:
        raise ValueError(f"city must be one of {list(cities)}, not {city!r}")
    rows = spark.read.parquet(path).where(F.col("city") == city).select(*spec.columns)
    if fresh is not None:
        rows = union_sources(rows, fresh.select(*spec.columns, *order), rank="_rank")
    if stations is not None:
        rows = rows.where(F.col(spec.station).isin(list(stations)))
    rows = clean(rows, spec).where(F.col(spec.ts).isNotNull())
    if fresh is not None:
        by = ["_rank", *order]
        rows = dedupe(rows, spec.keys, by, keep="last").drop(*by)
    return rows if fill is None else fill(rows)
