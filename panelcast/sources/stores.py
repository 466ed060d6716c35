"""Writers: panels, submissions, score tables, settings, features, landed rows."""

from __future__ import annotations

import hashlib
import json
from typing import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.fixed import MEASURE_NAMES
from panelcast.functions.columns import clip_missing
from panelcast.operators.panel import dedupe, new_rows
from panelcast.session import write_and_read
from panelcast.spec import PanelSpec


def read_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None while nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_panel(df: DataFrame, path: str, spec: PanelSpec, by: Sequence[str] = ("city",), mode: str = "overwrite") -> None:
    """Store a panel partitioned by ``by``, each file sorted by station and time."""
    df.repartition(*by, spec.station).sortWithinPartitions(*by, *spec.keys).write.mode(mode).partitionBy(*by).parquet(path)


def to_submission(forecast: DataFrame, spec: PanelSpec, names=MEASURE_NAMES, clip: bool = True) -> DataFrame:
    """Forecast rows as (test_id, measures by their outer names), clipped at 0."""
    outer = {inner: out for out, inner in names.items()}
    columns = [(clip_missing(m) if clip else F.col(m)).alias(outer.get(m, m)) for m in spec.measures]
    return forecast.select(F.concat_ws("#", spec.station, F.col("horizon").cast("string")).alias("test_id"), *columns)


def write_submission(submission: DataFrame, path: str, pred_date: str, model: str) -> str:
    """CSV with header under ``pred_date=.../model=...``, the folder returned; writing again replaces that part alone."""
    folder = f"{path}/pred_date={pred_date}/model={model}"
    submission.write.mode("overwrite").option("header", True).csv(folder)
    return folder


def append_scores(scores: DataFrame, path: str, places: int = 9) -> None:
    """Add the scores of a run. Runs are kept apart as files; nothing stored is rewritten.

    Scores are rounded, so that a repeated run stores rows equal to those of the first.
    """
    doubles = {c: F.round(c, places) for c, kind in scores.dtypes if kind == "double"}
    scores.withColumns(doubles).write.mode("append").parquet(path)


def read_scores(spark: SparkSession, path: str, day: str = "origin") -> DataFrame:
    """All runs' scores, exact duplicates once, by date."""
    return spark.read.option("mergeSchema", True).parquet(path).distinct().orderBy(day)


def append_settings(spark: SparkSession, path: str, settings: Sequence[dict], summary_path: str) -> None:
    """Log which settings' scores lie where."""
    rows = [(json.dumps(s, sort_keys=True, default=str), summary_path) for s in settings]
    spark.createDataFrame(rows, "setting string, summary string").coalesce(1).write.mode("append").json(path)


def cached_features(spark: SparkSession, root: str, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """Features stored under a digest of everything they depend on, built on first use.

    ``key`` must name city, imputation, window sizes, history and splits: two sets that differ in
    any of them never share a folder.
    """
    digest = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{root.rstrip('/')}/features={digest}"
    stored = read_if_any(spark, path)
    if stored is None:
        build().write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
    return stored


def land(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    complete_before: str | None = None,
    ts: str = "ts",
    order: Sequence[str] = (),
) -> None:
    """Append the rows whose key is not stored yet, so landing the same files again adds nothing.

    Of rows of one key the last by ``order`` stays (for landed files ``arrival``); these columns are
    not stored. ``complete_before`` holds back rows of the current, still incomplete day. The rows
    are read once; of the stored table only their time span is.
    """
    if complete_before is not None:
        rows = rows.where(F.col(ts) < F.lit(complete_before).cast("timestamp_ntz"))
    fresh = write_and_read(dedupe(rows, keys, order, keep="last").drop(*order), "landed")
    known = read_if_any(rows.sparkSession, path)
    if known is not None:
        span = (F.col(ts) >= fresh.agg(F.min(ts)).scalar()) & (F.col(ts) <= fresh.agg(F.max(ts)).scalar())
        fresh = new_rows(fresh, known.where(span), keys)
    fresh.write.mode("append").parquet(path)
