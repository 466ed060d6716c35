import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.fixed import WINDOW_FAMILIES, window_family
from panelcast.operators import seasonal as R
from panelcast.plans import backtest as B
from panelcast.spec import PanelSpec

DAILY = PanelSpec(measures=("m1",), step="day")
TWO = PanelSpec(measures=("m1", "m2"))


@pytest.fixture(scope="module")
def days(panel):
    """Day d of January holds the value d."""
    return panel([("a", f"2024-01-{d:02d} 00:00:00", float(d)) for d in range(1, 31)])


def only(df):
    return [r.m1 for r in df.collect()]


def test_window_bounds(days):
    # target day 11 of a window of 4: days 6, 7, 8
    assert only(R.window_summaries(days, DAILY, ["2024-01-11"], [4])) == [7.0]
    # as a feature: days 7 .. 10
    assert only(R.median_features(days, DAILY, ["2024-01-11"], [4])) == [8.5]


def test_doubled_keys_are_refused(days):
    with pytest.raises(Exception, match="dedupe it first"):
        R.window_summaries(days.union(days), DAILY, ["2024-01-11"], [4]).collect()


def test_window_before_the_history_is_null(days):
    both = R.window_summaries(days, DAILY, ["2024-01-02", "2024-01-11"], [4]).orderBy("target_day")
    assert only(both) == [None, 7.0]


def test_middle_matches_nanmedian():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, 5, 3))
    x[rng.random(x.shape) < 0.4] = np.nan
    x[:, 0, 0] = np.nan
    with np.errstate(all="ignore"):
        expected = np.nanmedian(x[:, 1:], axis=0)
    assert np.allclose(R.middle(x, 0)[1:], expected)
    assert np.isnan(R.middle(x, 0)[0, 0])


def test_arrow_form_equals_frame_form(synthetic):
    holes = synthetic.withColumn("m1", F.when(F.pmod(F.hash("station", "ts"), F.lit(7)) > 0, F.col("m1")))
    windows, targets = [3, 5, 13], ["2024-02-10", "2024-02-20"]
    arrow = R.window_summaries(holes, TWO, targets, windows).drop("method")
    frame = R.rolling_seasonal_summary(holes, TWO, windows).where(F.col("ts").cast("date").isin(targets))
    long = frame.select(
        "station",
        F.unix_date(F.col("ts").cast("date")).alias("target_day"),
        F.hour("ts").alias("season"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(w).alias("window"), F.col(f"m1_w{w}").alias("m1"), F.col(f"m2_w{w}").alias("m2"))
                    for w in windows
                ]
            )
        ).alias("cells"),
    ).select("station", "target_day", "season", "cells.*")

    def rounded(df):
        return df.select("station", "target_day", "season", "window", F.round("m1", 8), F.round("m2", 8))

    assert rounded(arrow).exceptAll(rounded(long)).count() == 0
    assert rounded(long).exceptAll(rounded(arrow)).count() == 0


def test_chunks_do_not_change_the_result(synthetic, monkeypatch):
    targets = [f"2024-02-{d:02d}" for d in range(1, 25)]
    whole = R.window_summaries(synthetic, TWO, targets, [3, 8]).collect()
    monkeypatch.setattr(R, "MAX_CELLS", 1500)
    pieces = R.window_summaries(synthetic, TWO, targets, [3, 8]).collect()
    assert sorted(whole) == sorted(pieces) and len(whole) == 3 * 24 * 2 * 24


def test_median_over_windows(panel):
    # summaries of the four windows: 4, missing, 10, 6 -> 6
    assert R.middle(np.array([[4.0], [np.nan], [10.0], [6.0]]), 0)[0] == 6.0


def test_no_reading_after_the_cut_is_used(synthetic):
    origin = "2024-02-15"
    changed = synthetic.withColumn("m1", F.when(F.col("ts") >= "2024-02-14", -1.0).otherwise(F.col("m1")))
    a, b = (
        R.median_of_medians(df, TWO, [origin], {"f": [3, 5]}, fill=fill).orderBy("station", "horizon").collect()
        for df, fill in ((synthetic, "day+mean"), (changed, "day+mean"))
    )
    assert a == b and len(a) == 3 * 48


def test_origins_in_one_job_equal_single_ones(synthetic):
    families = {"s": [3, 5], "l": [3, 5, 8, 13]}
    origins = ["2024-02-10", "2024-02-11", "2024-02-20"]
    together = R.median_of_medians(synthetic, TWO, origins, families, methods=["median", "mean"])
    assert together.count() == 3 * 3 * 48 * 2 * 2
    alone = R.median_of_medians(synthetic, TWO, [origins[1]], families, methods=["median", "mean"])
    assert alone.exceptAll(together).count() == 0


def test_grid_is_complete_and_clipped(panel):
    df = panel([("a", f"2024-01-{d:02d} 00:00:00", -5.0) for d in range(1, 10)] + [("b", "2024-01-01 00:00:00", 1.0)])
    forecast = R.median_of_medians(df, DAILY, ["2024-01-09"], {"f": [3, 4]})
    grid = B.on_grid(forecast, df, DAILY, "2024-01-09", horizon=2)
    assert sorted((r.station, r.horizon, r.m1) for r in grid.collect()) == [
        ("a", 0, 0.0), ("a", 1, 0.0), ("b", 0, 0.0), ("b", 1, 0.0),
    ]


def test_families():
    assert window_family("golden_4") == [11, 18, 30, 48]
    assert len(window_family("fib_9")) == 9 and len(WINDOW_FAMILIES) == 10


def test_bad_arguments(days):
    with pytest.raises(ValueError):
        R.window_summaries(days, DAILY, ["2024-01-11"], [4], methods=["mode"])
    with pytest.raises(ValueError):
        R.median_of_medians(days, DAILY, ["2024-01-11"], {"f": [4]}, fill="zero")


def test_pieces_are_bounded_and_hold_whole_stations(monkeypatch):
    """A task never gathers more than a bounded piece, however many stations it has (rolling_summary_golden)."""
    monkeypatch.setattr(R, "MAX_ROWS", 100)
    lengths = [7, 30, 1, 250, 3, 60] * 20
    rows = pa.RecordBatch.from_pydict({
        "station": pa.array(np.repeat(np.arange(len(lengths)), lengths)),
        "_n": pa.array(np.concatenate([np.arange(1, n + 1) for n in lengths])),
    })
    pieces = list(R._whole_stations(rows.slice(i, 40) for i in range(0, rows.num_rows, 40)))
    assert sum(p.num_rows for p in pieces) == rows.num_rows and len(pieces) > 15
    assert all(p.column("_n")[0].as_py() == 1 for p in pieces) and max(p.num_rows for p in pieces) < 100 + 250 + 40
    assert pa.Table.from_batches(pieces).column("station").to_pylist() == rows.column("station").to_pylist()
