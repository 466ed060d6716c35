import pytest
from pyspark.sql import functions as F

from panelcast.functions.columns import at_hour, clip_missing, number, shift_hours
from panelcast.operators import panel as P
from panelcast.spec import PanelSpec, day_number

ONE = PanelSpec(measures=("m1",))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_dedupe_first_and_last(spark):
    df = spark.createDataFrame([("k", 0, 1.0), ("k", 1, 2.0), ("j", 1, 5.0)], "k string, rank int, v double")
    assert rows(P.dedupe(df, ["k"], ["rank"]).select("k", "v")) == [("j", 5.0), ("k", 1.0)]
    assert rows(P.dedupe(df, ["k"], ["rank"], keep="last").select("k", "v")) == [("j", 5.0), ("k", 2.0)]
    with pytest.raises(ValueError):
        P.dedupe(df, ["k"], ["rank"], keep="any")


def test_dedupe_collapses_copies_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("'hot' AS k", "id AS seq", "cast(id AS double) AS v")
    once = P.dedupe(df, ["k"], ["seq"])
    plan = once._jdf.queryExecution().toString()
    assert "Window" not in plan and "partial_min" in plan
    assert rows(once) == [("hot", 0, 0.0)]


def test_spine_is_complete(panel):
    df = panel([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 02:00:00", 2.0), ("b", "2024-01-01 01:00:00", 3.0)])
    full = P.to_spine(df, ONE)
    assert full.count() == 6 and full.where("m1 IS NULL").count() == 3
    assert full.select("station", "ts").distinct().count() == 6


def test_spine_with_given_bounds_and_stations(spark, panel):
    df = panel([("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 01:30:00", 9.0)])
    names = spark.createDataFrame([("a",), ("z",)], "station string")
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-01 00:00:00", "2024-01-01 02:00:00"))
    full = P.to_spine(df, ONE, start=lo, end=hi, stations=names)
    assert full.count() == 6  # the reading at half past is off the grid
    assert full.where("m1 = 9").count() == 0


def test_spine_joins_nothing_and_keeps_odd_rows(panel):
    """The grid is never a join's side, so no guess of its size can broadcast it (fold_score_spread)."""
    rows_in = [("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 01:00:00", 2.0), ("b", "2024-01-01 00:00:00", None),
               (None, "2024-01-01 03:00:00", 5.0), ("a", "2024-01-01 02:30:00", 9.0), ("c", None, 4.0)]
    full = P.to_spine(panel(rows_in), ONE)
    known = full.where("m1 IS NOT NULL")
    assert "Join" not in known._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.m1 for r in known.collect()) == [1.0, 2.0]
    assert full.count() == 4 * 4 + 1 and full.where("station IS NULL AND m1 IS NULL").count() == 4


def test_daily_spine(panel):
    daily = PanelSpec(measures=("m1",), step="day")
    df = panel([("a", "2024-02-27 00:00:00", 1.0), ("a", "2024-03-01 00:00:00", 2.0)])
    assert P.to_spine(df, daily).count() == 4


def test_merge_sources(panel):
    primary = panel([("a", "2024-01-01 00:00:00", None), ("a", "2024-01-01 01:00:00", 3.0)])
    other = panel([("a", "2024-01-01 00:00:00", 7.0), ("a", "2024-01-01 01:00:00", 9.0)])
    assert [r.m1 for r in P.merge_sources(primary, other, ONE).orderBy("ts").collect()] == [7.0, 3.0]


def test_clean_and_clip(spark):
    df = spark.createDataFrame(
        [("a", "20180101", 0, "NaT"), ("a", "20180101", 1, "nan"), ("a", "20180101", 2, "-2"), ("a", "20180101", 3, "5")],
        "station string, date string, hour int, m1 string",
    )
    out = df.select(number("m1").alias("n"), clip_missing("m1").alias("c")).collect()
    assert [r.n for r in out] == [None, None, -2.0, 5.0]
    assert [r.c for r in out] == [0.0, 0.0, 0.0, 5.0]
    utc = df.select(shift_hours(at_hour("date", "hour"), -8).cast("string").alias("t")).first().t
    assert utc == "2017-12-31 16:00:00"


def test_clean_renames_and_shifts(spark):
    raw = spark.createDataFrame([("a", "2018-01-01 00:00:00", "1.5")], ["id", "when", "PM2.5"])
    out = P.clean(raw, ONE, {"id": "station", "when": "ts", "PM2.5": "m1", "never": "x"}, utc_offset_hours=8).first()
    assert out.m1 == 1.5 and str(out.ts) == "2017-12-31 16:00:00"
    with pytest.raises(ValueError):
        P.clean(raw, ONE)


def test_history_cut(panel):
    df = panel([("a", f"2024-01-{d:02d} {h:02d}:00:00", float(d)) for d in range(1, 11) for h in (0, 15)])
    cut = P.history_cut(df, ONE, "2024-01-10", history_days=3, cut_hours=9)
    assert [str(r.ts) for r in cut.orderBy("ts").collect()][0] == "2024-01-06 15:00:00"
    assert str(cut.agg(F.max("ts")).first()[0]) == "2024-01-09 15:00:00"


def test_complete_case_ignores_absent_series(panel):
    spec = PanelSpec(measures=("m1", "m2"), absent={"m2": ("b",)})
    df = panel([("a", "2024-01-01 00:00:00", 1.0, None), ("b", "2024-01-01 00:00:00", 1.0, None)], ("m1", "m2"))
    assert [r.station for r in P.complete_case(df, spec).collect()] == ["b"]
    assert P.series(df, spec).count() == 3


def test_wide_round_trip(panel):
    spec = PanelSpec(measures=("m1", "m2"))
    df = panel([("a", "2024-01-01 00:00:00", 1.0, 2.0), ("b", "2024-01-01 00:00:00", None, 4.0)], ("m1", "m2"))
    wide = P.rows_to_station_columns(df, spec, ["a", "b"])
    assert wide.count() == 2 and set(wide.columns) == {"ts", "type", "a", "b"}
    back = P.station_columns_to_rows(wide, spec, ["a", "b", "not_there"])
    assert rows(back) == rows(df)


def test_new_rows_and_scatter(panel):
    old = panel([("a", "2024-01-01 00:00:00", 1.0)])
    new = panel([("a", "2024-01-01 00:00:00", 5.0), ("a", "2024-01-01 01:00:00", 6.0)])
    assert [r.m1 for r in P.new_rows(new, old, ONE.keys).collect()] == [6.0]
    assert [r.m1 for r in P.scatter_update(old, new, ONE.keys, ["m1"]).collect()] == [5.0]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "panel")
    spark.sql("SELECT 'a' AS station, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts, 1.0D AS m1, 2.0D AS m2").write.parquet(path)
    cut = P.in_range(spark.read.parquet(path), ONE, "2024-01-01", "2024-01-02").select("station", "m1")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "m2" not in plan


def test_spec_checks():
    with pytest.raises(ValueError):
        PanelSpec(step="minute")
    with pytest.raises(ValueError):
        PanelSpec(measures=())
    assert day_number("1970-01-11") == 10
