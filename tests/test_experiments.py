from pyspark.sql import functions as F

from panelcast.operators import net as N
from panelcast.plans import experiments as E, predict as D
from panelcast.spec import PanelSpec

TWO = PanelSpec(measures=("m1", "m2"))
GATE = {"x": 2, "y": 2}


def test_sizes_of_the_grids(spark):
    medians = E.medians_settings()
    assert len(medians) == 160 and [s.num for s in medians] == list(range(1, 161))
    assert {s.city for s in E.chosen(medians, range(1, 81))} == {"beijing"}
    curves = E.curve_settings()
    assert len(curves) == 72 and len(E.net_settings()) == 2
    assert sum(s.history_days == 475 for s in curves) == 54
    assert E.settings_table(spark, curves).select("num").distinct().count() == 72
    assert len(E.chosen(curves, None)) == 72


def test_city_settings():
    settings = D.city_settings()
    assert settings["beijing"].windows == [11, 18, 30, 48, 78] and len(settings["london"].windows) == 9
    assert (settings["beijing"].strength, settings["london"].strength) == (0.003, 0.001)
    assert settings["beijing"].exclude == ("zhiwuyuan_aq",) and settings["london"].exclude == ()
    assert [s.city for s in E.net_settings()] == ["london", "beijing"]


def test_medians_run(synthetic, tmp_path):
    panels = {"x": synthetic.where("station < 'c'"), "y": synthetic}
    settings = [s for s in E.medians_settings(("x", "y")) if s.family in ("golden_4", "fib_5")]
    scores = E.run_medians(panels, TWO, settings, ["2024-02-20", "2024-02-21"], GATE)
    board = E.record(scores, settings, str(tmp_path))
    rows = board.collect()
    assert len(rows) == 32 and all(0 <= r.score <= 2 for r in rows)
    assert rows == sorted(rows, key=lambda r: r.score)
    # nothing is missing in the panel, so the fills change nothing
    by_num = {r.num: round(r.score, 9) for r in rows}
    kinds = {}
    for s in settings:
        kinds.setdefault((s.city, s.method, s.family), set()).add(by_num[s.num])
    assert all(len(v) == 1 for v in kinds.values())
    assert E.record(scores, settings, str(tmp_path)).count() == 32


def test_record_compares_on_the_same_days(spark, tmp_path):
    scores = spark.createDataFrame([(1, "d1", 0.2), (1, "d2", 0.9), (2, "d1", 0.3), (3, "d9", 0.0)], "num int, origin string, score double")
    settings = [E.CurveSetting(n, "x", 30, 0.05, 5) for n in (1, 2)]
    board = E.record(scores, settings, str(tmp_path)).collect()
    assert [(r.num, r.score) for r in board] == [(1, 0.2), (2, 0.3)]


def test_curve_run(synthetic):
    settings = [E.CurveSetting(1, "x", 30, 0.05, 5), E.CurveSetting(2, "x", 30, 0.001, 5)]
    scores = E.run_curves({"x": synthetic}, TWO, settings, ["2024-02-20"], GATE)
    assert sorted(r.num for r in scores.collect()) == [1, 2] and scores.where("score > 0.2").count() == 0


def test_pooled_run_masks_the_excluded_station(synthetic):
    broken = synthetic.withColumn("m1", F.when(F.col("station") != "c", F.col("m1")).otherwise(F.lit(1000.0)))
    setting = E.NetExperiment(0, "x", 3, "fib_5", 0.0, (8, 8, 8, 8), 10, shifts=4, median_shifts=1)
    scores = E.run_pooled({"x": broken}, TWO, [setting], ["2024-02-20"], GATE, exclude=["c"], folds=2).collect()
    assert len(scores) == 1 and scores[0].score < 0.2


def test_net_job_covers_the_grid(synthetic):
    setting = D.CitySetting(
        [3], 2, lag_history_days=2, shifts=4, median_shifts=1, folds=2, net=N.NetSetting((6, 6, 6, 6), epochs=2)
    )
    out = D.predict_cities({"x": synthetic}, TWO, "2024-02-20", {"x": setting}, "net")
    assert out.count() == 3 * 48 and out.where("m1 < 0 OR m1 IS NULL").count() == 0


def test_no_run_looks_ahead(synthetic):
    """Readings after the last forecast step's truth change no score, on a panel with gaps."""
    gaps = synthetic.withColumn("m1", F.when(F.pmod(F.hash("station", "ts"), F.lit(5)) > 0, F.col("m1")))
    late = gaps.withColumn("m1", F.when(F.col("ts") >= F.lit("2024-02-12").cast("timestamp_ntz"), F.col("m1") * 100).otherwise(F.col("m1")))
    medians = [s for s in E.medians_settings(("x",)) if s.learned and s.family == "golden_4"][:1]
    curve = [E.CurveSetting(1, "x", 30, 0.05, 5)]
    pooled = [E.NetExperiment(0, "x", 3, "fib_5", 0.0, (8, 8, 8, 8), 10, shifts=4, median_shifts=1)]
    runs = ((E.run_medians, medians, {}), (E.run_curves, curve, {}), (E.run_pooled, pooled, {"folds": 2}))
    for run, settings, options in runs:
        a, b = (run({"x": p}, TWO, settings, ["2024-02-09"], GATE, **options).first().score for p in (gaps, late))
        assert a == b and a is not None
