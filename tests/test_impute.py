import pytest
from pyspark.sql import functions as F

from panelcast.operators import impute as I
from panelcast.spec import PanelSpec

ONE = PanelSpec(measures=("m1",))


def values(df):
    return [r.m1 for r in df.orderBy("station", "ts").collect()]


def test_day_fill_stays_in_its_day(panel):
    day1 = [("a", f"2024-01-01 {h:02d}:00:00", v) for h, v in enumerate([None, 3.0, None, None, 7.0])]
    day2 = [("a", f"2024-01-02 {h:02d}:00:00", None) for h in range(3)]
    out = values(I.fill_within(panel(day1 + day2), ONE, "day"))
    assert out == [3.0, 3.0, 3.0, 3.0, 7.0, None, None, None]


def test_season_fill(panel):
    df = panel([("a", f"2024-01-{d:02d} 05:00:00", v) for d, v in enumerate([None, 2.0, None, 6.0], 1)])
    assert values(I.fill_within(df, ONE, "season")) == [2.0, 2.0, 2.0, 6.0]
    assert values(I.fill_within(df, ONE, "season", direction="forward")) == [None, 2.0, 2.0, 6.0]


def test_mean_and_zero(panel):
    df = panel(
        [("a", f"2024-01-01 {h:02d}:00:00", v) for h, v in enumerate([1.0, None, 3.0])]
        + [("b", f"2024-01-01 {h:02d}:00:00", v) for h, v in enumerate([None, 10.0])]
    )
    assert values(I.fill_mean(df, ONE)) == [1.0, 2.0, 3.0, 10.0, 10.0]
    assert values(I.fill_zero(df, ONE)) == [1.0, 0.0, 3.0, 0.0, 10.0]


def five_stations(panel, missing):
    """Two complete hours to learn from, then one with ``missing`` stations out."""
    names = "abcde"
    rows = [(s, f"2024-01-01 {h:02d}:00:00", float(10 * h + i)) for i, s in enumerate(names) for h in range(4)]
    rows += [(s, "2024-01-01 04:00:00", None if i < missing else 40.0 + i) for i, s in enumerate(names)]
    return panel(rows)


@pytest.mark.parametrize("missing, filled", [(2, True), (3, False)])
def test_gate(panel, missing, filled):
    out = I.fill_from_neighbors(five_stations(panel, missing), ONE, max_missing=3)
    assert (out.where("m1 IS NULL").count() == 0) is filled


def test_gate_as_fraction(panel):
    assert I.fill_from_neighbors(five_stations(panel, 2), ONE, 0.5).where("m1 IS NULL").count() == 0
    assert I.fill_from_neighbors(five_stations(panel, 2), ONE, 0.4).where("m1 IS NULL").count() == 2


def test_neighbors_stay_within_their_city(panel):
    df = five_stations(panel, 0).withColumn("city", F.when(F.col("station") < "c", "x").otherwise("y"))
    viewed = I.with_neighbors(df, ONE, within=["city"]).where("station = 'a' AND hour(ts) = 1").first()
    assert viewed.m1_others == 11.0 and viewed.m1_stations == 2


def test_line_recovers_a_linear_relation(panel):
    out = I.fill_from_neighbors(five_stations(panel, 1), ONE, max_missing=3)
    assert out.where("station = 'a' AND hour(ts) = 4").first().m1 == pytest.approx(40.0)


def test_cascade_keeps_known_values_and_leaves_no_gap(synthetic):
    spec = PanelSpec(measures=("m1", "m2"))
    holes = synthetic.withColumn("m1", F.when(F.pmod(F.hash("station", "ts"), F.lit(5)) > 0, F.col("m1")))
    done = I.impute(holes, spec, ["neighbors", "day", "season", "mean", "zero"], max_missing=2)
    assert done.where("m1 IS NULL OR m2 IS NULL").count() == 0
    both = holes.where("m1 IS NOT NULL").join(done.withColumnRenamed("m1", "after"), ["station", "ts"])
    assert both.where("m1 <> after").count() == 0


def test_step_lists():
    assert I.main_residual_steps("fwbw_day", "mean") == ["day", "mean"]
    assert I.main_residual_steps("hour", "zero") == ["season", "zero"]
    assert I.main_residual_steps("mean", "zero") == ["mean", "zero"]
    for bad in (("x", "mean"), ("day", "x")):
        with pytest.raises(ValueError):
            I.main_residual_steps(*bad)
    with pytest.raises(ValueError):
        I.step("guess")


def test_small_sides_are_broadcast_before_the_panel_moves(panel):
    """Sums by time and lines by station are counted, so no panel is shuffled to meet them (settings_grid)."""
    out = I.fill_from_neighbors(five_stations(panel, 1), ONE, max_missing=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
