import pytest
from pyspark.sql import functions as F

from panelcast.operators import score as S, seasonal as R
from panelcast.operators.seasonal import median_of_medians
from panelcast.plans import backtest as B
from panelcast.spec import PanelSpec

TWO = PanelSpec(measures=("m1", "m2"))


def metric(spark, pairs, fn):
    df = spark.createDataFrame(pairs, "a double, p double")
    return df.agg(fn(F.col("a"), F.col("p")).alias("s")).first().s


def test_smape_variants(spark):
    assert metric(spark, [(10.0, 20.0), (0.0, 0.0)], S.smape_official) == pytest.approx(1 / 3)
    assert metric(spark, [(10.0, 20.0), (4.0, None)], S.smape_official) is None
    assert metric(spark, [(10.0, 20.0), (4.0, None)], S.smape_skip_missing) == pytest.approx(2 / 3)
    assert metric(spark, [(10.0, -20.0), (0.0, 0.0)], S.smape_loss) == pytest.approx(2.0)
    assert metric(spark, [(10.0, 20.0), (10.0, 500.0)], lambda a, p: S.mae(a, p, clip=50.0)) == pytest.approx(30.0)
    assert metric(spark, [(10.0, 20.0), (None, 500.0)], lambda a, p: S.mae(a, p, clip=50.0)) == pytest.approx(10.0)


def grid(spark, rows):
    df = spark.createDataFrame(rows, "origin string, station string, horizon int, m1 double, m2 double")
    return df.withColumn("origin", F.col("origin").cast("date"))


def test_two_is_no_score_and_masking(spark):
    actual = grid(spark, [("2024-01-01", s, h, 5.0, 5.0) for s in "ab" for h in (0, 1)])
    predicted = grid(spark, [("2024-01-01", s, h, 0.0, 5.0) for s in "ab" for h in (0, 1)])
    scores = S.score_grid(actual, predicted, TWO, two_is_missing=True, ignore_stations=["b"])
    found = {(r.station, r.measure): r.score for r in scores.collect()}
    assert found == {("a", "m1"): None, ("a", "m2"): 0.0, ("b", "m1"): None, ("b", "m2"): None}
    kept = S.score_grid(actual, predicted, TWO)
    assert kept.where("measure = 'm1'").first().score == 2.0


def test_missing_forecast_row_is_not_dropped(spark):
    actual = grid(spark, [("2024-01-01", "a", h, 5.0, 5.0) for h in (0, 1)])
    predicted = grid(spark, [("2024-01-01", "a", 0, 5.0, 5.0)])
    assert [r.score for r in S.score_grid(actual, predicted, TWO).collect()] == [None, None]


def test_truth_numbers_horizons(synthetic):
    t = S.truth(synthetic, TWO, ["2024-02-01", "2024-02-02"], gap_days=1)
    counts = {str(r.origin): (r["count"]) for r in t.groupBy("origin").count().collect()}
    assert counts == {"2024-02-01": 144, "2024-02-02": 144}
    assert t.agg(F.min("horizon"), F.max("horizon")).first()[:] == (0, 47)


def test_complete_case_truth(panel):
    spec = PanelSpec(measures=("m1", "m2", "m3"))
    df = panel([("a", "2024-01-01 00:00:00", 1.0, None, 3.0)], spec.measures)
    assert S.truth(df, spec, ["2024-01-01"], complete=True).count() == 0
    assert S.truth(df, spec, ["2024-01-01"]).count() == 1


def test_alignment_of_the_two_modes(synthetic):
    origins = ["2024-02-10", "2024-02-11"]
    forecast = S.truth(synthetic, TWO, origins)  # a perfect forecast of the origin's own days
    perfect = B.backtest(forecast, synthetic, TWO, origins)
    assert perfect.where("score <> 0").count() == 0 and perfect.count() == 12
    late = B.backtest(forecast, synthetic, TWO, origins, align="legacy")
    assert late.where("score > 0").count() > 0
    with pytest.raises(ValueError):
        B.backtest(forecast, synthetic, TWO, origins, align="other")


def test_scores_lie_between_0_and_2(synthetic):
    origins = [f"2024-02-{d:02d}" for d in range(5, 15)]
    scores = B.backtest_medians(synthetic, synthetic, TWO, origins, {"f": [3, 5, 8]})
    low, high, n = scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
    assert 0 <= low <= high <= 2 and n == 10 * 3 * 2


def test_bootstrap_draws_without_replacement(spark):
    daily = spark.range(30).selectExpr("cast(id AS string) AS origin", "cast(id AS double) AS score")
    a = S.bootstrap(daily, reps=5, days=30).collect()
    assert all(r.score == 14.5 for r in a)
    b, c = (sorted(S.bootstrap(daily, reps=5, days=10, seed=3).collect()) for _ in range(2))
    assert b == c and len({r.score for r in b}) > 1


def test_leaderboard_and_best(spark):
    rows = [("x", "d1", 0.2), ("x", "d2", 0.4), ("y", "d1", 0.1), ("y", "d2", 0.3), ("z", "d1", None)]
    scores = spark.createDataFrame(rows, "family string, origin string, score double")
    board = S.leaderboard(scores, ["family"])
    assert [r.family for r in board.collect()] == ["y", "x", "z"]
    assert S.best_setting(board, ["family"]).first().family == "y"


def test_score_tables(spark):
    scores = spark.createDataFrame(
        [("d1", "a", "m1", 0.5), ("d1", "a", "m2", 0.7)], "origin string, station string, measure string, score double"
    )
    wide = S.wide_scores(scores, TWO, ["a-m1", "a-m2"]).first()
    assert wide.smape == pytest.approx(0.6) and wide["a-m1"] == 0.5
    assert S.merge_scores(scores, scores.drop("measure")).count() == 4
    assert S.merge_scores(scores, scores).count() == 2


def test_forecast_beats_the_overall_mean(synthetic):
    origins = [f"2024-02-{d:02d}" for d in range(10, 20)]
    medians = median_of_medians(synthetic, TWO, origins, {"f": [7, 14]})
    truth = S.truth(synthetic, TWO, origins)
    level = synthetic.where("ts < '2024-02-10'").groupBy("station").agg(F.avg("m1").alias("m1"), F.avg("m2").alias("m2"))
    flat = truth.select("origin", "station", "horizon").join(level, "station")
    def mean(pred):
        return S.mean_scores(S.score_grid(truth, pred, TWO), by=[]).first().score

    assert mean(medians) < 0.6 * mean(flat)


def test_a_setting_with_gaps_does_not_win(spark):
    """Setting b fails on the hard cell; on the cells that both score, a is the better one."""
    rows = [("a", "d1", "s", "m1", 0.1), ("a", "d1", "t", "m1", 0.9), ("b", "d1", "s", "m1", 0.2), ("b", "d1", "t", "m1", None)]
    board = S.leaderboard(spark.createDataFrame(rows, "name string, origin string, station string, measure string, score double"), ["name"])
    assert [(r.name, r.score, r.cells) for r in board.collect()] == [("a", 0.1, 1), ("b", 0.2, 1)]


def test_bootstrap_of_a_difference(spark):
    days = [(f"d{i}", f, s) for i in range(40) for f, s in (("a", 0.5 + 0.01 * (i % 5)), ("b", 0.6))] + [("d99", "a", 9.0)]
    daily = spark.createDataFrame(days, "origin string, family string, score double")
    one = S.bootstrap_difference(daily, "family", "a", "b", 300).first()
    assert one.days == 40 and one.difference == pytest.approx(-0.08) and one.low < one.difference < one.high < -0.07
    assert S.bootstrap_difference(daily.repartition(7), "family", "a", "b", 300).first().low == pytest.approx(one.low)
    wide = S.bootstrap_difference(daily, "family", "a", "b", 300, level=0.99).first()
    assert wide.low <= one.low and wide.high >= one.high
    draws = spark.range(20_000).select(S._poisson(F.col("id").cast("string")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert draws[0] == pytest.approx(1, abs=0.03) and draws[1] == pytest.approx(1, abs=0.05)


def test_packed_forecasts_score_as_the_long_ones(spark, synthetic):
    """A row per origin and station meets the truth (settings_grid), odd rows of both sides included."""
    holes = synthetic.withColumn("m1", F.when(F.pmod(F.hash("station", "ts"), F.lit(5)) > 0, F.col("m1")))
    late = holes.where("station = 'a' AND ts >= '2024-02-10'").withColumn("station", F.lit("late"))
    nameless = holes.where("station = 'b'").withColumn("station", F.lit(None).cast("string"))
    raw = holes.union(late).union(nameless).union(holes.where("ts = '2024-02-10 05:00:00'"))
    train = holes.union(nameless)
    origins, families, methods = ["2024-02-10", "2024-02-12"], {"f": [3, 5], "g": [4]}, ["median", "mean"]
    packed = R.packed_medians(train, TWO, origins, families, methods)
    assert packed.count() == 2 * 4 and packed.first().m1.__len__() == 48 * 2 * 2
    by = ["origin", "family", "method"]
    for fill in (None, "day+mean"):
        long = median_of_medians(train, TWO, origins, families, methods, fill)
        one = B.backtest(long, raw, TWO, origins, by=by)
        both = [df.withColumn("score", F.round("score", 9)) for df in (one, B.backtest_medians(train, raw, TWO, origins, families, methods, fill))]
        assert both[0].columns == both[1].columns
        assert both[0].exceptAll(both[1]).count() == 0 and both[1].exceptAll(both[0]).count() == 0


def test_leaderboard_reads_the_scores_once(spark):
    """Sums are stored by how many settings score a cell (best_setting, settings_leaderboard)."""
    scores = spark.range(60).selectExpr(
        "if(id % 2 = 0, 'x', 'y') AS family", "concat('d', id div 20) AS origin", "cast(id div 2 % 10 AS string) AS station",
        "if(id = 7, null, id / 100.0D) AS score",
    )
    board = S.leaderboard(scores, ["family"])
    assert "Range" not in board._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.family, r.cells) for r in board.collect()] == [("x", 29), ("y", 29)]
