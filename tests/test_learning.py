import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import curve as C, features as X, net as N, pooled as P, score as S
from panelcast.session import write_and_read
from panelcast.spec import PanelSpec, day_number

TWO = PanelSpec(measures=("m1", "m2"))
ABSENT = PanelSpec(measures=("m1", "m2"), absent={"m2": ("c",)})


def test_label_split_spans(synthetic):
    row = X.history_label_split(synthetic, TWO, ["2024-01-10"], 2).where("station = 'a' AND measure = 'm1'").first()
    values = [r.m1 for r in synthetic.where("station = 'a'").orderBy("ts").collect()]
    at = 9 * 24
    assert list(row.x) == values[at - 48 : at]
    assert list(row.y) == values[at + 24 : at + 72]


def test_splits_without_history_or_label_are_left_out(synthetic):
    out = X.history_label_split(synthetic, TWO, ["2024-01-02", "2024-01-03", "2024-02-28", "2024-02-27"], 2)
    assert {r.split_day for r in out.select("split_day").distinct().collect()} == {
        day_number("2024-01-03"), day_number("2024-02-27")
    }
    later = X.history_label_split(synthetic, TWO, ["2024-03-01"], 2, labels=False)
    assert later.count() == 6 and "y" not in later.columns


def test_gaps_keep_their_place(synthetic):
    holes = synthetic.withColumn("m1", F.when(F.hour("ts") != 3, F.col("m1")))
    row = X.history_label_split(holes, TWO, ["2024-01-10"], 1).where("measure = 'm1'").first()
    assert len(row.x) == 24 and row.x[3] is None and row.x[4] is not None


def test_supervised_shape(synthetic):
    splits = X.shifted_splits("2024-02-10", 3, 2)
    rows = X.supervised(synthetic, ABSENT, splits, 3, [3, 5], median_shifts=2, group=F.col("station") == "b")
    assert rows.count() == 3 * 5  # station c has no second measure
    one = rows.where("station = 'b' AND measure = 'm2'").first()
    assert (len(one.x), len(one.med), len(one.y)) == (72, 2 * 2 * 24, 48)
    assert (one.is_m1, one.is_m2, one.is_group) == (0, 1, 1)


def test_standardize_and_back(panel, synthetic):
    df = panel([("a", f"2024-01-01 {h:02d}:00:00", v) for h, v in enumerate([1.0, 3.0, None])])
    one = PanelSpec(measures=("m1",))
    scaled, _ = X.standardize(df, one)
    assert [r.m1 for r in scaled.orderBy("ts").collect()] == [-1.0, 1.0, None]
    scaled, scalers = X.standardize(synthetic, TWO)
    back = X.inverse(scaled, scalers, TWO).withColumnRenamed("m1", "again")
    worst = synthetic.join(back.select("station", "ts", "again"), ["station", "ts"])
    assert worst.agg(F.max(F.abs(F.col("m1") - F.col("again")))).first()[0] < 1e-9


def test_folds_are_even_and_disjoint(spark):
    rows = spark.range(37 * 4).selectExpr("concat('s', id % 37) AS station")
    folds = X.group_folds(rows, "station", 5)
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [7, 7, 7, 8, 8] and folds.select("station").distinct().count() == 37


@pytest.mark.parametrize("seed", range(40))
def test_dealing_goes_to_the_lightest_fold(seed):
    r = np.random.default_rng(seed)
    k = int(r.integers(1, 7))
    sizes = sorted(set(r.integers(1, [3, 30, 1000][seed % 3], 12).tolist()), reverse=True)
    runs = [(s, int(r.integers(1, 40))) for s in sizes]
    loads, expected = [0] * k, []
    for size, count in runs:
        for _ in range(count):
            fold = loads.index(min(loads))
            loads[fold] += size
            expected.append(fold)
    got = []
    for (size, starts, turns), (_, count) in zip(X.deal(runs, k), runs, strict=True):
        for place in range(count):
            at = max(i for i, s in enumerate(starts) if s <= place)
            got.append(turns[at][(place - starts[at]) % len(turns[at])])
    assert got == expected


def test_folds_of_unequal_groups_are_balanced(spark):
    rows = spark.range(40).selectExpr("concat('g', id) AS station", "explode(sequence(1, int(id * id) + 1)) AS x").unionByName(spark.range(3000).selectExpr("null AS station", "1 AS x"))
    folds = X.group_folds(rows, "station", 4)
    assert folds.count() == 41 and folds.where("station IS NULL").first().fold == 0
    loads = [x["n"] for x in rows.join(folds, rows.station.eqNullSafe(folds.station)).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert max(loads) - min(loads) < 400 and sum(loads) == rows.count()


def test_calendar(spark, panel):
    one = PanelSpec(measures=("m1",))
    days = X.calendar(spark, {"x": ["2024-01-01"], "y": ["2024-01-01", "2024-01-02"]})
    df = panel([("a", f"2024-01-{d:02d} 04:00:00", 1.0) for d in (1, 2, 3)])
    assert [r.holiday for r in X.with_calendar(df, one, days).orderBy("ts").collect()] == ["x+y", "y", None]


@pytest.mark.parametrize("penalty", ["laplace", "ridge"])
def test_curve_beats_the_level(synthetic, penalty):
    origins = ["2024-02-15", "2024-02-20"]
    forecast = C.to_wide(C.curve_forecast(synthetic, ABSENT, origins, 40, 0.05, 10, penalty=penalty), ABSENT)
    assert forecast.count() == 2 * 3 * 48
    assert forecast.where("m2 IS NULL").select("station").distinct().collect()[0][0] == "c"
    truth = S.truth(synthetic, ABSENT, origins)
    level = synthetic.where("ts < '2024-02-14'").groupBy("station").agg(F.avg("m1").alias("m1"), F.avg("m2").alias("m2"))
    flat = truth.select("origin", "station", "horizon").join(level, "station")
    curve, mean = (S.mean_scores(S.score_grid(truth, p, ABSENT), by=[]).first().score for p in (forecast, flat))
    assert curve < 0.5 * mean


def test_curve_ignores_what_follows_the_cut(synthetic):
    changed = synthetic.withColumn("m1", F.when(F.col("ts") > "2024-02-14 15:00:00", 1e6).otherwise(F.col("m1")))
    a, b = (
        C.curve_forecast(df, TWO, ["2024-02-15"], 30, 0.05, 5).orderBy("station", "measure", "horizon").collect()
        for df in (synthetic, changed)
    )
    assert a == b


def test_strong_penalty_removes_slope_changes():
    t = np.arange(400) / 24.0
    y = np.where(t < 8, t, 16 - t) + 20
    loose = C.fit_curve(t, y, t, 10.0, 10, 24)
    stiff = C.fit_curve(t, y, t, 1e-6, 10, 24)
    assert np.abs(loose - y).max() < 0.5 < np.abs(stiff - y).max()


def hard_series(seed):
    r = np.random.default_rng(seed)
    t = np.sort(r.choice(475 * 24, [2, 3, 7, 40, 400, 6000][seed % 6], replace=False)) / 24.0
    kinds = [np.full(len(t), 7.0), np.zeros(len(t)), r.normal(size=len(t)) * 1e-9 + 5, np.cumsum(r.normal(size=len(t))) * 100, np.abs(t - 200) + r.normal(size=len(t))]
    return t, kinds[seed % 5]


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("strength", [0.001, 0.5])
def test_slope_changes_reach_the_duality_gap(seed, strength):
    """Few points, equal values, huge and tiny scales, 67 changes: the search ends, near the minimum."""
    t, v = hard_series(seed)
    model = C.fit_model(t, v, C.CurveShape(475, strength, 67), 24)
    assert model["gap"] <= 1e-8 and np.isfinite(C.curve_at(model, t, 24)).all()


def test_lasso_meets_the_conditions_of_its_minimum():
    r = np.random.default_rng(7)
    x = np.maximum(np.linspace(0, 1, 300)[:, None] - np.linspace(0, 0.8, 68)[1:], 0)
    y = x @ np.where(r.random(67) < 0.1, r.normal(size=67), 0) + 0.05 * r.normal(size=300)
    for weight in (1e-3, 0.1, 1.0, 100.0):
        d, gap = C.lasso(x, y, weight)
        slope = x.T @ (y - x @ d)
        assert gap <= 1e-10
        assert np.abs(slope).max() <= weight + 1e-4 and np.allclose(slope[d != 0], weight * np.sign(d[d != 0]), atol=1e-4)


def test_curves_of_many_shapes_in_one_pass(synthetic):
    shapes = {1: C.CurveShape(30, 0.05, 5), 2: C.CurveShape(20, 0.5, 10), 3: C.CurveShape(30, 0.05, 5, "ridge")}
    models = write_and_read(C.curve_models(synthetic, ABSENT, ["2024-02-20", "2024-02-21"], shapes), "models")
    assert models.count() == 3 * 2 * 5 and models.where("status = 'fitted'").count() == 3 * 2 * 5
    together = C.predict_curves(models, ABSENT).where("num = 2").drop("num")
    alone = C.curve_forecast(synthetic, ABSENT, ["2024-02-20", "2024-02-21"], 20, 0.5, 10)
    assert together.exceptAll(alone).isEmpty() and together.count() == alone.count()
    off = C.optimality(models, synthetic, ABSENT, shapes).collect()
    assert len(off) == 3 * 2 * 5 and max(r.violation for r in off) < 1e-6


def test_gradient_of_the_net():
    rng = np.random.default_rng(1)
    shapes = N.layer_shapes(6, (5, 4, 4, 3), 2)
    w = N.initial_weights(shapes, 0) + rng.normal(size=sum(r * c for r, c in shapes)) * 0.05
    x, y = rng.normal(size=(8, 6)), rng.uniform(1, 2, size=(8, 2))
    y[0, 1] = np.nan
    out, inputs, masks = N.forward(x, w, shapes)
    loss, slope = N.loss_and_slope(y, out)
    gradient = N.backward(slope, inputs, masks, w, shapes)
    for i in rng.choice(len(w), 25, replace=False):
        step = np.zeros_like(w)
        step[i] = 1e-6
        up, down = (N.loss_and_slope(y, N.forward(x, w + s, shapes)[0])[0].sum() for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_net_learns_and_repeats(synthetic):
    rows = X.supervised(synthetic, TWO, X.shifted_splits("2024-02-10", 6), 2, [3])
    train = write_and_read(rows.join(X.group_folds(rows, "station", 3), "station"), "training")
    setting = N.NetSetting(units=(8, 8, 8, 8), dropout=0.1, batch_rows=5, patience=3)
    net = N.train_net(train, TWO, setting, k=3)
    losses = [[h["val"] for h in net.history if h["fold"] == f] for f in range(3)]
    for held in losses:  # patience ended each fold, not a number of epochs
        assert len(held) < setting.epochs and len(held) - 1 - int(np.argmin(held)) >= setting.patience and min(held) < held[0]
    again = N.train_net(train, TWO, setting, k=3)
    assert all((a == b).all() for a, b in zip(net.weights, again.weights))
    # several shards: their steps are averaged, and the net still learns
    shards = N.train_net(train, TWO, N.NetSetting(units=(8, 8, 8, 8), dropout=0.1, batch_rows=5, patience=3, shard_rows=9), k=3)
    assert min(h["val"] for h in shards.history) < shards.history[0]["val"]
    test = X.supervised(synthetic, TWO, ["2024-02-13"], 2, [3], labels=False)
    assert N.net_forecast(net, test, TWO).where("value IS NOT NULL").count() == 6 * 48


def test_one_shard_is_mini_batch_training():
    """An epoch over one shard equals Adam over its batches in the seeded order."""
    rng, setting = np.random.default_rng(3), N.NetSetting(units=(3, 3, 3, 3), dropout=0.0, batch_rows=4)
    shapes = N.layer_shapes(5, setting.units, 2)
    x, y = rng.normal(size=(10, 5)), rng.uniform(1, 2, size=(10, 2))
    w = N.initial_weights(shapes, 0)
    start = N._State(w, np.zeros_like(w), np.zeros_like(w), 0, 0.01, 10)
    got, first, second, steps, _ = N._fold_steps(x, y, start, shapes, setting, np.random.default_rng(5))
    order, moments, expected = np.random.default_rng(5).permutation(10), (np.zeros_like(w), np.zeros_like(w)), w.copy()
    for i, part in enumerate((order[:4], order[4:8], order[8:])):
        out, inputs, masks = N.forward(x[part], expected, shapes)
        gradient = N.backward(N.loss_and_slope(y[part], out)[1], inputs, masks, expected, shapes) / len(part)
        expected = N._adam(expected, gradient, moments, i + 1, 0.01, setting)
    assert steps == 3 and (got == expected).all() and (first == moments[0]).all() and not start.first.any()


def test_mini_batches_beat_one_step_an_epoch(synthetic):
    """The same twelve passes over the rows: many steps each lead further than one each."""
    rows = X.supervised(synthetic, TWO, X.shifted_splits("2024-02-17", 12), 2, [3])
    train = write_and_read(rows.join(X.group_folds(rows, "station", 3), "station"), "training")
    best = []
    for batch in (8, 10**6):
        net = N.train_net(train, TWO, N.NetSetting(units=(16, 16, 16, 16), dropout=0.0, batch_rows=batch, epochs=12), k=3)
        best.append(min(h["val"] for h in net.history))
    assert best[0] < best[1]


def test_pooled_ensemble(synthetic):
    forecast, scores = P.pooled_panel_forecast(
        synthetic, TWO, "2024-02-20", X.shifted_splits("2024-02-17", 5), 3, [3, 5], k=3, exclude=["c"]
    )
    wide = C.to_wide(forecast.withColumn("origin", F.date_from_unix_date(F.col("split_day") + 1)), TWO)
    assert wide.count() == 3 * 48 and wide.where("m1 IS NULL").count() == 0
    truth = S.truth(synthetic, TWO, ["2024-02-21"])
    assert S.mean_scores(S.score_grid(truth, wide, TWO), by=[]).first().score < 0.2
    assert scores.count() == 3


def test_boosted_imputer(synthetic, tmp_path):
    holes = synthetic.withColumn("m1", F.when((F.col("station") != "b") | (F.hour("ts") != 4), F.col("m1")))
    models = P.fit_neighbor_trees(holes, TWO, maxIter=5, maxDepth=3)
    P.save_models(models, str(tmp_path))
    loaded = P.load_models(str(tmp_path), TWO)
    filled = P.fill_from_trees(holes, TWO, loaded, max_missing=2)
    assert filled.where("m1 IS NULL").count() == 0 and filled.count() == holes.count()
    error = filled.withColumnRenamed("m1", "f").join(synthetic, ["station", "ts"]).where("station = 'b' AND hour(ts) = 4")
    assert error.agg(F.avg(F.abs(F.col("f") - F.col("m1")))).first()[0] < 8


def test_grid_search_picks_a_model(synthetic):
    few = synthetic.where("ts < '2024-01-15'")
    one = PanelSpec(measures=("m1",))
    models = P.fit_neighbor_trees(few, one, grid=[{"maxIter": 1}, {"maxIter": 4}], folds=2, maxDepth=2)
    assert models["m1"].stages[-1].getNumTrees == 4


def test_fold_medians_come_from_one_pass(spark, tmp_path):
    """The panel is not built again for every fold (fold_ensemble); a supplier without a known value stays."""
    from registry import learning

    rows = [(s, d, None if s == 2 else float(s * d % 7), None if s == 2 else float(d)) for s in (1, 2, 3) for d in (1, 2, 4, 9, 11)]
    items = spark.createDataFrame(rows, "l_suppkey long, d int, l_quantity double, l_extendedprice double")
    items.selectExpr("*", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(d) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = learning.fold_ensemble(spark, str(tmp_path))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r.station: (r.m1, r.m2, r.m3) for r in out.collect()}
    fold = {d: (19723 + d) % 5 for _, d, *_ in rows}
    for s in (1, 3):
        per_fold = [np.median([d for d in fold if fold[d] != f]) for f in range(5)]
        assert found[str(s)][1] == pytest.approx(np.mean(per_fold), abs=1e-6)
    assert found["2"] == (None, None, 1.0) and len(found) == 3
