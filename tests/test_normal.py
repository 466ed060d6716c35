import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import impute as I, normal as N
from panelcast.spec import PanelSpec

ONE = PanelSpec(measures=("m1",))


def em_by_hand(x, rounds, prior):
    """Textbook EM over rows: conditional means and covariances of the missing part."""
    center, scale = np.nanmean(x, 0), np.nanstd(x, 0)
    y = (x - center) / scale
    y = y[(~np.isnan(y)).any(1)]
    n, s = y.shape
    mean, cov = np.zeros(s), np.eye(s)
    for _ in range(rounds):
        full, extra = np.empty_like(y), np.zeros((s, s))
        for i, row in enumerate(y):
            o = ~np.isnan(row)
            b = cov[~o][:, o] @ np.linalg.inv(cov[o][:, o])
            full[i, o], full[i, ~o] = row[o], mean[~o] + b @ (row[o] - mean[o])
            extra[np.ix_(~o, ~o)] += cov[~o][:, ~o] - b @ cov[o][:, ~o]
        now = full.mean(0)
        second = (full - now).T @ (full - now) / n + extra / n
        mean, cov = now, (n * second + prior * np.eye(s)) / (n + prior)
    return center + scale * mean, cov, scale


def station_rows(seed=1, n=120, gone=0.25):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(5, 5))
    x = r.normal(size=(n, 5)) @ mix * [1, 2, 3, 10, 0.1] + [5, 0, 100, -3, 1]
    x += 0.1 * r.normal(size=x.shape)
    holes = np.where(r.random(x.shape) < gone, np.nan, x)
    holes[3] = np.nan
    times = [f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00" for i in range(n)]
    rows = [("abcde"[j], times[i], None if np.isnan(holes[i, j]) else float(holes[i, j])) for i in range(n) for j in range(5)]
    return x, holes, rows


@pytest.mark.parametrize("rounds", [1, 7])
def test_rounds_equal_em_by_hand(spark, panel, rounds):
    _, holes, rows = station_rows()
    models = N.fit_normal(panel(rows).repartition(4), ONE, rounds=rounds, tolerance=0.0).orderBy("place").collect()
    mean, cov, scale = em_by_hand(holes, rounds, 1.0)
    assert np.allclose([r.mean for r in models], mean) and np.allclose([r.row for r in models], cov) and np.allclose([r.scale for r in models], scale)
    assert not any(r.settled for r in models)


def test_fill_is_the_conditional_mean_and_beats_the_line(spark, panel):
    x, holes, rows = station_rows(3, 600, 0.2)
    df = panel(rows)
    models = N.fit_normal(df, ONE)
    assert models.where("NOT settled").isEmpty()
    filled = {(r.station, str(r.ts)): r.m1 for r in N.fill_from_normal(df, ONE, 4, models).collect()}
    lines = {(r.station, str(r.ts)): r.m1 for r in I.fill_from_neighbors(df, ONE, 4).collect()}
    m = models.orderBy("place").collect()
    mean, cov, scale = np.array([r.mean for r in m]), np.array([r.row for r in m]), np.array([r.scale for r in m])
    errors = {"normal": [], "line": []}
    for k, (station, ts, value) in enumerate(rows):
        i, j = divmod(k, 5)
        key = (station, ts)
        o = ~np.isnan(holes[i])
        if value is not None:
            assert filled[key] == value
        elif (~o).sum() < 4:
            z = cov[j, o] @ np.linalg.solve(cov[np.ix_(o, o)], (holes[i, o] - mean[o]) / scale[o])
            assert filled[key] == pytest.approx(mean[j] + scale[j] * z)
            errors["normal"].append(abs(filled[key] - x[i, j]) / scale[j])
            errors["line"].append(abs(lines[key] - x[i, j]) / scale[j])
        else:
            assert filled[key] is None
    assert np.mean(errors["normal"]) < 0.6 * np.mean(errors["line"])


def test_many_times_of_one_pattern_are_one_row(spark, panel):
    rows = [(s, f"2024-01-{d:02d} {h:02d}:00:00", float(i + h * d)) for i, s in enumerate("abc") for d in range(1, 29) for h in range(24)]
    df = panel(rows).repartition(8)
    known = {(r.measure, r.station): (r.mean, r.scale) for r in N.moments(df, ONE).collect()}
    held = N.patterns(N.times(df, ONE, list("abc"), known)).collect()
    assert len(held) == 1 and held[0].n == 28 * 24


def test_odd_panels(spark, panel):
    absent = PanelSpec(measures=("m1", "m2"), absent={"m2": ("b",)})
    rows = [(s, f"2024-01-01 {h:02d}:00:00", None if s == "c" else 1.0 if s == "a" else float(h), None if h == 2 else float(h)) for s in "abc" for h in range(8)]
    df = panel(rows, ("m1", "m2"))
    filled = N.fill_from_normal(df, absent, 3)
    by = {(r.station, r.ts.hour): (r.m1, r.m2) for r in filled.collect()}
    assert len(by) == 24 and by["c", 1][0] is None and by["b", 2][1] is None  # never reported, absent
    assert by["a", 2] == (1.0, None)  # nobody reports the second measure then
    part = N.fill_from_normal(df.withColumn("m1", F.when((F.col("station") != "b") | (F.hour("ts") != 4), F.col("m1"))), absent, 0.7)
    assert part.where("station = 'b' AND hour(ts) = 4 AND m1 IS NULL").isEmpty()
    assert I.impute(df, absent, ["normal", "mean", "zero"], max_missing=3).where("m1 IS NULL").isEmpty()
