import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import boosted as B, impute as I
from panelcast.spec import PanelSpec

ONE = PanelSpec(measures=("m1",))


def panel_rows(seed, n, gone=0.2, stations="abcd"):
    r = np.random.default_rng(seed)
    base = r.normal(size=n)
    x = np.stack([np.sign(base) * k + base**2 + 0.2 * r.normal(size=n) for k in range(1, len(stations) + 1)], 1)
    holes = np.where(r.random(x.shape) < gone, np.nan, x)
    rows = [(s, f"2024-{1 + i // 600:02d}-{1 + i // 24 % 25:02d} {i % 24:02d}:00:00", None if np.isnan(holes[i, j]) else float(holes[i, j])) for i in range(n) for j, s in enumerate(stations)]
    return x, holes, rows


def split_by_hand(b, g, feature_edges, own, gap, l2, least):
    """Best (gain, feature, cut, gaps left) of one node by trying everything, and its left side."""
    top = None
    for f in range(b.shape[1]):
        if f == own:
            continue
        for cut in sorted(set(b[:, f].tolist()) - {gap}):
            for left in (False, True):
                side = np.where(b[:, f] == gap, left, b[:, f] <= cut)
                nl, nr = side.sum(), (~side).sum()
                if nl < least or nr < least:
                    continue
                gain = g[side].sum() ** 2 / (nl + l2) + g[~side].sum() ** 2 / (nr + l2) - g.sum() ** 2 / (len(g) + l2)
                key = (round(gain, 6), -f, -cut, not left)
                if gain > 1e-9 and (top is None or key > top[0]):
                    top = key, (f, cut, left), side
    return top


def tree_by_hand(b, g, own, gap, depth, l2, least, rate, out, rows):
    top = split_by_hand(b[rows], g[rows], None, own, gap, l2, least) if depth else None
    if top is None:
        out[rows] = -rate * g[rows].sum() / (len(rows) + l2)
        return
    side = top[2]
    for part in (rows[side], rows[~side]):
        tree_by_hand(b, g, own, gap, depth - 1, l2, least, rate, out, part)


@pytest.mark.parametrize("trees, depth", [(1, 2), (3, 3)])
def test_trees_equal_a_search_by_hand(spark, panel, monkeypatch, trees, depth):
    monkeypatch.setattr(B, "STORE_EVERY", 2)
    _, holes, rows = panel_rows(1, 300)
    df = panel(rows).repartition(4)
    models = {r.station: r for r in B.fit_boosted(df, ONE, trees, depth, bins=8, rate=0.5, least_rows=10).collect()}
    z = (holes - [models[s].mean for s in "abcd"]) / [models[s].scale for s in "abcd"]
    edges = [np.array(models[s].edges) for s in "abcd"]
    b = B.binned(z, edges, 8)
    for own, s in enumerate("abcd"):
        known = ~np.isnan(z[:, own])
        by_hand = np.zeros(len(z))
        for _ in range(trees):
            out = np.zeros(known.sum())
            tree_by_hand(b[known], (by_hand - z[:, own])[known], own, 8, depth, 1.0, 10, 0.5, out, np.arange(known.sum()))
            by_hand[known] += out
        got, size = np.zeros(len(z)), 1 << (depth + 1)
        for a in range(0, len(models[s].value), size):
            tree = B.Tree(depth)
            for name in ("feature", "cut", "gap_left", "value"):
                getattr(tree, name)[:] = getattr(models[s], name)[a : a + size]
            got += tree.value[tree.leaf_of(b, 8)]
        assert np.allclose(got[known], by_hand[known])


def test_fill_beats_the_line_where_the_relation_is_no_line(spark, panel):
    x, holes, rows = panel_rows(5, 700, 0.15)
    df = panel(rows)
    models = B.fit_boosted(df, ONE, trees=8, depth=3, rate=0.5, share=0.8)
    trees = {(r.station, str(r.ts)): r.m1 for r in B.fill_from_boosted(df, ONE, 3, models).collect()}
    lines = {(r.station, str(r.ts)): r.m1 for r in I.fill_from_neighbors(df, ONE, 3).collect()}
    errors = [[], []]
    for k, (station, ts, value) in enumerate(rows):
        i, j = divmod(k, 4)
        gaps = np.isnan(holes[i]).sum()
        if value is not None:
            assert trees[station, ts] == value
        elif gaps < 3:
            for e, found in zip(errors, (trees, lines)):
                e.append(abs(found[station, ts] - x[i, j]))
        else:
            assert trees[station, ts] is None
    assert np.mean(errors[0]) < 0.7 * np.mean(errors[1])


def test_gaps_may_tell_more_than_values(spark, panel):
    """A neighbour that is silent exactly when the station is high."""
    r = np.random.default_rng(2)
    high = r.random(400) < 0.5
    rows = []
    for i in range(400):
        ts = f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00"
        rows += [("a", ts, 100.0 if high[i] else 0.0), ("b", ts, None if high[i] else float(r.normal())), ("c", ts, float(r.normal()))]
    best = B.first_splits(panel(rows), ONE, bins=4, edges="width").where("station = 'a'").first()
    assert best.neighbour == "b" and best.n == 400 and best.gain > 300 and not best.gap_left


def test_odd_panels(spark, panel):
    spec = PanelSpec(measures=("m1", "m2"), absent={"m2": ("b",)})
    rows = [(s, f"2024-01-{d:02d} {h:02d}:00:00", None if s == "c" else float(h * d % 7), 5.0) for s in "abc" for d in (1, 2, 3) for h in range(24)]
    df = panel(rows, ("m1", "m2")).withColumn("m1", F.when((F.col("station") != "a") | (F.hour("ts") != 4), F.col("m1")))
    filled = B.fill_from_boosted(df, spec, 0.9, B.fit_boosted(df, spec, trees=2, depth=2))
    assert filled.count() == 216 and filled.where("station = 'c' AND m1 IS NOT NULL").isEmpty()
    assert filled.where("station = 'a' AND m1 IS NULL").isEmpty()
    assert I.impute(df, spec, ["boosted", "mean", "zero"], max_missing=3, before="2024-01-03").where("m1 IS NULL").isEmpty()
