"""Boosted trees for every station and measure at once, from all other stations, with gaps as a branch of their own.

A model predicts a station's reading from what the others report at the time. All models grow level by level in one
job: tasks add up histograms of gradients by (model, node, feature, bin), Spark adds these up by key, and the best
split of every node of every model is an aggregate of running sums.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from panelcast.operators.normal import fill_from_guesses, moments, station_list, times
from panelcast.session import write_and_read
from panelcast.spec import PanelSpec

STORE_EVERY = 10


def bin_edges(df: DataFrame, spec: PanelSpec, stations: list, known: dict, bins: int, kind: str) -> dict:
    """Ascending edges per (measure, station), in scale: of equal shares of the readings (approximate), or of equal width."""
    shares = [k / bins for k in range(1, bins)]
    out = {}
    for m in spec.measures:
        if kind == "share":
            cuts = F.percentile_approx(m, shares, 10_000)
        else:
            low, high = F.min(m), F.max(m)
            cuts = F.array(*[low + (high - low) * k / bins for k in range(1, bins)])
        for r in df.where(spec.reports(m)).groupBy(spec.station).agg(cuts.alias("cuts")).collect():
            if (m, r[0]) in known:
                mean, scale = known[m, r[0]]
                out[m, r[0]] = np.unique((np.array(r["cuts"], float) - mean) / scale)
    return out


def _dense(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Values of a batch, a column per station, NaN for a gap."""
    out = np.full((batch.num_rows, width), np.nan)
    places = batch.column("stations")
    out[np.repeat(np.arange(batch.num_rows), pc.list_value_length(places).to_numpy()), places.flatten().to_numpy()] = batch.column("x").flatten().to_numpy()
    return out


def _square(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def binned(x: np.ndarray, edges: list[np.ndarray], gap: int) -> np.ndarray:
    """Bin of every value: how many edges lie below it; ``gap`` for a missing one."""
    out = np.full(x.shape, gap, np.int16)
    for f, e in enumerate(edges):
        known = ~np.isnan(x[:, f])
        out[known, f] = np.searchsorted(e, x[known, f], "left")
    return out


class Tree:
    """Nodes by heap number from 1: a feature (-1 for a leaf), the last bin that goes left, where gaps go, a leaf's value."""

    def __init__(self, depth: int):
        n = 1 << (depth + 1)
        self.feature, self.cut = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.gap_left, self.value = np.zeros(n, bool), np.zeros(n)

    def leaf_of(self, bins: np.ndarray, gap: int) -> np.ndarray:
        node = np.ones(len(bins), np.int64)
        while True:
            f = self.feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return node
            at = node[inner]
            b = bins[inner, f[inner]]
            left = np.where(b == gap, self.gap_left[at], b <= self.cut[at])
            node[inner] = 2 * at + ~left


def _histograms(models: dict, edges: dict, width: int, bins: int, share: float, seed: int):
    """Per task: (model, node, feature, bin, g, n) of all rows of all models in the nodes now open.

    ``models`` by number: (measure, place, trees since the margins were stored, the growing tree, open nodes).
    """
    by_measure: dict = {}
    for number, model in models.items():
        by_measure.setdefault(model[0], []).append((number, *model[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            measures = np.array(batch.column("measure").to_pylist())
            taken, values, margins = batch.column("draw").to_numpy(), _dense(batch, width), _square(batch.column("margin"), width)
            for m, held in by_measure.items():
                rows = np.flatnonzero(measures == m)
                if not len(rows):
                    continue
                x, margin = values[rows], margins[rows]
                b = binned(x, edges[m], bins)
                for number, place, trees, tree, nodes in held:
                    here = np.flatnonzero(~np.isnan(x[:, place]) & (_draw(taken[rows], number, seed) < share))
                    if not len(here):
                        continue
                    own = b[here]
                    g = margin[here, place] - x[here, place]
                    for t in trees:
                        g += t.value[t.leaf_of(own, bins)]
                    at = tree.leaf_of(own, bins)
                    slot = np.searchsorted(nodes, at)
                    open_rows = np.flatnonzero((slot < len(nodes)) & (nodes[np.minimum(slot, len(nodes) - 1)] == at))
                    base = slot[open_rows] * (bins + 1)
                    size = len(nodes) * (bins + 1)
                    for f in range(width):
                        if f == place or not len(edges[m][f]):
                            continue
                        key = base + own[open_rows, f]
                        sums = np.stack([np.bincount(key, g[open_rows], size), np.bincount(key, minlength=size)])
                        total[number, f] = total[number, f] + sums if (number, f) in total else sums
        for (number, f), sums in total.items():
            some = np.flatnonzero(sums[1])
            nodes = models[number][4]
            columns = [
                pa.array(np.full(len(some), number, np.int32)),
                pa.array(nodes[some // (bins + 1)].astype(np.int32)),
                pa.array(np.full(len(some), f, np.int32)),
                pa.array((some % (bins + 1)).astype(np.int32)),
                pa.array(sums[0][some]),
                pa.array(sums[1][some].astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "node", "feature", "bin", "g", "n"])

    return run


def _draw(hashes: np.ndarray, number: int, seed: int) -> np.ndarray:
    """A number in [0, 1) per row, model and tree."""
    mixed = (hashes.astype(np.uint64) ^ np.uint64(number * 0x9E3779B97F4A7C15 + seed * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(11)).astype(float) / float(1 << 53)


def best_splits(histograms: DataFrame, gap: int, l2: float, least_rows: int) -> DataFrame:
    """The best split of every (model, node): feature, cut, where gaps go, gain and the sums on both sides.

    ``histograms`` are (model, node, feature, bin, g, n) with the bin ``gap`` for missing values. Every bin
    but the last is a cut, with gaps on either side. Of equal gains the first feature, the lowest cut and
    gaps on the right win. Nodes that cannot be split have a null feature. Tasks have added up what they
    hold, so rows go to their node once: sums by key, running sums within a feature (``gap`` + 1 rows) and the
    maximum need no other exchange.
    """
    h = histograms.repartition("model", "node").groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    whole = Window.partitionBy("model", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = F.col("bin") == gap
    h = h.withColumns({"_G": F.sum("g").over(whole), "_N": F.sum("n").over(whole), "_gl": F.sum("g").over(upto), "_nl": F.sum("n").over(upto)})
    h = h.withColumns({"_gm": F.coalesce(F.sum(F.when(missing, F.col("g"))).over(whole), F.lit(0.0)), "_nm": F.coalesce(F.sum(F.when(missing, F.col("n"))).over(whole), F.lit(0))})
    sides = F.explode(F.array(F.struct(F.lit(False).alias("left"), F.col("_gl").alias("gl"), F.col("_nl").alias("nl")), F.struct(F.lit(True).alias("left"), (F.col("_gl") + F.col("_gm")).alias("gl"), (F.col("_nl") + F.col("_nm")).alias("nl"))))
    c = h.select("model", "node", "feature", "bin", "_G", "_N", missing.alias("_missing"), sides.alias("s")).select("*", "s.*")
    gr, nr = F.col("_G") - F.col("gl"), F.col("_N") - F.col("nl")
    gain = F.col("gl") ** 2 / (F.col("nl") + l2) + gr**2 / (nr + l2) - F.col("_G") ** 2 / (F.col("_N") + l2)
    fits = ~F.col("_missing") & (F.col("nl") >= least_rows) & (nr >= least_rows) & (gain > 1e-9)
    rank = F.struct(F.round(gain, 6).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("left")).alias("right"), "gl", "nl", gr.alias("gr"), nr.alias("nr"))
    best = c.groupBy("model", "node").agg(F.max(F.when(fits, rank)).alias("top"), F.max("_G").alias("g"), F.max("_N").alias("n"))
    return best.select("model", "node", "g", "n", (-F.col("top.f")).alias("feature"), (-F.col("top.b")).alias("cut"), (~F.col("top.right")).alias("gap_left"), "top.gain", "top.gl", "top.nl", "top.gr", "top.nr")


def _margins(trees: dict, edges: dict, width: int, bins: int):
    """Adds the trees by (measure, place) to the stored margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures = np.array(batch.column("measure").to_pylist())
            margin, values = _square(batch.column("margin"), width).copy(), _dense(batch, width)
            for m in np.unique(measures):
                rows = np.flatnonzero(measures == m)
                b = binned(values[rows], edges[m], bins)
                for (measure, place), held in trees.items():
                    if measure == m:
                        margin[rows, place] += sum(t.value[t.leaf_of(b, bins)] for t in held)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(margin) + 1, dtype=np.int32) * width), pa.array(margin.ravel()))
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", column)

    return run


def _base(df: DataFrame, spec: PanelSpec, bins: int, kind: str) -> tuple[list, dict, dict, DataFrame]:
    """Stations, scales, edges by measure and place, and the stored rows of all measures with margins of 0."""
    known = {(r["measure"], r[spec.station]): (r["mean"], r["scale"]) for r in moments(df, spec).collect()}
    stations = [s for s in station_list(df, spec) if any((m, s) in known for m in spec.measures)]
    cuts = bin_edges(df, spec, stations, known, bins, kind)
    edges = {m: [cuts.get((m, s), np.zeros(0)) for s in stations] for m in spec.measures}
    zeros = F.array_repeat(F.lit(0.0), len(stations)).alias("margin")
    rows = times(df, spec, stations, known).select("measure", "stations", "x", zeros, F.xxhash64(spec.ts, "measure").alias("draw"))
    return stations, known, edges, write_and_read(rows, "rows")


ROWS = "measure string, stations array<int>, x array<double>, margin array<double>, draw long"
HISTOGRAM = "model int, node int, feature int, bin int, g double, n long"


def first_splits(df: DataFrame, spec: PanelSpec, bins: int = 32, l2: float = 1.0, least_rows: int = 20, edges: str = "share") -> DataFrame:
    """The root's best split of every model: (measure, station, neighbour, cut, gap_left, gain, n)."""
    stations, known, cuts, rows = _base(df, spec, bins, edges)
    models = [(m, s) for m in spec.measures for s in stations if (m, s) in known]
    grown = {i: (m, stations.index(s), [], Tree(0), np.array([1])) for i, (m, s) in enumerate(models)}
    best = best_splits(rows.mapInArrow(_histograms(grown, cuts, len(stations), bins, 1.0, 0), HISTOGRAM), bins, l2, least_rows)
    kind = dict(df.dtypes)[spec.station]
    names = df.sparkSession.createDataFrame([(i, *m) for i, m in enumerate(models)], f"model int, measure string, `{spec.station}` {kind}")
    neighbour = F.get(F.array(*[F.lit(s) for s in stations]), F.col("feature")).alias("neighbour")
    return best.join(names, "model").select("measure", spec.station, neighbour, "cut", "gap_left", "gain", "n")


def fit_boosted(
    df: DataFrame,
    spec: PanelSpec,
    trees: int = 80,
    depth: int = 4,
    bins: int = 32,
    rate: float = 0.1,
    l2: float = 1.0,
    least_rows: int = 20,
    share: float = 1.0,
) -> DataFrame:
    """One boosted model per station and measure: (measure, station, place, mean, scale, edges, feature, cut, gap_left, value).

    Squared error in each station's own scale. A level of one tree of all models is one job over the
    stored rows, whose histograms are as large as models x nodes x stations x bins whatever the rows;
    the driver sees one split per open node. Margins are stored every STORE_EVERY trees and added to from the
    trees since. ``share`` of the rows, drawn by hash, is used by each tree. The trees are arrays by tree and heap number of the node.
    """
    stations, known, cuts, rows = _base(df, spec, bins, "share")
    width = len(stations)
    models = [(m, stations.index(s)) for m in spec.measures for s in stations if (m, s) in known]
    done: dict = {m: [] for m in models}
    recent: dict = {m: [] for m in models}
    for t in range(trees):
        grown = {m: Tree(depth) for m in models}
        nodes = {m: np.array([1]) for m in models}
        for level in range(depth):
            asked = {i: (*m, recent[m], grown[m], nodes[m]) for i, m in enumerate(models) if len(nodes[m])}
            if not asked:
                break
            histograms = rows.mapInArrow(_histograms(asked, cuts, width, bins, share, t), HISTOGRAM)
            after: dict = {m: [] for m in models}
            for r in best_splits(histograms, bins, l2, least_rows).collect():
                m, k = models[r["model"]], r["node"]
                tree = grown[m]
                if r["feature"] is None:
                    tree.value[k] = -rate * r["g"] / (r["n"] + l2)
                    continue
                tree.feature[k], tree.cut[k], tree.gap_left[k] = r["feature"], r["cut"], r["gap_left"]
                tree.value[2 * k] = -rate * r["gl"] / (r["nl"] + l2)
                tree.value[2 * k + 1] = -rate * r["gr"] / (r["nr"] + l2)
                after[m] += [2 * k, 2 * k + 1]
            nodes = {m: np.array(sorted(v)) for m, v in after.items()}
        for m in models:
            recent[m].append(grown[m])
            done[m].append(grown[m])
        if (t + 1) % STORE_EVERY == 0 and t + 1 < trees:
            rows = write_and_read(rows.mapInArrow(_margins(recent, cuts, width, bins), ROWS), "margins")
            recent = {m: [] for m in models}
    out = []
    for m, place in models:
        held = done[m, place]
        mean, scale = known[m, stations[place]]
        flat = lambda name: np.concatenate([getattr(t, name) for t in held]).tolist()
        out.append((m, stations[place], place, mean, scale, cuts[m][place].tolist(), flat("feature"), flat("cut"), flat("gap_left"), flat("value")))
    kind = dict(df.dtypes)[spec.station]
    schema = (
        f"measure string, `{spec.station}` {kind}, place int, mean double, scale double, edges array<double>, "
        f"feature array<int>, cut array<int>, gap_left array<boolean>, value array<double>"
    )
    return df.sparkSession.createDataFrame(out, schema).withColumns({"depth": F.lit(depth), "bins": F.lit(bins)})


def fill_from_boosted(df: DataFrame, spec: PanelSpec, max_missing: float, models: DataFrame | None = None) -> DataFrame:
    """Fill gated missing cells by the boosted models; values used are those before imputation.

    The gate is that of ``fill_from_neighbors``. ``models`` is a table of ``fit_boosted``, fitted on ``df`` by default.
    Times at which no station reports a measure have nothing to go by and stay.
    """
    models = models if models is not None else fit_boosted(df, spec)
    learned = {(r["measure"], r[spec.station]): r for r in models.collect()}
    stations = [s for _, s in sorted({(r["place"], s) for (_, s), r in learned.items()})]
    place = {s: i for i, s in enumerate(stations)}
    known = {k: (r["mean"], r["scale"]) for k, r in learned.items()}
    held: dict = {}
    for (m, s), r in learned.items():
        n = 1 << (r["depth"] + 1)
        trees = []
        for a in range(0, len(r["value"]), n):
            tree = Tree(r["depth"])
            for name in ("feature", "cut", "gap_left", "value"):
                getattr(tree, name)[:] = r[name][a : a + n]
            trees.append(tree)
        held[m, place[s]] = trees
    bins = next(iter(learned.values()))["bins"] if learned else 1
    edges = {m: [np.array(learned[m, s]["edges"]) if (m, s) in learned else np.zeros(0) for s in stations] for m in spec.measures}

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures, values = np.array(batch.column("measure").to_pylist()), _dense(batch, len(stations))
            out = np.full(values.shape, np.nan)
            for m in np.unique(measures):
                rows = np.flatnonzero(measures == m)
                b = binned(values[rows], edges[m], bins)
                for (measure, at), trees in held.items():
                    if measure == m:
                        mean, scale = known[m, stations[at]]
                        out[rows, at] = mean + scale * sum(t.value[t.leaf_of(b, bins)] for t in trees)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(stations)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("measure"), batch.column(spec.ts), column], names=["measure", spec.ts, "guess"])

    kind = dict(df.dtypes)[spec.ts]
    guessed = times(df, spec, stations, known).mapInArrow(guess, f"measure string, `{spec.ts}` {kind}, guess array<double>")
    return fill_from_guesses(df, spec, guessed, stations, max_missing)

