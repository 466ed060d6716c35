"""Filling a cell from all other stations at once: a multivariate normal per measure, fitted with gaps by EM.

At a time some stations report a measure and some do not: the pattern of that time. What EM needs of all
times of a pattern are their number, their sum and their sum of outer products, so readings are aggregated once
and every round works on patterns alone.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelcast.session import write_and_read
from panelcast.spec import PanelSpec

ROUNDS = 100
TOLERANCE = 1e-4
CHUNK = 256
PATTERN = "measure string, stations array<int>, n long, sums array<double>, outer array<double>"


def station_list(df: DataFrame, spec: PanelSpec) -> list:
    """The stations of a panel, in order. What is held per pair of them bounds what the driver holds."""
    return [r[0] for r in df.select(spec.station).distinct().orderBy(spec.station).collect()]


def numbered(df: DataFrame, spec: PanelSpec, stations: list) -> DataFrame:
    """Adds ``_at``, the station's place in the list."""
    kind = dict(df.dtypes)[spec.station]
    places = df.sparkSession.createDataFrame(list(enumerate(stations)), f"_at int, `{spec.station}` {kind}")
    return df.join(places, spec.station)


def moments(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """(measure, station, mean, scale): population deviation of the known values, 1 for a constant."""
    parts = []
    for m in spec.measures:
        known = df.where(spec.reports(m))
        stats = known.groupBy(spec.station).agg(F.avg(m).alias("mean"), F.stddev_pop(m).alias("scale"))
        scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale")
        parts.append(stats.where("mean IS NOT NULL").select(F.lit(m).alias("measure"), spec.station, "mean", scale))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def times(df: DataFrame, spec: PanelSpec, stations: list, known: dict) -> DataFrame:
    """One row per measure and time with a reading: places of the stations that report, ascending, and their values in scale."""
    rows = numbered(df, spec, stations)
    cells = []
    for m in spec.measures:
        mean, scale = (F.array(*[F.lit(float(known[m, s][k]) if (m, s) in known else 0.0) for s in stations]) for k in (0, 1))
        value = (F.col(m) - F.get(mean, F.col("_at"))) / F.get(scale, F.col("_at"))
        here = F.col(m).isNotNull() & spec.reports(m) & F.col(spec.station).isin([s for s in stations if (m, s) in known])
        cells.append(F.sort_array(F.collect_list(F.when(here, F.struct("_at", value.alias("value"))))).alias(m))
    by_time = rows.groupBy(spec.ts).agg(*cells)
    long = by_time.select(spec.ts, F.explode(F.create_map(*[x for m in spec.measures for x in (F.lit(m), F.col(m))])).alias("measure", "_cells"))
    return long.where(F.size("_cells") > 0).select("measure", spec.ts, F.col("_cells._at").alias("stations"), F.col("_cells.value").alias("x"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
    return np.split(flat, ends[:-1])


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times of a task added up by pattern."""
    for batch in batches:
        found: dict = {}
        for measure, places, x in zip(batch.column("measure").to_pylist(), _lists(batch.column("stations")), _lists(batch.column("x")), strict=True):
            held = found.setdefault((measure, places.tobytes()), [places, []])
            held[1].append(x)
        rows = []
        for (measure, _), (places, xs) in found.items():
            x = np.array(xs)
            rows.append({"measure": measure, "stations": places, "n": len(x), "sums": x.sum(0), "outer": (x.T @ x).ravel()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("measure", pa.string()), ("stations", pa.list_(pa.int32())), ("n", pa.int64()), ("sums", pa.list_(pa.float64())), ("outer", pa.list_(pa.float64()))]))


def _merge(table: pa.Table) -> pa.Table:
    """The sums of one pattern from many tasks."""
    if table.num_rows == 1:
        return table
    n, total = pc.sum(table.column("n")), {}
    for name in ("sums", "outer"):
        column = table.column(name).combine_chunks()
        total[name] = column.flatten().to_numpy().reshape(len(column), -1).sum(0)
    first = table.slice(0, 1)
    columns = [first.column("measure"), first.column("stations"), pa.array([n.as_py()]), *[pa.array([total[k]], pa.list_(pa.float64())) for k in ("sums", "outer")]]
    return pa.table(columns, names=table.column_names)


def patterns(rows: DataFrame) -> DataFrame:
    """(measure, stations, n, sums, outer) of all times with the same stations reporting."""
    parts = rows.select("measure", "stations", "x").mapInArrow(_reduce, PATTERN)
    return parts.groupBy("measure", "stations").applyInArrow(_merge, PATTERN)


def _by_width(places: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows with equally many stations, at most CHUNK at once."""
    width = np.array([len(p) for p in places])
    for k in np.unique(width):
        rows = np.flatnonzero(width == k)
        for a in range(0, len(rows), CHUNK):
            yield rows[a : a + CHUNK]


def expected(places: list, n: np.ndarray, sums: list, outer: list, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What patterns add to the next mean and covariance, before both are multiplied by the covariance, and to the log likelihood.

    With K the inverse of the covariance of the stations that report, padded with zeros, and T and d the sums of
    squares and of deviations from the mean: sum of K T K - n K, and of K d.
    """
    s = len(mean)
    square, line, likelihood = np.zeros((s, s)), np.zeros(s), 0.0
    for rows in _by_width(places):
        at = np.stack([places[r] for r in rows])
        count = n[rows][:, None]
        center = mean[at]
        total = np.stack([sums[r] for r in rows])
        second = np.stack([outer[r] for r in rows]).reshape(len(rows), at.shape[1], at.shape[1])
        cross = total[:, :, None] * center[:, None, :]
        t = second - cross - cross.transpose(0, 2, 1) + count[:, :, None] * center[:, :, None] * center[:, None, :]
        k = np.linalg.inv(cov[at[:, :, None], at[:, None, :]])
        np.add.at(square, (at[:, :, None], at[:, None, :]), k @ t @ k - count[:, :, None] * k)
        np.add.at(line, at, (k @ (total - count * center)[:, :, None])[:, :, 0])
        likelihood += 0.5 * float((n[rows] * np.linalg.slogdet(k)[1]).sum() - (k * t).sum())
    return square, line, likelihood


def _round(models: dict):
    """Per task and measure the sums of ``expected``, a row per station, and one for the log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures = np.array(batch.column("measure").to_pylist())
            places, sums, outer = (_lists(batch.column(c)) for c in ("stations", "sums", "outer"))
            n = batch.column("n").to_numpy()
            for m in np.unique(measures):
                rows = np.flatnonzero(measures == m)
                pick = lambda x: [x[r] for r in rows]
                square, line, likelihood = expected(pick(places), n[rows], pick(sums), pick(outer), *models[m])
                values = [*np.column_stack([square, line]).tolist(), [likelihood]]
                columns = [pa.array([m] * len(values)), pa.array(range(len(values)), pa.int32()), pa.array(values, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["measure", "i", "row"])

    return run


def next_round(mean: np.ndarray, cov: np.ndarray, square: np.ndarray, line: np.ndarray, n: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance after a round; ``prior`` rows speak for stations that know nothing of one another."""
    step = cov @ line / n
    now = cov + cov @ square @ cov / n - np.outer(step, step)
    now = (n * now + prior * np.eye(len(mean))) / (n + prior)
    return mean + step, (now + now.T) / 2


def fit_normal(df: DataFrame, spec: PanelSpec, prior: float = 1.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Means and covariances of all measures over the stations: (measure, station, place, mean, scale, row, settled).

    Values are put in each station's own scale. A round is one job over the patterns of all measures; it
    adds up a matrix per measure in each task, and Spark the matrices, so the driver holds a number per pair of
    stations and measure. It ends when the log likelihood per time, which no round lowers, rises by less than
    ``tolerance``, or after ``rounds``, which ``settled`` tells. Pairs of stations that never report together stay uncorrelated but for what
    others say of both. All stations are neighbours: split a panel of several cities first.
    """
    stations = station_list(df, spec)
    scales = moments(df, spec).collect()
    known = {(r["measure"], r[spec.station]): (r["mean"], r["scale"]) for r in scales}
    held = write_and_read(patterns(times(df, spec, stations, known)), "patterns")
    sizes = {r["measure"]: r["n"] for r in held.groupBy("measure").agg(F.sum("n").alias("n")).collect()}
    models = {m: (np.zeros(len(stations)), np.eye(len(stations))) for m in sizes}
    open_measures, likelihood = set(models), {}
    for _ in range(rounds):
        if not open_measures:
            break
        chosen = {m: models[m] for m in open_measures}
        sums = held.where(F.col("measure").isin(sorted(open_measures))).mapInArrow(_round(chosen), "measure string, i int, row array<double>")
        cells = sums.select("measure", "i", F.posexplode("row").alias("j", "v")).groupBy("measure", "i", "j").agg(F.sum("v").alias("v"))
        total = {m: np.zeros((len(stations) + 1, len(stations) + 1)) for m in open_measures}
        for r in cells.collect():
            total[r["measure"]][r["i"], r["j"]] = r["v"]
        for m in sorted(open_measures):
            mean, cov = models[m]
            reached = total[m][-1, 0] - 0.5 * prior * (np.linalg.slogdet(cov)[1] + np.trace(np.linalg.inv(cov)))
            models[m] = next_round(mean, cov, total[m][:-1, :-1], total[m][:-1, -1], sizes[m], prior)
            if reached - likelihood.get(m, -np.inf) < tolerance * sizes[m]:
                open_measures.discard(m)
            likelihood[m] = reached
    rows = []
    for m, (mean, cov) in models.items():
        for i, s in enumerate(stations):
            center, scale = known.get((m, s), (None, None))
            rows.append((m, s, i, center if center is None else center + scale * float(mean[i]), scale, cov[i].tolist(), m not in open_measures))
    kind = dict(df.dtypes)[spec.station]
    schema = f"measure string, `{spec.station}` {kind}, place int, mean double, scale double, row array<double>, settled boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def conditional(places: list, values: list, cov: np.ndarray) -> np.ndarray:
    """Every station's expected value, in scale and from the mean, given those that report."""
    out = np.zeros((len(places), len(cov)))
    for rows in _by_width(places):
        at = np.stack([places[r] for r in rows])
        x = np.stack([values[r] for r in rows])
        z = np.zeros((len(rows), len(cov)))
        np.put_along_axis(z, at, np.linalg.solve(cov[at[:, :, None], at[:, None, :]], x[:, :, None])[:, :, 0], 1)
        out[rows] = z @ cov
    return out


def fill_from_normal(df: DataFrame, spec: PanelSpec, max_missing: float, models: DataFrame | None = None) -> DataFrame:
    """Fill a missing cell by its expected value given all stations that report at the time.

    Only where fewer than ``max_missing`` stations lack a reading (below 1 it is a fraction of them), as
    ``fill_from_neighbors`` does. ``models`` is a table of ``fit_normal``, fitted on ``df`` by default. Values used are those
    before imputation; stations without a model in a measure are neither filled nor asked.
    """
    models = models if models is not None else fit_normal(df, spec)
    learned: dict = {}
    for r in models.collect():
        learned.setdefault(r["measure"], {})[r[spec.station]] = (r["place"], r["mean"], r["scale"], r["row"])
    stations = sorted({s for held in learned.values() for s in held}, key=lambda s: next(h[s][0] for h in learned.values() if s in h))
    known = {(m, s): (v[1], v[2]) for m, held in learned.items() for s, v in held.items() if v[1] is not None}
    covs = {m: np.array([held[s][3] for s in stations]) for m, held in learned.items()}

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures = np.array(batch.column("measure").to_pylist())
            places, values = _lists(batch.column("stations")), _lists(batch.column("x"))
            out = np.zeros((batch.num_rows, len(stations)))
            for m in np.unique(measures):
                rows = np.flatnonzero(measures == m)
                z = conditional([places[r] for r in rows], [values[r] for r in rows], covs[m])
                center, scale = np.array([known.get((m, s), (np.nan, np.nan)) for s in stations]).T
                out[rows] = center + scale * z
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(stations)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("measure"), batch.column(spec.ts), column], names=["measure", spec.ts, "guess"])

    kind = dict(df.dtypes)[spec.ts]
    guessed = times(df, spec, stations, known).mapInArrow(guess, f"measure string, `{spec.ts}` {kind}, guess array<double>")
    return fill_from_guesses(df, spec, guessed, stations, max_missing)


def fill_from_guesses(df: DataFrame, spec: PanelSpec, guessed: DataFrame, stations: list, max_missing: float) -> DataFrame:
    """Fill gated missing cells from rows (measure, time, guess), a guess per station in the order given."""
    wide = guessed.groupBy(spec.ts).agg(*[F.first(F.when(F.col("measure") == m, F.col("guess")), ignorenulls=True).alias(f"_guess_{m}") for m in spec.measures])
    counts = []
    for m in spec.measures:
        counts += [F.count_if(spec.reports(m)).alias(f"_all_{m}"), F.count_if(spec.reports(m) & F.col(m).isNotNull()).alias(f"_cnt_{m}")]
    gates = df.groupBy(spec.ts).agg(*counts)
    joined = df.join(wide.join(gates, spec.ts), spec.ts, "left")
    place = F.create_map(*[x for i, s in enumerate(stations) for x in (F.lit(s), F.lit(i))])
    filled = {}
    for m in spec.measures:
        limit = F.col(f"_all_{m}") * max_missing if max_missing < 1 else F.lit(max_missing)
        value = F.nanvl(F.get(f"_guess_{m}", F.try_element_at(place, F.col(spec.station))), F.lit(None).cast("double"))
        gate = (F.col(f"_all_{m}") - F.col(f"_cnt_{m}") < limit) & spec.reports(m)
        filled[m] = F.coalesce(F.col(m), F.when(gate, value))
    return joined.withColumns(filled).select(*df.columns)
