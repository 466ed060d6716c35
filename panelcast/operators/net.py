"""The pooled feed-forward net with one shortcut, trained data-parallel on Spark.

Four hidden layers and a linear output of one unit per horizon step; the second layer sees the
input next to the first layer's output. The loss is the symmetric error of every output. Rows lie
in shards of about ``shard_rows``. Each epoch is one Spark job: every shard takes Adam steps over its
own mini-batches from the same weights, and Spark averages weights and moments by rows, so an epoch
has as many steps as a shard has batches, and one that fits a shard is plain mini-batch training. The
driver holds weights and moments, whose size depends on the layers alone. All folds train together,
a row adding to every fold that does not hold its station out. Averages are sums of whole numbers,
exact in any order, so a run repeats whatever the tasks' order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from panelcast.session import write_and_read
from panelcast.spec import PanelSpec

ADAM = {"beta1": 0.9, "beta2": 0.999, "epsilon": 1e-8}
EPSILON = 1e-6
CHUNK = 16384
# weights are averaged in steps of 2^-40, moments (at most 1) of 2^-50, losses of 2^-20
FINE, FINER, LOSS = 2.0**40, 2.0**50, 2.0**20


def layer_shapes(n_inputs: int, units: Sequence[int], n_outputs: int) -> list[tuple[int, int]]:
    widths = [n_inputs, n_inputs + units[0], units[1], units[2], units[3]]
    return [(w + 1, out) for w, out in zip(widths, [*units, n_outputs])]


def initial_weights(shapes, seed: int) -> np.ndarray:
    """Uniform in +-sqrt(3/fan_in), biases 0, all layers in one vector."""
    rng = np.random.default_rng(seed)
    parts = []
    for rows, out in shapes:
        limit = np.sqrt(3 / (rows - 1))
        w = rng.uniform(-limit, limit, (rows, out))
        w[-1] = 0.0
        parts.append(w.ravel())
    return np.concatenate(parts)


def _layers(weights, shapes):
    out, at = [], 0
    for rows, cols in shapes:
        out.append(weights[at : at + rows * cols].reshape(rows, cols))
        at += rows * cols
    return out


def _with_bias(a):
    return np.hstack([a, np.ones((len(a), 1))])


def forward(x, weights, shapes, drop=0.0, rng=None):
    """Output and what the backward pass needs."""
    inputs, masks, a = [], [], x
    layers = _layers(weights, shapes)
    for i, w in enumerate(layers):
        inputs.append(_with_bias(a))
        z = inputs[-1] @ w
        if i == len(layers) - 1:
            return z, inputs, masks
        mask = (z > 0).astype(float)
        if drop and rng is not None:
            mask *= (rng.random(z.shape) >= drop) / (1 - drop)
        masks.append(mask)
        a = z * mask
        if i == 0:
            a = np.hstack([x, a])


def loss_and_slope(y, out):
    """Mean symmetric error per row, and its derivative by the output; missing labels add nothing."""
    known = ~np.isnan(y)
    diff, total = np.where(known, out - y, 0.0), np.abs(out) + np.abs(np.where(known, y, 0.0)) + EPSILON
    share = 2.0 / np.maximum(known.sum(axis=1, keepdims=True), 1)
    slope = share * np.where(known, np.sign(diff) / total - np.abs(diff) * np.sign(out) / total**2, 0.0)
    return (share * np.abs(diff) / total).sum(axis=1), slope


def backward(slope, inputs, masks, weights, shapes):
    layers, grads, delta = _layers(weights, shapes), [], slope
    for i in range(len(layers) - 1, -1, -1):
        grads.append(inputs[i].T @ delta)
        if i == 0:
            break
        below = (delta @ layers[i].T)[:, :-1]
        if i == 1:
            below = below[:, -masks[0].shape[1] :]
        delta = below * masks[i - 1]
    return np.concatenate([g.ravel() for g in reversed(grads)])


@dataclass(frozen=True)
class NetSetting:
    units: Sequence[int] = (48, 48, 48, 48)
    dropout: float = 0.2
    l2: float = 1e-4
    learning_rate: float = 0.005
    epochs: int = 65_535
    batch_rows: int = 84
    shard_rows: int = 8192
    patience: int = 30
    slow_after: int = 15
    clip: float = 1.0
    seed: int = 0


@dataclass
class Net:
    """Weights of the best epoch per fold, the input scale, and each epoch's losses."""

    weights: list[np.ndarray]
    shapes: list[tuple[int, int]]
    scale: float
    history: list[dict] = field(default_factory=list)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _inputs(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    flags = [f"is_{m}" for m in spec.measures] + (["is_group"] if "is_group" in rows.columns else [])
    known = F.transform(F.concat("x", "med"), lambda v: F.coalesce(v, F.lit(0.0)))
    return rows.withColumns({"inputs": known, "flags": F.array(*[F.col(f).cast("double") for f in flags])})


def _sharded(rows: DataFrame, spec: PanelSpec, setting: NetSetting) -> DataFrame:
    """The training rows, stored shard by shard in a fixed order."""
    keys = [spec.station, "measure", "split_day"]
    shards = max(1, -(-rows.count() // setting.shard_rows))
    data = _inputs(rows, spec).withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))
    placed = data.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64(*keys), *keys)
    return write_and_read(placed.select("shard", "inputs", "flags", "y", "fold"), "shards")


def train_net(rows: DataFrame, spec: PanelSpec, setting: NetSetting, k: int = 5) -> Net:
    """Train one net per fold on rows of ``supervised`` with a ``fold`` column.

    A fold ends when its held-out loss has not fallen for ``patience`` epochs; ``epochs`` only guards
    against a loss that falls forever. ``rows`` should be a stored table, as it is read twice; epochs
    read a copy in shards.
    """
    data = _sharded(rows, spec, setting)
    magnitude = F.aggregate("inputs", F.lit(0.0), lambda s, v: s + F.abs(v)) / F.size("inputs")
    facts = data.agg(
        F.max(F.size("inputs") + F.size("flags")).alias("inputs"),
        F.max(F.size("y")).alias("outputs"),
        F.avg(magnitude).alias("scale"),
        *[F.count_if(F.col("fold") != f).alias(f"n_{f}") for f in range(k)],
    ).first()
    if facts["inputs"] is None:
        raise ValueError("no training rows")
    scale = facts["scale"] or 1.0
    shapes = layer_shapes(facts["inputs"], setting.units, facts["outputs"])
    states = [_State(w, np.zeros_like(w), np.zeros_like(w), 0, setting.learning_rate, facts[f"n_{f}"])
              for f, w in ((f, initial_weights(shapes, setting.seed + f)) for f in range(k))]
    net = Net([s.weights.copy() for s in states], shapes, scale)
    best, stale = [np.inf] * k, [0] * k
    for epoch in range(setting.epochs):
        active = {f: s for f, s in enumerate(states) if stale[f] < setting.patience and s.rows}
        if not active:
            break
        moved = _epoch(data, active, shapes, scale, setting, epoch)
        for f, (state, train_loss, m, val_loss) in moved.items():
            val = val_loss / max(m, 1)
            net.history.append({"epoch": epoch, "fold": f, "train": train_loss / state.rows, "val": val})
            if val < best[f] - 1e-6:
                best[f], stale[f], net.weights[f] = val, 0, states[f].weights.copy()
            else:
                stale[f] += 1
                if stale[f] % setting.slow_after == 0:
                    state.rate /= 10
            states[f] = state
    return net


@dataclass
class _State:
    """Where a fold's training stands: weights, Adam's moments and steps, rate, and its number of training rows."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int
    rate: float
    rows: int


def _adam(w, gradient, moments, step, rate, setting):
    g = gradient + 2 * setting.l2 * w
    norm = np.linalg.norm(g)
    g = np.clip(g * min(1.0, setting.clip / max(norm, 1e-12)), -setting.clip, setting.clip)
    first, second = moments
    first[:] = ADAM["beta1"] * first + (1 - ADAM["beta1"]) * g
    second[:] = ADAM["beta2"] * second + (1 - ADAM["beta2"]) * g * g
    a, b = first / (1 - ADAM["beta1"] ** step), second / (1 - ADAM["beta2"] ** step)
    return w - rate * a / (np.sqrt(b) + ADAM["epsilon"])


def _chunks(vector: np.ndarray) -> list[np.ndarray]:
    """Pieces of a state, summed by different tasks."""
    return np.array_split(vector, max(1, len(vector) // CHUNK))


def _by_shard(batches):
    """The rows of each shard, which lie together: (shard, columns)."""
    held, shard = [], None
    for batch in batches:
        number = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and number[a] != shard:
                yield shard, pa.Table.from_batches(held).combine_chunks()
                held = []
            if b > a:
                shard = number[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield shard, pa.Table.from_batches(held).combine_chunks()


def _fold_steps(x, y, start, shapes, setting, rng):
    """Adam over the mini-batches of one shard: weights, moments, steps, and the sum of losses on the way."""
    weights, first, second, step, loss = start.weights, start.first.copy(), start.second.copy(), start.steps, 0.0
    order = rng.permutation(len(x))
    for at in range(0, len(x), setting.batch_rows):
        part = order[at : at + setting.batch_rows]
        out, inputs, masks = forward(x[part], weights, shapes, setting.dropout, rng)
        losses, slope = loss_and_slope(y[part], out)
        step += 1
        weights = _adam(weights, backward(slope, inputs, masks, weights, shapes) / len(part), (first, second), step, start.rate, setting)
        loss += losses.sum()
    return weights, first, second, step - start.steps, loss


def _epoch(data, states, shapes, scale, setting, epoch):
    """One pass: per fold the averaged state after it, the loss sum of training rows, and number and loss sum of held-out rows.

    Held-out rows are judged by the weights that the pass starts from.
    """
    n_weights = sum(r * c for r, c in shapes)
    sent = {f: (s.weights, s.first, s.second, s.steps, s.rate, s.rows) for f, s in states.items()}
    sent = data.sparkSession.sparkContext.broadcast(sent)

    def run(batches):
        totals = {f: np.zeros(3 * n_weights + 4) for f in sent.value}
        for shard, rows in _by_shard(batches):
            x = np.hstack([_matrix(rows.column("inputs").chunk(0)) / scale, _matrix(rows.column("flags").chunk(0))])
            y, fold = _matrix(rows.column("y").chunk(0)) / scale, rows.column("fold").to_numpy()
            for f, state in sent.value.items():
                start, total, seen = _State(*state), totals[f], fold != f
                if seen.any():
                    rng = np.random.default_rng([setting.seed, epoch, int(shard), f])
                    weights, first, second, steps, loss = _fold_steps(x[seen], y[seen], start, shapes, setting, rng)
                    share = seen.sum() / start.rows
                    total[:n_weights] += np.rint(share * weights * FINE)
                    total[n_weights : 2 * n_weights] += np.rint(share * first * FINER)
                    total[2 * n_weights : 3 * n_weights] += np.rint(share * second * FINER)
                    total[-4:-2] += [np.rint(share * steps * LOSS), np.rint(loss * LOSS)]
                if not seen.all():
                    loss, _ = loss_and_slope(y[~seen], forward(x[~seen], start.weights, shapes)[0])
                    total[-2:] += [(~seen).sum(), np.rint(loss.sum() * LOSS)]
        pieces = [(f, i, part) for f, t in totals.items() for i, part in enumerate(_chunks(t))]
        yield pa.RecordBatch.from_pydict(
            {
                "fold": pa.array([f for f, _, _ in pieces], pa.int32()),
                "chunk": pa.array([i for _, i, _ in pieces], pa.int32()),
                "total": pa.array([part for _, _, part in pieces], pa.list_(pa.float64())),
            }
        )

    partial = data.mapInArrow(run, "fold int, chunk int, total array<double>")
    summed = partial.groupBy("fold", "chunk").agg(
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")
    )
    rows = sorted(summed.collect(), key=lambda r: (r["fold"], r["chunk"]))
    result = {}
    for f, state in states.items():
        total = np.concatenate([r["total"] for r in rows if r["fold"] == f])
        weights, first, second = total[: 3 * n_weights].reshape(3, n_weights)
        steps, train_loss, m, val_loss = total[-4:]
        moved = _State(weights / FINE, first / FINER, second / FINER, state.steps + round(steps / LOSS), state.rate, state.rows)
        result[f] = (moved, train_loss / LOSS, m, val_loss / LOSS)
    sent.unpersist()
    return result


def net_forecast(net: Net, rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Mean over the folds' nets: (station, measure, split_day, horizon, value)."""
    shapes, scale, weights = net.shapes, net.scale, net.weights
    keys = [spec.station, "measure", "split_day"]
    data = _inputs(rows, spec).select(*keys, "inputs", "flags")
    kinds = dict(data.dtypes)

    def predict(batches):
        for batch in batches:
            x = np.hstack([_matrix(batch.column("inputs")) / scale, _matrix(batch.column("flags"))])
            out = np.mean([forward(x, w, shapes)[0] for w in weights], axis=0) * scale
            yield pa.RecordBatch.from_pydict(
                {**{c: batch.column(c) for c in keys}, "out": pa.array(list(out), pa.list_(pa.float64()))}
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", out array<double>"
    return data.mapInArrow(predict, schema).select(*keys, F.posexplode("out").alias("horizon", "value"))
