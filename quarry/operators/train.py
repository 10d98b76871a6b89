"""Training of classifiers over vectors in tasks, with parameter averaging: a flat one (div), or two heads (sub and div).

Layers are linear, batch normalisation, ReLU, dropout; the loss is class-weighted cross-entropy, the optimiser Adam. Rows are
dealt to WORKERS tasks at most, once. In an epoch each task goes through its rows in mini-batches from the same state (weights,
moments, running means), and the states that come out are averaged by rows. They are averaged in slices, as many as there are
tasks: each task sends its state cut into slices, and a slice's versions meet in one task, so no task holds more than about
one state, and the driver gets one. Rows never leave the executors.

An epoch's task first counts what the averaged state of the epoch before does on its held-out rows, so an epoch is one job. The
rate falls when the held-out loss stands still; training stops when the balanced accuracy of the held-out divs does, and the
best state is kept. Batch normalisation is folded into the layers of the model that comes out.

Rows without a vector or a label are left out. A class that is only held out is known but never right.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import ensure_checkpoint_dir
from .predict import Flat, TwoHead
from .vectors import batch_matrix

WORKERS, BATCH, EPSILON, MOMENTUM = 64, 512, 1e-5, 0.1


class Layout(NamedTuple):
    """Sizes of the input and the hidden layers, and of each head its classes and its share of the loss."""

    sizes: tuple[int, ...]
    heads: tuple[int, ...]
    shares: tuple[float, ...]

    def shapes(self) -> list[tuple[int, ...]]:
        """Of a layer its weights, bias, scale and shift; of a head its weights and bias."""
        hidden = [s for a, b in zip(self.sizes, self.sizes[1:]) for s in ((a, b), (b,), (b,), (b,))]
        return hidden + [s for n in self.heads for s in ((self.sizes[-1], n), (n,))]

    def count(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes())

    def start(self, seed: int) -> np.ndarray:
        """Weights, two moments, running means and variances, rows, steps."""
        draw, parts = np.random.default_rng(seed), []
        layers = 4 * (len(self.sizes) - 1)
        for i, s in enumerate(self.shapes()):
            if len(s) == 2:
                bound = np.sqrt(1 / s[0])
                parts.append(draw.uniform(-bound, bound, s).ravel())
            else:
                parts.append(np.full(s, 1.0 if i < layers and i % 4 == 2 else 0.0))
        weights = np.concatenate(parts)
        means = np.concatenate([np.concatenate((np.zeros(n), np.ones(n))) for n in self.sizes[1:]] or [np.zeros(0)])
        return np.concatenate((weights, np.zeros(2 * len(weights)), means, [0.0]))


def unpacked(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes:
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def cross_entropy(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean by class weights, and its gradient by z."""
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    w, at = weight[y], np.arange(len(y))
    total = max(w.sum(), 1e-300)
    loss = float(-(w * np.log(np.maximum(p[at, y], 1e-300))).sum() / total)
    p[at, y] -= 1
    return loss, p * (w / total)[:, None]


def loss_and_gradient(flat: np.ndarray, layout: Layout, x: np.ndarray, ys: list[np.ndarray], weights: list[np.ndarray], keep: list[np.ndarray] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, the batch's means and variances by layer) of one batch. keep: masks of dropout, scaled."""
    parts = unpacked(flat, layout.shapes())
    depth = len(layout.sizes) - 1
    acts, saved, means = [x], [], []
    for i in range(depth):
        w, b, scale, shift = parts[4 * i : 4 * i + 4]
        z = acts[-1] @ w + b
        mean, var = z.mean(axis=0), z.var(axis=0)
        sd = np.sqrt(var + EPSILON)
        norm = (z - mean) / sd
        y = np.maximum(norm * scale + shift, 0)
        on = y > 0
        if keep is not None:
            y = y * keep[i]
        acts.append(y)
        saved.append((norm, sd, on))
        means.append(np.concatenate((mean, var * len(z) / max(1, len(z) - 1))))
    loss, back, grads = 0.0, np.zeros_like(acts[-1]), []
    for h, (share, y, weight) in enumerate(zip(layout.shares, ys, weights, strict=True)):
        w, b = parts[4 * depth + 2 * h : 4 * depth + 2 * h + 2]
        part, g = cross_entropy(acts[-1] @ w + b, y, weight)
        loss, g = loss + share * part, share * g
        grads += [acts[-1].T @ g, g.sum(axis=0)]
        back = back + g @ w.T
    for i in range(depth - 1, -1, -1):
        norm, sd, on = saved[i]
        if keep is not None:
            back = back * keep[i]
        back = back * on
        scale = parts[4 * i + 2]
        g_scale, g_shift = (back * norm).sum(axis=0), back.sum(axis=0)
        g = back * scale
        g = (g - g.mean(axis=0) - norm * (g * norm).mean(axis=0)) / sd
        grads = [acts[i].T @ g, g.sum(axis=0), g_scale, g_shift, *grads]
        back = g @ parts[4 * i].T
    return loss, np.concatenate([g.ravel() for g in grads]), np.concatenate(means) if means else np.zeros(0)


def layers(state: np.ndarray, layout: Layout) -> tuple[list, list]:
    """(trunk, heads) as (weights, bias), with batch normalisation folded in."""
    parts, n = unpacked(state[: layout.count()], layout.shapes()), layout.count()
    at, trunk = 3 * n, []
    for i, width in enumerate(layout.sizes[1:]):
        mean, var = state[at : at + width], state[at + width : at + 2 * width]
        at += 2 * width
        w, b, scale, shift = parts[4 * i : 4 * i + 4]
        k = scale / np.sqrt(np.maximum(var, 0) + EPSILON)
        trunk.append((w * k, (b - mean) * k + shift))
    rest = parts[4 * len(trunk) :]
    return trunk, list(zip(rest[::2], rest[1::2]))


def trained_on(state: np.ndarray, layout: Layout, x: np.ndarray, ys: list[np.ndarray], weights: list[np.ndarray], rate: float, dropout: float, draw: np.random.Generator, batch: int) -> tuple[np.ndarray, float]:
    """(state, sum of losses) after one pass over some rows in an order drawn anew. A last row alone has no variance, so it
    joins the batch before."""
    n, state, total = layout.count(), state.copy(), 0.0
    order = draw.permutation(len(x))
    cuts = list(range(0, len(x), batch)) + [len(x)]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < 2:
        cuts.pop(-2)
    for a, b in zip(cuts, cuts[1:]):
        at = order[a:b]
        if len(at) < 2:
            continue
        keep = [(draw.random((len(at), w)) >= dropout) / (1 - dropout) for w in layout.sizes[1:]]
        loss, gradient, means = loss_and_gradient(state[:n], layout, x[at], [y[at] for y in ys], weights, keep)
        total += loss * len(at)
        state[-1] += 1
        m, v = state[n : 2 * n], state[2 * n : 3 * n]
        m *= 0.9
        m += 0.1 * gradient
        v *= 0.999
        v += 0.001 * gradient**2
        t = state[-1]
        state[:n] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        state[3 * n : -1] = (1 - MOMENTUM) * state[3 * n : -1] + MOMENTUM * means
    return state, total


def train(
    df: DataFrame, vector: str, div: str, held_out: str, sub: str | None = None, hidden: tuple[int, ...] = (512, 256), epochs: int = 60,
    rate: float = 1e-3, alpha: float = 0.35, dropout: float = 0.3, batch: int = BATCH, patience: int = 8, factor: float = 0.5,
    stop_after: int = 15, seed: int = 42, workers: int = WORKERS,
) -> tuple[TwoHead | Flat, list[dict]]:
    """(model, history). Without `sub` the flat model of divs; with it the two heads, alpha being the sub's share of the loss.
    held_out is a boolean column."""
    from .stats import class_weights

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    labels = [div] if sub is None else [sub, div]
    known = df.where(F.size(vector) > 0)
    for c in labels:
        known = known.where(F.col(c).isNotNull())
    seen = known.select(*labels).distinct().collect()  # a row a class
    names = [sorted({r[i] for r in seen}) for i in range(len(labels))]
    size = known.select(F.max(F.size(vector))).first()[0]
    if size is None:
        raise ValueError("no row has a vector and its labels")
    weight = {c: dict(class_weights(known.where(~F.col(held_out)), c).collect()) for c in labels}
    weights = [np.array([weight[c].get(x, 0.0) for x in found]) for c, found in zip(labels, names, strict=True)]
    layout = Layout((size, *hidden), tuple(map(len, names)), (1.0,) if sub is None else (alpha, 1 - alpha))
    numbers = spark.createDataFrame([(*r, *(found.index(x) for x, found in zip(r, names, strict=True))) for r in seen], ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in labels] + [f"y{i} int" for i in range(len(labels))]))
    tasks = max(1, min(workers, spark.sparkContext.defaultParallelism))
    rows = known.select(F.col(vector).cast("array<double>").alias("x"), F.col(held_out).alias("held"), *labels).join(F.broadcast(numbers), labels)
    rows = rows.select("x", "held", *(f"y{i}" for i in range(len(labels)))).repartition(tasks, F.xxhash64("x")).sortWithinPartitions(F.xxhash64("x")).checkpoint()
    divs = len(names[-1])

    def epoch(state: np.ndarray, now: float, number: int, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """(figures of the state on held-out rows: rows, loss, then right ones and all ones by div, then training rows and
        their loss; the averaged state after this epoch)."""
        shared = spark.sparkContext.broadcast(state)
        cuts = np.linspace(0, len(state), tasks + 1).astype(int)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.compute  # noqa: F401
            from pyspark import TaskContext

            start = shared.value
            own, figures, n = start.copy(), np.zeros(4 + 2 * divs), 0
            trunk, heads = layers(start, layout)
            draw = np.random.default_rng((seed, number, TaskContext.get().partitionId()))
            for part in batches:
                x, fits = batch_matrix(part.column(0), layout.sizes[0])
                held = np.array(part.column(1).fill_null(False)) & fits
                ys = [part.column(2 + i).to_numpy() for i in range(len(labels))]
                if held.any():
                    top = x[held]
                    for w, b in trunk:
                        top = np.maximum(top @ w + b, 0)
                    z = [top @ w + b for w, b in heads]
                    loss = sum(s * cross_entropy(a, y[held], np.maximum(k, 1e-12))[0] for s, a, y, k in zip(layout.shares, z, ys, weights, strict=True))
                    truth = ys[-1][held]
                    allowed = mask[z[0].argmax(axis=1)] if sub is not None else True
                    guess = np.where(allowed, z[-1], -np.inf).argmax(axis=1)
                    figures[:2] += held.sum(), loss * held.sum()
                    figures[2 : 2 + divs] += np.bincount(truth[guess == truth], minlength=divs)
                    figures[2 + divs : 2 + 2 * divs] += np.bincount(truth, minlength=divs)
                used = ~held & fits
                if learn and used.any():
                    own, loss = trained_on(own, layout, x[used], [y[used] for y in ys], weights, now, dropout, draw, batch)
                    n += int(used.sum())
                    figures[-2:] += used.sum(), loss
            yield pa.RecordBatch.from_pydict({"slice": [-1], "n": [n], "data": [figures.tobytes()]}, schema=kind)
            if n:
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    yield pa.RecordBatch.from_pydict({"slice": [i], "n": [n], "data": [own[a:b].tobytes()]}, schema=kind)

        kind = pa.schema([("slice", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

        def added(table: pa.Table) -> pa.Table:
            at, total, count = table.column("slice")[0].as_py(), 0.0, 0
            for n, data in zip(table.column("n").to_pylist(), table.column("data"), strict=True):
                values = np.frombuffer(data.as_buffer(), np.float64)
                total, count = total + (values if at < 0 else n * values), count + n
            return pa.table({"slice": [at], "n": [count], "data": [(total if at < 0 else total / count).tobytes()]}, schema=kind)

        found = {r.slice: np.frombuffer(r.data) for r in rows.mapInArrow(run, "slice int, n long, data binary").groupBy("slice").applyInArrow(added, "slice int, n long, data binary").collect()}  # one state
        figures = found.pop(-1, np.zeros(4 + 2 * divs))
        return figures, np.concatenate([found[i] for i in sorted(found)]) if found else state

    mask = None
    if sub is not None:
        hierarchy = {(r[0], r[1]) for r in seen}
        mask = np.array([[(s, d) in hierarchy for d in names[1]] for s in names[0]])
    state, history, best, best_state, idle, least, waited, now = layout.start(seed), [], -1.0, None, 0, np.inf, 0, rate
    losses = None
    for number in range(epochs + 1):  # the figures of a state come with the epoch after it
        figures, after = epoch(state, now, number, number < epochs)
        if number:
            right, every = figures[2 : 2 + divs], figures[2 + divs : 2 + 2 * divs]
            some = every > 0
            balanced = float((right[some] / every[some]).mean()) if some.any() else 0.0
            held_loss = float(figures[1] / max(figures[0], 1))
            history.append({"epoch": number, "tr_loss": losses, "va_loss": held_loss, "val_acc": float(right.sum() / max(figures[0], 1)), "val_bal": balanced, "lr": now})
            if balanced > best:
                best, best_state, idle = balanced, state, 0
            else:
                idle += 1
                if idle >= stop_after:
                    break
            least, waited = (held_loss, 0) if held_loss < least * (1 - 1e-4) else (least, waited + 1)
            if waited > patience:
                now, waited = now * factor, 0
        losses, state = float(figures[-1] / max(figures[-2], 1)), after
    trunk, heads = layers(best_state if best_state is not None else state, layout)
    if sub is None:
        return Flat(trunk, heads[0], names[0]), history
    return TwoHead(trunk, heads[0], heads[1], names[0], names[1], hierarchy), history
