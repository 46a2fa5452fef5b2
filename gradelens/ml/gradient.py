"""Distributed minibatch training for the families Spark ML lacks.

Families (reference grids in ``functions.constants``):

* ``mlp_reg``  (M9)  multilayer perceptron, squared loss, relu/tanh
* ``mlp_clf``  (M8)  multilayer perceptron, logistic loss, relu/tanh
* ``svr``      (M10) epsilon-insensitive loss + L2 (C), linear on a Nystroem
  map (rbf, Williams & Seeger 2001) or on all monomials of degree 3 (poly)
* ``svc``      (M11) hinge loss + L2 (C), linear or on a Nystroem map

How it runs on Spark
--------------------
Every model trains in a *space*: the columns that preprocessing and selection
fitted on its own training rows give, with the kernel scale and the landmark
rows of the same rows.  A row carries one vector per space (a search has one per
held-out fold and one of all rows), so that nothing of a held-out fold
reaches the models that are scored on it.

The training rows are dealt to shards by a hash and persisted once, as packed blocks.
All models (all search candidates x all CV folds + the full refits) train side by side:

* A multilayer perceptron's epoch is a round trip: in every Spark job it trains on one shard
  (minibatch Adam, batches of 200 as in the reference library) and goes on to the next with its
  parameters and moments, so that an epoch is the reference's sequential pass over all rows,
  whatever their number; a shard holds other models meanwhile.  The rows stay where they are.
* The SVMs, whose objective is convex, run some epochs in every shard at once, starting from the global
  parameters; the per-shard parameters and Adam moments, weighted by row count, are summed by
  ``Summarizer.sum`` in a two-level tree, so no reducer receives more than about sqrt(shards)
  vectors.  Their average (parameter averaging / local SGD) is the new global state.

Both are the same with one shard.  Only model-sized vectors reach the driver.

Deviations (documented): the SVMs' epochs run on shards in parallel and are averaged; the minibatches
of a perceptron are drawn within a shard; the rbf kernel is that of at most ``LANDMARKS`` rows.
"""
from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

L2_ALPHA = 1e-4      # MLP weight decay (the reference library's default alpha)
STEPS_RUN = [0]      # steps of the last joint loop (for diagnostics)


@dataclass(frozen=True)
class Spec:
    """One model family configuration (a point of a search grid)."""
    family: str                       # mlp_reg | mlp_clf | svr | svc
    hidden: tuple = ()
    activation: str = "relu"
    lr: float = 0.01
    C: float = 1.0
    epsilon: float = 0.1
    kernel: str = "linear"            # linear | rbf | poly
    seed: int = 42

    def label(self) -> str:
        d = {k: v for k, v in asdict(self).items() if k != "seed"}
        return json.dumps(d, sort_keys=True)


# ------------------------------------------------------------ feature maps ---

#: Rows that span the approximated rbf kernel.
LANDMARKS = 256


@dataclass(frozen=True)
class Space:
    """Where a model's inputs live: their number, the kernel scale, landmark rows (float64, row by row) and the label's scale."""
    d: int
    gamma: float = 1.0
    landmarks: bytes = b""
    column: str = "x"
    y_mean: float = 0.0
    y_std: float = 1.0


def rbf(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - z|^2) for all rows of ``x`` and ``z``."""
    square = (x * x).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2.0 * (x @ z.T)
    return np.exp(-gamma * np.maximum(square, 0.0))


@lru_cache(maxsize=64)
def _feature_map(kernel: str, space: Space):
    """Explicit map x -> phi(x) for the kernel (identity for linear / mlp), and its width; cached per worker."""
    d = space.d
    if kernel == "rbf":
        # phi(x) = k(x, landmarks) K^(-1/2): the products of phi are the kernel projected on the landmarks
        rows = np.frombuffer(space.landmarks).reshape(-1, d)
        values, vectors = np.linalg.eigh(rbf(rows, rows, space.gamma))
        keep = values > 1e-10 * values[-1]
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        return lambda x: rbf(x.astype(float), rows, space.gamma) @ whiten, int(keep.sum())
    if kernel == "poly":                           # (gamma x.z)^3: all monomials of degree 3, with their multiplicity
        i, j, k = np.array([(i, j, k) for i in range(d) for j in range(i, d) for k in range(j, d)]).reshape(-1, 3).T
        times = np.where((i == j) & (j == k), 1.0, np.where((i == j) | (j == k), 3.0, 6.0))
        scale = np.sqrt(times) * space.gamma ** 1.5
        pairs = [(a, b) for a in range(d) for b in range(a, d)]

        def monomials(x):
            factor, out, at = scale.astype(x.dtype), np.empty((len(x), len(i)), x.dtype), 0
            for a, b in pairs:                     # the last index runs over b..d-1: side by side in both arrays
                np.multiply((x[:, a] * x[:, b])[:, None], x[:, b:], out=out[:, at:at + d - b])
                at += d - b
            out *= factor
            return out

        return (lambda x: np.concatenate([monomials(x[r:r + 1000]) for r in range(0, max(1, len(x)), 1000)])), len(i)
    return (lambda x: x), d


def _in_space(space: Space | int) -> Space:
    """A bare number of inputs means standardised inputs."""
    return space if isinstance(space, Space) else Space(space, 1.0 / max(space, 1))


def _shapes(spec: Spec, space: Space | int) -> list[tuple[int, int]]:
    _, dd = _feature_map(spec.kernel, _in_space(space))
    if spec.family.startswith("mlp"):
        sizes = [dd, *spec.hidden, 1]
        return [(sizes[i], sizes[i + 1]) for i in range(len(sizes) - 1)]
    return [(dd, 1)]


def n_params(spec: Spec, space: Space | int) -> int:
    return sum(a * b + b for a, b in _shapes(spec, space))


def init_params(spec: Spec, space: Space | int) -> np.ndarray:
    rng = np.random.default_rng(spec.seed)
    parts = []
    for a, b in _shapes(spec, space):
        if spec.family.startswith("mlp"):
            lim = np.sqrt(6.0 / (a + b)) if spec.activation == "relu" else np.sqrt(2.0 / (a + b))
            parts += [rng.uniform(-lim, lim, size=a * b), np.zeros(b)]
        else:
            parts += [np.zeros(a * b), np.zeros(b)]
    return np.concatenate(parts)


def _unpack(theta: np.ndarray, shapes):
    out, k = [], 0
    for a, b in shapes:
        w = theta[k:k + a * b].reshape(a, b)
        k += a * b
        out.append((w, theta[k:k + b]))
        k += b
    return out


def _act(z, kind):
    return np.maximum(z, 0.0) if kind == "relu" else np.tanh(z)


def _dact(a, kind):
    return (a > 0).astype(a.dtype) if kind == "relu" else 1.0 - a * a


def forward(spec: Spec, theta: np.ndarray, x: np.ndarray, space: Space | int) -> np.ndarray:
    """Raw output f(x) (regression value, or margin / logit for classifiers)."""
    fmap, _ = _feature_map(spec.kernel, _in_space(space))
    h = fmap(x)
    layers = _unpack(theta, _shapes(spec, space))
    for i, (w, b) in enumerate(layers):
        h = h @ w + b
        if i < len(layers) - 1:
            h = _act(h, spec.activation)
    return h[:, 0]


def loss_grad(spec: Spec, theta: np.ndarray, x: np.ndarray, y: np.ndarray, space: Space | int, mapped: bool = False):
    """(sum of data loss, gradient of the summed data loss) over the rows given (``mapped``: x is phi(x))."""
    fmap, _ = _feature_map(spec.kernel, _in_space(space))
    layers = _unpack(theta, _shapes(spec, space))
    acts = [x if mapped else fmap(x)]
    for i, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        acts.append(_act(z, spec.activation) if i < len(layers) - 1 else z)
    f = acts[-1][:, 0]
    if spec.family == "mlp_reg":
        r = f - y
        loss, g = 0.5 * float(r @ r), r
    elif spec.family == "mlp_clf":
        p = 1.0 / (1.0 + np.exp(-np.clip(f, -35, 35)))
        loss = float(-(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).sum())
        g = p - y
    elif spec.family == "svr":
        r, epsilon = f - y, spec.epsilon / _in_space(space).y_std        # epsilon is in label units, y is standardised
        over = np.abs(r) > epsilon
        loss = spec.C * float((np.abs(r) - epsilon)[over].sum())
        g = spec.C * np.sign(r) * over
    else:  # svc, labels 0/1 -> -1/+1
        s = 2.0 * y - 1.0
        m = 1.0 - s * f
        loss = spec.C * float(np.maximum(m, 0.0).sum())
        g = -spec.C * s * (m > 0)
    delta = g[:, None]
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        w, _ = layers[i]
        grads.append((acts[i].T @ delta, delta.sum(axis=0)))
        if i > 0:
            delta = (delta @ w.T) * _dact(acts[i], spec.activation)
    flat = np.concatenate([p.ravel() for gw, gb in reversed(grads) for p in (gw, gb)])
    return loss, flat


# ---------------------------------------------------------------- training ---

@dataclass(eq=False)
class _Job:
    spec: Spec
    held_out: int | None              # fold left out (None = fit on all rows)
    space: Space = None
    candidate: int = 0                # number of the spec; seeds the order of its minibatches
    theta: np.ndarray = field(default=None)
    m: np.ndarray = field(default=None)
    v: np.ndarray = field(default=None)
    t: int = 0                        # Adam steps taken
    n: int = 0                        # training rows
    best: float = float("inf")
    stall: int = 0
    done: bool = False


def to_training_frame(df: DataFrame, features: dict[str, str], label_col: str, fold_col: str | None) -> DataFrame:
    """``features``: space column -> vector column of ``df``.  Rows without a label are left out."""
    cols = [vector_to_array(F.col(v)).alias(x) for x, v in features.items()]
    cols.append(F.col(label_col).cast("double").alias("y"))
    cols.append(F.col(fold_col).cast("int").alias("fold") if fold_col else F.lit(-1).alias("fold"))
    key = F.xxhash64(F.col("id")) if "id" in df.columns else F.xxhash64(*cols[:2])
    cols.append(key.alias("key"))
    return df.where(F.col(label_col).isNotNull()).select(*cols)


def find_spaces(data: DataFrame, held_out: dict[str, int | None], regression: bool, landmarks: int = LANDMARKS) -> dict[int | None, Space]:
    """The space of every column of ``data``, from the rows outside its held-out fold.

    One aggregation gives each matrix's variance, hence the kernel scale
    ``1 / (d * variance)``, and the label's mean and deviation; the landmarks
    are the rows with the least hashes, the same whatever the partitioning (at most
    ``8 * landmarks`` rows reach the driver).
    """
    def summed(x, own, f):
        return F.sum(F.when(own, F.aggregate(x, F.lit(0.0), f)))

    aggs = []
    for x, fold in held_out.items():
        own = F.lit(True) if fold is None else F.col("fold") != fold
        aggs += [summed(x, own, lambda a, v: a + v).alias(f"s_{x}"), summed(x, own, lambda a, v: a + v * v).alias(f"q_{x}"),
                 F.count_if(own).alias(f"n_{x}"), F.avg(F.when(own, F.col("y"))).alias(f"m_{x}"), F.stddev_pop(F.when(own, F.col("y"))).alias(f"d_{x}")]
    st = data.agg(*aggs).first()
    near = data.orderBy(F.xxhash64("key", F.lit("landmark")), "key").limit(8 * landmarks).select("fold", *held_out).collect()
    out = {}
    for x, fold in held_out.items():
        rows = np.array([r[x] for r in near if fold is None or r["fold"] != fold][:landmarks], float)
        d = rows.shape[1] if rows.size else len(data.select(x).first()[x])
        n = max(1, st[f"n_{x}"] * d)
        mean = (st[f"s_{x}"] or 0.0) / n
        var = (st[f"q_{x}"] or 0.0) / n - mean * mean
        out[fold] = Space(d, 1.0 / (max(d, 1) * var) if var > 0 else 1.0, rows.tobytes(), x,
                          float(st[f"m_{x}"] or 0.0) if regression else 0.0, float(st[f"d_{x}"] or 1.0) if regression else 1.0)
    return out


def tree_sum(per_part: DataFrame, fan_in: int) -> DataFrame:
    """Sum one state per (shard, model) in two levels.

    A single ``groupBy(model)`` would send every shard's vector of a model to
    one reducer.  Grouping first by (model, bucket of shards) with about
    sqrt(shards) buckets and then by model bounds the fan-in of every reducer
    by that, like MLlib's tree aggregation."""
    vec = array_to_vector(F.col("g"))
    level1 = (per_part.withColumn("__bucket", F.col("shard") % F.lit(fan_in))
              .groupBy("model", "__bucket")
              .agg(Summarizer.sum(vec).alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n")))
    return level1.groupBy("model").agg(Summarizer.sum(F.col("g")).alias("g"), F.sum("loss").alias("loss"),
                                       F.sum("n").alias("n"))


#: Rows of a training shard.  The number of shards follows from the rows alone,
#: so the fitted parameters depend on neither the cluster nor the partitioning.
SHARD_ROWS = 50_000
#: The same for perceptrons alone: they need no feature maps, which take the memory, and visit the shards in turn.
VISITED_ROWS = 200_000
#: Partitions that the models of a search are dealt to while there are fewer shards than this.
MODEL_GROUPS = 24
#: Rows of a packed block.
PACKED_ROWS = 10_000


def sharded(data: DataFrame, columns: list[str], rows: int, shard_rows: int) -> tuple[DataFrame, int, int]:
    """``data`` dealt to (shard, model group) partitions in packed blocks, and the numbers of both.

    A row's shard is a hash of its ``key``.  A block holds the matrices of up to ``PACKED_ROWS``
    rows of a shard as bytes, which the jobs read without unpacking single rows.  With few shards
    every block goes to several model groups, so a search on a small table still uses many cores.
    """
    shards = max(1, -(-rows // shard_rows))
    groups = max(1, -(-MODEL_GROUPS // shards))

    def pack(batches):
        block = 0
        for pdf in batches:
            for at in range(0, len(pdf), PACKED_ROWS):
                part = pdf.iloc[at:at + PACKED_ROWS]
                yield pd.DataFrame({
                    "shard": [int(part["shard"].iloc[0])], "block": [block], "n": [len(part)],
                    "y": [part["y"].to_numpy(dtype=float).tobytes()], "fold": [part["fold"].fillna(-1).to_numpy(dtype=np.int32).tobytes()],
                    **{c: [np.stack(part[c].to_numpy()).astype(np.float32).tobytes()] for c in columns}})
                block += 1

    blocks = (data.withColumn("shard", F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)).cast("int"))
              .repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "y").drop("key")
              .mapInPandas(pack, "shard int, block int, n int, y binary, fold binary, " + ", ".join(f"{c} binary" for c in columns)))
    dealt = (blocks.withColumn("grp", F.explode(F.array(*[F.lit(g) for g in range(groups)])))
             .repartitionById(shards * groups, (F.col("shard") * F.lit(groups) + F.col("grp")).cast("int"))
             .sortWithinPartitions("shard", "grp", "block"))
    return dealt, shards, groups


MINIBATCH = 200      # the reference library's default batch size


def _local_epoch(spec: Spec, theta, m, v, t, x, y, d: Space, n_total: int, seed: int):
    """One Adam epoch over a shard's mapped rows in minibatches of 200.

    Per minibatch the objective is the mean data loss plus the regulariser
    scaled to the batch (alpha/2 |W|^2 / batch for MLPs, |w|^2/2 * batch/n
    for SVMs), as in the reference library's minibatch solvers.
    Returns the updated (theta, m, v, steps) and the summed objective."""
    if spec.family.startswith("mlp"):
        return _mlp_epoch(spec, theta, m, v, t, x, y, d, seed)
    b1, b2, eps = 0.9, 0.999, 1e-8
    order = np.random.default_rng(seed).permutation(len(y))
    shapes = _shapes(spec, d)
    mask = np.concatenate([np.r_[np.ones(a * b), np.zeros(b)] for a, b in shapes])
    theta, m, v = theta.copy(), m.copy(), v.copy()
    single = np.empty(theta.shape, np.float32)
    w, grad, tmp = np.empty_like(theta), np.empty_like(theta), np.empty_like(theta)
    total, steps = 0.0, 0
    for start in range(0, len(order), MINIBATCH):             # in place: new arrays of this size cost more than the sums
        idx = order[start:start + MINIBATCH]
        bs = len(idx)
        np.copyto(single, theta, casting="same_kind")
        loss, g = loss_grad(spec, single, x[idx], y[idx], d, mapped=True)
        np.multiply(theta, mask, out=w)
        pen = 0.5 * float(w @ w) * bs / n_total
        w *= bs
        w /= n_total
        np.add(g, w, out=grad)
        grad /= bs
        t += 1
        steps += 1
        m *= b1
        np.multiply(grad, 1 - b1, out=tmp)
        m += tmp
        v *= b2
        np.multiply(grad, 1 - b2, out=tmp)
        tmp *= grad
        v += tmp
        np.divide(v, 1 - b2 ** t, out=tmp)
        np.sqrt(tmp, out=tmp)
        tmp += eps
        np.divide(m, 1 - b1 ** t, out=grad)
        grad *= spec.lr
        grad /= tmp
        theta -= grad
        total += float(loss) + pen
    return theta, m, v, steps, total


def _mlp_epoch(spec: Spec, theta, m, v, t, x, y, d: Space, seed):
    """``_local_epoch`` of a multilayer perceptron: gradients and moments in single precision, the
    parameters in double; the bias corrections of Adam are factors of the whole step."""
    b1, b2, eps = np.float32(0.9), np.float32(0.999), 1e-8
    order = np.random.default_rng(seed).permutation(len(y))
    xs, ys = x[order].astype(np.float32, copy=False), y[order].astype(np.float32, copy=False)
    shapes = _shapes(spec, d)
    decay = np.concatenate([np.r_[np.full(a * b, L2_ALPHA), np.zeros(b)] for a, b in shapes]).astype(np.float32)
    gradient = _MlpGradient(spec, shapes)
    theta, m, v = theta.copy(), m.astype(np.float32), v.astype(np.float32)
    single, tmp = np.empty(theta.shape, np.float32), np.empty(theta.shape, np.float32)
    step = np.empty_like(theta)
    total, steps = 0.0, 0
    for start in range(0, len(ys), MINIBATCH):
        yb = ys[start:start + MINIBATCH]
        bs = len(yb)
        np.copyto(single, theta, casting="same_kind")
        loss, grad = gradient(single, xs[start:start + bs], yb)
        np.multiply(single, decay, out=tmp)
        pen = 0.5 * float(tmp @ single)
        grad += tmp
        grad *= np.float32(1 / bs)
        t += 1
        steps += 1
        m *= b1
        np.multiply(grad, 1 - b1, out=tmp)
        m += tmp
        v *= b2
        grad *= grad
        grad *= 1 - b2
        v += grad
        right = (1 - 0.999 ** t) ** 0.5
        np.sqrt(v, out=tmp)
        tmp += np.float32(eps * right)
        np.divide(m, tmp, out=tmp)
        np.multiply(tmp, spec.lr * right / (1 - 0.9 ** t), out=step)
        theta -= step
        total += float(loss) + pen
    return theta, m.astype(float), v.astype(float), steps, total


class _MlpGradient:
    """``loss_grad`` of a multilayer perceptron with the layers' arrays kept from batch to batch."""

    def __init__(self, spec: Spec, shapes: list[tuple[int, int]]):
        self.spec, self.shapes = spec, shapes
        self.flat = np.empty(sum(a * b + b for a, b in shapes), np.float32)
        self.grads = _unpack(self.flat, shapes)
        self.acts = [np.empty((MINIBATCH, b), np.float32) for _, b in shapes]
        self.deltas = [np.empty((MINIBATCH, a), np.float32) for a, _ in shapes]
        self.slopes = [np.empty((MINIBATCH, a), np.float32) for a, _ in shapes]

    def __call__(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray):
        n, relu = len(y), self.spec.activation == "relu"
        layers = _unpack(theta, self.shapes)
        acts = [x]
        for i, (w, b) in enumerate(layers):
            z = self.acts[i][:n]
            np.matmul(acts[-1], w, out=z)
            z += b
            if i < len(layers) - 1:
                np.maximum(z, 0.0, out=z) if relu else np.tanh(z, out=z)
            acts.append(z)
        f = acts[-1][:, 0]
        if self.spec.family == "mlp_reg":
            g = f - y
            loss = 0.5 * float(g @ g)
        else:
            p = 1.0 / (1.0 + np.exp(-np.clip(f, -35, 35)))
            loss = float(-(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).sum())
            g = p - y
        delta = g[:, None]
        for i in range(len(layers) - 1, -1, -1):
            gw, gb = self.grads[i]
            np.matmul(acts[i].T, delta, out=gw)
            np.sum(delta, axis=0, out=gb)
            if i > 0:
                below = self.deltas[i][:n]
                if delta.shape[1] == 1:                         # BLAS is slow at products over one column
                    np.multiply(delta, layers[i][0].T, out=below)
                else:
                    np.matmul(delta, layers[i][0].T, out=below)
                if relu:
                    np.multiply(below, acts[i] > 0, out=below)
                else:
                    slope = self.slopes[i][:n]
                    np.multiply(acts[i], acts[i], out=slope)
                    np.subtract(1.0, slope, out=slope)
                    below *= slope
                delta = below
        return loss, self.flat


def deal(costs: list[float], groups: int) -> list[int]:
    """A group for each model: the dearest first, each to the group with the least work so far."""
    load, out = [0.0] * groups, [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: -costs[i]):
        g = load.index(min(load))
        out[i], load[g] = g, load[g] + costs[i]
    return out


def train_many(data: DataFrame, specs: list[Spec], folds: list[int | None], steps: int = 1000,
               tol: float = 1e-4, patience: int = 10, epochs_per_job: int = 5,
               spaces: dict[int | None, Space] | None = None) -> list[_Job]:
    """Train every (spec, held-out fold) pair jointly.

    Each job sends the current parameters and Adam moments of the active
    models to the executors.  With several shards a perceptron visits them one after the other, one
    job each, and its epoch ends with the last; an SVM runs ``epochs_per_job`` local epochs
    in every shard (its held-out fold excluded), and a two-level ``Summarizer`` sum of the states,
    weighted by row count, gives the weighted average (parameter averaging / local SGD),
    which becomes the new global state.  A model stops after ``patience`` epochs without
    improving its epoch loss by ``tol`` (the reference library's ``tol`` /
    ``n_iter_no_change``); the loop ends when every model has stopped or
    after ``steps`` epochs.  The models that are still active are dealt to the
    partitions by their size before every epoch.

    With one shard a task has all rows of its models and looks itself, every ``epochs_per_job`` epochs,
    whether they have stopped, for up to ``ROUNDS`` times a job.

    ``data`` has columns ``y`` (double), ``fold`` (int), ``key`` (long) and one array per space;
    ``spaces`` gives each held-out fold's (default: column ``x`` for all, nothing fitted per fold).
    """
    spark = data.sparkSession
    ship_package(spark)
    if spaces is None:
        whole = find_spaces(data, {"x": None}, False)[None]
        spaces = {f: whole for f in folds}
    columns = sorted({spaces[f].column for f in folds})
    jobs = [_Job(s, f, spaces[f], i) for i, s in enumerate(specs) for f in folds]
    for j in jobs:
        j.theta = init_params(j.spec, j.space)
        j.m, j.v = np.zeros_like(j.theta), np.zeros_like(j.theta)
    counts = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    for j in jobs:
        j.n = sum(c for f, c in counts.items() if j.held_out is None or f != j.held_out)
    mlp = [j for j in jobs if j.spec.family.startswith("mlp")]
    dealt, shards, groups = sharded(data.select(*columns, "y", "fold", "key"), columns, sum(counts.values()),
                                    VISITED_ROWS if len(mlp) == len(jobs) else SHARD_ROWS)
    cached = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _train_visiting(cached, jobs if shards == 1 else mlp, shards, groups, steps, tol, patience, epochs_per_job)
        _train_averaged(cached, [] if shards == 1 else [j for j in jobs if j not in mlp], shards, groups, steps, tol, patience, epochs_per_job)
    finally:
        cached.unpersist()
    return jobs


#: Looks at a model's stopping rule in one job, with one shard.
ROUNDS = 4


def _stopped(best: float, stall: int, losses: list[float], tol: float, patience: int) -> tuple[float, int, bool]:
    """The stopping rule after more epochs: best loss, epochs without a better one, and whether to stop."""
    for obj in losses:
        if obj < best - tol:
            best, stall = obj, 0
        else:
            stall += 1
            if stall >= patience:
                return best, stall, True
    return best, stall, False


def _shard_rows(batches, columns: list[str]):
    """A partition's packed blocks as arrays: shard, group, labels, folds and a function giving a space's rows."""
    parts = [pdf for pdf in batches if not pdf.empty]
    if not parts:
        return None
    pdf = pd.concat(parts, ignore_index=True)                  # one shard
    n = int(pdf["n"].sum())

    def joined(c, kind):
        return np.frombuffer(b"".join(pdf[c]), kind)
    return (int(pdf["shard"].iloc[0]), int(pdf["grp"].iloc[0]), joined("y", np.float64), joined("fold", np.int32),
            lambda c: joined(c, np.float32).reshape(n, -1))


def _own_rows(job: _Job, y, fold, rows, maps: dict):
    """A model's mapped training rows and labels in a shard; ``maps`` keeps them for the next models in the same space."""
    held, space = job.held_out, job.space
    at = (job.spec.kernel, space.column, held)
    if at not in maps:
        maps.clear()                                            # one space's at a time
        sel = np.nonzero(fold != held)[0] if held is not None else np.arange(len(y))
        maps[at] = (_feature_map(job.spec.kernel, space)[0](rows(space.column)[sel]).astype(np.float32) if len(sel) else None,
                    ((y[sel] - space.y_mean) / space.y_std).astype(np.float32))
    return maps[at]


def _dealt(active: list[_Job], groups: int) -> list[int]:
    """A group for each model, by its work.  SVMs of one space go together: they share its feature map, which costs more than their epochs."""
    space = [i if j.spec.family.startswith("mlp") else (j.spec.kernel, j.space.column, j.held_out) for i, j in enumerate(active)]
    cost: dict = {}
    for at, j in zip(space, active):
        cost[at] = cost.get(at, 0.0 if j.spec.family.startswith("mlp") else 5.0 * len(j.theta) * j.n) + float(len(j.theta) + 2000) * j.n
    group = dict(zip(cost, deal(list(cost.values()), groups)))
    return [group[at] for at in space]


def _train_visiting(cached: DataFrame, jobs: list[_Job], shards: int, groups: int, steps: int, tol: float, patience: int,
                    epochs_per_job: int) -> None:
    """Every model's epoch is one pass over the shards, one after the other."""
    spark = cached.sparkSession
    columns = sorted({j.space.column for j in jobs})
    rounds = ROUNDS if shards == 1 else 1
    each = epochs_per_job if shards == 1 else 1
    epoch = 0
    while epoch < steps and (active := [j for j in jobs if not j.done]):
        n_ep = min(rounds * each, steps - epoch)
        dealt = _dealt(active, shards * groups)
        totals, seen = [np.zeros(n_ep) for _ in active], [0] * len(active)
        for hop in range(shards):
            slots: dict = {}
            for i, (j, k) in enumerate(zip(active, dealt)):
                slots.setdefault(((k % shards + hop) % shards, k // shards), []).append((i, j))
            bc = spark.sparkContext.broadcast(slots)

            def local(batches, bc=bc, epoch=epoch, n_ep=n_ep):
                got = _shard_rows(batches, columns)
                if got is None:
                    return
                shard, grp, y, fold, rows = got
                maps: dict = {}
                for i, j in sorted(bc.value.get((shard, grp), []), key=lambda m: (m[1].spec.kernel, m[1].space.column)):
                    xs, ys = _own_rows(j, y, fold, rows, maps)
                    if not len(ys):
                        continue
                    th, mm, vv, t, losses, best, stall = j.theta, j.m, j.v, j.t, [], j.best, j.stall
                    for start in range(0, n_ep, each):
                        for e in range(start, min(n_ep, start + each)):
                            th, mm, vv, ke, obj = _local_epoch(j.spec, th, mm, vv, t, xs, ys, j.space, j.n,
                                                               seed=(j.spec.seed, epoch + e, shard, j.candidate))
                            t += ke
                            losses.append(obj)
                        if shards == 1:
                            best, stall, done = _stopped(best, stall, [x / len(ys) for x in losses[start:]], tol, patience)
                            if done:
                                break
                    yield pd.DataFrame({"model": [i], "state": [np.concatenate([th, mm, vv]).tobytes()], "t": [t],
                                        "losses": [losses], "n": [len(ys)]})

            busy = F.array_contains(F.lit([s * groups + g for s, g in slots]), F.col("shard") * groups + F.col("grp"))
            for r in cached.where(busy).mapInPandas(local, "model int, state binary, t long, losses array<double>, n long").collect():
                j = active[r["model"]]
                j.theta, j.m, j.v = (x.copy() for x in np.frombuffer(r["state"]).reshape(3, -1))
                j.t = r["t"]
                seen[r["model"]] += r["n"]
                totals[r["model"]] = totals[r["model"]][:len(r["losses"])] + r["losses"]
            bc.unpersist()
        epoch += n_ep
        STEPS_RUN[0] = epoch
        for j, total, n in zip(active, totals, seen):
            j.best, j.stall, j.done = _stopped(j.best, j.stall, (total / max(n, 1)).tolist(), tol, patience)


def _train_averaged(cached: DataFrame, jobs: list[_Job], shards: int, groups: int, steps: int, tol: float, patience: int,
                    epochs_per_job: int) -> None:
    """Every model runs some epochs in all shards at once; the states are averaged."""
    spark = cached.sparkSession
    columns = sorted({j.space.column for j in jobs})
    fan_in = max(1, int(shards ** 0.5))
    epoch = 0
    while epoch < steps and (active := [j for j in jobs if not j.done]):
        n_ep = min(epochs_per_job, steps - epoch)
        slot = _dealt(active, groups)
        bc = spark.sparkContext.broadcast([(i, g, j) for i, (j, g) in enumerate(zip(active, slot))])

        def local(batches, bc=bc, epoch=epoch, n_ep=n_ep):
            got = _shard_rows(batches, columns)
            if got is None:
                return
            shard, grp, y, fold, rows = got
            maps: dict = {}
            for i, g, j in sorted((m for m in bc.value if m[1] == grp), key=lambda m: (m[2].spec.kernel, m[2].space.column)):
                xs, ys = _own_rows(j, y, fold, rows, maps)
                if not len(ys):
                    continue
                th, mm, vv, k, losses = j.theta, j.m, j.v, 0, []
                for e in range(n_ep):
                    th, mm, vv, ke, obj = _local_epoch(j.spec, th, mm, vv, j.t + k, xs, ys, j.space, j.n,
                                                       seed=(j.spec.seed, epoch + e, shard, j.candidate))
                    k += ke
                    losses.append(obj)
                yield pd.DataFrame([(i, shard, (np.concatenate([th, mm, vv, [k]]) * float(len(ys))).tolist() + losses, 0.0, len(ys))],
                                   columns=["model", "shard", "g", "loss", "n"])

        per_part = cached.mapInPandas(local, "model int, shard int, g array<double>, loss double, n long")
        summed = tree_sum(per_part, fan_in).collect()
        bc.unpersist()
        epoch += n_ep
        STEPS_RUN[0] = epoch
        for r in summed:
            j = active[r["model"]]
            n = max(r["n"], 1)
            vec = r["g"].toArray()
            size = len(j.theta)
            avg = vec[:3 * size + 1] / n
            j.theta, j.m, j.v = avg[:size], avg[size:2 * size], avg[2 * size:3 * size]
            j.t += int(round(avg[-1]))
            j.best, j.stall, j.done = _stopped(j.best, j.stall, (vec[3 * size + 1:] / n).tolist(), tol, patience)


# ------------------------------------------------------------------ model ---

class GradientModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted model of ``train_many``: scores with ``mapInPandas`` (Arrow batches)."""

    specJson = Param(Params._dummy(), "specJson", "model spec", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "flat parameters", TypeConverters.toListFloat)
    nFeatures = Param(Params._dummy(), "nFeatures", "input width", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "features column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    plattA = Param(Params._dummy(), "plattA", "Platt slope", TypeConverters.toFloat)
    plattB = Param(Params._dummy(), "plattB", "Platt intercept", TypeConverters.toFloat)
    yMean = Param(Params._dummy(), "yMean", "label mean used for standardising", TypeConverters.toFloat)
    yStd = Param(Params._dummy(), "yStd", "label std used for standardising", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel scale", TypeConverters.toFloat)
    landmarks = Param(Params._dummy(), "landmarks", "landmark rows of the rbf kernel, row by row", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, specJson=None, weights=None, nFeatures=None, featuresCol="features",
                 predictionCol="prediction", plattA=1.0, plattB=0.0, yMean=0.0, yStd=1.0, gamma=1.0, landmarks=None):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", plattA=1.0, plattB=0.0,
                         yMean=0.0, yStd=1.0, gamma=1.0, landmarks=[])
        self._set(**self._input_kwargs)

    @property
    def spec(self) -> Spec:
        d = json.loads(self.getOrDefault(self.specJson))
        d["hidden"] = tuple(d.get("hidden", ()))
        return Spec(**d)

    @property
    def space(self) -> Space:
        return Space(self.getOrDefault(self.nFeatures), self.getOrDefault(self.gamma), np.array(self.getOrDefault(self.landmarks), float).tobytes())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spec, theta = self.spec, np.asarray(self.getOrDefault(self.weights))
        d = self.space
        a, b = self.getOrDefault(self.plattA), self.getOrDefault(self.plattB)
        fcol, pcol = self.getOrDefault(self.featuresCol), self.getOrDefault(self.predictionCol)
        ship_package(dataset.sparkSession)
        x = vector_to_array(F.col(fcol))
        if spec.family not in ("mlp_clf", "svc"):
            mu, sd = self.getOrDefault(self.yMean), self.getOrDefault(self.yStd)

            @F.pandas_udf("double")
            def score(xs: pd.Series) -> pd.Series:
                return pd.Series(forward(spec, theta, np.stack(xs.to_numpy()).astype(float), d) * sd + mu)
            return dataset.withColumn(pcol, score(x))

        @F.pandas_udf("pred double, raw double, p1 double")
        def score_clf(xs: pd.Series) -> pd.DataFrame:
            f = forward(spec, theta, np.stack(xs.to_numpy()).astype(float), d)
            z = f if spec.family == "mlp_clf" else a * f + b
            p1 = 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
            pred = (p1 >= 0.5) if spec.family == "mlp_clf" else (f >= 0)
            return pd.DataFrame({"pred": pred.astype(float), "raw": f, "p1": p1})

        out = dataset.withColumn("__s", score_clf(x))
        return out.withColumns({
            pcol: F.col("__s.pred"), "raw": F.col("__s.raw"),
            "probability": array_to_vector(F.array(F.lit(1.0) - F.col("__s.p1"), F.col("__s.p1"))),
        }).drop("__s")


def make_model(job: _Job, features_col: str = "features") -> GradientModel:
    s = asdict(job.spec)
    s["hidden"] = list(s["hidden"])
    space = job.space
    rows = np.frombuffer(space.landmarks).tolist() if job.spec.kernel == "rbf" else []
    return GradientModel(specJson=json.dumps(s), weights=job.theta.tolist(), nFeatures=space.d, featuresCol=features_col,
                         yMean=space.y_mean, yStd=space.y_std, gamma=space.gamma, landmarks=rows)
