"""Boosted trees of many (depth, rate) settings and folds side by side.

Boosting is a chain of small steps: one per tree level.  While the rows of a space fit a task
(``ALONE_ROWS`` a model, ``MOST_ROWS`` at most), every model is boosted to its end by one task,
which gets the binned rows of its space by a shuffle: a search is one Spark job.  Larger tables
stay dealt: one job per level serves all models that are still growing, so a search costs as many
jobs as its longest model.

The trees are those of ``GBTRegressor`` with its defaults (squared loss, 32 bins, variance
gain, no subsampling): the first tree learns the label with weight 1, every further
tree twice the residual with weight ``rate``.  The training rows are blocks of binned columns;
in the joint loop they stay in Spark as cached blocks with every model's prediction; a task sums its block's
histograms, two levels of tasks add them, and only histograms and trees
reach the driver.  Of two siblings the one with fewer rows is summed, the other is
the rest of their parent.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from .gradient import deal
from .trees import load_trees

MAX_BINS = 32                # GBTRegressor's default
SPLIT_ROWS = 10_000          # rows that GBTRegressor, too, finds its thresholds on
BLOCK_ROWS = 8_192           # rows of a block while there are fewer than FEW_BLOCKS of them ...
FEW_BLOCKS = 16
LARGE_BLOCK_ROWS = 65_536    # ... and at most this many otherwise
CHECKPOINT_TREES = 20        # the lineage of the predictions is cut after as many trees
ALONE_ROWS = 1_500_000       # rows for each model of a search up to which a task boosts a whole model ...
MOST_ROWS = 6_000_000        # ... and rows that a task holds at most (about 50 bytes each)
TASKS = 24                   # tasks that whole models are dealt to


@dataclass
class Boosted:
    """One model of the loop: ``held_out`` is left out of its training rows and scored (None: nothing is)."""
    held_out: int | None
    depth: int
    rate: float
    rounds: int
    mse: list[float] = field(default_factory=list)      # of the held-out rows, after every tree
    keep: bool = False                                  # whether its trees are wanted
    trees: list = field(default_factory=list)           # (tree, statistics of its nodes)
    cuts: list = field(default_factory=list)            # where the columns of its space are cut


@dataclass
class _Tree:
    """Nodes by heap number (children of i: 2i, 2i + 1); ``feature`` -1: leaf."""
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray


def thresholds(values: np.ndarray, max_bins: int = MAX_BINS) -> np.ndarray:
    """Where a column is cut: between all its values, or where the counts come nearest to equal shares."""
    found, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    between = (found[1:] + found[:-1]) / 2
    if len(between) < max_bins:
        return between
    reached, stride = np.cumsum(counts).astype(float), counts.sum() / max_bins
    out, target = [], stride
    for i in range(1, len(found)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out[:max_bins - 1])


def _steps(tree: _Tree, bins: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
    """The nodes that rows at the nodes ``at`` reach in ``levels`` steps; below a leaf a row keeps left."""
    if not len(bins):
        return at << levels
    row, flat, split = np.arange(bins.shape[1]), bins.reshape(-1), tree.feature >= 0
    column = np.where(split, tree.feature, 0).astype(np.int64) * bins.shape[1]      # where its values begin in ``flat``
    cut = np.where(split, tree.bin, MAX_BINS).astype(np.uint8)
    for _ in range(levels):
        place = column.take(at)
        place += row
        right = flat.take(place) > cut.take(at)
        at = at + at
        at += right
    return at


def _walk(tree: _Tree, bins: np.ndarray, levels: int) -> np.ndarray:
    """Every row's node after ``levels`` steps from the root."""
    return _steps(tree, bins, np.ones(bins.shape[1], np.int64), levels)


def _histogram(bins, y, fold, raw, at, held, first, slot, wanted, keep):
    """Sums of the targets and counts (``keep``: and sums of their squares) by wanted node, column and bin."""
    node = slot.take(at)
    mine = node >= 0
    if held is not None:
        mine &= fold != held
    rows = np.flatnonzero(mine)
    target = y[rows] if first else 2.0 * (y[rows] - raw[rows])
    square = target * target if keep else None
    key = node[rows] * MAX_BINS
    hist = np.empty((3 if keep else 2, wanted, len(bins), MAX_BINS))
    for c, column in enumerate(bins):
        place = key + column.take(rows)
        hist[0, :, c] = np.bincount(place, target, wanted * MAX_BINS).reshape(wanted, MAX_BINS)
        hist[1, :, c] = np.bincount(place, minlength=wanted * MAX_BINS).reshape(wanted, MAX_BINS)
        if keep:
            hist[2, :, c] = np.bincount(place, square, wanted * MAX_BINS).reshape(wanted, MAX_BINS)
    return hist


def _histograms(block, plan, scored=()):
    """``model -> (2, wanted nodes, columns, bins)``: sums of the targets and counts over the block;
    ``(model, "error") -> `` squared error and number of the held-out rows for the models of ``scored``."""
    bins, y, fold, raw = block
    out = {}
    for i, held in scored:
        out[i, "error"] = _error(y, fold, raw[i], held)
    for i, space, held, first, keep, tree, level, slot, wanted in plan:
        out[i] = _histogram(bins[space], y, fold, raw[i], _walk(tree, bins[space], level), held, first, slot, wanted, keep)
    return out


def _error(y, fold, raw, held):
    """Squared error and number of the held-out rows."""
    left = fold == held if held is not None else np.zeros(len(y), bool)
    return np.array([((y[left] - raw[left]) ** 2).sum(), left.sum()])


def _add(a, b):
    return {i: a[i] + b[i] for i in a}


def _sum(state, plan, scored, parts):
    """The histograms and errors of all blocks."""
    found = state.map(lambda block: _histograms(block, plan, scored))
    return found.reduce(_add) if parts <= FEW_BLOCKS else found.treeReduce(_add)


def _grown(block, new):
    """The block with the new trees in the predictions."""
    bins, y, fold, raw = block
    raw = dict(raw)
    for i, space, weight, tree, depth in new:
        raw[i] = raw[i] + weight * tree.value[_walk(tree, bins[space], depth)]
    return bins, y, fold, raw


def _advance(state, new):
    return state.map(lambda block: _grown(block, new))


def _forget(spark, path):
    """Delete a checkpoint of this loop that nothing reads any more."""
    if path:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _blocks(rows, cuts):
    """One block of a partition's rows: per space the bins of its columns; the label, the fold, no predictions."""
    rows = list(rows)
    if not rows:
        return
    bins = []
    for s, space in enumerate(cuts):
        x = np.array([r[s] for r in rows], float).reshape(len(rows), len(space))
        bins.append(np.array([np.searchsorted(t, x[:, c], "left") for c, t in enumerate(space)], np.uint8).reshape(len(space), len(rows)))
    yield bins, np.array([r[-2] for r in rows], float), np.array([r[-1] for r in rows], np.int8), {}


def _best(hist):
    """Best split of every node: gain, column, bin, rows and target sums of both sides."""
    sums, counts = np.cumsum(hist[0], 2), np.cumsum(hist[1], 2)
    total, n = sums[:, :1, -1:], counts[:, :1, -1:]
    left, right = counts[..., :-1], n - counts[..., :-1]
    s, rest = sums[..., :-1], total - sums[..., :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((left > 0) & (right > 0), s * s / left + rest * rest / right - total * total / n, -np.inf)
    flat = gain.reshape(len(gain), -1).argmax(1)
    at = np.unravel_index(flat, gain.shape[1:])
    i = np.arange(len(gain))
    return gain[i, at[0], at[1]], at[0], at[1], left[i, at[0], at[1]], right[i, at[0], at[1]], s[i, at[0], at[1]], rest[i, at[0], at[1]], n[:, 0, 0], total[:, 0, 0]


class _Growing:
    """The tree that a model grows now: which nodes are summed next, and their histograms."""

    def __init__(self, model: Boosted):
        size = 2 << model.depth
        self.model, self.level = model, 0
        self.tree = _Tree(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))
        self.nodes = {"count": np.zeros(size), "sum": np.zeros(size), "square": np.zeros(size), "gain": np.zeros(size)} if model.keep else None
        self.asked, self.sibling, self.parents = [1], {}, {}

    def request(self):
        slot = np.full(len(self.tree.feature), -1, np.int64)
        slot[self.asked] = np.arange(len(self.asked))
        return self.tree, self.level, slot, len(self.asked)

    def grow(self, hist):
        """Split the nodes of this level; whether there are more to split."""
        own = {node: hist[:, k] for k, node in enumerate(self.asked)}
        for node, other in self.sibling.items():
            own[other] = self.parents[node >> 1] - own[node]
        nodes = sorted(own)
        stacked = np.stack([own[n] for n in nodes], 1)
        gain, column, at, n_left, n_right, s_left, s_right, n, total = _best(stacked)
        self.asked, self.sibling, self.parents = [], {}, {}
        for k, node in enumerate(nodes):
            self.tree.value[node] = total[k] / n[k] if n[k] else 0.0
            self._note(node, n[k], total[k], stacked[2, k, 0].sum() if self.nodes else 0.0)
            if not gain[k] > 1e-12 * total[k] ** 2 / max(n[k], 1.0):
                below = 2 * node
                while below < len(self.tree.value):          # rows in a leaf keep left
                    self.tree.value[below] = self.tree.value[node]
                    below *= 2
                continue
            self.tree.feature[node], self.tree.bin[node] = column[k], at[k]
            self.tree.value[2 * node], self.tree.value[2 * node + 1] = s_left[k] / n_left[k], s_right[k] / n_right[k]
            small, large = (2 * node, 2 * node + 1) if n_left[k] <= n_right[k] else (2 * node + 1, 2 * node)
            self.asked.append(small)
            self.sibling[small] = large
            self.parents[node] = own[node]
            if self.nodes:
                square = stacked[2, k, column[k], :at[k] + 1].sum()
                self.nodes["gain"][node] = gain[k] / n[k]
                self._note(2 * node, n_left[k], s_left[k], square)
                self._note(2 * node + 1, n_right[k], s_right[k], stacked[2, k, 0].sum() - square)
        self.level += 1
        return bool(self.asked) and self.level < self.model.depth

    def _note(self, node, count, total, square):
        if self.nodes:
            self.nodes["count"][node], self.nodes["sum"][node], self.nodes["square"][node] = count, total, square


def _boosted(blocks, model: Boosted):
    """A whole model by one task that holds all blocks of its space: the errors and the kept trees."""
    raw, errors, trees = [np.zeros(len(y)) for _, y, _ in blocks], [], []
    for t in range(model.rounds):
        growing = _Growing(model)
        at, more = [np.ones(len(y), np.int64) for _, y, _ in blocks], True
        while more:
            _, level, slot, wanted = growing.request()
            more = growing.grow(reduce(np.add, (_histogram(bins, y, fold, r, a, model.held_out, t == 0, slot, wanted, model.keep)
                                                for (bins, y, fold), r, a in zip(blocks, raw, at))))
            at = [_steps(growing.tree, bins, a, 1) for (bins, _, _), a in zip(blocks, at)]
        value = growing.tree.value * (1.0 if t == 0 else model.rate)
        raw = [r + value.take(a << (model.depth - growing.level)) for r, a in zip(raw, at)]
        square, rows = reduce(np.add, (_error(y, fold, r, model.held_out) for (_, y, fold), r in zip(blocks, raw)))
        errors.append(float(square / rows) if rows else float("nan"))
        if model.keep:
            trees.append((growing.tree, growing.nodes))
    return errors, trees


def _boost_alone(blocks, place: dict, models: list[Boosted]) -> None:
    """Every model by one task; a task gets the blocks of one space only, the longest tasks come first."""
    tasks = []
    for held, s in place.items():
        own = [i for i, m in enumerate(models) if m.held_out == held]
        cost = [float(models[i].rounds * models[i].depth) for i in own]
        group = deal(cost, min(len(own), max(1, TASKS // len(place)))) if own else []
        tasks += [(sum(c for c, g in zip(cost, group) if g == k), s, [i for i, g in zip(own, group) if g == k]) for k in sorted(set(group))]
    tasks.sort(key=lambda task: -task[0])

    def copies(part, rows):
        for bins, y, fold, _ in rows:
            for k, (_, s, _) in enumerate(tasks):
                yield k, (part, bins[s], y, fold)

    def train(k, rows):
        own = [block[1:] for block in sorted((block for _, block in rows), key=lambda block: block[0])]
        for i in tasks[k][2]:
            yield i, _boosted(own, models[i])

    dealt = blocks.mapPartitionsWithIndex(copies).partitionBy(len(tasks), lambda k: k)
    for i, (errors, trees) in dealt.mapPartitionsWithIndex(train).collect():
        models[i].mse, models[i].trees = errors if models[i].held_out is not None else [], trees


def boost_many(data: DataFrame, spaces: dict[int, str], models: list[Boosted]) -> list[Boosted]:
    """Fill ``mse`` of every model that holds a fold out, and the trees of those that keep them.

    ``data``: a vector column per held-out fold (``spaces``), ``label`` (double), ``fold`` (int).
    """
    spark = data.sparkSession
    sc = spark.sparkContext
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    held = list(spaces)
    data = data.select(*[vector_to_array(F.col(spaces[f])).alias(f"x{s}") for s, f in enumerate(held)], F.col("label").cast("double").alias("label"),
                       F.col("fold").cast("int").alias("fold")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = data.count()
        if not n:
            return models
        cuts = []
        for s, f in enumerate(held):
            near = (data if f is None else data.where(F.col("fold") != f)).orderBy(F.xxhash64(f"x{s}", "label")).limit(SPLIT_ROWS).select(f"x{s}").toPandas()
            x = np.stack(near.iloc[:, 0].to_numpy()) if len(near) else np.zeros((0, len(data.first()[s])))
            cuts.append([thresholds(x[:, c]) for c in range(x.shape[1])])
        for m in models:
            m.cuts = cuts[held.index(m.held_out)]
        place = {f: s for s, f in enumerate(held)}
        parts = max(1, min(-(-n // BLOCK_ROWS), FEW_BLOCKS), -(-n // LARGE_BLOCK_ROWS))
        bc = sc.broadcast(cuts)
        blocks = data.repartition(parts).rdd.mapPartitions(lambda rows: _blocks(rows, bc.value))
        if n <= min(ALONE_ROWS * len(models), MOST_ROWS):
            _boost_alone(blocks, place, models)
            bc.unpersist()
            return models
        state = blocks.map(lambda b: (b[0], b[1], b[2], {i: np.zeros(len(b[1])) for i in range(len(models))})).persist(StorageLevel.MEMORY_AND_DISK)
        state.count()
    finally:
        data.unpersist()
    written, before, scored = None, None, []

    def take(summed):
        for i, _ in scored:
            square, rows = summed[i, "error"]
            if models[i].held_out is not None:
                models[i].mse.append(float(square / rows) if rows else float("nan"))

    try:
        for t in range(max(m.rounds for m in models)):
            growing = {i: _Growing(m) for i, m in enumerate(models) if t < m.rounds}
            going = list(growing)
            while going:
                plan = [(i, place[models[i].held_out], models[i].held_out, t == 0, models[i].keep, *growing[i].request()) for i in going]
                summed = _sum(state, plan, scored, parts)       # the first job over a new state also scores it
                take(summed)
                scored = []
                if before is not None:
                    before.unpersist()
                    before = None
                    if state.isCheckpointed():
                        _forget(spark, written)
                        written = state.getCheckpointFile()
                going = [i for i in going if growing[i].grow(summed[i])]
            new = [(i, place[models[i].held_out], 1.0 if t == 0 else models[i].rate, g.tree, models[i].depth) for i, g in growing.items()]
            scored = [(i, models[i].held_out) for i in growing]
            for i, g in growing.items():
                if models[i].keep:
                    models[i].trees.append((g.tree, g.nodes))
            before, state = state, _advance(state, new).persist(StorageLevel.MEMORY_AND_DISK)
            if (t + 1) % CHECKPOINT_TREES == 0:
                state.checkpoint()
        take(_sum(state, [], scored, parts))
    finally:
        if before is not None:
            before.unpersist()
        last = state.getCheckpointFile() if state.isCheckpointed() else None
        state.unpersist()
        for path in {written, last}:
            _forget(spark, path)
        bc.unpersist()
    return models


def _node_rows(number: int, tree: _Tree, nodes: dict, cuts: list):
    """A tree's nodes, parents first, as ``trees.NODES``."""
    order, at = [1], 0
    while at < len(order):
        if tree.feature[order[at]] >= 0:
            order += [2 * order[at], 2 * order[at] + 1]
        at += 1
    place = {node: k for k, node in enumerate(order)}
    for k, node in enumerate(order):
        f, n = int(tree.feature[node]), float(nodes["count"][node])
        mean = float(nodes["sum"][node]) / n if n else 0.0
        impurity = max(0.0, float(nodes["square"][node]) / n - mean * mean) if n else 0.0
        stats = [n, float(nodes["sum"][node]), float(nodes["square"][node])]
        leaf = f < 0
        yield (number, (k, float(tree.value[node]), impurity, stats, int(n), -1.0 if leaf else float(nodes["gain"][node]),
                        -1 if leaf else place[2 * node], -1 if leaf else place[2 * node + 1],
                        (-1, [], -1) if leaf else (f, [float(cuts[f][tree.bin[node]])], -1)))


def fit_boosted(rows: DataFrame, estimator):
    """``estimator`` (a ``GBTRegressor``) fitted on ``rows`` without its own chain of jobs, a job a level
    and each tree's slower than the last one's: the same trees while all rows give the thresholds."""
    features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    model = Boosted(None, estimator.getMaxDepth(), estimator.getStepSize(), estimator.getMaxIter(), keep=True)
    boost_many(rows.select(features, F.col(label).cast("double").alias("label"), F.lit(0).alias("fold")), {None: features}, [model])
    if not model.trees:
        return estimator.fit(rows)                              # no rows: its own error
    nodes = [r for k, (tree, found) in enumerate(model.trees) for r in _node_rows(k, tree, found, model.cuts)]
    weights = [1.0] + [model.rate] * (model.rounds - 1)
    return load_trees(estimator, rows.sparkSession, nodes, weights, len(model.cuts))
