"""Random forests of many settings and folds, every tree grown by one task.

Spark's forests grow all trees level by level over the dealt rows: a deep tree has thousands of nodes a
level, and every one of them costs a full histogram in every task and a shuffle of it.  While the binned
rows fit a task (``MOST_ROWS``), a tree needs none of that: a task gets all rows of its space by a
shuffle and grows its share of the trees.  Larger tables keep Spark's own way.

The trees are those of ``RandomForestClassifier``: rows drawn with replacement (Poisson(1) times each),
ceil(sqrt(columns)) columns drawn for every node, 32 bins, gini gain of weighted classes, at least
``minInstancesPerNode`` drawn rows in a child, sibling leaves of one prediction merged; a forest's vote is the sum of its
leaves' class shares.  The draws follow from the seed, the tree and the rows alone, not from the partitioning.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .boosting import LARGE_BLOCK_ROWS, MAX_BINS, SPLIT_ROWS, thresholds
from .gradient import deal
from .trees import load_trees

MOST_ROWS = 2_000_000        # rows whose trees are grown whole by a task
CHUNK_TREES = 25             # trees of a forest that stay together
TASKS = 24                   # tasks that the trees of a search are dealt to


@dataclass
class Forest:
    """One forest of a search: ``held_out`` is left out of its training rows (None: nothing is)."""
    held_out: int | None
    trees: int
    depth: int
    least: int               # drawn rows that a child needs
    seed: int


@dataclass
class _Tree:
    """Nodes with parents first; the right child follows the left one; ``feature`` -1: leaf."""
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    counts: np.ndarray       # drawn rows of every class
    gain: np.ndarray
    levels: list[int]        # where each level begins


def _scores(left, total, weights):
    """Weighted gini gain (times the node's weight) of splits: ``left`` and ``total`` are class counts, classes first."""
    w = weights.reshape(-1, *[1] * (left.ndim - 1))
    a, b = left * w, (total - left) * w
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a * a).sum(0) / a.sum(0) + (b * b).sum(0) / b.sum(0) - ((total * w) ** 2).sum(0) / (total * w).sum(0)


def grow(bins: np.ndarray, y: np.ndarray, drawn: np.ndarray, weights: np.ndarray, depth: int, least: int, rng) -> _Tree:
    """One tree on the binned columns ``bins`` (columns, rows) of the rows drawn ``drawn`` times each."""
    d, n, classes = len(bins), bins.shape[1], len(weights)
    flat, most = bins.reshape(-1), int(np.ceil(np.sqrt(d)))
    row = np.flatnonzero(drawn)
    each = [np.where(y[row] == k, drawn[row], 0).astype(float) for k in range(classes)]
    node = np.zeros(len(row), np.int64)
    totals = np.array([[e.sum()] for e in each])
    feature, cut, left, counts, gains, levels = [], [], [], [], [], []
    size, level = 0, 0
    while totals.shape[1]:
        k = totals.shape[1]
        levels.append(size)
        size += k
        open_ = np.zeros(k, bool) if level >= depth or not d else ((totals > 0).sum(0) > 1) & (totals.sum(0) >= 2 * least)
        best, best_f, best_b = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64)
        best_left = np.zeros_like(totals)
        number = np.cumsum(open_) - 1                                  # among the open nodes
        kept = open_[node]
        row, node, each = row[kept], node[kept], [e[kept] for e in each]
        at, own = number[node], np.flatnonzero(open_)
        if len(own):
            total = totals[:, own]
            floor = 1e-10 * (total * weights[:, None]).sum(0)
            picked = rng.random((len(own), d)).argpartition(most - 1, axis=1)[:, :most] if most < d else np.tile(np.arange(d), (len(own), 1))
            for s in range(most):
                column = picked[:, s]
                key = at * MAX_BINS
                key += flat.take(column.take(at) * n + row)
                if len(own) * MAX_BINS <= 2 * len(row):
                    below = np.array([np.bincount(key, e, len(own) * MAX_BINS) for e in each]).reshape(classes, -1, MAX_BINS).cumsum(2)
                    whole = total[:, :, None]
                    rows_left = below.sum(0)
                    score = np.where((rows_left >= least) & (whole.sum(0) - rows_left >= least), _scores(below, np.broadcast_to(whole, below.shape), weights), -1.0)
                    b = score.argmax(1)
                    top, chosen, found = score[np.arange(len(own)), b], below[:, np.arange(len(own)), b], np.arange(len(own))
                else:                                                  # more bins than rows: only those that have some
                    order = np.argsort(key, kind="stable")
                    key = key[order]
                    ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
                    of = key[ends] // MAX_BINS
                    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    below = np.array([np.cumsum(e[order])[ends] for e in each])
                    before = np.where(first > 0, below[:, first - 1], 0.0)
                    below -= before[:, of]
                    whole = total[:, of]
                    rows_left = below.sum(0)
                    score = np.where((rows_left >= least) & (whole.sum(0) - rows_left >= least), _scores(below, whole, weights), -1.0)
                    is_top = np.flatnonzero(score == np.maximum.reduceat(score, first)[of])
                    pick = is_top[np.r_[True, of[is_top][1:] != of[is_top][:-1]]]
                    found, b, top, chosen = of[pick], key[ends[pick]] % MAX_BINS, score[pick], below[:, pick]
                better = top > np.maximum(best[own[found]], floor[found])
                to = own[found[better]]
                best[to], best_f[to], best_b[to] = top[better], column[found[better]], b[better]
                best_left[:, to] = chosen[:, better]
        split = best_f >= 0
        child = 2 * (np.cumsum(split) - 1)                             # number of the left child in the next level
        feature.append(best_f)
        cut.append(best_b)
        left.append(np.where(split, size + child, -1))
        counts.append(totals)
        gains.append(best / np.maximum((totals * weights[:, None]).sum(0), 1e-300))
        kept = split[node]
        row, node, each = row[kept], node[kept], [e[kept] for e in each]
        right = flat.take(best_f[node] * n + row) > best_b[node]
        node = child[node] + right
        rest = totals[:, split] - best_left[:, split]
        totals = np.stack([best_left[:, split], rest], 2).reshape(classes, -1)
        level += 1
    tree = _Tree(np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(counts, 1), np.concatenate(gains), levels)
    _merge(tree, weights)
    return tree


def _merge(tree: _Tree, weights: np.ndarray) -> None:
    """Sibling leaves of one prediction become their parent, from the lowest level up."""
    told = (tree.counts * weights[:, None]).argmax(0)
    for start, end in reversed(list(zip(tree.levels, [*tree.levels[1:], len(tree.feature)]))):
        inner = start + np.flatnonzero(tree.feature[start:end] >= 0)
        a = tree.left[inner]
        same = inner[(tree.feature[a] < 0) & (tree.feature[a + 1] < 0) & (told[a] == told[a + 1])]
        tree.feature[same] = -1


def votes(tree: _Tree, bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(classes, rows): the class shares of the leaves that the rows reach."""
    n, inner = bins.shape[1], tree.feature >= 0
    column, cut = np.where(inner, tree.feature, 0) * n, np.where(inner, tree.bin, MAX_BINS).astype(np.uint8)
    left, flat = np.where(inner, tree.left, np.arange(len(inner))), bins.reshape(-1)
    at, row = np.zeros(n, np.int64), np.arange(n)
    if len(flat):
        for _ in tree.levels[1:]:
            right = flat.take(column.take(at) + row) > cut.take(at)
            at = left.take(at)
            at += right
    share = tree.counts * weights[:, None]
    return (share / share.sum(0))[:, at]


def _grown(bins, y, forest: Forest, number: int, weights) -> _Tree:
    rng = np.random.default_rng((forest.seed, number))
    return grow(bins, y, rng.poisson(1.0, len(y)), weights, forest.depth, forest.least, rng)


def _dealt(data: DataFrame, spaces: dict, forests: list[Forest]):
    """An RDD with a partition for every task: ``(number of the task, block)``; the tasks: space and ``(forest, first tree, trees)``; the cuts."""
    spark = data.sparkSession
    ship_package(spark)
    held = list(spaces)
    data = data.select(*[vector_to_array(F.col(c)).alias(f"x{s}") for s, c in enumerate(spaces.values())], F.col("label").cast("int").alias("label"),
                       F.col("fold").cast("int").alias("fold"), "key").persist(StorageLevel.MEMORY_AND_DISK)
    n, cuts = data.count(), []
    for s, f in enumerate(held):
        near = (data if f is None else data.where(F.col("fold") != f)).orderBy(F.xxhash64(f"x{s}", "label")).limit(SPLIT_ROWS).select(f"x{s}").toPandas()
        x = np.stack(near.iloc[:, 0].to_numpy()) if len(near) else np.zeros((0, len(data.first()[s])))
        cuts.append([thresholds(x[:, c]) for c in range(x.shape[1])])
    tasks = []
    for s, f in enumerate(held):
        own = [(i, k, min(CHUNK_TREES, m.trees - k)) for i, m in enumerate(forests) if m.held_out == f for k in range(0, m.trees, CHUNK_TREES)]
        cost = [float(trees * min(forests[i].depth, 20)) for i, _, trees in own]
        group = deal(cost, max(1, TASKS // len(held)))
        tasks += [(sum(c for c, g in zip(cost, group) if g == k), s, [o for o, g in zip(own, group) if g == k]) for k in sorted(set(group))]
    tasks.sort(key=lambda task: -task[0])
    parts = max(1, -(-n // LARGE_BLOCK_ROWS))
    bc = spark.sparkContext.broadcast((cuts, tasks))

    def blocks(part, rows):
        cuts, tasks = bc.value
        rows = list(rows)
        if not rows:
            return
        found = []
        for s, space in enumerate(cuts):
            x = np.array([r[s] for r in rows], float).reshape(len(rows), len(space))
            found.append(np.array([np.searchsorted(t, x[:, c], "left") for c, t in enumerate(space)], np.uint8).reshape(len(space), len(rows)))
        y, fold = np.array([r[-3] for r in rows], np.int16), np.array([-1 if r[-2] is None else r[-2] for r in rows], np.int16)
        for k, (_, s, _) in enumerate(tasks):
            yield k, (part, found[s], y, fold)

    sorted_ = data.repartition(parts, "key").sortWithinPartitions("key", "label")
    return data, sorted_.rdd.mapPartitionsWithIndex(blocks).partitionBy(len(tasks), lambda k: k), [t[1:] for t in tasks], cuts


def _whole(rows):
    """A task's blocks as one: bins, classes, folds."""
    own = sorted((block for _, block in rows), key=lambda block: block[0])
    return np.concatenate([b[1] for b in own], 1), np.concatenate([b[2] for b in own]), np.concatenate([b[3] for b in own])


def forest_accuracies(data: DataFrame, spaces: dict[int, str], forests: list[Forest], weights: list[float]) -> list[float]:
    """The accuracy of every forest on the fold that it holds out.

    ``data``: a vector column per held-out fold (``spaces``), ``label`` (class number), ``fold``, ``key`` (long)."""
    cached, dealt, tasks, _ = _dealt(data, spaces, forests)
    weights = np.array(weights, float)

    def score(k, rows):
        bins, y, fold = _whole(rows)
        held = next(f for s, f in enumerate(spaces) if s == tasks[k][0])
        own, out = (fold != held) & (fold >= 0), fold == held
        train, test = np.ascontiguousarray(bins[:, own]), np.ascontiguousarray(bins[:, out])
        for i, first, trees in tasks[k][1]:
            yield i, (sum(votes(_grown(train, y[own], forests[i], first + t, weights), test, weights) for t in range(trees)), y[out])

    def right(found):
        shares, y = found
        return int((shares.argmax(0) == y).sum()), len(y)

    try:
        hit = dict(dealt.mapPartitionsWithIndex(score).reduceByKey(lambda a, b: (a[0] + b[0], a[1])).mapValues(right).collect())
    finally:
        cached.unpersist()
    return [hit[i][0] / hit[i][1] if hit[i][1] else float("nan") for i in range(len(forests))]


def fit_forest(data: DataFrame, features: str, estimator, weights: list[float]):
    """``estimator`` (a ``RandomForestClassifier``) fitted on all rows of ``data`` (as above)."""
    forest = Forest(None, estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getSeed())
    cached, dealt, tasks, cuts = _dealt(data, {None: features}, [forest])
    weight = np.array(weights, float)

    def nodes(k, rows):
        bins, y, _ = _whole(rows)
        for _, first, trees in tasks[k][1]:
            for t in range(first, first + trees):
                yield from _node_rows(t, _grown(bins, y, forest, t, weight), weight, cuts[0])

    try:
        return load_trees(estimator, data.sparkSession, dealt.mapPartitionsWithIndex(nodes), [1.0] * forest.trees, len(cuts[0]), len(weights))
    finally:
        cached.unpersist()


def _node_rows(number: int, tree: _Tree, weights: np.ndarray, cuts: list):
    """A tree's nodes, parents first, as ``trees.NODES``."""
    reached = np.zeros(len(tree.feature), bool)
    reached[0] = True
    for start, end in zip(tree.levels, [*tree.levels[1:], len(tree.feature)]):
        inner = start + np.flatnonzero(reached[start:end] & (tree.feature[start:end] >= 0))
        reached[tree.left[inner]] = reached[tree.left[inner] + 1] = True
    order = np.flatnonzero(reached)
    place = np.cumsum(reached) - 1
    share = (tree.counts * weights[:, None])[:, order]
    impurity, told = 1.0 - (share * share).sum(0) / share.sum(0) ** 2, share.argmax(0)
    drawn, share = tree.counts[:, order].sum(0), share.T.tolist()
    for k, node in enumerate(order.tolist()):
        f = int(tree.feature[node])
        if f < 0:
            yield number, (k, float(told[k]), float(impurity[k]), share[k], int(drawn[k]), -1.0, -1, -1, (-1, [], -1))
        else:
            a = int(place[tree.left[node]])
            yield number, (k, float(told[k]), float(impurity[k]), share[k], int(drawn[k]), float(tree.gain[node]), a, a + 1,
                           (f, [float(cuts[f][tree.bin[node]])], -1))
