"""Random search with 3-fold CV (M12) and the six model families.

Boosted trees (``gbt_search``) share the candidate-independent work:
preprocessing and selector once per fold, one model per (depth, rate) group
scored at every prefix, all groups and folds boosted in one joint loop (see
``ml.boosting``; same scores as the plain cross-validation); the forest search
(``rf_search``) shares the per-fold preprocessing the same way.
``spark_search`` is the plain form: Spark ML estimators inside a full ``Pipeline``
(preprocessing + importance selector + model) under ``CrossValidator`` with
the hash fold column, so scaling, encoding and selection are refitted per
fold as in the reference; candidates run ``parallelism`` at a time.

The gradient families train every candidate on every fold plus the full
refit in one joint loop (see ``ml.gradient``).  Preprocessing, selector, kernel scale,
landmarks and label scale are fitted once per fold on the rows outside it, and
once on all rows for the refit; every row carries the vector of each.
"""
from __future__ import annotations

import itertools
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.metrics import with_class_weight
from pyspark import StorageLevel

from .boosting import BLOCK_ROWS, FEW_BLOCKS, LARGE_BLOCK_ROWS, SPLIT_ROWS, Boosted, boost_many, fit_boosted
from .forest import MOST_ROWS, Forest, fit_forest, forest_accuracies
from .gradient import Spec, find_spaces, forward, make_model, to_training_frame, train_many
from .preprocess import ImportanceSelector, feature_columns, preprocessing_stages

FAMILIES = {
    "gbt_reg": ("regression", K.GBT_GRID),
    "rf_clf": ("classification", K.RF_GRID),
    "mlp_reg": ("regression", K.MLP_GRID),
    "mlp_clf": ("classification", K.MLP_GRID),
    "svr": ("regression", K.SVR_GRID),
    "svc": ("classification", K.SVC_GRID),
}


def sample_grid(grid: dict, n: int = K.SEARCH_CANDIDATES, seed: int = K.SEED) -> list[dict]:
    """Up to ``n`` distinct grid points, drawn with a seeded generator (all when fewer)."""
    keys = list(grid)
    combos = [dict(zip(keys, v)) for v in itertools.product(*grid.values())]
    if len(combos) <= n:
        return combos
    return random.Random(seed).sample(combos, n)


@dataclass
class SearchResult:
    family: str
    task: str
    model: PipelineModel
    best_params: dict
    cv_scores: list[tuple[dict, float]] = field(default_factory=list)
    feature_cols: tuple[list[str], list[str]] = ((), ())

    @property
    def best_score(self) -> float:
        return max(s for _, s in self.cv_scores) if self.cv_scores else float("nan")


def spark_model(family: str, params: dict, label: str, weight_col: str | None):
    if family == "gbt_reg":
        return GBTRegressor(featuresCol="selected", labelCol=label, seed=K.SEED, maxIter=params["maxIter"],
                            maxDepth=params["maxDepth"], stepSize=params["stepSize"])
    depth = params["maxDepth"] if params["maxDepth"] is not None else 30
    # without cached node ids every pass walks all trees from their roots, up to 30 levels
    return RandomForestClassifier(featuresCol="selected", labelCol=label, seed=K.SEED, numTrees=params["numTrees"],
                                  maxDepth=depth, minInstancesPerNode=max(1, params["minSamplesSplit"] // 2),
                                  weightCol=weight_col, cacheNodeIds=True)


def spark_search(train: DataFrame, label: str, family: str, exclude: list[str], n: int = K.SEARCH_CANDIDATES,
                 folds: int = K.CV_FOLDS, parallelism: int = 8, fold_col: str = "fold",
                 grid: dict | None = None) -> SearchResult:
    """M6 (boosted trees, R²) and M7 (balanced random forest, accuracy) via CrossValidator."""
    task, default_grid = FAMILIES[family]
    weight_col = None
    if family == "rf_clf":
        weight_col = "class_weight"
        train = with_class_weight(train, label, weight_col)
    num, cat = feature_columns(train, exclude + [label, fold_col, "class_weight"])
    candidates = sample_grid(grid or default_grid, n)
    pre = preprocessing_stages(num, cat)
    selector = ImportanceSelector(featuresCol="features", labelCol=label, outputCol="selected", task=task)
    # One model stage per candidate keeps each ParamMap a plain estimator swap.
    proto = spark_model(family, candidates[0], label, weight_col)
    pipeline = Pipeline(stages=[*pre, selector, proto])
    maps = []
    for c in candidates:
        m = spark_model(family, c, label, weight_col)
        maps.append({getattr(proto, p.name): m.getOrDefault(p.name) for p in m.params
                     if m.isDefined(p) and p.name in ("maxIter", "maxDepth", "stepSize", "numTrees",
                                                     "minInstancesPerNode")})
    evaluator = (RegressionEvaluator(labelCol=label, metricName="r2") if task == "regression"
                 else MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"))
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds,
                        foldCol=fold_col, parallelism=min(parallelism, len(maps)), seed=K.SEED)
    cvm = cv.fit(train.where(F.col(label).isNotNull()))
    scores = list(zip(candidates, cvm.avgMetrics))
    best = max(range(len(scores)), key=lambda i: scores[i][1])
    return SearchResult(family, task, cvm.bestModel, candidates[best], scores, (num, cat))


#: Bytes of prepared rows that one fitting task holds.
TASK_BYTES = 32 << 20
#: Rows of a fitting task while there are fewer than ``FEW_BLOCKS`` tasks.
TASK_ROWS = BLOCK_ROWS


def task_count(rows: int, width: int = 0) -> int:
    """Fitting tasks for ``rows`` rows of ``width`` bytes in all: one for few rows, 16 for 131,072, then by size."""
    return max(1, min(rows // TASK_ROWS, FEW_BLOCKS), rows // LARGE_BLOCK_ROWS, -(-width // TASK_BYTES))


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt to as many partitions as fitting on them can use and cached, where they have fewer.
    Rows that stay as they are keep their order, on which the forests' draws depend."""
    parts = task_count(rows.count())
    return rows.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK) if parts > rows.rdd.getNumPartitions() else rows


def compact(rows: DataFrame, vector: str = "selected") -> DataFrame:
    """Cached rows in as many partitions as their number and bytes need: a boosting round runs
    several jobs over them, and on a small table their cost is the task count."""
    held = rows.cache()
    n, width = held.select(F.length(F.col(vector).cast("string")).alias("w")).agg(F.count("*"), F.sum("w")).first()
    parts = task_count(n, int(width or 0))
    small = (held.repartition(parts) if parts > held.rdd.getNumPartitions() else held.coalesce(parts)).cache()
    small.count()
    held.unpersist()
    return small


def gbt_search(train: DataFrame, label: str, exclude: list[str], n: int = K.SEARCH_CANDIDATES,
               folds: int = K.CV_FOLDS, parallelism: int = 8, fold_col: str = "fold",
               grid: dict | None = None) -> SearchResult:
    """M6 + M12 with shared work; same candidates, folds and scores as ``spark_search``.

    * Preprocessing and the importance selector do not depend on the
      candidate: they are fitted once per fold (not once per candidate).
    * Boosting is deterministic here (no subsampling), so a 50- or 100-tree
      model is a prefix of the 200-tree model with the same depth and rate:
      one model per (depth, rate) group and fold is grown to the group's largest
      ``maxIter``, all of them in one joint loop (``ml.boosting``), which gives the
      held-out MSE of every prefix; R² = 1 - MSE / var_pop(held-out label).
    The best candidate is refitted on all training rows by ``fit_boosted``.
    """
    train = spread(train.where(F.col(label).isNotNull()))
    num, cat = feature_columns(train, exclude + [label, fold_col])
    candidates = sample_grid(grid or K.GBT_GRID, n)
    groups: dict[tuple, int] = {}
    for c in candidates:
        key = (c["maxDepth"], c["stepSize"])
        groups[key] = max(groups.get(key, 0), c["maxIter"])

    def prepare(f):
        return Pipeline(stages=[*preprocessing_stages(num, cat),
                                ImportanceSelector(featuresCol="features", labelCol=label, outputCol="selected",
                                                   task="regression")]).fit(train.where(F.col(fold_col) != f))

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, folds))) as pool:
        fitted = list(pool.map(prepare, range(folds)))
    var = {r[0]: r[1] for r in train.groupBy(fold_col).agg(F.var_pop(F.col(label).cast("double"))).collect()}
    rows, base = train, list(train.columns)
    for f, pre in enumerate(fitted):
        rows = pre.transform(rows).withColumnRenamed("selected", f"__x{f}").select(*base, f"__x{f}")
        base.append(f"__x{f}")
    spaces = {f: f"__x{f}" for f in range(folds)}
    models = boost_many(rows.select(*spaces.values(), F.col(label).alias("label"), F.col(fold_col).alias("fold")), spaces,
                        [Boosted(f, depth, rate, iters) for f in range(folds) for (depth, rate), iters in groups.items()])
    scores = []
    for c in candidates:
        per_fold = [1.0 - m.mse[c["maxIter"] - 1] / var[m.held_out] if var.get(m.held_out) else 0.0
                    for m in models if (m.depth, m.rate) == (c["maxDepth"], c["stepSize"])]
        scores.append((c, float(np.mean(per_fold))))
    best = max(range(len(scores)), key=lambda i: (scores[i][1], -i))
    b = candidates[best]
    pre = Pipeline(stages=[*preprocessing_stages(num, cat),
                           ImportanceSelector(featuresCol="features", labelCol=label, outputCol="selected",
                                              task="regression")]).fit(train)
    final = PipelineModel(stages=[*pre.stages, fit_boosted(pre.transform(train), spark_model("gbt_reg", b, label, None))])
    train.unpersist()
    return SearchResult("gbt_reg", "regression", final, b, scores, (num, cat))


def _class_weights(train: DataFrame, label: str) -> tuple[list[float] | None, int]:
    """The weight of every class by its number (None when a label is no class number), and the rows."""
    found = train.groupBy(F.col(label).cast("double").alias("y")).agg(F.first("class_weight"), F.count("*")).collect()
    rows = sum(r[2] for r in found)
    if any(not 0 <= r[0] < 100 or r[0] != int(r[0]) for r in found):
        return None, rows
    weights = [0.0] * (int(max((r[0] for r in found), default=0)) + 1)
    for y, w, _ in found:
        weights[int(y)] = float(w)
    return weights, rows


def _forests_by_spark(train, label, fitted, candidates, fold_col, parallelism, _):
    """Every candidate's accuracy on each held-out fold, by ``RandomForestClassifier``."""
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")

    def prepare(f):
        cols = ["selected", label, "class_weight"]
        return tuple(compact(fitted[f].transform(train.where(own)).select(*cols)) for own in (F.col(fold_col) != f, F.col(fold_col) == f))

    with ThreadPoolExecutor(max_workers=len(fitted)) as pool:
        prepared = list(pool.map(prepare, range(len(fitted))))

    def fit_score(job):
        ci, (fit_rows, val_rows) = job
        model = spark_model("rf_clf", candidates[ci], label, "class_weight").fit(fit_rows)
        return ci, evaluator.evaluate(model.transform(val_rows))

    dear = sorted(range(len(candidates)), key=lambda ci: -candidates[ci]["numTrees"] * (candidates[ci]["maxDepth"] or 30))
    jobs = [(ci, p) for ci in dear for p in prepared]                 # the largest forests first, so that none is left over at the end
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(jobs)))) as pool:
        results = list(pool.map(fit_score, jobs))
    for fit_rows, val_rows in prepared:
        fit_rows.unpersist()
        val_rows.unpersist()
    return [[score for c, score in results if c == ci] for ci in range(len(candidates))]


def _keyed(rows: DataFrame, label: str, fold_col: str):
    """``label``, ``fold`` and ``key`` beside the vectors of ``rows``."""
    key = F.xxhash64("id") if "id" in rows.columns else F.xxhash64(*[c for c in rows.columns if not isinstance(rows.schema[c].dataType, VectorUDT)])
    vectors = [c for c in rows.columns if isinstance(rows.schema[c].dataType, VectorUDT)]
    return rows.select(*vectors, F.col(label).alias("label"), F.col(fold_col).alias("fold"), key.alias("key"))


def _forests_in_tasks(train, label, fitted, candidates, fold_col, _, weights):
    """Every candidate's accuracy on each held-out fold, the trees grown whole by tasks."""
    rows, base = train, list(train.columns)
    for f, pre in enumerate(fitted):
        rows = pre.transform(rows).withColumnRenamed("selected", f"__x{f}").select(*base, f"__x{f}")
        base.append(f"__x{f}")
    forests = []
    for c in candidates:
        m = spark_model("rf_clf", c, label, "class_weight")
        forests += [Forest(f, m.getNumTrees(), m.getMaxDepth(), m.getMinInstancesPerNode(), m.getSeed()) for f in range(len(fitted))]
    found = forest_accuracies(_keyed(rows, label, fold_col), {f: f"__x{f}" for f in range(len(fitted))}, forests, weights)
    return [found[k:k + len(fitted)] for k in range(0, len(found), len(fitted))]


def rf_search(train: DataFrame, label: str, exclude: list[str], n: int = K.SEARCH_CANDIDATES,
              folds: int = K.CV_FOLDS, parallelism: int = 8, fold_col: str = "fold",
              grid: dict | None = None) -> SearchResult:
    """M7 + M12 with shared work; same candidates, folds and scores as ``spark_search``.

    Balanced weights (A18) are attached once; preprocessing and the importance
    selector are fitted once per fold; every (candidate, fold) forest is then
    fitted on the prepared rows and scored by accuracy on the held-out fold,
    all fits submitted concurrently.  The best candidate is refitted on all
    training rows.
    """
    train = spread(with_class_weight(train.where(F.col(label).isNotNull()), label, "class_weight"))
    num, cat = feature_columns(train, exclude + [label, fold_col, "class_weight"])
    candidates = sample_grid(grid or K.RF_GRID, n)

    def prepare(f):
        return Pipeline(stages=[*preprocessing_stages(num, cat),
                                ImportanceSelector(featuresCol="features", labelCol=label, outputCol="selected",
                                                   task="classification")]).fit(train if f is None else train.where(F.col(fold_col) != f))

    weights, rows = _class_weights(train, label)
    whole = weights is not None and SPLIT_ROWS < rows <= MOST_ROWS       # a task grows whole trees
    with ThreadPoolExecutor(max_workers=folds) as pool:
        fitted = list(pool.map(prepare, range(folds)))
    per_fold = (_forests_in_tasks if whole else _forests_by_spark)(train, label, fitted, candidates, fold_col, parallelism, weights)
    scores = [(c, float(np.mean(s))) for c, s in zip(candidates, per_fold)]
    best = max(range(len(scores)), key=lambda i: (scores[i][1], -i))
    b = candidates[best]
    pre, model = prepare(None), spark_model("rf_clf", b, label, "class_weight")
    if whole:
        model = fit_forest(_keyed(pre.transform(train), label, fold_col), "selected", model, weights)
    else:
        model = model.fit(pre.transform(train))
    final = PipelineModel(stages=[*pre.stages, model])
    train.unpersist()
    return SearchResult("rf_clf", "classification", final, b, scores, (num, cat))


def _spec(family: str, c: dict) -> Spec:
    if family.startswith("mlp"):
        return Spec(family, hidden=tuple(c["hidden"]), activation=c["activation"], lr=c["learningRate"])
    if family == "svr":
        return Spec(family, C=float(c["C"]), epsilon=float(c["epsilon"]), kernel=c["kernel"], lr=0.01)
    return Spec(family, C=float(c["C"]), kernel=c["kernel"], lr=0.01)


def held_out_margins(data: DataFrame, jobs, label: str = "y") -> DataFrame:
    """``model`` (number of the job), ``raw`` (label units), ``y``: every fold model's output on the rows it never saw."""
    from ..session import ship_package
    spark = data.sparkSession
    ship_package(spark)
    fold_jobs = [(i, j.spec, j.held_out, j.space, j.theta) for i, j in enumerate(jobs) if j.held_out is not None]
    columns = sorted({j[3].column for j in fold_jobs})
    bc = spark.sparkContext.broadcast(fold_jobs)

    def run(batches, bc=bc):
        for pdf in batches:
            fold, y = pdf["fold"].to_numpy(), pdf["y"].to_numpy(dtype=float)
            for i, spec, held, space, theta in bc.value:
                sel = np.nonzero(fold == held)[0]
                if len(sel):
                    x = np.stack(pdf[space.column].to_numpy()[sel]).astype(float)
                    yield pd.DataFrame({"model": i, "raw": forward(spec, theta, x, space) * space.y_std + space.y_mean, "y": y[sel]})

    return data.select(*columns, "y", "fold").mapInPandas(run, "model int, raw double, y double")


def _cv_scores(data: DataFrame, jobs, task: str) -> dict[int, float]:
    """Score every fold model on its held-out rows in one job; mean over folds per candidate."""
    if task == "regression":
        aggs = [F.sum((F.col("raw") - F.col("y")) ** 2).alias("a"), (F.var_pop("y") * F.count("*")).alias("b")]
    else:
        aggs = [F.sum(((F.col("raw") >= 0) == (F.col("y") > 0)).cast("double")).alias("a"), F.count("*").cast("double").alias("b")]
    per: dict[int, list[float]] = {}
    for r in held_out_margins(data, jobs).groupBy("model").agg(*aggs).collect():
        share = r["a"] / r["b"] if r["b"] else float("nan")
        per.setdefault(jobs[r["model"]].candidate, []).append((1.0 - share if r["b"] else 0.0) if task == "regression" else share)
    return {k: float(np.mean(v)) for k, v in per.items()}


def platt(margins: DataFrame) -> tuple[float, float]:
    """Slope and intercept of P(class 1) over a margin (``raw``, ``y``)."""
    lr = LogisticRegression(featuresCol="m", labelCol="y").fit(VectorAssembler(inputCols=["raw"], outputCol="m").transform(margins))
    return float(lr.coefficients[0]), float(lr.intercept)


def gradient_search(train: DataFrame, label: str, family: str, exclude: list[str],
                    n: int = K.SEARCH_CANDIDATES, folds: int = K.CV_FOLDS, fold_col: str = "fold",
                    steps: int = 1000, grid: dict | None = None) -> SearchResult:
    """M8-M11 (+M12): joint training of all candidates x folds, each fold in its own space, then the full refit of the best.

    The probabilities of an SVC come from the margins that its fold models give
    to the rows they never saw (Platt scaling by cross-validation).
    """
    task, default_grid = FAMILIES[family]
    num, cat = feature_columns(train, exclude + [label, fold_col])
    train = train.where(F.col(label).isNotNull())
    held = {**{f"x{f}": f for f in range(folds)}, "x": None}

    def prepare(f):
        rows = train if f is None else train.where(F.col(fold_col) != f)
        return Pipeline(stages=[*preprocessing_stages(num, cat),
                                ImportanceSelector(featuresCol="features", labelCol=label, outputCol="selected", task=task)]).fit(rows)

    with ThreadPoolExecutor(max_workers=len(held)) as pool:
        fitted = dict(zip(held, pool.map(prepare, held.values())))
    rows, base = train, list(train.columns)
    for x, pre in fitted.items():
        rows = pre.transform(rows).withColumnRenamed("selected", f"__{x}").select(*base, f"__{x}")
        base.append(f"__{x}")
    data = to_training_frame(rows, {x: f"__{x}" for x in held}, label, fold_col).persist(StorageLevel.MEMORY_AND_DISK)
    candidates = sample_grid(grid or default_grid, n)
    try:
        spaces = find_spaces(data, held, task == "regression")
        specs = [_spec(family, c) for c in candidates]
        jobs = train_many(data, specs, list(held.values()), steps=steps, spaces=spaces)
        cv = _cv_scores(data, jobs, task) if folds else {}
        scores = [(c, cv.get(i, float("nan"))) for i, c in enumerate(candidates)]
        best = max(range(len(specs)), key=lambda i: (scores[i][1], -i))
        model = make_model(next(j for j in jobs if j.candidate == best and j.held_out is None), "selected")
        if family == "svc" and folds:
            a, b = platt(held_out_margins(data, [j for j in jobs if j.candidate == best]))
            model.set(model.plattA, a)
            model.set(model.plattB, b)
    finally:
        data.unpersist()
    return SearchResult(family, task, PipelineModel(stages=[*fitted["x"].stages, model]), candidates[best], scores if folds else [],
                        (num, cat))


def fit_point(train: DataFrame, label: str, family: str, exclude: list[str], params: dict,
              fold_col: str = "fold", steps: int = 1000) -> SearchResult:
    """One point of a family's space fitted on all training rows, without a search."""
    task = FAMILIES[family][0]
    if family not in ("gbt_reg", "rf_clf"):
        grid = {k: [v] for k, v in params.items()}
        folds = K.CV_FOLDS if family == "svc" else 0       # its probabilities need margins of rows that were held out
        return gradient_search(train, label, family, exclude, n=1, folds=folds, fold_col=fold_col, steps=steps, grid=grid)
    train = train.where(F.col(label).isNotNull())
    weight = None
    if family == "rf_clf":
        weight = "class_weight"
        train = with_class_weight(train, label, weight)
    num, cat = feature_columns(train, exclude + [label, fold_col, "class_weight"])
    pre = Pipeline(stages=[*preprocessing_stages(num, cat),
                           ImportanceSelector(featuresCol="features", labelCol=label, outputCol="selected", task=task)]).fit(train)
    rows = compact(pre.transform(train).select("selected", label, *([weight] if weight else [])))
    model = spark_model(family, params, label, weight)
    model = fit_boosted(rows, model) if family == "gbt_reg" else model.fit(rows)
    rows.unpersist()
    return SearchResult(family, task, PipelineModel(stages=[*pre.stages, model]), params, [], (num, cat))


def fit_selector(train: DataFrame, label: str, exclude: list[str], task: str = "regression", fold_col: str = "fold") -> PipelineModel:
    """M4 + M5 only: preprocessing and the importance selector."""
    train = train.where(F.col(label).isNotNull())
    num, cat = feature_columns(train, exclude + [label, fold_col])
    return Pipeline(stages=[*preprocessing_stages(num, cat),
                            ImportanceSelector(featuresCol="features", labelCol=label, outputCol="selected", task=task)]).fit(train)


def train_family(train: DataFrame, label: str, family: str, exclude: list[str], **kw) -> SearchResult:
    """Dispatch to the right search for ``family`` (see ``FAMILIES``)."""
    if family == "gbt_reg":
        return gbt_search(train, label, exclude, **kw)
    if family == "rf_clf":
        return rf_search(train, label, exclude, **kw)
    return gradient_search(train, label, family, exclude, **kw)
