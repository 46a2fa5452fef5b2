"""End-to-end training plan: the reference's training page / CLI as Spark jobs.

prepared cohort -> class guard (F4) -> md5 split (M1) + folds (W3; by class for
the classifiers) -> six family searches (M6-M12) and per-subject boosted trees (M13) -> test
metrics (A15/A16) -> metric table (M24) and best model per task (M14).
"""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import expr as X
from ..ml.boosting import fit_boosted
from ..ml.preprocess import ImportanceSelector, feature_columns, preprocessing_stages
from ..ml.scoring import predict
from ..ml.search import FAMILIES, SearchResult, compact, spark_model, train_family
from ..operators import metrics as M
from ..operators.cohort import class_guard
from ..operators.columns import model_drop_list
from ..operators.sampling import with_folds, with_split, with_stratified_folds

REG_FAMILIES = ["gbt_reg", "mlp_reg", "svr"]           # selection order for M14
CLF_FAMILIES = ["rf_clf", "mlp_clf", "svc"]
FAMILY_NAMES = K.FAMILY_NAMES


@dataclass
class Trained:
    frame: DataFrame                                   # prepared rows + is_test + fold
    results: dict[str, SearchResult] = field(default_factory=dict)
    subjects: dict[str, SearchResult] = field(default_factory=dict)
    metrics: list[dict] = field(default_factory=list)
    best: dict[str, str] = field(default_factory=dict)

    @property
    def train(self) -> DataFrame:
        return self.frame.where(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.frame.where(F.col("is_test"))


def model_frame(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Add the split flag and the folds: by the id only, and (with a pass label) stratified by it within the split."""
    df = with_folds(with_split(df, id_col), id_col)
    return with_stratified_folds(df, ["is_test", K.TARGET_CLF], id_col, col="fold_class") if K.TARGET_CLF in df.columns else df


def fold_column(df: DataFrame, task: str) -> str:
    """Classifiers are cross-validated on stratified folds, where there are any."""
    return "fold_class" if task == "classification" and "fold_class" in df.columns else "fold"


def excluded_columns(df: DataFrame, target: str = K.TARGET_REG, uploaded: bool = False) -> list[str]:
    """Everything that is not a model input: identity, grades, clocks, targets, split columns."""
    observed = [c for c in df.columns if c.endswith("__observed")]
    return model_drop_list(df.columns, target, uploaded) + ["id", "is_test", "fold", "fold_class", *observed]


def test_metrics(result: SearchResult, test: DataFrame, label: str) -> dict:
    scored = predict(result.model, test, "pred")
    if result.task == "regression":
        r = M.regression_metrics(scored, label, "pred").first()
        return {"task": "regression", "family": result.family, "r2": r["r2"], "mae": r["mae"], "rmse": r["rmse"]}
    r = M.classification_metrics(scored, label, "pred").first()
    return {"task": "classification", "family": result.family, "accuracy": r["accuracy"], "f1": r["f1"],
            "precision": r["precision"], "recall": r["recall"]}


def choose_best(metrics: list[dict]) -> dict[str, str]:
    """Highest R² / accuracy; a later family wins only if strictly better."""
    best = {}
    for task, fams, key in (("regression", REG_FAMILIES, "r2"), ("classification", CLF_FAMILIES, "accuracy")):
        cand = [m for f in fams for m in metrics if m["family"] == f]
        if cand:
            top = cand[0]
            for m in cand[1:]:
                if (m[key] if m[key] is not None else float("-inf")) > \
                   (top[key] if top[key] is not None else float("-inf")):
                    top = m
            best[task] = top["family"]
    return best


def with_observed(frame: DataFrame, raw: DataFrame, subjects: list[str], id_col: str = "id") -> DataFrame:
    """``frame`` with each subject's grade as it was before imputation, ``<subject>__observed``."""
    seen = raw.select(id_col, *[F.col(s).cast("double").alias(f"{s}__observed") for s in subjects])
    return frame.join(seen, id_col, "left")


def train_subject_models(frame: DataFrame, subjects: list[str], exclude: list[str],
                         threads: int = 4, fit=train_family, **kw) -> dict[str, SearchResult]:
    """One boosted-tree model per grade column, trained on rows with an observed grade.

    The label is ``<subject>__observed`` where the frame has it (see
    ``with_observed``): cleaning has filled the grade columns themselves.  The
    fits are independent Spark jobs, submitted from a thread pool so their
    small jobs overlap on the cluster.
    """
    train = frame.where(~F.col("is_test"))
    observed = [c for c in frame.columns if c.endswith("__observed")]

    def one(subject):
        label = f"{subject}__observed" if f"{subject}__observed" in frame.columns else subject
        excl = [*exclude, K.TARGET_REG, K.TARGET_CLF, subject, *(c for c in observed if c != label)]
        return subject, fit(train.where(F.col(label).isNotNull()), label, "gbt_reg", excl, **kw)

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        return dict(pool.map(one, subjects))


def fit_subject_models(frame: DataFrame, subjects: list[str], exclude: list[str], params: dict, threads: int = 4) -> dict[str, SearchResult]:
    """M13 over shared work: the boosted trees of every subject at one point of their space.

    The subjects have the same inputs, so preprocessing is fitted and applied once, and one
    cached matrix with all labels serves every selector and every boosting; a subject's
    rows are those whose label is observed.  The fits are submitted together.
    """
    train = frame.where(~F.col("is_test"))
    observed = [c for c in frame.columns if c.endswith("__observed")]
    labels = {s: f"{s}__observed" if f"{s}__observed" in frame.columns else s for s in subjects}
    num, cat = feature_columns(train, [*exclude, K.TARGET_REG, K.TARGET_CLF, *subjects, *observed])
    pre = Pipeline(stages=preprocessing_stages(num, cat)).fit(train)
    matrix = compact(pre.transform(train).select("features", *[F.col(c).cast("double").alias(f"label_{s}") for s, c in labels.items()]), "features")

    def one(subject):
        label = f"label_{subject}"
        rows = matrix.where(F.col(label).isNotNull())
        selector = ImportanceSelector(featuresCol="features", labelCol=label, outputCol="selected", task="regression").fit(rows)
        trees = fit_boosted(selector.transform(rows), spark_model("gbt_reg", params, label, None))
        return subject, SearchResult("gbt_reg", "regression", PipelineModel(stages=[*pre.stages, selector, trees]), params, [], (num, cat))

    try:
        with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
            return dict(pool.map(one, subjects))
    finally:
        matrix.unpersist()


def train_models(df: DataFrame, target: str = K.TARGET_REG, threshold: float = K.PASS_THRESHOLD,
                 families: list[str] | None = None, subjects: list[str] | None = None,
                 uploaded: bool = False, raw: DataFrame | None = None, **kw) -> Trained:
    """Train the requested families (default: all six) and subject models (on ``raw``'s observed grades)."""
    if K.TARGET_CLF not in df.columns:
        df = df.withColumn(K.TARGET_CLF, X.pass_label(target, threshold))
    frame = model_frame(df)
    if raw is not None and subjects:
        frame = with_observed(frame, raw, subjects)
    if not class_guard(frame, K.TARGET_CLF):
        raise ValueError("the pass label has a single class: adjust the threshold")
    if not class_guard(frame.where(~F.col("is_test")), K.TARGET_CLF):
        raise ValueError("the training split has a single class")
    exclude = excluded_columns(frame, target, uploaded)
    out = Trained(frame=frame)
    train = out.train
    for fam in families or list(FAMILIES):
        task = FAMILIES[fam][0]
        label = target if task == "regression" else K.TARGET_CLF
        excl = [c for c in exclude if c != label]
        out.results[fam] = train_family(train, label, fam, excl, **{"fold_col": fold_column(frame, task), **kw})
        out.metrics.append(test_metrics(out.results[fam], out.test, label))
    out.best = choose_best(out.metrics)
    if subjects:
        out.subjects = train_subject_models(frame, subjects, exclude, **kw)
    return out
