"""Command-line batch run.

    python -m gradelens.plans.cli --sf /root/testdata/sf0.01 --out /shared/run1
    python -m gradelens.plans.cli --csv grades.csv --out /shared/run2 --target moyenne --threshold 12 --map sommeil=sleep

load (cohort view or CSV) -> row id -> schema check -> column mapping -> clean
-> clocks -> features -> split -> model families and subject models -> test
metrics -> predictions as ';' CSV -> Shapley tables (all and failing test
students) -> model bundle -> Markdown report.
"""
from __future__ import annotations

import argparse
import logging

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import expr as X
from ..ml.explain import failure_impact, feature_impact
from ..ml.persist import save_models
from ..ml.preprocess import selected_features
from ..ml.scoring import pass_probability, predict, predict_all
from ..operators.clean import clean
from ..operators.columns import column_mapping, default_target, override_mapping, require_columns, with_row_id
from ..operators.features import add_clock_features, add_features
from ..session import cut_lineage, local_session
from ..sources.csv_io import read_table_csv, write_table_csv
from .prepare import raw_cohort, with_row_mean
from .report import build_report, write_report
from .training import train_models

CLI_FAMILIES = ["gbt_reg", "rf_clf", "mlp_reg", "mlp_clf"]


def load_csv(spark, csv: str, target: str | None = None):
    """An uploaded table: lower-case names, an id for every row, and its target column.

    The table is written once with its ids, so that every later pass sees the same ones."""
    df = read_table_csv(spark, csv)
    if df is None:
        raise SystemExit(f"cannot read {csv}")
    df = cut_lineage(with_row_id(df))
    if target is None and K.TARGET_REG not in df.columns and any(c in df.columns for c in K.GRADE_COLUMNS):
        df = with_row_mean(df)
    name = (target or default_target(df)[0] or "").lower()
    require_columns(df, ["id", name])
    return df, name


def run(spark, out: str, sf_dir: str | None = None, csv: str | None = None, target: str | None = None,
        threshold: float = K.PASS_THRESHOLD, mapping: dict[str, str | None] | None = None,
        families: list[str] | None = None, subjects: bool = True, **search) -> str:
    if csv:
        raw, target = load_csv(spark, csv, target)
    else:
        raw, target = raw_cohort(spark, sf_dir), K.TARGET_REG
        require_columns(raw, ["id", target])
    found = override_mapping(column_mapping(raw.columns), mapping or {}, raw.columns)
    df = add_features(add_clock_features(clean(raw), found), found, threshold)
    df = cut_lineage(df.withColumn(K.TARGET_CLF, X.pass_label(target, threshold)))
    graded = [c for c in K.GRADE_COLUMNS if c in raw.columns] if subjects else []
    t = train_models(df, target, threshold, families or CLI_FAMILIES, subjects=graded, uploaded=bool(csv), raw=raw, **search)
    reg = t.results[t.best["regression"]]
    feats = list(reg.feature_cols[0]) + list(reg.feature_cols[1])
    scored = predict_all(t.frame, reg.model, {s: r.model for s, r in t.subjects.items()}, target)
    write_table_csv(scored, f"{out}/predictions")
    impact = cut_lineage(feature_impact(reg.model, t.test, t.train, feats))
    impact.write.mode("overwrite").parquet(f"{out}/impact")
    failure_impact(reg.model, t.test, t.train, feats, target, threshold).write.mode("overwrite").parquet(f"{out}/failure_impact")
    names = {"gbt_reg": "reg", "rf_clf": "clf", "mlp_reg": "nn_reg", "mlp_clf": "nn_clf", "svr": "svm_reg", "svc": "svm_clf"}
    bundle = {names[f]: r.model for f, r in t.results.items()} | {"best_reg": reg.model}
    risk = None
    if "classification" in t.best:
        clf = t.results[t.best["classification"]].model
        bundle["best_clf"] = clf
        risk = predict(reg.model, pass_probability(clf, t.test), "note_predite").where(X.at_risk("proba_reussite", "note_predite")).count()
    save_models(spark, f"{out}/models", bundle, {"feature_columns": feats, "target": target, "threshold": threshold, "metrics": t.metrics})
    kept = [r["feature"] for r in selected_features(reg.model, t.frame.limit(1)).where("kept").collect()]
    ranks = [(r["label"], r["mean_abs_impact"]) for r in impact.orderBy(F.desc("mean_abs_impact"), "feature").limit(5).collect()]
    text = build_report(df, t.metrics, kept, t.best, target, threshold, impact=ranks, n_at_risk=risk)
    return write_report(spark, text, f"{out}/report")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--sf", help="folder with the driver's parquet tables")
    p.add_argument("--csv", help="questionnaire CSV instead of the cohort view")
    p.add_argument("--out", required=True, help="output folder (shared file system on a cluster)")
    p.add_argument("--target", help="grade column of the CSV")
    p.add_argument("--threshold", type=float, default=K.PASS_THRESHOLD)
    p.add_argument("--map", action="append", default=[], metavar="CONCEPT=COLUMN", help="override the column of a concept (empty: none)")
    p.add_argument("--family", action="append", help="model family (repeat; default: four families)")
    p.add_argument("--no-subjects", action="store_true")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO)
    mapping = {k: v.lower() or None for k, _, v in (x.partition("=") for x in a.map)}
    print(run(local_session(), a.out, a.sf, a.csv, a.target, a.threshold, mapping, a.family, not a.no_subjects))


if __name__ == "__main__":
    main()
