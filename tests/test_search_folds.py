"""Searches of the gradient families: nothing of a held-out fold reaches the models scored on it."""
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gradelens.functions import constants as K
from gradelens.ml import gradient as G
from gradelens.ml import search as S
from gradelens.ml.preprocess import ImportanceSelector, feature_columns, preprocessing_stages
from gradelens.plans.prepare import prepared_cohort
from gradelens.plans.training import excluded_columns, model_frame

from conftest import SF_SMOKE


@pytest.fixture(scope="module")
def train(spark):
    return model_frame(prepared_cohort(spark, SF_SMOKE)).where("not is_test").cache()


def _excluded(train, label):
    return [c for c in excluded_columns(train) if c != label]


@pytest.mark.parametrize("family,label,grid", [
    ("mlp_reg", K.TARGET_REG, {"hidden": [(6,)], "activation": ["relu", "tanh"], "learningRate": [0.01]}),
    ("svr", K.TARGET_REG, {"C": [1.0], "epsilon": [0.1], "kernel": ["rbf"]}),
    ("svc", K.TARGET_CLF, {"C": [1.0], "kernel": ["rbf", "linear"]})])
def test_fold_scores_equal_a_plain_loop(spark, train, family, label, grid):
    got = S.gradient_search(train, label, family, _excluded(train, label), grid=grid, steps=10)
    task = S.FAMILIES[family][0]
    num, cat = feature_columns(train, _excluded(train, label) + [label, "fold"])
    per = {}
    for fold in range(K.CV_FOLDS):
        seen = train.where(F.col("fold") != fold)
        pre = Pipeline(stages=[*preprocessing_stages(num, cat),
                               ImportanceSelector(featuresCol="features", labelCol=label, outputCol="selected", task=task)]).fit(seen)
        data = G.to_training_frame(pre.transform(seen), {"x": "selected"}, label, "fold").cache()
        space = G.find_spaces(data, {"x": None}, task == "regression")[None]
        rows = pre.transform(train.where(F.col("fold") == fold)).select(vector_to_array("selected").alias("x"), F.col(label).cast("double").alias("y")).collect()
        x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
        for j in G.train_many(data, [S._spec(family, c) for c in S.sample_grid(grid)], [None], steps=10, spaces={None: space}):
            f = G.forward(j.spec, j.theta, x, space) * space.y_std + space.y_mean
            score = 1 - ((f - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() if task == "regression" else np.mean((f >= 0) == (y > 0))
            per.setdefault(j.candidate, []).append(score)
    assert [s for _, s in got.cv_scores] == pytest.approx([np.mean(per[i]) for i in range(len(per))], abs=1e-6)


def _rows(spark, n, d, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * scale
    return x, spark.createDataFrame([(r.tolist(), float(r[0]), i % 3, int(i)) for i, r in enumerate(x)], "x array<double>, y double, fold int, key long")


def test_kernel_scale_and_landmarks(spark):
    x, data = _rows(spark, 700, 5, scale=3.0)
    fold = np.arange(700) % 3
    data = data.withColumn("x1", F.col("x"))
    spaces = G.find_spaces(data, {"x": None, "x1": 1}, True, landmarks=40)
    again = G.find_spaces(data.repartition(7), {"x": None, "x1": 1}, True, landmarks=40)
    assert spaces[None].gamma == pytest.approx(1 / (5 * x.var())) and spaces[1].gamma == pytest.approx(1 / (5 * x[fold != 1].var()))
    assert spaces[1].y_mean == pytest.approx(x[fold != 1, 0].mean()) and spaces[1].y_std == pytest.approx(x[fold != 1, 0].std())
    for f in (None, 1):
        rows = np.frombuffer(spaces[f].landmarks).reshape(-1, 5)
        own = {tuple(r) for r in (x if f is None else x[fold != 1])}
        assert len(rows) == 40 and {tuple(r) for r in rows} <= own and spaces[f].landmarks == again[f].landmarks


def test_landmark_map_is_near_the_kernel(spark):
    x, data = _rows(spark, 2000, 6, seed=3)
    space = G.find_spaces(data, {"x": None}, False)[None]
    phi = G._feature_map("rbf", space)[0](x)
    exact = G.rbf(x, x, space.gamma)
    error = np.abs(phi @ phi.T - exact)
    assert error.mean() < 0.02 and np.sqrt((error ** 2).mean()) < 0.04
    rows = np.frombuffer(space.landmarks).reshape(-1, 6)      # exact between landmarks
    on = G._feature_map("rbf", space)[0](rows)
    assert np.allclose(on @ on.T, G.rbf(rows, rows, space.gamma), atol=1e-6)
    rng = np.random.default_rng(1)
    w, b = rng.normal(0.0, np.sqrt(2 * space.gamma), (6, G.LANDMARKS)), rng.uniform(0, 2 * np.pi, G.LANDMARKS)
    random = np.sqrt(2 / G.LANDMARKS) * np.cos(x @ w + b)     # as many random features are further off
    assert np.abs(random @ random.T - exact).mean() > 2 * error.mean()


def test_models_are_dealt_by_their_cost():
    got = G.deal([8.0, 1.0, 1.0, 1.0, 1.0, 4.0, 4.0], 3)
    load = [sum(c for c, g in zip([8.0, 1.0, 1.0, 1.0, 1.0, 4.0, 4.0], got) if g == k) for k in range(3)]
    assert sorted(load) == [6.0, 6.0, 8.0]
    assert sorted(G.deal([1.0] * 8, 8)) == list(range(8))


def test_platt_scaling_on_held_out_margins(spark):
    """An overfitted classifier is sure of its training rows; margins of held-out rows calibrate it better."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 12))
    y = (rng.random(600) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), int(v), i % 3, i >= 300) for i, (r, v) in enumerate(zip(x, y))],
                               "id long, " + ", ".join(f"c{k} double" for k in range(12)) + ", y int, fold int, is_test boolean")
    train, test = df.where("not is_test").drop("is_test").cache(), df.where("is_test")
    res = S.gradient_search(train, "y", "svc", ["id"], grid={"C": [10.0], "kernel": ["rbf"]}, steps=200)
    model = res.model.stages[-1]
    on_training = S.platt(res.model.transform(train).select("raw", F.col("y").cast("double").alias("y")))

    def loss(a, b):
        rows = res.model.transform(test).select("raw", "y").collect()
        p = np.clip(1 / (1 + np.exp(-(a * np.array([r["raw"] for r in rows]) + b))), 1e-9, 1 - 1e-9)
        t = np.array([r["y"] for r in rows])
        return -(t * np.log(p) + (1 - t) * np.log(1 - p)).mean()

    own = model.getOrDefault(model.plattA), model.getOrDefault(model.plattB)
    assert 0 < own[0] < on_training[0] and loss(*own) < loss(*on_training)


def test_forests_fit_in_several_tasks_and_keep_their_rows_nodes(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 50)
    rows = spark.range(220).select(F.array(F.col("id").cast("double")).alias("selected")).coalesce(1)
    small = S.compact(rows)
    assert small.rdd.getNumPartitions() == 4 and small.count() == 220
    spread = S.spread(rows)
    assert spread.rdd.getNumPartitions() == 4 and spread.count() == 220
    assert S.task_count(40) == 1 and S.task_count(10 ** 9) == 10 ** 9 // S.LARGE_BLOCK_ROWS
    forest = S.spark_model("rf_clf", {"numTrees": 3, "maxDepth": None, "minSamplesSplit": 5}, "y", "w")
    assert forest.getCacheNodeIds() and forest.getMaxDepth() == 30 and forest.getMinInstancesPerNode() == 2


@pytest.mark.parametrize("shard_rows", [1000, 100])
def test_a_perceptron_passes_over_all_rows_in_turn(spark, monkeypatch, shard_rows):
    """An epoch is one sequential pass over all rows, shard after shard; nothing is averaged."""
    monkeypatch.setattr(G, "VISITED_ROWS", shard_rows)
    x, data = _rows(spark, 500, 3, seed=4)
    specs = [G.Spec("mlp_reg", hidden=(5,), activation=a) for a in ("relu", "tanh")]
    space = G.find_spaces(data, {"x": None}, True)[None]
    jobs = G.train_many(data, specs, [None, 1], steps=9, patience=3, tol=0.05, spaces={None: space, 1: space})
    shards = max(1, -(-500 // shard_rows))
    rows = data.withColumn("shard", F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards))).orderBy("key", "y").collect()
    assert len({r["shard"] for r in rows}) == shards
    each, groups = 5 if shards == 1 else 1, max(1, -(-G.MODEL_GROUPS // shards))
    slots = G._dealt(jobs, shards * groups)
    for job, slot in zip(jobs, slots):
        theta, t = G.init_params(job.spec, space), 0
        m, v, best, stall, done, epoch = np.zeros_like(theta), np.zeros_like(theta), float("inf"), 0, False, 0
        while epoch < 9 and not done:
            losses = []
            for e in range(epoch, min(9, epoch + each)):
                total = 0.0
                for hop in range(shards):
                    s = (slot % shards + hop) % shards
                    own = [r for r in rows if r["shard"] == s and r["fold"] != job.held_out]
                    xs = np.array([r["x"] for r in own], np.float32)
                    ys = ((np.array([r["y"] for r in own]) - space.y_mean) / space.y_std).astype(np.float32)
                    theta, m, v, k, loss = G._local_epoch(job.spec, theta, m, v, t, xs, ys, space, job.n, (job.spec.seed, e, s, job.candidate))
                    t, total = t + k, total + loss
                losses.append(total / job.n)
            epoch += len(losses)
            best, stall, done = G._stopped(best, stall, losses, 0.05, 3)
        assert job.t == t and job.done == done and job.theta == pytest.approx(theta, abs=1e-9)


def test_the_kept_arrays_give_the_plain_gradient():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(230, 4)).astype(np.float32), (rng.random(230) < 0.4).astype(np.float32)
    for family in ("mlp_reg", "mlp_clf"):
        for activation in ("relu", "tanh"):
            spec = G.Spec(family, hidden=(7, 3), activation=activation)
            theta = G.init_params(spec, 4).astype(np.float32)
            kept = G._MlpGradient(spec, G._shapes(spec, 4))
            for rows in (slice(0, 200), slice(200, 230)):         # the last batch is smaller
                loss, g = kept(theta, x[rows], y[rows])
                want, grad = G.loss_grad(spec, theta, x[rows], y[rows], 4)
                assert loss == pytest.approx(want) and g == pytest.approx(grad, abs=1e-6)


def test_an_epoch_of_a_perceptron_is_that_of_adam():
    """Against a plain loop in double precision over ``loss_grad``; moments in single precision, the last batch smaller."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(430, 4)).astype(np.float32), rng.normal(size=430).astype(np.float32)
    for activation in ("relu", "tanh"):
        spec, space = G.Spec("mlp_reg", hidden=(7, 3), activation=activation), G.Space(4)
        start = G.init_params(spec, space)
        mask = np.concatenate([np.r_[np.ones(a * b), np.zeros(b)] for a, b in G._shapes(spec, space)])
        theta, m, v, t, total = start.copy(), 0 * start, 0 * start, 0, 0.0
        order = np.random.default_rng(5).permutation(430)
        for at in range(0, 430, 200):
            rows = order[at:at + 200]
            loss, g = G.loss_grad(spec, theta, x[rows].astype(float), y[rows].astype(float), space)
            total += loss + 0.5 * G.L2_ALPHA * (theta * mask) @ theta
            g, t = (g + G.L2_ALPHA * theta * mask) / len(rows), t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - spec.lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        got = G._local_epoch(spec, start, 0 * start, 0 * start, 0, x, y, space, 430, 5)
        assert got[3] == t and got[4] == pytest.approx(total, rel=1e-5)
        assert got[1].dtype == float and got[1] == pytest.approx(m, abs=1e-5) and got[2] == pytest.approx(v, abs=1e-6)
        assert got[0] == pytest.approx(theta, abs=1e-4)


def test_monomials_of_the_cubic_kernel():
    x = np.random.default_rng(1).normal(size=(1203, 4))
    phi, width = G._feature_map("poly", G.Space(4, 0.3))
    assert phi(x).shape == (1203, width) and phi(x[:0]).shape == (0, width)
    assert phi(x) @ phi(x[:50]).T == pytest.approx((0.3 * x @ x[:50].T) ** 3, abs=1e-8)
