import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMOKE = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from gradelens.session import local_session
    s = local_session(cpus="*", shuffle_partitions=8, app="gradelens-tests")
    yield s
    s.stop()


#: Points of the search spaces that tests of the model queries search.
SMALL_GRIDS = {
    "gbt_reg": {"maxIter": [4], "maxDepth": [2, 3], "stepSize": [0.2]},
    "rf_clf": {"numTrees": [6], "maxDepth": [4], "minSamplesSplit": [2]},
    "mlp_reg": {"hidden": [(8,)], "activation": ["relu"], "learningRate": [0.01]},
    "mlp_clf": {"hidden": [(8,)], "activation": ["tanh"], "learningRate": [0.01]},
    "svr": {"C": [1], "epsilon": [0.1], "kernel": ["rbf"]},
    "svc": {"C": [1], "kernel": ["linear"]},
}


@pytest.fixture(scope="session")
def small_searches():
    """The model queries' searches over a few points and few steps."""
    from gradelens.ml.search import train_family
    from gradelens.plans import catalogue_models

    def search(train, label, family, exclude, **kw):
        if family not in ("gbt_reg", "rf_clf"):
            kw["steps"] = 20
        return train_family(train, label, family, exclude, grid=SMALL_GRIDS[family], **kw)

    whole, catalogue_models.train_family = catalogue_models.train_family, search
    yield
    catalogue_models.train_family = whole
