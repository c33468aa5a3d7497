"""M6: the duality gap against a fit by plain subgradient-free coordinate ascent, in one and in several partitions."""

import numpy as np
from pyspark.ml.linalg import Vectors

from threadlens.operators import models as MO
from threadlens.operators import svm


def data(n=600, d=12, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * (r.random((n, d)) < 0.5)
    y = (x @ r.normal(size=d) + r.normal(size=n) > 0.3).astype(int)
    return x, y


def frame(spark, x, y):
    rows = [(i, Vectors.sparse(x.shape[1], np.flatnonzero(v), v[v != 0]) if i % 3 else Vectors.dense(v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "features", "label"])


def plain(x, y, C, passes=400):
    """(objective, dual) by dual coordinate ascent over all rows, until it hardly moves."""
    x, s = np.c_[x, np.ones(len(x))], 2 * y - 1
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    for _ in range(passes):
        for i in range(len(x)):
            new = min(1.0, max(0.0, a[i] + (1 - s[i] * (w @ x[i])) / (C * (x[i] @ x[i]))))
            w += C * (new - a[i]) * s[i] * x[i]
            a[i] = new
    norm = w @ w / (2 * C * len(x))
    return norm + np.maximum(0, 1 - s * (x @ w)).mean(), a.mean() - norm


def test_gap_bounds_the_distance_from_the_optimum(spark):
    x, y = data()
    df = frame(spark, x, y)
    for C in (0.05, 1.0):
        best, dual = plain(x, y, C)
        assert best - dual < 1e-4
        for block in (10_000, 150):  # one partition; four that add their changes
            fit = svm.fit_linear(df, "features", "label", C=C, block_rows=block)
            assert 0 <= fit.gap + 1e-12 and fit.gap <= 1e-3
            assert best - 1e-6 <= fit.objective + 1e-4 and fit.objective - best <= fit.gap + 1e-6
            w = fit.weights
            hinge = np.maximum(0, 1 - (2 * y - 1) * (x @ w[:-1] + w[-1])).mean()
            assert abs(hinge + w @ w / (2 * C * len(x)) - fit.objective) < 1e-9


def test_predictions_and_edges(spark):
    x, y = data(200)
    df = frame(spark, x, y)
    got = MO.linear_svc(df, df, "features", "label").collect()
    assert len(got) == 200 and np.mean([r.label == r.label_pred for r in got]) > 0.85 and all(r.svc_gap <= 1e-3 for r in got)
    one = df.where("label = 1")  # a single class
    assert {r.label_pred for r in MO.linear_svc(one, one, "features", "label").collect()} == {1}
    assert svm.fit_linear(df.limit(0), "features", "label").rounds == 0


def test_lists_are_views_of_the_buffer():
    import pyarrow as pa

    column = pa.array([[9, 9], [1, 2, 3], [], [4]], pa.list_(pa.int64())).slice(1)
    got = list(svm.pieces(column))
    assert [x.tolist() for x in got] == [[1, 2, 3], [], [4]] and all(x.base is not None for x in got)
