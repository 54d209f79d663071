"""Logistic regression by summed normal equations, against a plain descent over all rows at once."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskfold.operators import models


def plain(x, y, classes, l2=1.0):
    """Median fill, scaling and the optimum by long gradient descent with momentum; no code shared with the library."""
    x = x.copy()
    for j in range(x.shape[1]):
        gone = np.isnan(x[:, j])
        x[gone, j] = np.median(x[~gone, j])
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    z = np.column_stack([x, np.ones(len(x))])
    n = np.array([(y == c).sum() for c in classes])
    w = (len(y) / (len(classes) * n))[np.searchsorted(classes, y)]
    target = (y[:, None] == np.array(classes)).astype(float)
    two = len(classes) == 2
    b = np.zeros((1 if two else len(classes), z.shape[1]))
    speed, rate = np.zeros_like(b), 1.0 / (w.sum() * (0.25 if two else 0.5) * 3 + l2)
    for _ in range(20_000):
        ahead = b + 0.98 * speed
        t = z @ ahead.T
        if two:
            grad = (w * (1 / (1 + np.exp(-t[:, 0])) - target[:, 1])) @ z[:, :]
            grad = grad[None, :]
        else:
            e = np.exp(t - t.max(axis=1, keepdims=True))
            grad = ((e / e.sum(axis=1, keepdims=True) - target) * w[:, None]).T @ z
        grad = grad + l2 * np.column_stack([ahead[:, :-1], np.zeros(len(ahead))])
        new = ahead - rate * grad
        speed, b = new - b, new
    return b


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_reaches_the_optimum(spark, classes):
    rng = np.random.default_rng(classes)
    n = 400
    y = rng.integers(0, classes, n) * (rng.random(n) < 0.8)  # class 0 is the largest
    x = rng.normal(size=(n, 3)) + np.outer(y, [1.0, -0.5, 0.0]) + [0, 100, 0]
    x[rng.random((n, 3)) < 0.1] = np.nan
    x[:, 2] *= 1e-4
    rows = [(i, i % 4, int(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, fold int, label int, a double, b double, c double").repartition(5)
    whole = models.fit_logistic(df, "abc", "label")[None]
    assert np.abs(whole.weights - plain(x, y, list(range(classes)))).max() < 1e-6
    got = models.fit_logistic(df, "abc", "label", "fold")
    assert set(got) == {0, 1, 2, 3}
    use = np.arange(n) % 4 != 2
    assert np.abs(got[2].weights - plain(x[use], y[use], list(range(classes)))).max() < 1e-6
    oof = models.logistic_cv(df, "abc", "label", "fold", ["id"]).collect()
    assert len(oof) == n and len({r.id for r in oof}) == n
    for r in [r for r in oof if r.fold == 2]:
        p = got[2].probabilities(x[r.id : r.id + 1])[0]
        assert r.predicted == p.argmax() and abs(r.probability - p.max()) < 1e-12


def test_logistic_corner_cases(spark):
    ddl = "id bigint, fold int, label string, a double, b double"
    # separable, a constant and a wholly empty feature, a row without a label, repeated rows
    rows = [(i, i % 2, "yes" if i % 10 > 4 else "no", float(i % 10), None) for i in range(60)] + [(99, 0, None, 4.0, None)]
    df = spark.createDataFrame(rows, ddl).withColumn("k", F.lit(7.0))
    oof = models.logistic_cv(df, ["a", "b", "k"], "label", "fold", ["id"]).collect()
    assert len(oof) == 61 and all(r.predicted == r.label for r in oof if r.label) and {r.predicted for r in oof if r.id == 99} <= {"yes", "no"}
    with pytest.raises(ValueError):
        models.fit_logistic(df.limit(0), ["a"], "label")


def test_medians_fill_exactly(spark):
    rows = [(1.0, None), (float("nan"), None), (4.0, None), (2.0, None), (None, None), (9.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = models.fill_medians(df, "ab").collect()
    assert sorted(r.a for r in got) == [1.0, 2.0, 3.0, 3.0, 4.0, 9.0] and {r.b for r in got} == {0.0}
    other = models.fill_medians(df, ["a"], df.where("a < 3")).where("b is null").collect()
    assert sorted(r.a for r in other) == [1.0, 1.5, 1.5, 2.0, 4.0, 9.0]
