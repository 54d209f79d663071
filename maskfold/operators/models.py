"""Cross-validated classifiers over candidate features: logistic regression by summed normal equations, forests with pyspark.ml."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.materialise import materialise
from ..plans.ordering import exact_percentiles


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Class weight n / (k x class size) on each row; the class table has one row per label."""
    per = df.groupBy(label).agg(F.count("*").alias("__c"))
    tot = per.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    w = per.join(F.broadcast(tot)).select(label, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("weight"))
    return df.join(F.broadcast(w), label)


@dataclass(frozen=True)
class Logistic:
    """A fitted model: medians, means and deviations per feature, and one row of weights (intercept last) per class;
    a single row, for the second class, where there are two."""

    classes: list
    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(x), self.median, x) - self.mean) / self.scale
        return np.hstack([z, np.ones((len(z), 1))])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.design(x), self.weights)


def softmax(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Class probabilities per row; a single row of weights stands for two classes."""
    t = z @ weights.T
    if len(weights) == 1:
        t = np.hstack([np.zeros_like(t), t])
    t -= t.max(axis=1, keepdims=True)
    e = np.exp(t)
    return e / e.sum(axis=1, keepdims=True)


def _normal_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of the weighted rows of one batch, as one flat vector."""
    p = softmax(z, weights)
    loss = -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
    k, d = weights.shape
    first = p.shape[1] - k
    q = p[:, first:]
    miss = q - (y[:, None] == np.arange(first, p.shape[1]))
    grad = (w[:, None] * miss).T @ z
    hess = np.empty((k, d, k, d))
    for i in range(k):
        for j in range(k):
            hess[i, :, j, :] = (z * (w * q[:, i] * ((i == j) - q[:, j]))[:, None]).T @ z
    return np.concatenate([[loss], grad.ravel(), hess.ravel()])


def fit_logistic(
    df: DataFrame, features: Sequence[str], label: str, fold: str | None = None, l2: float = 1.0, rounds: int = 100, tol: float = 1e-9
) -> dict:
    """Class-balanced logistic regression by Newton's method; with `fold`, one model per fold, fitted on the other folds.

    Medians fill nulls and NaN (exact ones, by counts), features are scaled by mean and population deviation; `l2` is the weight of
    half the squared coefficients, intercepts are free. Each round is one pass over the data for all models at once:
    batches add up loss, gradient and Hessian, Spark sums them over the partitions, and only these
    sums, whose size depends on classes and features alone, meet the driver. The optimum is unique, so the result does not depend on
    partitioning beyond rounding. A step that does not lower the loss is halved. Rows without a label are left out; a feature
    without any value counts as 0. Returns {fold (None without folds): Logistic}.
    """
    spark, d = df.sparkSession, len(features)
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    held = F.col(fold) if fold else F.lit(None).cast("int")
    data = materialise(df.where(F.col(label).isNotNull()).select(x.alias("x"), F.col(label).alias("y"), held.alias("held")), "rows")
    sizes = [tuple(r) for r in data.groupBy("held", "y").count().collect()]  # one row per fold and class
    models = sorted({h for h, _, _ in sizes}) if fold else [None]
    classes = sorted({y for _, y, _ in sizes})
    if len(classes) < 2:
        raise ValueError("a classifier needs two classes")
    every = data.withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(len(models))])))
    if fold:
        names = F.array(*[F.lit(m) for m in models])
        every = every.where(~F.element_at(names, F.col("m") + 1).eqNullSafe(F.col("held")))
    cells = every.select("m", F.posexplode("x").alias("j", "v"))
    middle = np.zeros((len(models), d))
    for r in exact_percentiles(cells.where(~F.isnan("v")), "v", {"q": 0.5}, ["m", "j"]).collect():  # one row per model and feature
        middle[r.m, r.j] = r.q
    at = F.element_at(F.array(*[F.lit(float(v)) for v in middle.ravel()]), F.col("m") * d + F.col("j") + 1)
    off = F.when(F.isnan("v"), 0.0).otherwise(F.col("v") - at)
    mean, scale = np.zeros((len(models), d)), np.ones((len(models), d))
    for r in cells.withColumn("o", off).groupBy("m", "j").agg(F.avg("o").alias("a"), F.var_pop("o").alias("s")).collect():
        mean[r.m, r.j] = middle[r.m, r.j] + r.a
        scale[r.m, r.j] = np.sqrt(r.s) if r.s > 0 else 1.0
    k = 1 if len(classes) == 2 else len(classes)
    per_class = np.array([[sum(n for h, y, n in sizes if y == c and (not fold or h != m)) for c in classes] for m in models], float)
    weight = per_class.sum(axis=1, keepdims=True) / (len(classes) * np.maximum(per_class, 1))
    number, own = {c: i for i, c in enumerate(classes)}, {m: i for i, m in enumerate(models)} if fold else {}

    def sums(at_weights: np.ndarray) -> np.ndarray:
        def run(frames: Iterator) -> Iterator:
            total = None
            for pdf in frames:
                if not len(pdf):
                    continue
                xs, ys = np.stack(pdf["x"].to_numpy()), pdf["y"].map(number).to_numpy()
                home = pdf["held"].map(own).to_numpy() if own else None
                part = []
                for m in range(len(models)):
                    use = slice(None) if home is None else home != m
                    one = Logistic(classes, middle[m], mean[m], scale[m], at_weights[m])
                    part.append(_normal_sums(one.design(xs[use]), ys[use], weight[m][ys[use]], at_weights[m]))
                total = np.stack(part) if total is None else total + np.stack(part)
            if total is not None:
                yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

        size = 1 + k * (d + 1) + (k * (d + 1)) ** 2
        out = np.zeros(len(models) * size)
        for r in data.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r.i] = r.v
        out = out.reshape(len(models), size)
        out[:, 0] += 0.5 * l2 * (at_weights[:, :, :d] ** 2).sum(axis=(1, 2))
        return out

    p = k * (d + 1)
    penal = np.tile(np.append(np.full(d, l2), 0.0), k)
    w = np.zeros((len(models), k, d + 1))
    now = sums(w)
    step = np.zeros_like(w)
    for _ in range(rounds):
        for m in range(len(models)):
            grad = now[m, 1 : 1 + p] + penal * w[m].ravel()
            hess = now[m, 1 + p :].reshape(p, p) + np.diag(penal)
            # the least step of all: intercepts of several classes are free up to a constant
            step[m] = -np.linalg.lstsq(hess, grad, rcond=1e-12)[0].reshape(k, d + 1)
        if np.abs(step).max() < tol:
            break
        shrink = np.ones((len(models), 1, 1))
        for _ in range(30):
            new = sums(w + shrink * step)
            worse = new[:, 0] > now[:, 0] + 1e-9 * np.abs(now[:, 0])
            if not worse.any():
                break
            shrink[worse] /= 2
        w, now = w + shrink * step, new
    return {m: Logistic(classes, middle[i], mean[i], scale[i], w[i]) for i, m in enumerate(models)}


def logistic_cv(df: DataFrame, features: Sequence[str], label: str, fold: str, keys: Sequence[str], l2: float = 1.0) -> DataFrame:
    """Out-of-fold predictions and the probability of the predicted class; all folds' models come from the same passes."""
    data = materialise(df.select(*dict.fromkeys([*keys, fold, label, *features])), "folds")
    found = fit_logistic(data, features, label, fold, l2)
    kept = list(dict.fromkeys([*keys, fold, label]))
    shape = T.StructType([*[data.schema[c] for c in kept], T.StructField("predicted", data.schema[label].dataType), T.StructField("probability", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[list(features)].astype("float64").to_numpy()
        out = pdf[kept].copy()
        at, best = np.zeros(len(pdf), int), np.zeros(len(pdf))
        for m, model in found.items():
            rows = (pdf[fold] == m).to_numpy()
            if rows.any():
                p = model.probabilities(x[rows])
                at[rows], best[rows] = p.argmax(axis=1), p.max(axis=1)
        out["predicted"] = np.array(next(iter(found.values())).classes)[at]
        out["probability"] = best
        return out

    return batch_score(data, run, shape)


def logistic_coefficients(model: Logistic, features: Sequence[str], spark) -> DataFrame:
    """Coefficient of each scaled feature, per class; as many rows as classes x features."""
    first = len(model.classes) - len(model.weights)
    rows = [(str(model.classes[first + c]), f, float(model.weights[c, j])) for c in range(len(model.weights)) for j, f in enumerate(features)]
    return spark.createDataFrame(rows, "class string, feature string, coefficient double").orderBy("class", F.abs("coefficient").desc())


def fill_medians(df: DataFrame, features: Sequence[str], by: DataFrame | None = None) -> DataFrame:
    """Features as doubles, nulls and NaN filled with the exact medians of `by` (default: of `df` itself); 0 where a feature
    has no value at all."""
    def value(f: str) -> Column:
        v = F.col(f).cast("double")
        return F.when(~F.isnan(v), v)

    source = df if by is None else by
    cells = source.select(F.posexplode(F.array(*[value(f) for f in features])).alias("j", "v"))
    found = {r.j: r.q for r in exact_percentiles(cells, "v", {"q": 0.5}, ["j"]).collect()}  # one row per feature
    return df.withColumns({f: F.coalesce(value(f), F.lit(found.get(j, 0.0))) for j, f in enumerate(features)})


def forest_pipeline(features: Sequence[str], label: str, trees: int = 300, depth: int = 5, min_leaf: int = 2, seed: int = 42) -> Pipeline:
    """A class-balanced random forest over features without nulls."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed),
    ])


def forest_cv(df: DataFrame, features: Sequence[str], label: str, fold: str, keys: Sequence[str], pipeline: Pipeline | None = None) -> DataFrame:
    """Out-of-fold predictions: for each fold a model is fitted on the others, whose medians fill both. Fitting is
    distributed; the loop runs over the handful of folds only."""
    data = materialise(df, "folds")
    pipeline = pipeline or forest_pipeline(features, label)
    out = None
    for f in [r[0] for r in data.select(fold).distinct().orderBy(fold).collect()]:
        others = data.where(F.col(fold) != f)
        train = balanced_weights(fill_medians(others, features), label)
        scored = pipeline.fit(train).transform(fill_medians(data.where(F.col(fold) == f), features, others))
        part = scored.select(*keys, fold, label, F.col("prediction").cast("int").alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def explain_forest(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Importance per feature, highest first."""
    imp = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(imp[j])) for j, f in enumerate(features)], "feature string, importance double").orderBy(F.col("importance").desc())


def batch_score(df: DataFrame, fn: Callable, schema: T.StructType | str, batch: int | None = None) -> DataFrame:
    """Score rows in Arrow batches with a caller's function (pandas frame in, pandas frame out).

    The function sees at most `batch` rows at a time, so memory follows the batch, not the partition.
    """
    def run(frames):
        for pdf in frames:
            step = batch or max(len(pdf), 1)
            for i in range(0, len(pdf), step):
                yield fn(pdf.iloc[i : i + step])

    return df.mapInPandas(run, schema)
