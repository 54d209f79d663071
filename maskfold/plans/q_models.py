"""Queries on cross-validated classifiers over document features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, models, splits
from .materialise import materialise
from .registry import query

FEATS = ("n_chars", "n_words", "mean_word")


def candidates(t):
    d = t.fx_docs.join(t.labels.select("doc_id", "quality"), "doc_id")
    d = d.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.when(F.col("n_words") > 1, F.col("n_words").cast("double")).alias("n_words"),
                 (F.col("n_chars") / F.col("n_words")).alias("mean_word"), F.col("quality").alias("label"))
    return materialise(splits.stratified_kfold(d, "label", "doc_id", 5), "candidates")


@query("m1_logistic_cv")
def _(t):
    oof = models.logistic_cv(candidates(t), FEATS, "label", "fold", ["doc_id"])
    return features.classification_report(oof, (0, 1))


@query("m2_forest_cv")
def _(t):
    oof = models.forest_cv(candidates(t), FEATS, "label", "fold", ["doc_id"])
    return features.classification_report(oof, (0, 1))


@query("m3_importances_coefs")
def _(t):
    rows = candidates(t)
    data = models.balanced_weights(models.fill_medians(rows, FEATS), "label")
    coef = models.logistic_coefficients(models.fit_logistic(rows, FEATS, "label")[None], FEATS, t.spark)
    imp = models.explain_forest(models.forest_pipeline(FEATS, "label").fit(data), FEATS, t.spark)
    return coef.select(F.lit("coefficient").alias("kind"), "feature", F.round("coefficient", 4).alias("value")).unionAll(
        imp.select(F.lit("importance").alias("kind"), "feature", F.round("importance", 4).alias("value")))


@query("m4_balanced_weights", "", "select quality as label, round((select count(*) from labels) / (2.0 * count(*)), 6) as weight, count(*) as n from labels group by 1")
def _(t):
    w = models.balanced_weights(t.labels.select(F.col("quality").alias("label")), "label")
    return w.groupBy("label").agg(F.round(F.max("weight"), 6).alias("weight"), F.count("*").alias("n"))
