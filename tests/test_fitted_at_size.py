"""Classifiers are fitted on stored vectors, a forest in tasks of a bounded number of rows."""

import random

import pytest
from pyspark.ml.classification import OneVsRest, RandomForestClassifier

from corpusloom.operators import models as M

WORDS = {"de": ["und", "der", "die"], "en": ["and", "the", "of"]}


def rows(spark, n):
    rng = random.Random(5)
    made = [(i, " ".join(rng.choices(WORDS[k], k=6)), k) for i in range(n) for k in [rng.choice(["de", "en"])]]
    return spark.createDataFrame(made, "id long, text string, label string").coalesce(1)


@pytest.mark.parametrize(("kind", "estimator"), [("random_forest", RandomForestClassifier), ("linear_svm", OneVsRest)])
def test_what_a_classifier_is_fitted_on(spark, monkeypatch, kind, estimator):
    seen, fit = [], estimator._fit

    def spy(self, dataset):
        seen.append((dataset.rdd.glom().map(len).collect(), dataset._jdf.queryExecution().optimizedPlan().toString()))
        return fit(self, dataset)

    monkeypatch.setattr(estimator, "_fit", spy)
    monkeypatch.setattr(M, "FOREST_ROWS", 8, raising=False)
    df = rows(spark, 100)
    found = M.fit_predict(kind, df, df, "label").collect()
    assert len(found) == 100 and all(r["y_true"] == r["y_pred"] for r in found)
    sizes, plan = seen[0]
    assert sum(sizes) == 100 and "regexp_extract_all" not in plan
    assert kind != "random_forest" or max(sizes) <= 2 * 8
