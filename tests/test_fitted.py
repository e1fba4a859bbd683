"""Paired tests, the bootstrap and cross-validation on small rows."""

import pytest

from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E, models as M

FLAGS = "a_right boolean, b_right boolean"
PAIRS = "id long, y_true string, y_pred string"


@pytest.mark.parametrize("a_only, b_only, p", [(10, 2, 0.03857421875), (0, 0, 1.0), (3, 3, 1.0), (1, 0, 1.0), (2000, 1000, 0.0)])
def test_mcnemar(spark, a_only, b_only, p):
    rows = spark.createDataFrame([(True, False)] * a_only + [(False, True)] * b_only + [(True, True)], FLAGS)
    (r,) = E.mcnemar(rows).collect()
    assert (r["a_only"], r["b_only"], r["n"]) == (a_only, b_only, a_only + b_only + 1)
    assert r["p"] == pytest.approx(p, abs=1e-9)


def test_bootstrap(spark):
    rows = spark.createDataFrame([(i, "xy"[i % 2], "x" if i % 4 < 3 and i % 2 == 0 or i % 10 == 1 else "y") for i in range(400)], PAIRS)
    right = rows.where("y_true = y_pred").count() / 400
    got = {r["metric"]: r for r in E.bootstrap(rows).collect()}
    half = 1.96 * (right * (1 - right) / 400) ** 0.5
    assert got["accuracy"]["value"] == pytest.approx(right)
    assert got["accuracy"]["low"] == pytest.approx(right - half, abs=0.01) and got["accuracy"]["high"] == pytest.approx(right + half, abs=0.01)
    assert got["macro_f1"]["value"] == pytest.approx(E.averaged(E.class_metrics(rows)).first()["macro_f1"])
    assert got["macro_f1"]["low"] < got["macro_f1"]["value"] < got["macro_f1"]["high"]
    assert E.bootstrap(rows.limit(0)).count() == 0


def test_cross_validated_rows_are_scored_by_other_folds(spark):
    rows = spark.createDataFrame([(i, f"{w} {w} same", w) for i, w in enumerate(["one", "two"] * 10)] + [(99, "lone word", "third")], "id long, text string, label string")
    got = {r["id"]: (r["fold"], r["y_true"], r["y_pred"]) for r in M.cross_validated(rows, "label", 3, F.col("id") % 3).collect()}
    assert len(got) == 21 and all(p == t for i, (_, t, p) in got.items() if i != 99)
    assert got[99][2] != "third"  # its only row of that label is in its own fold
