"""Stacking: a logistic regression over the out-of-fold probabilities of several naive Bayes models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import arrays as A
from corpusloom.operators import bayes as B
from corpusloom.operators.corpus import written

LEAST = 1e-6  # probabilities under this are alike to the final model, which sees their logarithms
BASES = {"words": B.word_tokens, "endings": B.ending_tokens, "lengths": B.length_tokens}


def base_probabilities(train: DataFrame, test: DataFrame, labels: list[str], bases: dict[str, Callable] | None = None, folds: int = 5) -> DataFrame:
    """(id, fold, label, one array of probabilities for each base). train: id, text, label; test: id, text.

    A training row is scored by models of the other folds, a test row (fold ``folds``, label null) by models of all training
    rows: the models of a base are differences of counts made once, so all of its folds are fitted together. Folds are by a hash of the id.
    """
    spark, bases = train.sparkSession, bases or BASES
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("id")), F.lit(folds)).cast("int")
    rows = train.select("id", "text", "label", fold.alias("fold")).unionByName(test.select("id", "text", F.lit(None).cast("string").alias("label"), F.lit(folds).alias("fold")))
    out = rows.select("id", "fold", "label")
    for name, tokens in bases.items():
        found = B.out_of_fold(rows.select("id", "fold", "label"), written(spark, tokens(rows, "fold", "label")), labels)
        out = out.join(found.select("id", B.posterior(F.col("scores"), F.lit(1)).alias(name)), "id")
    return written(spark, out)


def stack(train: DataFrame, test: DataFrame, labels: list[str], bases: dict[str, Callable] | None = None, folds: int = 5) -> DataFrame:
    """(id, p, one array for each base, label) of the test rows; classes weigh the same in the final fit."""
    bases = bases or BASES
    rows = base_probabilities(train, test, labels, bases, folds)
    index = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
    rows = rows.withColumn("x", array_to_vector(F.flatten(F.array(*[F.transform(b, lambda v: F.ln(F.greatest(v, F.lit(LEAST)))) for b in bases]))))
    fit = rows.where("label IS NOT NULL").withColumn("y", index.cast("double"))
    counts = {r["y"]: r["n"] for r in fit.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each label
    weight = F.element_at(F.map_from_arrays(F.array(*[F.lit(float(y)) for y in counts]), F.array(*[F.lit(sum(counts.values()) / (len(counts) * n)) for n in counts.values()])), F.col("y"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", family="multinomial", regParam=1e-3, maxIter=100, probabilityCol="probability").fit(fit.withColumn("w", weight))
    scored = model.transform(rows.where(F.col("fold") == folds))
    p = F.concat(vector_to_array("probability"), F.array_repeat(F.lit(0.0), len(labels) - model.numClasses))
    return scored.select("id", p.alias("p"), *bases, A.argmax_label(p, labels).alias("label"))
