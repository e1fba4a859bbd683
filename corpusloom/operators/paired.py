"""Paired significance of any number of models on the same rows: shared resamples, exact McNemar, Holm."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.operators.corpus import written
from corpusloom.operators.evaluation import holm, mcnemar

#: The number of resamples and the level of the intervals.
RESAMPLES, ALPHA = 2000, 0.05
BLOCK = 100  # replicates of one model that are put together in one task
METRICS = ("accuracy", "macro_f1")


def weights(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """How often each resample holds each row: a Poisson draw of mean 1 from a hash of key, resample and seed, so that all models meet the same resample wherever their rows lie."""
    m = np.uint64(0x9E3779B97F4A7C15)
    x = keys.astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + (np.arange(resamples, dtype=np.uint64) + np.uint64(1)) * m + np.uint64(seed * 0xBF58476D1CE4E5B9 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))
    return np.searchsorted((steps * 2.0**53).astype(np.uint64), u, side="right").astype(np.float32)


def scores(cells: np.ndarray, labels: int) -> dict[str, np.ndarray]:
    """Accuracy and macro-F1 over the labels that occur, of confusion counts (labels * labels, replicates)."""
    c = cells.reshape(labels, labels, -1)
    hit, true, guessed = np.einsum("iir->ir", c), c.sum(axis=1), c.sum(axis=0)
    present = true + guessed > 0
    f1 = np.where(present, 2 * hit / np.maximum(true + guessed, 1e-300), 0.0)
    return {"accuracy": hit.sum(axis=0) / np.maximum(c.sum(axis=(0, 1)), 1e-300), "macro_f1": f1.sum(axis=0) / np.maximum(present.sum(axis=0), 1)}


def aligned(df: DataFrame, models: list[str]) -> DataFrame:
    """(id, y_true, y_pred by model) of rows (id, model, y_true, y_pred), or an error unless every model has each id once with the same true label."""
    at = [F.max(F.when(F.col("model") == m, F.col("y_pred"))) for m in models]
    wide = df.where(F.col("model").isin(*models)).groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("model").alias("k"), F.min("y_true").alias("y_true"), F.max("y_true").alias("_last"), F.array(*at).alias("y_pred"))
    wide = written(df.sparkSession, wide)
    wrong = wide.where((F.col("n") != len(models)) | (F.col("k") != len(models)) | ~F.col("y_true").eqNullSafe(F.col("_last"))).limit(1).collect()
    if wrong:
        raise ValueError(f"the models are not aligned at id {wrong[0]['id']}")
    return wide.select("id", "y_true", "y_pred")


def replicates(wide: DataFrame, models: list[str], labels: list[str], resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """(model, replicate, metric, value); replicate -1 is the sample itself. Tasks add up confusion counts for each replicate; a row of the exchange is a block of replicates of a model."""
    import pandas as pd

    size, code = len(labels), {x: i for i, x in enumerate(labels)}

    def count(batches):
        total = np.zeros((len(models), size * size, resamples + 1))
        for batch in batches:
            true = np.array([code[y] for y in batch.column("y_true").to_pylist()], np.int64)
            guessed = batch.column("y_pred").to_pylist()
            for lo in range(0, len(true), 1024):
                t = true[lo : lo + 1024]
                w = np.hstack([np.ones((len(t), 1), np.float32), weights(batch.column("h").to_numpy()[lo : lo + 1024], resamples, seed)])
                for m in range(len(models)):
                    cell = t * size + np.array([code[g[m]] for g in guessed[lo : lo + 1024]], np.int64)
                    one = np.zeros((size * size, len(t)), np.float32)
                    one[cell, np.arange(len(t))] = 1
                    total[m] += one @ w
        if total.any():
            blocks = range(0, resamples + 1, BLOCK)
            flat = [total[m, :, b : b + BLOCK].ravel().tolist() for m in range(len(models)) for b in blocks]
            yield pa.RecordBatch.from_pydict({"model": [x for x in models for _ in blocks], "block": pa.array([b for _ in models for b in blocks], pa.int32()), "cells": pa.array(flat, pa.list_(pa.float64()))})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(rows["cells"].to_list()), axis=0)
        return rows.iloc[:1].assign(cells=[total.tolist()])

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        found = scores(np.array(add(rows)["cells"].iloc[0]).reshape(size * size, -1), size)
        at = int(rows["block"].iloc[0]) - 1 + np.arange(len(found["accuracy"]))
        return pd.concat([pd.DataFrame({"model": rows["model"].iloc[0], "replicate": at, "metric": m, "value": found[m]}) for m in METRICS])

    keyed = wide.select("y_true", "y_pred", F.xxhash64(F.col("id").cast("string")).alias("h"))
    parts = keyed.mapInArrow(count, "model string, block int, cells array<double>").withColumn("part", F.spark_partition_id() % 32)
    few = parts.groupBy("model", "block", "part").applyInPandas(lambda rows: add(rows), "model string, block int, cells array<double>, part int")
    return few.groupBy("model", "block").applyInPandas(lambda rows: score(rows), "model string, replicate int, metric string, value double")


def paired_significance(df: DataFrame, models: list[str], labels: list[str], resamples: int = RESAMPLES, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """(a, b, metric, value, low, high, p, adjusted): each model's metrics (b null) and each pair's differences a - b with percentile intervals over shared resamples, the point inside; exact McNemar p and Holm's for pairs."""
    wide = aligned(df, models)
    found = written(df.sparkSession, replicates(wide, models, labels, resamples, seed))
    ends = lambda c: F.percentile(F.when(F.col("replicate") >= 0, F.col(c)), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    point = lambda c: F.max(F.when(F.col("replicate") < 0, F.col(c)))
    single = found.select(F.col("model").alias("a"), F.lit(None).cast("string").alias("b"), "metric", "replicate", "value")
    pairs = list(combinations(models, 2))
    x, y = found.alias("x"), found.alias("y")
    both = x.join(y, ["metric", "replicate"]).where(F.concat_ws("\x1f", "x.model", "y.model").isin(*["\x1f".join(p) for p in pairs]))
    double = both.select(F.col("x.model").alias("a"), F.col("y.model").alias("b"), "metric", "replicate", (F.col("x.value") - F.col("y.value")).alias("value"))
    out = single.unionByName(double).groupBy("a", "b", "metric").agg(point("value").alias("value"), ends("value").alias("e"))
    least = F.when(F.col("b").isNull(), 0.0).otherwise(-1.0)
    out = out.select("a", "b", "metric", "value", F.greatest(F.least(F.col("e")[0], "value"), least).alias("low"), F.least(F.greatest(F.col("e")[1], "value"), F.lit(1.0)).alias("high"))
    right = lambda i: F.col("y_pred")[i].eqNullSafe(F.col("y_true"))
    each = wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), right(models.index(a)).alias("a_right"), right(models.index(b)).alias("b_right")) for a, b in pairs])).alias("t")).select("t.*")
    tests = holm(mcnemar(each, "a", "b").withColumn("pair", F.concat_ws(",", "a", "b")), "p", "pair").select("a", "b", "p", "adjusted")  # one row for each pair
    return out.join(tests, ["a", "b"], "left")
