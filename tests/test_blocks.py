"""Weights and scores made in blocks of documents: the same as plain ones for blocks of any size, and no row of a document's word is shuffled."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import counted as K, models as M
from corpusloom.plans import registry

ROWS = [(0, "b a a"), (1, "a c"), (2, ""), (3, "żó b b 𝒳"), (0, "c"), (4, "zz"), (5, None), (None, "a b")]


def merged():
    out = {}
    for i, t in ROWS:
        out.setdefault(i, []).extend((t or "").split())
    return out


@pytest.mark.parametrize("slice_", [1, 1 << 21])
@pytest.mark.parametrize("block_chars", [1, 5, 1 << 22])
def test_dotted_against_plain_sums(spark, block_chars, slice_, monkeypatch):
    monkeypatch.setattr(K, "SLICE", slice_)
    df = spark.createDataFrame(ROWS, "id long, t string").repartition(3)
    vectors = spark.createDataFrame([("a", [0, 2], [1.0, 0.5]), ("b", [1], [2.0]), ("none", [0], [9.0])], "token string, at array<int>, g array<double>")
    dense = {"a": (1.0, 0.0, 0.5), "b": (0.0, 2.0, 0.0)}
    want = {i: [sum(dense.get(w, (0, 0, 0))[k] for w in ws) for k in range(3)] for i, ws in merged().items()}
    assert {r["id"]: r["s"] for r in K.dotted(df, vectors, 3, block_chars=block_chars).collect()} == want
    keyed = df.withColumn("id", F.struct(F.col("id").alias("x")))
    assert {r["id"]["x"]: r["s"] for r in K.dotted(keyed, vectors, 3, block_chars=block_chars).collect()} == want


@pytest.mark.parametrize("block_chars", [1, 5, 1 << 22])
@pytest.mark.parametrize("best", [None, 1, 2])
def test_tfidf_against_plain_weights(spark, block_chars, best):
    df = spark.createDataFrame(ROWS, "id long, t string").where("id is not null").repartition(3)
    counts = {i: Counter(ws) for i, ws in merged().items() if ws and i is not None}
    n, often = len(counts), Counter(t for c in counts.values() for t in c)
    want = {}
    for i, c in counts.items():
        w = {t: (1 + math.log(k)) * (math.log((1 + n) / (1 + often[t])) + 1) for t, k in c.items() if often[t] > 1}
        size = math.sqrt(sum(x * x for x in w.values()))
        order = sorted(w, key=lambda t: (-round(w[t] / size, 6), t))
        want |= {(i, t): w[t] / size for t in order[:best]}
    got = {(r["id"], r["token"]): r["weight"] for r in K.tfidf_by_block(df, best=best, block_chars=block_chars).collect()}
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("name", ["word_tfidf", "char_tfidf_top", "robustness_curve", "transfer_matrix"])
def test_no_word_of_a_document_is_shuffled(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [id#" in x and "token#" in x.split("]")[0]]


def test_naive_bayes_of_several_models(spark):
    train = spark.createDataFrame([(1, "ala ma kota", "x", "m"), (2, "bob hat hund", "y", "m"), (3, "kota hund", "y", "k"), (4, "ala", "x", "k"), (5, "hund", None, "k")], "id long, text string, y string, by string")
    test = spark.createDataFrame([(9, "kota kota", "m"), (9, "kota kota", "k"), (8, None, "m"), (7, "unseen", "k")], "id long, text string, by string")
    got = {(r["id"], r["by"]): r["y_pred"] for r in M.naive_bayes(train, test, "y", by=("by",)).collect()}
    assert got == {(9, "m"): "x", (9, "k"): "y", (8, "m"): "x", (7, "k"): "x"}
