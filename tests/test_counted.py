"""Counts made where a document lies: the same as plain counts, rows that repeat an id put together, and nothing of the words shuffled."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import counted as K
from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"


def shuffles_of_words(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def texts(n=40):
    rng = random.Random(3)
    return [" ".join(rng.choice(["a", "ab", "abab", "żółw", "𝒳yz", "abcdefgh"]) for _ in range(rng.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("slice_", [1, 50, 1 << 21])
@pytest.mark.parametrize("cut", [None, K.char_wb_pieces, K.affix_pieces])
def test_rows_against_plain_counts(spark, cut, slice_, monkeypatch):
    monkeypatch.setattr(K, "SLICE", slice_)
    rows = list(enumerate(texts())) + [(0, "ab new"), (None, "ab"), (None, "abab")]
    df = spark.createDataFrame(rows, "id long, text string").select("id", F.array_remove(F.split("text", " "), "").alias("w")).repartition(3)
    want = {}
    for key, text in rows:
        for w in text.split():
            want.setdefault(key, Counter()).update(cut(w) if cut else [w])
    want = {k: c for k, c in want.items() if c}
    one = K.one_row(df, "id")
    assert {(r["id"], r["token"]): r["tf"] for r in K.token_rows(one, ["id"], cut).collect()} == {(k, t): n for k, c in want.items() for t, n in c.items()}
    assert {r["id"]: (r["n"], r["kinds"]) for r in K.totals(one, ["id"], cut).collect()} == {k: (sum(c.values()), len(c)) for k, c in want.items()}
    assert {r["token"]: r["df"] for r in K.document_frequency(one, cut).collect()} == Counter(t for c in want.values() for t in c)


def test_char_wb_ngrams_shuffles_nothing(spark):
    assert shuffles_of_words(registry.queries()["char_wb_ngrams"](spark, SF)) == 0


@pytest.mark.parametrize("slice_", [1, 50])
def test_slices(slice_, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(K, "SLICE", slice_)
    lists = [t.split() for t in texts()]
    got = {}
    for row, number, count, names in K._pieces_by_row(pa.array(lists), K._Pieces(K.affix_pieces)):
        for r, x, c in zip(row.tolist(), number.tolist(), count.tolist()):
            assert (r, names[x].as_py()) not in got
            got[r, names[x].as_py()] = c
    assert got == {(i, t): n for i, ws in enumerate(lists) for t, n in Counter(x for w in ws for x in K.affix_pieces(w)).items()}


def test_affixes_shuffle_no_words(spark):
    assert shuffles_of_words(registry.queries()["affix_frequency"](spark, SF)) == 0
    plan = registry.queries()["affix_vocabulary_topn"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(token") == 1 and "doc_id" not in plan[: plan.index("Exchange hashpartitioning(token")].split("Exchange")[0]
