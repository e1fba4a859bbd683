"""Sums over blocks of documents are those of plain joins of words, and a document's words are not shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import active as AL, bayes as B, counted as K
from corpusloom.operators.corpus import written

LABELS = ["de", "en", "es"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    words = ["und", "Der", "the", "of", "el", "żółw", "²x", "a_b", "don't", "𝒳yz", "Ⅷ"]
    made = [(i, i % 3, " ".join(rng.choices(words[: 3 + i % 9], k=rng.randrange(9))) + rng.choice(["", f" w{i}", " !"]), rng.choice([*LABELS, None])) for i in range(60)]
    made += [(100, 0, None, "de"), (101, 1, "", "en"), (102, 2, "...", "es")]
    return spark.createDataFrame(made, "id long, fold int, text string, label string").repartition(3)


def near(a, b):
    return a.keys() == b.keys() and all(x == pytest.approx(y, abs=1e-9) for k in a for x, y in zip(a[k], b[k]))


@pytest.fixture(params=[1, 1 << 22])
def small(request, monkeypatch):
    monkeypatch.setattr(K.word_blocks, "__defaults__", (request.param,))


def test_words(spark, rows, small):
    got = {i: w for b in K.word_blocks(rows.select("id", "text")).collect() for i, w in _by_row(b)}
    want = {r["id"]: {x: r["w"].count(x) for x in r["w"]} for r in rows.select("id", X.words(F.col("text"), True).alias("w")).collect()}
    assert got == want


def _by_row(block):
    at = iter(zip(block["at"], block["tf"]))
    for i, n in zip(block["id"], block["n"]):
        yield i, {block["tokens"][a]: c for a, c in (next(at) for _ in range(n))}


def test_out_of_fold(spark, rows, small):
    tokens = written(spark, B.word_tokens(rows, "fold", "label"))
    key = lambda df: {r["id"]: (r["n"], *r["scores"]) for r in df.collect()}
    assert near(key(B.words_out_of_fold(rows, LABELS, 3)), key(B.out_of_fold(rows.select("id", "fold", "label"), tokens, LABELS)))


def test_contributions(spark, rows, small):
    tokens = written(spark, B.word_tokens(rows, "label"))
    key = lambda df: {(r["id"], r["rank"]): (r["weight"],) for r in df.collect()}
    assert near(key(B.word_contributions(rows, LABELS, 2)), key(B.top_contributions(tokens, LABELS, rows.select("id", "label"), 2)))
    merged = B.word_contributions(rows.unionByName(rows.where("id = 7")), LABELS, 2)
    assert merged.count() == key(B.word_contributions(rows, LABELS, 2)).__len__()


def test_counts_score_texts(spark, rows, small):
    known = rows.where("label is not null and fold > 0")
    counts = AL.Counts(LABELS).learn(known.select("id", "text", "label"))
    plain = AL.Counts(LABELS).add(known.select("id", "label"), B.word_tokens(known))
    key = lambda df: {r["id"]: (r["n"], *r["scores"]) for r in df.collect()}
    test = rows.where("fold = 0").select("id", "text")
    assert near(key(counts.scored(test)), key(plain.posteriors(test.select("id"), B.word_tokens(test))))
