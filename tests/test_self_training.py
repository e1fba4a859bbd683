"""Self-training over blocks of documents is that of a fit from scratch in each round, and a text is cut once."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import counted as K, models as M

KIND = "id long, text string, dialect string"


def plain(train, pool, rounds, threshold, cap):
    """Rounds of naive Bayes, each from scratch; rows that share an id are one."""
    learnt = [(t or "", x, 1) for _, t, x in train if x is not None]
    labels, left, out = sorted({x for _, x, _ in learnt}), {}, []
    for i, t, _ in pool:
        left.setdefault(i, []).append(t or "")
    for r in range(rounds):
        words = {x: Counter(w for t, y, _ in learnt if y == x for w in t.split()) for x in labels}
        docs = {x: sum(m for _, y, m in learnt if y == x) for x in labels}
        known = set().union(*words.values())
        sure = []
        for i, texts in left.items():
            of = [w for t in texts for w in t.split() if w in known]
            s = {x: math.log(docs[x] / sum(docs.values())) + sum(math.log((words[x][w] + 0.1) / (words[x].total() + 0.1 * len(known))) for w in of) for x in labels if words[x]}
            best = max(s, key=lambda x: (round(s[x], 6), -labels.index(x)))
            confidence = 1 / sum(math.exp(v - s[best]) for v in s.values())
            if confidence >= threshold:
                sure.append((-confidence, -1 if i is None else i, i, best))
        sure = sorted(sure)[:cap]
        if not sure:
            break
        out += [(x, n, r) for x, n in Counter(x for *_, x in sure).items()]
        learnt += [(" ".join(left[i]), x, len(left[i])) for _, _, i, x in sure]
        left = {i: t for i, t in left.items() if i not in {i for _, _, i, _ in sure}}
    return sorted(out)


@pytest.mark.parametrize("chars, cap", [(1, None), (1 << 22, None), (1, 3), (1 << 22, 7)])
def test_rounds_are_fits_from_scratch(spark, monkeypatch, chars, cap):
    monkeypatch.setattr(K.word_blocks, "__defaults__", (chars,))
    rng = random.Random(3)
    vocabulary = {x: [x + y for y in "abcdefghijklmnopqrstuvwxyz"] for x in "abc"}
    text = lambda x, n: " ".join(rng.choice(vocabulary[x if rng.random() < 0.7 else rng.choice("abc")]) for _ in range(n))
    train = [(i, text("abc"[i % 3], 4), "abc"[i % 3]) for i in range(9)] + [(90, "ca cb", None), (91, None, "a"), (92, "", "d")]
    pool = [(100 + i % 50, rng.choice([text("abc"[i % 3], rng.randrange(1, 7))] * 9 + [None, ""]), rng.choice(["a", None])) for i in range(70)] + [(None, "aa ab ac ad", None), (None, "ae af ag", None)]
    frames = [spark.createDataFrame(rows, KIND).repartition(3) for rows in (train, pool)]
    got = sorted(tuple(r) for r in M.self_train(*frames, "dialect", rounds=4, threshold=0.8, cap=cap).select("dialect", "n", "round").collect())
    want = plain(train, pool, 4, 0.8, cap)
    assert got == want and len({r for *_, r in want}) > 2


def test_nothing_to_learn_from(spark):
    pool = spark.createDataFrame([(1, "a b", None)], KIND)
    for train in ([(2, "a", None)], [(2, None, "x"), (3, "", "y")]):
        assert M.self_train(spark.createDataFrame(train, KIND), pool, "dialect").count() == 0


def test_a_text_is_cut_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    train = spark.createDataFrame([(1, "kot pies kot", "a"), (2, "auto rower auto", "b")], KIND)
    pool = spark.createDataFrame([(10, "kot kot pies kot mysz", None), (11, "rower auto rower auto", None), (12, "kot auto", None), (13, "mysz mysz mysz mysz", None)], KIND)
    M.self_train(train, pool.withColumn("text", F.udf(seen, "string")("text")), "dialect").collect()
    assert read.value == 4  # in all three rounds
