"""Paired significance, hierarchy with policies, stacking and naive Bayes by folds, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bayes as B, hierarchy as H, paired as P, stacking as K

LABELS = ["a", "b", "c"]


def test_resample_weights():
    w = P.weights(np.arange(4000), 50, 3)
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.01 and abs((w == 2).mean() - math.exp(-1) / 2) < 0.01
    assert (P.weights(np.array([7, 9]), 50, 3) == P.weights(np.arange(4000), 50, 3)[[7, 9]]).all() and (P.weights(np.array([7]), 50, 4) != w[7]).any()
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.06


@pytest.fixture(scope="module")
def answers():
    rng = random.Random(1)
    rows = []
    for i in range(300):
        y = rng.choice(LABELS)
        for m, right in (("good", 0.9), ("fair", 0.8), ("same", 0.8)):
            rows.append((i, m, y, y if rng.random() < right else rng.choice(LABELS)))
    same = {r[0]: r[3] for r in rows if r[1] == "fair"}
    return [(i, m, y, same[i] if m == "same" else g) for i, m, y, g in rows]


def plain_f1(y, g, w):
    labels = {v for v, k in zip(y, w) if k} | {v for v, k in zip(g, w) if k}
    out = []
    for c in labels:
        tp, t, p = (sum(k for a, b, k in zip(y, g, w) if cond(a, b, c)) for cond in (lambda a, b, c: a == b == c, lambda a, b, c: a == c, lambda a, b, c: b == c))
        out.append(2 * tp / (t + p))
    return sum(out) / len(out)


def test_paired_significance(spark, answers):
    df = spark.createDataFrame(answers, "id long, model string, y_true string, y_pred string").repartition(4)
    got = {(r["a"], r["b"], r["metric"]): r for r in P.paired_significance(df, ["good", "fair", "same"], LABELS, resamples=150, seed=5).collect()}
    assert len(got) == 12
    keys = [r["h"] for r in spark.range(300).select(F.xxhash64(F.col("id").cast("string")).alias("h")).collect()]
    w = P.weights(np.array(keys), 150, 5)
    y = [next(r[2] for r in answers if r[0] == i) for i in range(300)]
    of = {m: [r[3] for r in answers if r[1] == m] for m in ("good", "fair", "same")}
    acc = lambda m, k: sum(v for a, b, v in zip(y, of[m], k) if a == b) / sum(k)
    ones = [1.0] * 300
    for m in of:
        for metric, f in (("accuracy", acc), ("macro_f1", lambda m, k: plain_f1(y, of[m], k))):
            r, draws = got[m, None, metric], [f(m, w[:, k].tolist()) for k in range(150)]
            assert np.allclose([r["value"], r["low"], r["high"]], [f(m, ones), *np.percentile(draws, [2.5, 97.5])]) and r["low"] <= r["value"] <= r["high"] and r["p"] is None
    d = got["good", "fair", "accuracy"]
    draws = [acc("good", w[:, k].tolist()) - acc("fair", w[:, k].tolist()) for k in range(150)]
    assert np.allclose([d["value"], d["low"], d["high"]], [acc("good", ones) - acc("fair", ones), *np.percentile(draws, [2.5, 97.5])])
    a = sum(g == t != f for g, t, f in zip(of["good"], y, of["fair"]))
    b = sum(f == t != g for g, t, f in zip(of["good"], y, of["fair"]))
    p = min(1.0, 2 * sum(math.comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b))
    assert abs(d["p"] - p) < 1e-9 and abs(d["adjusted"] - min(1, 3 * p)) < 1e-9
    same = got["fair", "same", "macro_f1"]
    assert (same["value"], same["low"], same["high"], same["p"]) == (0, 0, 0, 1)


def test_unaligned_models(spark, answers):
    for wrong in (answers[1:], [*answers, answers[0]], [(0, "good", "zz", "a"), *answers[1:]]):
        with pytest.raises(ValueError):
            P.paired_significance(spark.createDataFrame(wrong, "id long, model string, y_true string, y_pred string"), ["good", "fair", "same"], LABELS, resamples=10)


PARENT = {"x1": "x", "x2": "x", "y1": "y"}
FINE, COARSE = ["x1", "x2", "y1"], ["standard", "x", "y"]
POLICIES = [
    H.Policy("always_accept"), H.Policy("confidence_threshold", 0.5), H.Policy("margin_threshold", 0.3), H.Policy("not_abstained"), H.Policy("all_of"), H.Policy("any_of"),
    H.Policy("all_of", children=(H.Policy("confidence_threshold", 0.3), H.Policy("any_of", children=(H.Policy("margin_threshold", 0.2), H.Policy("not_abstained"))))),
]


def plain_accepts(policy, p, abstained):
    top = sorted(p, reverse=True)
    return {
        "always_accept": lambda: True, "confidence_threshold": lambda: top[0] >= policy.value, "margin_threshold": lambda: len(p) < 2 or top[0] - top[1] >= policy.value, "not_abstained": lambda: not abstained,
        "all_of": lambda: all(plain_accepts(c, p, abstained) for c in policy.children), "any_of": lambda: any(plain_accepts(c, p, abstained) for c in policy.children),
    }[policy.kind]()


@pytest.mark.parametrize("policy", POLICIES)
def test_hierarchy(spark, policy):
    rng = np.random.default_rng(2)
    rows = [(i, rng.dirichlet([0.6] * 3).tolist(), rng.dirichlet([0.6] * 3).tolist()) for i in range(60)] + [(60, [0.0, 0.0, 1.0], [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, fine_p array<double>, coarse_p array<double>")
    assert H.Policy.from_json(policy.to_json()) == policy
    for below in (None, 0.6):
        got = {r["id"]: r for r in H.decide(df, FINE, COARSE, PARENT, policy, below).collect()}
        for i, f, c in rows:
            coarse = COARSE[int(np.argmax(c))] if max(c) >= (below or 0) else None
            abstained = max(f) < (below or 0)
            inside = [v if coarse is None or PARENT[x] == coarse else 0.0 for x, v in zip(FINE, f)]
            p = inside if coarse is None else [max(c) * v / sum(inside) for v in inside] if sum(inside) > 0 else None
            if p is not None and plain_accepts(policy, p, abstained):
                want = ("fine", None if coarse is None and abstained else FINE[int(np.argmax(p))], p)
            else:
                want = ("coarse", coarse, c)
            assert (got[i]["level"], got[i]["label"]) == want[:2] and np.allclose(got[i]["p"], want[2]), (i, policy)


def test_wrong_policies():
    for bad in (lambda: H.Policy("sometimes"), lambda: H.Policy("confidence_threshold"), lambda: H.Policy("always_accept", 0.1), lambda: H.Policy("not_abstained", children=(POLICIES[0],)), lambda: H.Policy.from_json('{"kind": "all_of", "more": 1}')):
        with pytest.raises(ValueError):
            bad()


def documents(n, seed):
    rng = random.Random(seed)
    own = {"a": "ala makota", "b": "bela bakota", "c": "ca cota"}
    out = []
    for i in range(n):
        y = rng.choice(LABELS)
        out.append((i, " ".join(rng.choice([*own[y].split(), "kota", "la", "und"]) for _ in range(rng.randint(0, 6))), y))
    return out


def test_naive_bayes_by_folds(spark):
    """Equal to a model counted anew for every fold."""
    docs = documents(120, 3)
    df = spark.createDataFrame([(i, t, None if i % 11 == 0 else y, i % 4) for i, t, y in docs], "id long, text string, label string, fold int")
    got = {r["id"]: r for r in B.out_of_fold(df.select("id", "fold", "label"), B.word_tokens(df, "fold", "label"), LABELS).collect()}
    for i, t, _ in docs:
        train = [(w, y) for j, w, y in docs if j % 4 != i % 4 and j % 11]
        counts = {c: Counter(w for x, y in train if y == c for w in x.split()) for c in LABELS}
        vocabulary = set().union(*counts.values())
        known = [w for w in t.split() if w in vocabulary]
        for c, s in zip(LABELS, got[i]["scores"]):
            want = math.log(sum(y == c for _, y in train) / len(train)) + sum(math.log((counts[c][w] + 0.1) / (sum(counts[c].values()) + 0.1 * len(vocabulary))) for w in known)
            assert abs(s - want) < 1e-9
        assert got[i]["n"] == len(known)


def test_stacking(spark):
    docs = documents(400, 4)
    train = spark.createDataFrame(docs[:300], "id long, text string, label string")
    test = spark.createDataFrame(docs[300:], "id long, text string, label string")
    out = K.stack(train, test.drop("label"), LABELS).collect()
    truth = {i: y for i, _, y in docs}
    assert {r["id"] for r in out} == set(range(300, 400)) and all(abs(sum(r["p"]) - 1) < 1e-9 for r in out)
    right = lambda f: sum(f(r) == truth[r["id"]] for r in out)
    stacked = right(lambda r: r["label"])
    assert stacked >= max(right(lambda r, b=b: LABELS[int(np.argmax(r[b]))]) for b in K.BASES) - 6 and stacked > 60  # texts without words are guesses


def test_out_of_fold_purity(spark):
    """A training row's probabilities do not depend on its own label."""
    docs = documents(60, 5)
    rows = lambda first: spark.createDataFrame([(i, t, first if i == 0 else y) for i, t, y in docs], "id long, text string, label string")
    none = rows("a").drop("label").limit(0)
    a, b = ({r["id"]: r["words"] for r in K.base_probabilities(rows(x), none, LABELS, {"words": B.word_tokens}).collect()} for x in "ab")
    assert np.allclose(a[0], b[0]) and any(not np.allclose(a[i], b[i]) for i in a)
