"""MinHash and LSH: signatures, crowded buckets, recall against the exact join."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C, minhash as M

SF = "/root/testdata/sf0.001"


def grams(text):
    t = " ".join(text.split()).casefold()
    return {t[i : i + 5] for i in range(len(t) - 4)} if len(t) > 5 else {t} - {""}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_signatures_estimate_similarity():
    rng, (a, b) = random.Random(0), M.permutations(512, 3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    for cut in (0, 300, 1500):
        other = text[cut:] + "xyz" * 20
        x, y = (M.signature(M.gram_hashes(" ".join(t.split()), 5), a, b) for t in (text, other))
        assert abs((x == y).mean() - jaccard(text, other)) < 0.08
    assert len(M.gram_hashes("", 5)) == 0 and len(M.gram_hashes("abc", 5)) == 1 and M.gram_hashes("abcdefg", 5).tolist() == sorted(set(M.gram_hashes("abcdefg", 5).tolist()))


def test_permutations():
    rng = np.random.default_rng(1)
    x, (a, b) = rng.integers(0, 1 << 32, 200, np.uint64), M.permutations(50, 2)
    assert M.permuted(x[:, None], a, b).tolist() == [[(int(u) * int(f) + int(s)) % M.PRIME for f, s in zip(a, b)] for u in x]


def near(rng, text, changes):
    t = list(text)
    for _ in range(changes):
        t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
    return "".join(t)


@pytest.mark.parametrize("crowded", [64, 3])
def test_pairs_of_planted_copies(spark, crowded):
    """Every bucket of the crowd is split, with crowded=3 down to the last; no near copy is left without a partner."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(30)]
    texts = base + [near(rng, base[0], 2) for _ in range(40)] + [near(rng, t, 4) for t in base[1:10]] + [base[3].upper() + "  ", base[3], None, " ", "abc", "ABC"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    pairs, members = M.lsh_pairs(df, crowded=crowded)
    found = {(r["a"], r["b"]): r["jaccard"] for r in pairs.collect()}
    assert {(r["id"], r["a"]) for r in members.collect()} == {(79, 3), (80, 3), (84, 83)}
    want = {(i, j): jaccard(texts[i], texts[j]) for i in range(79) for j in range(i + 1, 79) if i != 3 or j < 79}
    want = {k: v for k, v in want.items() if v >= 0.85}
    assert all(abs(v - want[k]) < 1e-3 for k, v in found.items())
    if crowded == 64:
        assert len(found) > 0.97 * len(want)
    linked = {i for p in found for i in p}
    assert linked == {i for p in want for i in p}
    kept = {r["id"] for r in M.deduplicate(df, crowded=crowded).collect()}
    assert kept == {*range(30), 81, 82, 83} and M.deduplicate(df.limit(0)).count() == 0


def test_recall_against_the_exact_join(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text").where("length(text) > 200")
    exact = {(r["a"], r["b"]) for r in C.similar_pairs(d).collect()}
    pairs, members = M.lsh_pairs(d)
    first = {r["id"]: r["a"] for r in members.collect()}
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    rep = lambda i: first.get(i, i)
    hit = sum(rep(a) == rep(b) or tuple(sorted((rep(a), rep(b)))) in found for a, b in exact)
    assert exact and hit >= 0.9 * len(exact)


def test_wrong_parameters(spark):
    with pytest.raises(ValueError):
        M.signatures(spark.createDataFrame([(1, "a")], "id long, text string"), number=10, bands=4)
    assert np.all(M.signature(np.zeros(0, np.uint32), *M.permutations(4, 0)) == M.PRIME)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 30, 3000):
        x = np.unique(rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32))
        y = np.unique(np.append(x[: n - n // 10], rng.integers(0, 1 << 32, n // 5, np.uint64).astype(np.uint32)))
        assert np.bitwise_count(M.parities(x) ^ M.parities(y)).sum() <= len(np.setxor1d(x, y))


def test_only_likely_sets_travel(spark):
    """Pairs that the parities rule out meet no set: a broken one would raise an error."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 32, 400, np.uint64).astype(np.uint32)) for _ in range(3)]
    rows = [(i, len(s), M.parities(s).tolist(), None if i == 2 else bytearray(s.tobytes())) for i, s in enumerate([sets[0], sets[0], sets[1]])]
    df = spark.createDataFrame(rows, "id long, n int, odd array<long>, grams binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    assert [tuple(r) for r in M.verified(pairs, df, 0.85).collect()] == [(0, 1, 1.0)]


def banded(texts, threshold=0.85):
    """By brute force the pairs that share a band and have the similarity."""
    a, b = M.permutations(M.PERMUTATIONS, 0)
    sets = [M.gram_hashes(M.cleaned(t), 5) for t in texts]
    bands = np.array([M.signature(s, a, b).reshape(M.BANDS, -1) for s in sets])
    alike = lambda i, j: (n := len(np.intersect1d(sets[i], sets[j]))) / (len(sets[i]) + len(sets[j]) - n)
    return {(i, j) for j in range(len(sets)) for i in range(j) if (bands[i] == bands[j]).all(axis=1).any() and alike(i, j) >= threshold}


@pytest.mark.parametrize("crowded", [None, 10])
def test_every_pair_of_a_large_crowd(spark, crowded):
    """Crowds of over 64 rows share their bands; in buckets crowded through three bands all pairs are listed, and none of them is left out."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(1200)) for _ in range(2)]
    texts = list(dict.fromkeys(near(rng, base[i % 2], rng.choice([1, 2, 20])) for i in range(240)))  # equal ones meet by their first
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = [(r["a"], r["b"]) for r in M.lsh_pairs(df, crowded=crowded)[0].collect()]
    assert len(set(found)) == len(found) > 2000 and set(found) == banded(texts)


def test_signature_is_exact():
    rng = np.random.default_rng(7)
    a, b = M.permutations(128, 0)
    a[:3], b[:3] = (1, M.PRIME - 1, M.PRIME - 1), (0, 0, 1)
    for n in (1, 255, 257, 3000):
        grams = np.unique(np.append(rng.integers(0, 1 << 32, n, np.uint64), np.arange(3)).astype(np.uint32))
        assert (M.signature(grams, a, b) == M.permuted(grams.astype(np.uint64)[:, None], a, b).min(axis=0)).all()
    assert M.signature(np.array([0], np.uint32), a[:1], b[:1]).tolist() == [0]


def test_ids_that_repeat_keep_their_texts(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(1, base), (1, "something else altogether, and long enough"), (2, near(rng, base, 1)), (None, near(rng, base, 1))]
    pairs, _ = M.lsh_pairs(spark.createDataFrame(rows, "id long, text string"))
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 2)]
