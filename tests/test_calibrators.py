"""Calibrators and order statistics against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import calibrators as K, ranks as R

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    z = rng.normal(size=(600, 3))
    y = [int(rng.choice(3, p=np.exp(v) / np.exp(v).sum())) for v in z]
    p = np.exp(3 * z) / np.exp(3 * z).sum(axis=1, keepdims=True)  # too sure by a factor of three
    p = np.round(p, 3)
    p[0] = [1.0, 0.0, 0.0]
    return [(i, p[i].tolist(), y[i] + 1, LABELS[y[i]]) for i in range(600)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, p array<double>, t int, y string").repartition(5)


def plain_loss(rows, t):
    out = []
    for _, p, y, _ in rows:
        z = [math.log(min(max(x, 1e-12), 1)) / t for x in p]
        out.append(min(-(z[y - 1] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))), -math.log(1e-12)))
    return sum(out) / len(out)


def test_temperature(frame, rows):
    t = K.fit_temperature(frame, "p", F.col("t"))
    assert 2 < t < 4.5 and all(plain_loss(rows, t) <= plain_loss(rows, t * f) + 1e-12 for f in (0.5, 0.99, 0.9999, 1.0001, 1.01, 2))
    got = {r["id"]: r["q"] for r in frame.select("id", K.scaled(F.col("p"), t).alias("q")).collect()}
    for i, p, _, _ in rows:
        z = np.log(np.clip(p, 1e-12, 1)) / t
        assert np.allclose(got[i], np.exp(z - z.max()) / np.exp(z - z.max()).sum()) and np.argmax(got[i]) == np.argmax(p)


def test_temperature_of_no_rows(frame):
    assert K.fit_temperature(frame.limit(0), "p", F.col("t")) == 1.0


def plain_isotonic(x, y):
    """Value at each distinct x by the max-min formula."""
    xs = sorted(set(x))
    n, s = np.array([x.count(v) for v in xs], float), np.array([sum(b for a, b in zip(x, y) if a == v) for v in xs], float)
    cn, cs = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(s))
    mean = lambda j, k: (cs[k + 1] - cs[j]) / (cn[k + 1] - cn[j])
    return xs, [max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i in range(len(xs))]


@pytest.mark.parametrize("fan_in", [2, 16])
def test_isotonic(frame, rows, fan_in, monkeypatch):
    monkeypatch.setattr(K, "FAN_IN", fan_in)
    some = [r for r in rows if r[0] % 5 == 0]
    part = frame.where("id % 5 = 0")
    blocks = K.fit_isotonic(part, "p", F.col("y"), LABELS)
    got = {r["id"]: r["p"] for r in K.apply_isotonic(frame, "id", "p", blocks, LABELS).collect()}
    fits = [plain_isotonic([r[1][k] for r in some], [float(r[3] == LABELS[k]) for r in some]) for k in range(3)]
    for i, p, _, _ in rows:
        want = np.array([np.interp(p[k], *fits[k]) for k in range(3)])
        want = want / want.sum() if want.sum() > 0 else np.full(3, 1 / 3)
        assert np.allclose(got[i], want, atol=1e-9), i
    assert len(got) == len(rows)


def test_pooling_parts_first_changes_nothing():
    rng = random.Random(2)
    for _ in range(200):
        points = [(float(i), float(i), float(rng.randint(1, 3)), float(rng.randint(0, 3))) for i in range(rng.randint(0, 40))]
        cut = rng.randint(0, len(points))
        assert K.pooled(K.pooled(points[:cut]) + K.pooled(points[cut:])) == K.pooled(points)


def test_order_statistics(spark):
    rng = np.random.default_rng(0)
    values = [(i % 3, float(v)) for i, v in enumerate(rng.lognormal(0, 8, 3000))] + [(3, 5.0)] * 4 + [(None, 1.0), (None, 2.0), (4, None), (4, float("nan")), (0, 1e-300), (0, 1e300)]
    df = spark.createDataFrame(values, "g int, v double")
    by = {g: sorted(v for a, v in values if a == g and v is not None and v == v) for g in (0, 1, 2, 3, None)}
    found = R.order_statistics(df, "v", lambda n: [1, (n + 1) // 2, n], "g")
    assert found == {(g, k): v[k - 1] for g, v in by.items() for k in (1, (len(v) + 1) // 2, len(v))}
    shares = [0.0, 0.1, 0.5, 0.975, 1.0]
    got = R.quantiles(df, "v", shares, "g")
    assert set(got) == set(by) and all(np.allclose(got[g], np.quantile(v, shares)) for g, v in by.items())
    assert R.quantiles(df.limit(0), "v", shares) == {}
    with pytest.raises(ValueError):
        R.order_statistics(df, "v", lambda n: [n + 1])


def test_running_sums(spark):
    rng = random.Random(1)
    values = [(i, rng.choice(["x", "y", None]), rng.choice([0.5, 0.5, rng.random()]), rng.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame(values, "id long, g string, v double, k long").repartition(7)
    got = {r["id"]: (r["k_upto"], r["one_upto"]) for r in R.running(df, [R.falling(F.col("v")), F.col("id")], {"k": F.col("k"), "one": F.lit(1)}, ("g",)).collect()}
    for g in ("x", "y", None):
        total = 0
        for n, (i, _, _, k) in enumerate(sorted((r for r in values if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            total += k
            assert got[i] == (total, n)
    assert len(got) == 2000


def test_two_sided_p(spark):
    from corpusloom.operators.evaluation import two_sided

    zs = [0.0, 0.5, -1.0, 1.96, 3.0, 6.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(two_sided(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - math.erfc(abs(z) / math.sqrt(2))) < 2e-7 * math.erfc(abs(z) / math.sqrt(2)) + 1e-15 for z, r in zip(zs, got))


def test_fairness(spark):
    from corpusloom.operators.evaluation import fairness

    s = spark.createDataFrame([("d", "x", 0.9, 100), ("d", "y", 0.7, 50), ("d", "z", 0.8, 10), ("e", "q", 1.0, 5), ("e", "r", 1.0, 5), ("one", "q", 0.5, 5)], "dimension string, value string, accuracy double, n long")
    got = {r["dimension"]: r for r in fairness(s).collect()}
    pool = 125 / 150
    p = math.erfc(0.2 / math.sqrt(pool * (1 - pool) * (1 / 100 + 1 / 50)) / math.sqrt(2))
    assert set(got) == {"d", "e"} and (got["d"]["best"], got["d"]["worst"]) == ("x", "y") and got["d"]["p"] == pytest.approx(p, rel=1e-6) and got["d"]["adjusted"] == pytest.approx(2 * p, rel=1e-6)
    assert got["e"]["p"] == 1.0 and got["e"]["gap"] == 0.0
