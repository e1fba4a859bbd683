"""Active learning, perturbations, attributions, digests and the token bucket, against plain versions."""

import hashlib
import json
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import active as AL, bayes as B, digests as D, perturbations as N
from corpusloom.streaming import jobs

LABELS = ["a", "b", "c"]


def documents(n, seed):
    rng = random.Random(seed)
    own = {"a": "ala makota", "b": "bela bakota", "c": "ca cota"}
    out = []
    for i in range(n):
        y = rng.choice(LABELS)
        out.append((i, " ".join(rng.choice([*own[y].split(), "kota", "la", "und"]) for _ in range(rng.randint(1, 6))), y))
    return out


def plain_scores(train, text):
    counts = {c: Counter(w for x, y in train if y == c for w in x.split()) for c in LABELS}
    vocabulary = set().union(*counts.values())
    known = [w for w in text.split() if w in vocabulary]
    n = Counter(y for _, y in train)
    return [(math.log(n[c] / len(train)) + sum(math.log((counts[c][w] + 0.1) / (sum(counts[c].values()) + 0.1 * len(vocabulary))) for w in known)) if n[c] else -math.inf for c in LABELS]


def test_counts_that_grow_are_those_of_a_refit(spark):
    docs = documents(80, 1)
    df = spark.createDataFrame(docs, "id long, text string, label string")
    tokens = B.word_tokens(df)
    counts = AL.Counts(LABELS)
    for lo, hi in ((0, 5), (5, 30), (30, 60)):
        counts.add(df.where(f"id >= {lo} AND id < {hi}").select("id", "label"), tokens)
        got = {r["id"]: r["scores"] for r in counts.posteriors(df.where("id >= 60"), tokens).collect()}
        assert len(got) == 20 and all(np.allclose(got[i], plain_scores([(t, y) for _, t, y in docs[:hi]], docs[i][1])) for i in got)


@pytest.mark.parametrize("strategy", ["entropy", "intensity_gated", "random"])
def test_active_loop(spark, strategy):
    docs = documents(60, 2) + [(100, "no label", None)]
    pool = spark.createDataFrame(docs, "id long, text string, label string")
    test = spark.createDataFrame([(200 + i, t, y) for i, t, y in documents(40, 3)], pool.schema)
    points = sorted(tuple(r) for r in AL.active_loop(pool, test, LABELS, strategy, seed_size=6, batch_size=25, rounds=4).collect())
    assert [p[:2] for p in points] == [(0, 6), (1, 31), (2, 56), (3, 60)] and all(0 <= p[2] <= 1 for p in points)
    truth = {200 + i: y for i, _, y in documents(40, 3)}
    full = [(t, y) for _, t, y in docs[:60]]
    right = sum(LABELS[int(np.argmax(np.round(plain_scores(full, t), 6)))] == truth[200 + i] for i, t, _ in documents(40, 3))
    assert points[-1][2] == pytest.approx(right / 40)


def test_round_robin(spark):
    pool = spark.createDataFrame([(i, "x" if i < 50 else "y" if i < 53 else None) for i in range(60)], "id long, label string")
    got = {r["id"] for r in AL.round_robin_seed(pool, "label", 10, 4).collect()}
    assert len(got) == 10 and len([i for i in got if 50 <= i < 53]) == 3 and not [i for i in got if i >= 53]
    assert {r["id"] for r in AL.round_robin_seed(pool, "label", 2, 4).collect()} < got
    with pytest.raises(ValueError):
        AL.active_loop(pool.withColumn("text", F.lit("t")), pool, LABELS, "entropy", seed_size=54)
    with pytest.raises(ValueError):
        AL.acquisition_score("luck", F.lit(0), F.lit(0))


def drawn(name, key, i):
    return int(hashlib.md5(f"{name}|{key}|{i}".encode()).hexdigest()[:8], 16) / 2**32


def test_keyboard():
    near = N.neighbours()
    assert {k: "".join(sorted(v)) for k, v in near.items() if k in "qsmpl"} == {"q": "aw", "s": "adewxz", "m": "jkn", "p": "lo", "l": "kop"} and len(near) == 26


@pytest.mark.parametrize("level", [0.0, 0.3, 1.0])
def test_perturbations(spark, level):
    texts = ["Zażółć GĘŚLĄ jaźń, Ż! może", "szyja żaba mazurek czapka", "", None, "QWERTY zxcvb 123"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {(r["name"], r["key"]): r["text"] for r in N.swept(df, list(N.PERTURBATIONS), [level]).collect()}
    whole = {r["key"]: (r["d"], r["s"]) for r in df.select("key", X.apply_rules(F.col("text")).alias("d"), X.to_standard(F.col("text")).alias("s")).collect()}
    for key, text in enumerate(texts):
        for name, table in (("asr", N.TRANSCRIBED), ("typo", N.neighbours())):
            want = None if text is None else ""
            for i, c in enumerate(text or ""):
                v = table.get(c.lower())
                if v and drawn(name, key, i) < level:
                    x = v[int(drawn(f"{name}-choice", key, i) * len(v))]
                    c = x[0].upper() + x[1:] if c.isupper() else x
                want += c
            assert got[f"{name}_noise", key] == want
        for name in ("intensity_dial", "standardize"):
            if level in (0.0, 1.0) or text is None:
                assert got[name, key] == (text if level == 0 or text is None else whole[key][name == "standardize"])
    kept = [w for i, w in enumerate("szyja żaba mazurek czapka".split()) if drawn("drop", 1, i) >= level]
    assert got["word_dropout", 1] == " ".join(kept)


def test_levels_nest(spark):
    df = spark.createDataFrame([(1, "abcdefghij klmnopqrstuvwxyz " * 5)], "key long, text string")
    rows = {r["level"]: r["text"] for r in N.swept(df, ["typo_noise"], [0.0, 0.2, 0.6]).collect()}
    changed = lambda x: {i for i, (a, b) in enumerate(zip(rows[0.0], rows[x])) if a != b}
    assert changed(0.2) and changed(0.2) < changed(0.6)
    cells = spark.createDataFrame([(0.0, 1.0), (0.5, 0.6), (1.0, 0.2)], "level double, v double").agg(N.slope("level", "v").alias("s"), N.breakdown("level", "v", F.lit(1.0)).alias("b")).first()
    assert cells["s"] == pytest.approx(-0.8) and cells["b"] == 1.0


def test_attributions_decompose_the_score(spark):
    docs = documents(60, 5)
    df = spark.createDataFrame(docs, "id long, text string, label string")
    rows = B.top_contributions(B.word_tokens(df, "label"), LABELS, df.select("id", "label"), k=50).collect()
    train = [(t, y) for _, t, y in docs]
    for i, t, y in docs:
        s = plain_scores(train, t)
        prior = [math.log(sum(x == c for _, x in train) / len(train)) for c in LABELS]
        lik = [a - b for a, b in zip(s, prior)]
        mine = [r for r in rows if r["id"] == i]
        assert sum(r["weight"] for r in mine) == pytest.approx(lik[LABELS.index(y)] - sum(lik) / 3, abs=1e-4)
        up = [(r["weight"], r["rank"]) for r in mine if r["rank"] > 0]
        assert sorted(up, key=lambda x: x[1]) == sorted(up, key=lambda x: -x[0])
    assert all(abs(r["rank"]) <= 1 for r in B.top_contributions(B.word_tokens(df, "label"), LABELS, df.select("id", "label"), k=1).collect())


def test_top_k_is_cut_before_the_exchange(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("label"))
    plan = AL.round_robin_seed(df, "label", 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_digest(spark):
    rows = [(i, f"t{i % 7}", None if i % 5 else "x", f"/home/u{i}/clip.wav", "train" if i % 3 else "test") for i in range(100)]
    schema = "id long, text string, note string, audio string, split string"
    of = lambda rs: {r["split"]: (r["n"], r["digest"]) for r in D.corpus_digest(spark.createDataFrame(rs, schema).repartition(3), ["id", "text", "note", "audio"], "split", ("audio",)).collect()}
    got = of(rows)
    for split in ("train", "test"):
        total = 0
        for i, t, x, a, s in rows:
            if s == split:
                total += sum(int(hashlib.sha256(json.dumps({"audio": "clip.wav", "id": i, "note": x, "text": t}, separators=(",", ":")).encode()).hexdigest()[8 * k : 8 * k + 8], 16) << 32 * (7 - k) for k in range(8))
        n = sum(r[4] == split for r in rows)
        assert got[split] == (n, hashlib.sha256(f"{total % (1 << 256):064x}:{n}".encode()).hexdigest())
    assert of(rows[::-1]) == got and of([(*r[:3], r[3].replace("/home", "/srv"), r[4]) for r in rows]) == got
    for changed in (rows[1:], [*rows, rows[0]], [(0, "t0", None, rows[0][3], "test"), *rows[1:]], [(*rows[0][:4], "train"), *rows[1:]]):
        assert of(changed)[None] != got[None]
    frame = lambda d: spark.createDataFrame([(s, n, x) for s, (n, x) in d.items()], "split string, n long, digest string")
    assert D.drift(frame(got), frame(got)).count() == 0 and {r["split"] for r in D.drift(frame(of(rows[1:])), frame(got)).collect()} == {"test"}


def test_token_bucket_over_batches(spark, tmp_path):
    """As one pass in order of time, whatever batch an event comes in."""
    start, rng = datetime(2024, 1, 1), random.Random(6)
    events = sorted((start + timedelta(seconds=rng.randrange(4000)), rng.randrange(4)) for _ in range(300))
    schema = "ts timestamp, user_id long"
    for i in range(0, 300, 60):
        spark.createDataFrame(events[i : i + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = jobs.token_bucket(stream, 0.02, 2.0, late="1 minute").writeStream.format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    want, held = Counter(), {}
    for ts, u in events:
        t = ts.timestamp()
        tokens, last = held.get(u, (2.0, t))
        tokens = min(2.0, tokens + (t - last) * 0.02)
        want[u, tokens >= 1] += 1
        held[u] = (tokens - (tokens >= 1), t)
    assert Counter((r["user_id"], r["allowed"]) for r in spark.table("buckets").collect()) == want


def test_learning_curve(spark):
    """Parts are nested and of the size asked for; the whole is the model of all rows."""
    docs, rest = documents(90, 7), documents(40, 8)
    train = spark.createDataFrame([*docs, (500, "none", None)], "id long, text string, label string")
    test = spark.createDataFrame([(1000 + i, t, y) for i, t, y in rest], train.schema)
    points = [tuple(r) for r in AL.learning_curve(train, test, LABELS, [1.0, 0.01, 0.3, 0.3]).collect()]
    n = Counter(y for _, _, y in docs)
    assert [(p[0], p[1]) for p in points] == [(f, sum(max(1, math.ceil(f * k)) for k in n.values())) for f in (0.01, 0.3, 1.0)]
    right = sum(LABELS[int(np.argmax(np.round(plain_scores([(t, y) for _, t, y in docs], t), 6)))] == y for _, t, y in rest)
    assert points[-1][2] == pytest.approx(right / 40)
    with pytest.raises(ValueError):
        AL.learning_curve(train, test, LABELS, [0.0])


def test_places_are_drawn_once_for_all_levels(monkeypatch):
    calls = []
    plain = N.drawn
    monkeypatch.setattr(N, "drawn", lambda *a: calls.append(a) or plain(*a))
    texts = N.rewritten("Żółw z łąki Żuje", "7", N.TRANSCRIBED, "asr", [0.0, 0.5, 1.0])
    assert texts[0] == "Żółw z łąki Żuje" and len(calls) == len(set(calls)) == 2 * 6
    changed = [[plain("7", "asr", i) < x for i, c in enumerate(texts[0]) if c.lower() in N.TRANSCRIBED] for x in (0.5, 1.0)]
    assert all(changed[1]) and (texts[1] != texts[0]) == any(changed[0])
