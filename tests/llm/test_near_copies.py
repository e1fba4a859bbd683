"""The pipeline's near-dedup stage against all pairs of five-word shingle sets; decontamination against its plain version."""

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from corpusloom.llm import near_copies, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, last string"


def order(doc_id):
    return doc_id is None, doc_id or 0


def shingles(text):
    w = re.findall(brute.SPACED, brute.low(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def kept_ids(rows):
    """The smallest doc_id (null last) of each component of pairs with a similarity of 4/5 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((min(g, key=order) for g in groups.values()), key=order)


@pytest.fixture(scope="module")
def planted():
    """Texts with near copies of which some words are other ones, so that similarities lie on both sides of 0.8; with common passages, chains, nulls and short texts."""
    rng = random.Random(11)
    line = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    passage, out = line(30), [None, "", " \n", "one", "One", "a b c d", "a b c d e", "a b c d e f"]
    for n in (8, 20, 60, 150, 400):
        for _ in range(8):
            base = line(n) + (passage if n < 100 else [])
            out.append(" ".join(base))
            for changes in (1, 2, 3, 5, 8, 12):
                copy = list(base)
                for k in rng.sample(range(len(copy)), min(changes, len(copy))):
                    copy[k] = f"x{rng.randint(0, 5000)}"
                out.append("  ".join(copy).upper() if changes % 2 else " ".join(copy))
    drift = line(90)
    for k in range(12):  # each like the next only
        drift = drift[5:] + line(5)
        out.append(" ".join(drift))
    return [(i if i % 50 else None, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("common", [2, near_copies.COMMON])
def test_near_dedup_stage(spark, monkeypatch, planted, common):
    monkeypatch.setattr(near_copies, "SAMPLE", 2 if common == 2 else near_copies.SAMPLE)
    monkeypatch.setattr(near_copies, "COMMON", common)
    rows = [(d, t, "en", "x") for d, t in planted]
    docs = spark.createDataFrame(rows + rows[9:12], SCHEMA).repartition(3)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=order) == kept_ids(planted)
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), SF).count() == 0


def test_near_dedup_stage_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()) == kept_ids(rows)


def test_prefix_and_place_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        n, common = int(rng.integers(1, 40)), 0
        a = set(rng.choice(60, min(n, 60), replace=False).tolist())
        b = set(list(a)[: int(rng.integers(0, len(a) + 1))]) | set(rng.choice(60, int(rng.integers(1, 6)), replace=False).tolist())
        common = len(a & b)
        first = [{k: pos for pos, k in enumerate(sorted(s)[: near_copies.prefix_length(len(s))])} for s in (a, b)]
        met = any(near_copies.similar(len(a), len(b), min(len(a) - first[0][k], len(b) - first[1][k])) for k in first[0].keys() & first[1].keys())
        assert met or 5 * common < 4 * len(a | b)


def test_decontamination_stage(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = brute.contamination(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    got = corpus_pipeline.decontamination_stage(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(x[0] for x in found if not x[5])


def test_near_dedup_stage_checks_what_fingerprints_link(spark, planted, monkeypatch):
    """The pairs that the stage checks first join what op6 joins."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(planted)], "doc_id long, text string").repartition(3)
    seen = []
    monkeypatch.setattr(near_copies, "fingerprint_pairs", lambda rows, all_, f=near_copies.fingerprint_pairs: seen.append((f(rows, all_), all_)) or seen[-1][0])
    assert corpus_pipeline.near_dedup_stage(spark, docs, SF).count()
    pairs, all_ = seen[0]
    root = {r["node"]: r["root"] for r in simhash.components(pairs).collect()}
    of = {r["did"]: root.get(r["node"], r["node"]) for r in all_.select("did", "node").collect()}
    want = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id")).collect()}
    groups = lambda x: sorted(sorted(k for k in x if x[k] == v) for v in set(x.values()))
    assert len(set(want.values())) < len(want) and groups(of) == groups(want)
