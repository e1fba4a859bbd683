"""Each operator against a plain version, on small rows with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from corpusloom.llm import decontaminate, exact_dedup, licenses, mixing, pii, quality, simhash, substrings, token_counts, token_output
from corpusloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp string, target string"
COLUMNS = ["doc_id", "text"]


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta", "été", "x1", "über", "naïve.", "io", "z"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long_ = line(60), line(4000)
    out = [None, "", "   \n", "one", "two words", long_, long_ + " tail", passage, line(5) + " " + passage + "\n" + line(9), passage + " " + line(3) + " " + passage]
    out += [line(rng.randint(1, 90)) for _ in range(30)]
    out += [out[12], out[12].upper(), out[13].replace(" ", "  "), "same " * 80, "The GNU General Public License; all rights reserved. CC BY", "cc by cc by", "general public", "Mail a.b@c.de, a@b, +1 (555) 123-4567 4111 1111 1111 1111 10.0.0.256 192.168.1.1.7"]
    out += ["😀 emoji <|endoftext|> text", "tabs\tand  two  spaces ", "İstanbul ﬁ ĳ"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = rows_of(texts)
    return spark.createDataFrame(rows + [rows[20], (None, texts[21], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)], SCHEMA).repartition(3)


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, empty):
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    expected = sorted(((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False)), len(t.encode(x or "", add_special_tokens=False)) > 2048) for d, x in pairs(docs)), key=repr)
    assert collected(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.count_tokens(empty, path).count() == 0


def test_pretokens_of_other_scripts():
    """Texts that pass for plain have the library's tokens, pre-token by pre-token."""
    from tokenizers import Tokenizer

    from corpusloom.llm import pretokens as P

    t, rng = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), random.Random(9)
    some = [*"abzABZ019 .,'!?\n", *"éßØıłŽ", *"αβΩώϊΆ", *"яЖйЁѣҐ", *"漢字日語", *"ひらカタ", *"한국어", *"–—‘’“”…€→、。「」☃", "\U0001f600", "\U0001f680"]
    plain = 0
    for _ in range(1500):
        x = "".join(rng.choice(some) for _ in range(rng.randint(1, 25)))
        if P.plain(x):
            plain += 1
            assert sum(len(t.encode(w, add_special_tokens=False)) for w in P.WORD_BPE(x.lower())) == len(t.encode(x, add_special_tokens=False)), x
    assert plain > 500


def test_token_output(docs, empty):
    path = vocabulary("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ordered = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, expected = 0, []
    for d, x in ordered:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        expected.append((d, at, len(ids), brute.crc(ids)))
        at += len(ids)
    for shard in (50, 1 << 20):
        assert collected(token_output.token_output(docs, path, shard), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    assert token_output.token_output(empty, path).count() == 0


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for vocab in (300, 70_000):
        ids = [np.append(rng.integers(0, 12, rng.integers(0, 400)), 2).astype(np.uint32) for _ in range(60)]
        whole = np.concatenate(ids)
        shard = token_output.Shard(token_output.pack([None, *range(59)], ids, vocab))
        assert shard.doc_ids == [None, *range(59)] and len(shard.rules) and len(shard.seq) < len(whole)
        assert all((shard.document(i) == x).all() for i, x in enumerate(ids))
        assert all((shard.ids(a, b) == whole[a:b]).all() for a, b in ((0, 1), (5, 900), (len(whole) - 3, len(whole))))


def test_decontamination(spark, docs, texts, empty):
    items = [(1, texts[7]), (2, "two words"), (3, None), (10, texts[5]), (10, "alpha"), (None, texts[14])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for block in (12_000, 1 << 20):
        assert collected(decontaminate.decontaminate(docs, benchmark, block), *names) == sorted(brute.contamination(pairs(docs), items), key=repr)
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not r[-1] for r in brute.contamination(pairs(docs), items))


def test_pii(docs, empty):
    got = pii.find_pii(docs).collect()
    expected = sorted(((d, *(sum(s[0] == k for s in brute.base_pii(x)) for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_pii(x)).encode()).hexdigest()) for d, x in pairs(docs)), key=repr)
    assert sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got), key=repr) == expected
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        base = {f"{k}:{a}:{b}" for k, a, b in brute.base_pii(text[r["doc_id"]])} if r["doc_id"] is not None else set()
        assert base <= set(r["spans"].split(","))
    assert pii.find_pii(empty).count() == 0


def test_pii_patterns_at_random():
    rng = random.Random(1)
    for _ in range(3000):
        x = "".join(rng.choice("ab1 +-().@_25.9@") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(x) == brute.base_pii(x), x


def test_pii_labelers_agree_after_training():
    counted = [("phone", "++00+0", 5, 80.0), ("phone", "-0-00-", 5, 60.0), ("name", "0000+0", 2, 30.0), ("ssn", "++00+0", 4, 20.0), ("ssn", "-0-00-", 4, 20.0)]
    w = pii.train(counted)
    assert pii._features("phone", "++00+0", 5) @ w > 0 > pii._features("phone", "-0-00-", 5) @ w


def test_pii_added_spans(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'the token = "{key[i:]}{key[:i]}" here {i}' for i in range(20)] + ["call 212-555-0143 now", "Dear John Miller, thanks", "ssn 123-45-6789", "The Monday Morning of long-hyphenated-compound-words", "plain words only", "see commit " + key]
    rows = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), COLUMNS)).collect()}
    assert all(rows[i]["spans"] == f"secret:13:53" and rows[i]["n_spans"] == 1 for i in range(20))
    assert rows[24]["spans"] == "" and rows[23]["spans"] == ""


def test_pii_reliabilities_against_enumeration():
    """One round of expectation-maximisation, the posteriors by summing over both truths."""
    patterns = [("++00+0", 30.0), ("-0-00-", 20.0), ("0+0000", 15.0), ("000000", 40.0)]
    prior, theta = pii.reliabilities(patterns, 3)
    v = np.array([["+-0".index(c) for c in p] for p, _ in patterns])
    got = pii.posterior(v, prior, theta)
    for row, q in zip(v, got):
        yes, no = prior * np.prod([theta[j, 1, k] for j, k in enumerate(row)]), (1 - prior) * np.prod([theta[j, 0, k] for j, k in enumerate(row)])
        assert q == pytest.approx(yes / (yes + no))
    assert got[0] > 0.5 > got[1] and np.allclose(theta.sum(axis=2), 1)


def test_licenses(docs, empty):
    expected = []
    for d, x in pairs(docs):
        n, found = brute.license_places(x)
        at = [i for i, _ in found]
        expected.append((d, n, len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    got = licenses.scan(docs)
    assert collected(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(expected, key=repr)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.collect())
    assert licenses.scan(empty).count() == 0
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


def test_license_notice_with_an_inserted_word(spark):
    x = "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated documentation files"
    row = licenses.scan(spark.createDataFrame([(1, x)], COLUMNS)).first()
    assert row["labels"] == "mit" and row["n_base"] == 0


def test_license_of_a_long_template(spark):
    whole = max((x for x, label in licenses.NOTICES if label == "mit"), key=len)
    words = whole.split()
    texts = [whole, " ".join(words[:40] + ["changed"] + words[40:]), " ".join(words[:120]), " ".join(words[60:100])]
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), COLUMNS)).collect()}
    assert len(words) > 2 * licenses.SEGMENT and rows[0]["labels"] == rows[1]["labels"] == "mit" and rows[0]["score"] == 1 and rows[3]["labels"] == ""
    same = sorted(licenses.template_pairs())
    assert all(size == sum(p[0] == tid for p in same) for tid, _, _, _, size, _, _ in same)


def same_as_sql(spark, name, texts):
    import duckdb
    import pandas as pd

    from corpusloom.llm.oracles import ORACLE_SQL

    rows = list(enumerate(texts))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  (DuckDB reads it)
    want = duckdb.sql(ORACLE_SQL[name])
    got = licenses.scan(spark.createDataFrame(rows, COLUMNS)).select(*want.columns).collect()
    show = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(show, got)) == sorted(map(show, want.fetchall()))


def test_licenses_against_sql(spark, texts):
    notices = [x for x, _ in licenses.NOTICES]
    same_as_sql(spark, "op5_license_scan", [t or "" for t in texts] + notices + [notices[13][:700] + " cc by " + notices[14]])


def test_simhash(docs, empty):
    rows = pairs(docs)
    fps = [brute.fingerprint(x) for _, x in rows]
    comp = brute.components(fps)
    least = {c: min((d for (d, _), k in zip(rows, comp) if k == c and d is not None), default=None) for c in comp}
    expected = sorted(((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp)), key=repr)
    assert collected(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dense", [4, 1024])
def test_links_lose_nothing(spark, monkeypatch, dense):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) for b in base]
    for b in base[:10]:
        for _ in range(60):
            near.append(int(b) ^ int(sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(1, 5)).tolist()))))
    fps = sorted(set(near))
    comp = brute.components(fps)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    monkeypatch.setattr(simhash, "DENSE", dense)
    for place in range(16):  # the splits of one key alone
        same = np.array([x for x in fps if (((x << 4 * place) | (x >> (64 - 4 * place))) & ((1 << 64) - 1)) >> 44 == 0], np.uint64)
        simhash.forest(same, place)
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    got = [roots.get(x, x - (1 << 64) if x >> 63 else x) for x in fps]
    assert len(set(zip(comp, got))) == len(set(comp)) == len(set(got))


def test_forest_of_a_large_key(monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 8)
    rng = np.random.default_rng(2)
    fps = np.unique(np.array([int(sum(1 << int(k) for k in set(rng.integers(0, 24, rng.integers(0, 5)).tolist()))) for _ in range(300)], np.uint64))
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    edges = simhash.forest(fps, 0)
    for a, b in edges:
        assert int(a ^ b).bit_count() <= 3
        root[max(find(a), find(b))] = min(find(a), find(b))
    # within one key the first 20 bits are equal, as here, and the chain allows one difference in 40, two in 60
    linked = lambda a, b: bool(simhash._linked(np.array([a], np.uint64), np.array([b], np.uint64), 0)[0])
    for a in fps.tolist():
        for b in fps.tolist():
            if a < b and linked(a, b):
                assert find(a) == find(b)


@pytest.mark.parametrize("block", [100, 1_500_000])
def test_substrings(docs, empty, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", block)
    for window, gram in ((35, 8), (6, 2)):
        assert collected(substrings.remove_repeats(docs, window, gram), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeats(pairs(docs), window), key=repr)
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("group_runs", [1, 2, 1000])
def test_substrings_of_crowded_prefixes_and_long_texts(spark, group_runs):
    """Prefixes lengthened or not; repeats that lie across the pieces of a text of over 512 KB."""
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randint(0, 9**6)}" for _ in range(n))
    common, passage = line(8), line(50)
    texts = [line(rng.randint(30, 40)) + " " + common + " " + line(rng.randint(30, 40)) for _ in range(40)]
    texts += [line(20) + " " + passage + "\t" + line(20) for _ in range(12)] + [passage, None]
    long_ = [line(60) for _ in range(2500)]
    texts += [" ".join(long_), " ".join(x + " " + line(2) for x in long_), "word " * 150_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = collected(substrings.remove_repeats(docs, group_runs=group_runs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.repeats(pairs(docs), 35), key=repr)


def source_facts(docs):
    """Size and target of each source, the plain way: share out by weight, cap, share again."""
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(brute.SPACED, r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left, w = sum(sizes.values()) - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and left / w * weight[s] >= 3 * sizes[s]}
        if not more:
            return {s: (sizes[s], 3 * sizes[s] if s in full else left / w * weight[s]) for s in order}
        full |= more


@pytest.mark.parametrize("block", [7, mixing.BLOCK_WORDS])
def test_mixing(docs, empty, block):
    got = mixing.mix(docs, block).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    facts, source = source_facts(docs), {}
    for r in docs.collect():
        source.setdefault((r["doc_id"], len(re.findall(brute.SPACED, r["text"] or ""))), set()).add(r["source"])
    taken = Counter()
    for r in got:
        own = [s for s in source[r["doc_id"], r["size"]] if facts[s][0] == r["source_size"]]
        assert own and r["target"] == pytest.approx(facts[own[0]][1])
        taken[own[0]] += r["taken"]
    assert all(abs(taken[s] - goal) <= block + 3 for s, (_, goal) in facts.items())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5), block).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(docs, block)
    assert mixed.columns == docs.columns and sum(len(re.findall(brute.SPACED, r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixed.where("doc_id IS NOT NULL").collect():  # what is taken are stretches of the document
        words = whole[r["doc_id"]].split()
        assert all(line in " ".join(words) for line in (" ".join(x.split()) for x in r["text"].split("\n")) if len(words) < 200)


def test_mixing_of_shards(spark):
    """The shares of a shard are those of a plain walk over its blocks."""
    import pandas as pd

    group = pd.DataFrame({"did": range(40), "text_key": range(40), "size": [(7 * i) % 23 for i in range(40)], "copies": [1] * 40, "place": [(i * 37) % 101 for i in range(40)]})
    total = int(group["size"].sum())
    for words in (0, 1, 50, total, total + 77, 3 * total):
        out = mixing._shares(8)((3, 5), group.assign(words=words))
        size = dict(zip(group["did"], group["size"]))
        share = {r.did: r.rounds * size[r.did] + sum(p["b"] - p["a"] for p in r.parts) for r in out.itertuples()}
        assert sum(share.values()) == words and all(words // total * size[d] <= n <= (words // total + 1) * size[d] for d, n in share.items())
        assert all(0 <= p["a"] < p["b"] <= size[r.did] for r in out.itertuples() for p in r.parts)


def test_mixing_of_few_words_and_likes(spark):
    few = spark.createDataFrame([(1, "a b c d", "x"), (2, "e f g h", "y")], "doc_id long, text string, source string")
    assert sum(r["taken"] for r in mixing.mix(few).collect()) == 8 and mixing.mixed_documents(few).count() == 2
    alike = spark.createDataFrame([(1, "a b c d e f g", "x")] * 5 + [(2, "p q r", "x"), (3, "k " * 40, "y")], "doc_id long, text string, source string")
    assert len({r["taken"] for r in mixing.mix(alike).where("doc_id = 1").collect()}) == 1


def test_sainte_lague_and_targets():
    assert mixing.sainte_lague([53000, 24000, 23000], 7) == [3, 2, 2]
    for votes, seats in (([1.0, 1.0, 1.0], 4), ([5.0, 0.0], 3), ([], 0), ([10.0, 3.0, 1.0, 1.0], 100)):
        got, slow = mixing.sainte_lague(votes, seats), [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            slow[max(range(len(votes)), key=lambda i: (votes[i] / (2 * slow[i] + 1), -i))] += 1
        assert got == slow
    assert mixing.targets([100, 10, 10], [5, 2, 1]) == [75.0, 30.0, 15.0]


@pytest.mark.parametrize("memory", [200, exact_dedup.MEMORY_BYTES])
def test_exact_dedup(docs, empty, memory):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", x or "")) for d, x in pairs(docs)]
    n, keep = Counter(x for _, x in norm), {}
    for d, x in norm:
        keep[x] = d if x not in keep or keep[x] is None else keep[x] if d is None else min(d, keep[x])
    expected = sorted(((d, keep[x], n[x], d == keep[x], hashlib.sha256(x.encode()).hexdigest()) for d, x in norm), key=repr)
    assert collected(exact_dedup.deduplicate(docs, memory), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected
    assert exact_dedup.deduplicate(empty).count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(0)
    good = [(i, " ".join(rng.choice(["the", "of", "and", "river", "stone", "light"]) for _ in range(30))) for i in range(200)]
    bad = [(1000 + i, " ".join(rng.choice(["the", "of", "and", "buy###", "click$$$", "now%%%"]) for _ in range(30))) for i in range(200)]
    table = spark.createDataFrame(good + bad, COLUMNS)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    held = quality.classify(table, labels).where("held_out").collect()
    assert len(held) > 50 and all(r["predicted"] == (r["doc_id"] < 1000) and 0 <= r["score"] <= 1 for r in held)
    assert quality.good_documents(table, labels).count() == 200
    scored = quality.classify(docs, labels)
    assert scored.count() == docs.count() and scored.where("score IS NULL OR isnan(score)").count() == 0
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    rows = out.orderBy("start").collect()
    assert rows and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}


CLASHING = "doc_id long, text string, did long, text_key string, row string, `_hits` int, `_a` int, last string, node int, source string, `a.b` int, n_chars int"


def test_stages_with_clashing_columns_nulls_and_repeats(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf}/documents.parquet").limit(12).collect()
    rows = [(r["doc_id"], r["text"], 111, "k", "r", 5, 6, "l", 7, r["source"], 8, r["n_chars"]) for r in some]
    rows += [rows[0], (None, None, None, None, None, None, None, None, None, None, None, None), (None, "", 1, "x", "y", 1, 1, "z", 1, None, 1, 0)]
    docs = spark.createDataFrame(rows, CLASHING).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, sf)
            assert out.schema.names == docs.schema.names
            kept = out.collect()
            assert all(r["did"] == 111 and r["a.b"] == 8 and r["_a"] == 6 for r in kept if r["doc_id"] is not None) and len(kept) <= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    """Documents cut into pieces, one with a word longer than a piece, give what whole ones give."""
    from corpusloom.llm import words as W

    monkeypatch.setattr(W, "CHUNK_BYTES", 400)
    monkeypatch.setattr(W, "_BLOCK", 800)
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randint(0, 60)}{'é' * rng.randint(0, 2)}" for _ in range(n))
    long_ = line(900)
    texts = [long_, line(300) + " " + "x" * 3000 + " " + line(400), "y" * 5000, "  \n" * 900, long_[700:2500], line(30), ""]
    column = W.pa.array(texts)
    for classes, fold in ((W.SPACED, W.SAME), (W.ALNUM, W.LOWER)):
        whole = [(i, int(p), int(h)) for c in W.chunks(column, classes, fold, cut=False) for i, p, h in zip(c.doc + c.lo, c.pos, c.hashes())]
        cut = [(i, int(p), int(h)) for c in W.chunks(column, classes, fold, 12) for i, p, h in list(zip(c.doc + c.lo, c.pos, c.hashes()))[: c.mine]]
        assert [tuple(map(int, x)) for x in cut] == [tuple(map(int, x)) for x in whole]
    for n in (2, 5, 13):
        grams = lambda **k: [(int(c.doc[i]) + c.lo, int(c.pos[i]), int(W.grams(c.hashes(), n)[i])) for c in W.chunks(column, W.SPACED, W.LOWER, **k) for i in c.begins(n)]
        assert grams(overlap=12) == grams(cut=False)


def test_quality_on_held_out_rows(spark):
    """Accuracy and area under the curve on rows that were not learnt from."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    print("held-out", len(rows), auc)
