"""Small cases of the library's own operators, with values worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A, lexicons as L, text as X
from corpusloom.operators import corpus as C, evaluation as E, models as M
from corpusloom.sources import manifest
from corpusloom.streaming import jobs


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "clean"), [("tak [szum] (śmiech głośny) -- no!!!  „dobrze”… ", 'tak no! "dobrze"...'), ("(a nie to) wiesz...", "(a nie to) wiesz..."), ("a ... b x......", "a b x..."), ("a – b", "a - b"), ("", ""), (None, None)])
def test_clean(spark, raw, clean):
    assert one(spark, raw, X.clean) == clean


def test_nfc_and_fingerprint(spark):
    assert one(spark, "é", X.nfc) == "é"
    assert one(spark, "Straße  a", X.fingerprint) == one(spark, "STRASSE a", X.fingerprint) != one(spark, "x", X.fingerprint)
    assert one(spark, None, X.fingerprint) is None


def test_rules_and_intensity(spark):
    assert one(spark, "piwo mnie jeszcze nogach", X.apply_rules) == "psiwo mnie jesce nogak"
    assert one(spark, "psiwo kobzieta mnie", X.to_standard) == "piwo kobieta mnie"
    got = one(spark, "baca psiwo x y", X.intensity)
    assert got == pytest.approx(1 - math.exp(-(8 * 2 / 4 + 8 * 1 / 4)))
    assert one(spark, "", X.intensity) == 0


def test_keywords_and_stylometry(spark):
    df = spark.createDataFrame([("Jo kaj, baca! Jo.",), (None,)], "text string")
    k = df.select(*[c.alias(n) for n, c in X.keyword_rates(X.words(F.col("text"), True)).items()]).collect()
    assert k[0]["silesia"] == 750 and k[0]["podhale"] == 500 and k[0]["kashubia"] == 500 and k[0]["total"] == 1750 and k[1]["total"] == 0
    texts = spark.createDataFrame([(1, "Jo kaj, baca! Jo."), (2, None), (3, "A-b \u2013 c... \u201eD\u201d 12?")], "doc_id long, text string")
    s = {r["doc_id"]: r for r in X.stylometry(texts).collect()}
    assert len(s[1]) == 18 and all(s[2][c] == 0 for c in s[2].asDict() if c != "doc_id")
    assert s[1]["sentence_count"] == 2 and s[1]["sentence_length_words_mean"] == 2 and s[1]["sentence_length_words_std"] == 1 and s[1]["type_token_ratio"] == 0.75
    assert s[1]["uppercase_ratio"] == pytest.approx(2 / 11) and s[1]["commas_per_100_chars"] == pytest.approx(100 / 17) and s[1]["hapax_legomena_ratio"] == 0.5 and s[1]["yules_k"] == pytest.approx(1e4 * 2 / 16)
    assert s[3]["dashes_per_100_chars"] == pytest.approx(200 / 18) and s[3]["ellipses_per_100_chars"] == pytest.approx(100 / 18) and s[3]["quotes_per_100_chars"] == pytest.approx(200 / 18) and s[3]["digit_ratio"] == pytest.approx(2 / 18)


def test_char_grams_and_shingles(spark):
    assert sorted(one(spark, "ab c", X.char_wb)) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])
    assert one(spark, "abcdefg", X.shingles) == ["abcde", "bcdef", "cdefg"] and one(spark, "ab", X.shingles) == ["ab"] and one(spark, "", X.shingles) == []


def test_bands_and_families(spark):
    rows = spark.createDataFrame([("19.9",), ("60",), ("teens",), (" ",), (None,)], "a string").select(X.age_band(F.col("a")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["<=19", "60+", "teens", None, None]
    assert one(spark, " Kurpie ", X.family_of) == "masovian" and one(spark, "x", X.family_of) is None
    assert set(L.FAMILY_OF) == set(L.DIALECT_PLACES) and set(L.FAMILY_OF.values()) <= set(L.FAMILIES)


def samples(spark, texts):
    return spark.createDataFrame([(i, i, t, f"s{i % 2}", "d", "x") for i, t in enumerate(texts)], "id long, _ord long, text string, speaker_id string, dialect string, source string")


def test_keep_first_keeps_blank_rows(spark):
    df = samples(spark, ["a  b", "A b", None, " ", None, "c"])
    assert sorted(r["id"] for r in C.keep_first(df, X.hash_text(F.col("text"))).collect()) == [0, 2, 3, 4, 5]


def test_greedy_dedup_keeps_the_end_of_a_chain(spark):
    df = samples(spark, ["a", "b", "c", "d"])
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert sorted(r["id"] for r in C.greedy_keep(df, links).collect()) == [0, 2]


def test_similar_pairs_against_all_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog again and again in the rain"
    texts = [base, base + "!", base.replace("quick", "slow"), base[:40], "nothing alike here at all", "", None, base]
    grams = [{t.lower()[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    want = {(i, j) for i in range(8) for j in range(i + 1, 8) if grams[i] and grams[j] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.85}
    assert {(r["a"], r["b"]) for r in C.similar_pairs(samples(spark, texts)).collect()} == want


def test_group_split(spark):
    df = spark.createDataFrame([(i, f"g{i % 9}", "ab"[i % 2]) for i in range(90)], "id long, speaker_id string, dialect string")
    out = C.group_split(df, "speaker_id", "dialect")
    assert out.count() == 90 and out.groupBy("speaker_id").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    assert {r["split"] for r in out.select("split").distinct().collect()} == {"train", "validation", "test"}
    with pytest.raises(ValueError):
        C.group_split(df.where("speaker_id = 'g0'"), "speaker_id", "dialect")


PRED = [(0, "a", "a", 0.9), (1, "a", "b", 0.8), (2, "b", "b", 0.7), (3, "b", "b", 0.6), (4, "c", "a", 0.5)]


def test_metrics(spark):
    df = spark.createDataFrame(PRED, "id long, y_true string, y_pred string, conf double")
    m = {r["label"]: r for r in E.class_metrics(df).collect()}
    assert (m["a"]["precision"], m["a"]["recall"], m["c"]["f1"]) == (0.5, 0.5, 0.0)
    avg = E.averaged(E.class_metrics(df)).first()
    assert avg["accuracy"] == pytest.approx(0.6) and avg["balanced_accuracy"] == pytest.approx(0.5) and avg["macro_f1"] == pytest.approx((0.5 + 0.8 + 0) / 3)
    assert E.auc(df, "conf", F.col("y_true") == F.col("y_pred")).first()["auc"] == pytest.approx(4 / 6)
    curve = [(r["id"], r["risk"]) for r in E.risk_coverage(df).orderBy("k").collect()]
    assert curve == [(0, 0.0), (1, 0.5), (2, pytest.approx(1 / 3)), (3, 0.25), (4, 0.4)]


def test_holm_and_conformal(spark):
    t = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "name string, p double")
    assert {r["name"]: round(r["adjusted"], 6) for r in E.holm(t, "p", "name").collect()} == {"x": 0.03, "z": 0.06, "y": 0.06}
    s = spark.createDataFrame([(x / 10,) for x in range(1, 10)], "score double")
    assert E.conformal_quantile(s, 0.2).first()["q"] == 0.8 and E.conformal_quantile(s, 0.01).first()["q"] == 1.0


def test_arrays(spark):
    p = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))
    row = spark.range(1).select(A.entropy(p).alias("h"), A.margin(p).alias("m"), A.argmax_label(p, ["a", "b", "c"]).alias("l"), A.renormalise(F.array(F.lit(0.0), F.lit(0.0))).alias("r"), A.fuse([p, F.lit(None).cast("array<double>")], "logpool").alias("f")).first()
    assert row["h"] == pytest.approx(math.log(2)) and row["m"] == 0 and row["l"] == "a" and row["r"] == [0.5, 0.5] and row["f"] == [0.5, 0.5, 0.0]


def test_naive_bayes(spark):
    train = spark.createDataFrame([(0, "red red apple", "a"), (1, "red plum", "a"), (2, "blue sea", "b")], "id long, text string, y string")
    test = spark.createDataFrame([(5, "red thing"), (6, "sea blue"), (7, "unknown"), (8, None)], "id long, text string")
    assert {r["id"]: r["y_pred"] for r in M.naive_bayes(train, test, "y").collect()} == {5: "a", 6: "b", 7: "a", 8: "a"}


def test_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text('﻿id,text,dialect,age\n1,"a, b",Kurpie,30\n,  x ,,\n3,,silesia,\n', encoding="utf-8")
    rows = {r["text"]: r for r in manifest.read_manifest(spark, str(tmp_path / "m.csv"), source="spokes").collect()}
    assert set(rows) == {"a, b", "x"} and rows["a, b"]["labels"]["family"] == "masovian" and rows["a, b"]["metadata"] == {"age": "30"}
    assert rows["x"]["labels"]["family"] == "standard" and rows["x"]["id"].startswith("spokes-") and rows["x"]["speaker_id"].startswith("spk-")
    (tmp_path / "m.jsonl").write_text(json.dumps({"id": "7", "body": "hej"}) + "\n\n", encoding="utf-8")
    assert manifest.read_manifest(spark, str(tmp_path / "m.jsonl"), columns={"text": "body"}).first()["text"] == "hej"


def test_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, start + timedelta(seconds=i // 2), 1, "a", 1.0) for i in range(8)] + [(0, start, 1, "a", 1.0)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, frame in (("seen", jobs.dedup_stream(stream, F.col("event_id"))), ("bucket", jobs.token_bucket(stream, 1.0, 2.0))):
        q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("seen").count() == 8
    assert spark.table("bucket").count() == 9 and spark.table("bucket").where("allowed").count() == 5
    assert jobs.tallies(events).first()["n"] == 9


def test_splits_keep_every_row(spark):
    rows = [(i, f"t{i}", f"s{i % 9}" if i % 5 else None, "x" if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, speaker_id string, dialect string")
    split = C.group_split(df, "speaker_id", "dialect").collect()
    assert sorted(r["id"] for r in split) == list(range(60)) and {r["split"] for r in split} == {"train", "validation", "test"}
    assert all(len({r["split"] for r in split if r["speaker_id"] == g}) == 1 for g in {r["speaker_id"] for r in split} if g)
    assert sorted(r["id"] for r in C.grouped_kfold(df, "speaker_id", "dialect", 3).collect()) == list(range(60))


def test_splits_of_many_groups(spark):
    """All but the largest groups are dealt by a hash; shares are met by label, groups stay whole, the result is the same again."""
    rows = [(i, f"s{i % 1500}" if i % 3 else None, "x" if i % 1500 % 4 else "y") for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, speaker_id string, dialect string").repartition(3)
    split = C.group_split(df, "speaker_id", "dialect", large=40).collect()
    assert {r["id"]: r["split"] for r in split} == {r["id"]: r["split"] for r in C.group_split(df, "speaker_id", "dialect", large=40).collect()} and len(split) == 9000
    assert all(len(v) == 1 for v in ({r["split"] for r in split if r["speaker_id"] == f"s{g}"} for g in range(1500)) if v)
    for label in "xy":
        n = [r["split"] for r in split if r["dialect"] == label]
        assert all(abs(n.count(s) / len(n) - f) < 0.03 for s, f in (("train", 0.7), ("validation", 0.15), ("test", 0.15)))
    folds = C.grouped_kfold(df, "speaker_id", "dialect", 4).groupBy("fold").count().collect()
    assert len(folds) == 4 and all(abs(r["count"] / 9000 - 0.25) < 0.03 for r in folds)


def test_self_training_by_confidence(spark):
    train = spark.createDataFrame([(1, "kot pies kot", "a"), (2, "auto rower auto", "b")], "id long, text string, dialect string")
    pool = spark.createDataFrame([(10, "kot kot pies kot mysz", None), (11, "rower auto rower auto", None), (12, "kot auto", None), (13, "mysz mysz mysz mysz", None)], train.schema)
    got = sorted(tuple(r) for r in M.self_train(train, pool, "dialect").select("round", "dialect", "n").collect())
    assert got == [(0, "a", 1), (0, "b", 1), (1, "a", 1)]  # 13 is sure only once mysz is known; 12 never
    assert M.self_train(train, pool.limit(0), "dialect").count() == 0
    assert [r["n"] for r in M.self_train(train, pool, "dialect", rounds=1, cap=1).collect()] == [1]
