"""The classifier from fit to folder, and the data set from corpora to splits."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import builder, classifier, corpus as C

OWN = {"a": "ala makota", "b": "bela bakota", "c": "ca cota"}


def rows_of(n, seed, start=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = rng.choice("abc")
        out.append((start + i, " ".join(rng.choice([*OWN[y].split(), "kota", "la"]) for _ in range(rng.randint(2, 6))), y))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, text string, label string")
    return make(rows_of(150, 1) + [(999, "no label", None)]), make(rows_of(120, 2, 1000)), make(rows_of(120, 3, 2000) + [(2999, "ala", "unknown")])


@pytest.mark.parametrize("kind", ["naive_bayes", "logistic_regression"])
def test_from_fit_to_folder(spark, frames, kind, tmp_path):
    train, held, test = frames
    model = classifier.Classifier(kind, abstain_below=0.6).fit(train)
    assert model.labels == ["a", "b", "c"]
    plain = {r["id"]: r["p"] for r in model.probabilities(test).collect()}
    assert len(plain) == 121 and all(abs(sum(p) - 1) < 1e-9 for p in plain.values())
    before = model.evaluate(test).first()
    assert before["accuracy"] > 0.8
    for how in ("temperature", "isotonic", "identity"):
        model.calibrate(held, how)
        after = model.evaluate(test).first()
        assert after["log_loss"] < before["log_loss"] + 0.35 and after["accuracy"] > 0.75
        if how != "identity":
            model.conform(held, 0.1, by_class=how == "isotonic")
            model.save(str(tmp_path / how), spark)
            other = classifier.Classifier.load(str(tmp_path / how), spark)
            same = lambda m: sorted((r["id"], r["label"], round(r["confidence"], 9), r["abstained"]) for r in m.predict(test).collect())
            assert same(other) == same(model) and (other.thresholds, other.alpha) == (model.thresholds, model.alpha)
            sets = {r["id"]: r["members"] for r in other.predict_sets(test).collect()}
            truth = {r["id"]: r["label"] for r in test.collect()}
            assert sum(truth[i] in m for i, m in sets.items() if truth[i] != "unknown") > 0.8 * 120 and all(sets.values())
    assert {i: p for i, p in plain.items()} == {r["id"]: r["p"] for r in model.probabilities(test).collect()}
    assert all((r["label"] is None) == (r["confidence"] < 0.6) == r["abstained"] for r in model.predict(test).collect())


def test_what_a_classifier_refuses(frames):
    train, held, test = frames
    model = classifier.Classifier()
    for bad in (lambda: classifier.Classifier("oracle"), lambda: classifier.Classifier(abstain_below=2), lambda: model.predict(test), lambda: model.fit(train.where("label = 'a'"))):
        with pytest.raises(ValueError):
            bad()
    model.fit(train)
    for bad in (lambda: model.calibrate(held, "luck"), lambda: model.conform(held, 1.0), lambda: model.predict_sets(test), lambda: model.calibrate(held.where("id < 0")), lambda: model.evaluate(test.where("label = 'unknown'"))):
        with pytest.raises(ValueError):
            bad()


def test_build(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    texts = [text() for _ in range(60)]
    one = [(i, t, f"s{i % 12}", "s", "xy"[i % 2]) for i, t in enumerate(texts)]
    two = [(100, texts[3].upper(), "s1", "t", "x"), (101, texts[4] + " z", "s2", "t", "y"), (102, "short", "s3", "t", "x"), (103, text(), "s4", "t", None), (104, text(), "s5", "t", ""), (105, None, "s6", "t", "x"), (106, "[note] " + texts[5], "s7", "t", "y")]
    schema = "id long, text string, speaker_id string, source string, dialect string"
    frames = [spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)]
    rows, manifest, digests = builder.build(frames)
    got = rows.collect()
    assert {r["id"] for r in got} == {*range(60), 105}
    steps = {r["step"]: r["n"] for r in manifest.where("split IS NULL").collect()}
    assert steps == {"loaded": 67, "labelled": 65, "long_enough": 64, "exact_kept": 62, "near_kept": 61}
    assert {r["split"] for r in got} == {"train", "validation", "test"} and manifest.where("split IS NOT NULL").agg(F.sum("n")).first()[0] == 61
    assert all(len({r["split"] for r in got if r["speaker_id"] == s}) == 1 for s in {r["speaker_id"] for r in got})
    again = builder.build([f.repartition(3) for f in frames])[2]
    assert {tuple(r) for r in digests.collect()} == {tuple(r) for r in again.collect()}
    with pytest.raises(ValueError):
        builder.build([])


def test_texts_are_cleaned_once(spark):
    df = spark.createDataFrame([(1, "a [note] text of some length"), (2, None), (3, "short")], "id long, text string")
    long_enough = C.min_length(builder.cleaned(df), 20)
    assert long_enough._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert {(r["id"], r["text"]) for r in long_enough.collect()} == {(1, "a text of some length"), (2, None)}


def test_copies_go_without_sending_texts(spark):
    rows = [(i, t) for i, t in enumerate(["a", "A", "b", None, None, " ", " ", "b", "\t", "\n"])] + [(None, "x")]
    df = spark.createDataFrame(rows, "_ord long, text string").repartition(3)
    gone = C.written(spark, C.later_copies(df, F.lower(F.trim("text"))))
    assert sorted(r["_ord"] for r in gone.collect()) == [1, 7]
    assert sorted(C.without(df, gone, "_ord").collect(), key=str) == sorted(df.join(gone, "_ord", "left_anti").collect(), key=str)
