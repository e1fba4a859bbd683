"""Contrast and evidence on literal rows with known markers; p-values; streams of a folder of files."""

import math

import pytest

from corpusloom.operators import explain as P
from corpusloom.plans import registry


@pytest.fixture
def rows(spark):
    data = [(i, "Baca siedzi w holny wieczór", "podhale") for i in range(6)] + [(i, "Jo godać umiem", "silesia") for i in range(6, 12)] + [(12, None, "silesia"), (13, "", "podhale"), (14, "Baca", None), (15, "psiwo psiwo", "podhale")]
    return spark.createDataFrame(data, "id int, text string, dialect string")


def test_contrast(rows):
    got = {(r["category"], r["feature"]): r for r in P.with_p_values(P.contrast(rows, "dialect", "podhale", "silesia")).collect()}
    baca = got["lexical", "baca"]
    assert (baca["n_a"], baca["n_b"], baca["favoured"]) == (6, 0, "podhale")  # the blank, the null and the unlabelled row count nowhere
    assert baca["rate_a"] == pytest.approx(6 / 7)
    assert baca["log_odds"] == pytest.approx(math.log(6.5 * 6.5 / (1.5 * 0.5)))
    z = (6 / 7) / math.sqrt(6 / 13 * 7 / 13 * (1 / 7 + 1 / 6))
    assert baca["p"] == pytest.approx(math.erfc(z / math.sqrt(2))) and baca["p"] <= baca["adjusted"]
    assert got["lexical", "godać"]["favoured"] == "silesia" and ("phonological", "soft_labials") not in got
    with pytest.raises(ValueError):
        P.contrast(rows, "dialect", "podhale", "podhale")


def test_evidence(rows):
    got = {(r["category"], r["feature"]): r for r in P.evidence(rows, "dialect").collect()}
    baca = got["lexical", "baca"]
    assert (baca["carriers"], baca["occurrences"], baca["top_class"], baca["share"], baca["low_support"]) == (6, 6, "podhale", 1.0, False)
    assert baca["lift"] == pytest.approx(14 / 8)
    fired = got["phonological", "soft_labials"]
    assert (fired["carriers"], fired["occurrences"], fired["low_support"]) == (1, 2, True)


def test_no_rows(rows):
    assert P.evidence(rows.limit(0), "dialect").count() == 0 and P.contrast(rows.limit(0), "dialect", "a", "b").count() == 0


def test_streams_read_a_folder_of_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("streaming_dedup", "streaming_tallies"):
        assert registry.queries()[name](spark, str(tmp_path)).count() == registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_dialect_evidence(spark):
    """Markers, fired rules and standing environments with their weights; words left alone fire nothing."""
    texts = ["Baca godo psiwo, baca! dach", "szyba czas żaba", "psi wziąć", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in P.dialect_evidence(df).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["kind"], r["label"], r["surface"], r["count"], r["weight"]))
    first = sorted(got[0])
    assert first[0][1:] == ("marker", "podhale", "baca", 2, 3.0) and first[1][1:] == ("isogloss_fired", "soft_labials", "psi", 1, 2.0)
    assert {x[1:] for x in first[2:]} >= {("marker", "silesia", "godo", 1, 1.5), ("marker", "kurpie", "psiwo", 1, 1.5)}
    assert {x[1:] for x in got[1]} == {("isogloss_environment", "mazurzenie", "", 3, -1.5)}
    assert not [x for x in got.get(2, []) if x[2] == "soft_labials"] and 3 not in got and 4 not in got
    assert [r["surface"] for r in P.dialect_evidence(df, k=1).where("id = 0").collect()] == ["baca"]
    assert {(r["family"], r["count"]) for r in P.family_evidence(df).where("id = 0").collect()} == {("lesser_polish", 2), ("silesian", 1), ("masovian", 2)}
