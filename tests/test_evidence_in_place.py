"""Evidence is found where a document lies."""

from corpusloom.operators import explain as P


def test_no_word_is_shuffled(spark):
    df = spark.createDataFrame([(1, "Hej baca psiwo nic", "a"), (1, "baca", "a"), (2, None, "b")], "id long, text string, dialect string")
    found = P.dialect_evidence(df)
    apart = P.dialect_evidence(df.dropDuplicates(["text"]).selectExpr("id + length(coalesce(text, '')) AS id", "text").localCheckpoint())
    plan = apart._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of the evidence, to rank it
    assert {(r["surface"], r["count"]) for r in found.collect() if r["kind"] != "isogloss_environment"} == {("baca", 2), ("hej", 1), ("psi", 1), ("psiwo", 1)}


def shuffled_by(df, keys):
    return f"hashpartitioning({keys}" in " ".join(df._jdf.queryExecution().executedPlan().toString().replace("#", " #").split())


def test_features_and_vocabulary_are_counted_in_place(spark):
    from corpusloom.functions import text as X

    df = spark.createDataFrame([(1, "Hej baca nic", "a"), (2, "baca", "b")], "id long, text string, dialect string")
    assert not shuffled_by(P.evidence(df, "dialect"), "id #")
    s = X.stylometry(df.withColumnRenamed("id", "doc_id"))
    assert ", x #" not in " ".join(s._jdf.queryExecution().executedPlan().toString().replace("#", " #").split())
    assert {r["type_token_ratio"] for r in s.collect()} == {1.0}
