"""A data set from corpora to splits in one go: joined, cleaned, filtered, deduplicated, split by groups, with its manifest and digest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import text as X
from corpusloom.operators import corpus as C, digests as D, minhash as MH
from corpusloom.operators.corpus import written


@dataclass(frozen=True)
class Plan:
    """What is done, in this order. near: Jaccard similarity from which a later text goes, None for exact copies only."""

    clean: bool = True
    lowercase: bool = False
    min_chars: int = 20
    exact: bool = True
    near: float | None = 0.85
    label: str = "dialect"
    group: str = "speaker_id"
    fractions: tuple = (("train", 0.7), ("validation", 0.15), ("test", 0.15))
    seed: int = 42


STEPS = ("loaded", "labelled", "long_enough", "exact_kept", "near_kept")


def cleaned(rows: DataFrame, lowercase: bool = False) -> DataFrame:
    """rows with clean NFC texts, each cleaned once: a filter is not moved past a generator, as it is past a column that it would then work out again."""
    return rows.withColumn("text", F.explode(F.array(X.clean(X.nfc(F.col("text")), lowercase=lowercase))))


def build(corpora: list[DataFrame], plan: Plan = Plan()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with split, manifest, digests) of corpora with the columns id, text, speaker_id, source and the label.

    Earlier corpora win over later ones, and smaller ids over larger ones, where copies meet. Texts are NFC and cleaned before they are
    measured and compared; rows without text (audio) pass filters and dedup. Rows without a label are left out. Texts are
    stored once cleaned; of later steps only what goes is.
    manifest: (step, split, label, n) of rows after each step, and of each split by label.
    """
    if not corpora:
        raise ValueError("no corpora")
    spark = corpora[0].sparkSession
    fields = ["id", "text", plan.group, plan.label, *(["source"] if plan.group != "source" else [])]
    rows = None
    for k, corpus in enumerate(corpora):
        one = corpus.select(*fields).withColumn("_corpus", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    counts = [("loaded", rows.count())]
    label = F.nullif(F.trim(F.col(plan.label)), F.lit(""))
    rows = rows.where(label.isNotNull())
    counts.append(("labelled", rows.count()))
    if plan.clean:
        rows = cleaned(rows, plan.lowercase)
    rows = written(spark, C.min_length(rows, plan.min_chars).withColumn("_ord", F.struct("_corpus", "id")))
    counts.append(("long_enough", rows.count()))
    if plan.exact:
        rows = C.without(rows, written(spark, C.later_copies(rows, X.fingerprint(F.col("text")))), "_ord")
    counts.append(("exact_kept", rows.count()))
    if plan.near is not None:
        keyed = rows.withColumn("_name", F.col("id")).withColumn("id", F.col("_ord"))
        rows = MH.deduplicate(keyed, plan.near).withColumn("id", F.col("_name")).drop("_name")
    counts.append(("near_kept", rows.count()))
    out = written(spark, C.group_split(rows, plan.group, plan.label, plan.fractions, plan.seed).select(*fields, "split"))
    steps = spark.createDataFrame([(s, None, None, n) for s, n in counts], "step string, split string, label string, n long")
    each = out.groupBy("split", F.col(plan.label).alias("label")).agg(F.count("*").alias("n")).select(F.lit("split").alias("step"), "split", "label", "n")
    return out, steps.unionByName(each), D.corpus_digest(out, fields, "split")
