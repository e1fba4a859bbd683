"""The driver's tables as this library's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import arrays as A
from corpusloom.operators import bayes as B
from corpusloom.operators.corpus import written

LABELS = ("de", "en", "es", "fr")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark, sf_dir: str) -> DataFrame:
    """documents as sample rows: language stands for the dialect, source for the speaker."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("_ord"), "text", F.col("source").alias("speaker_id"), F.col("lang").alias("dialect"), "source", "n_chars")


FOLDS = 5
_made: dict = {}


def posteriors(spark, sf_dir: str, name: str, label=None, labels=LABELS, tokens=B.length_tokens) -> DataFrame:
    """(id, label, source, n_chars, fold, p): out-of-fold posterior of a label (the language if None), in order of labels, by naive Bayes over tokens. Made once for each session, table and name, and stored."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        label = F.col("lang") if label is None else label
        d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", label.alias("label"), "source", "n_chars", (F.col("doc_id") % FOLDS).cast("int").alias("fold"))
        found = B.out_of_fold(d.select("id", "fold", "label"), written(spark, tokens(d, "fold", "label")), list(labels)).select("id", B.posterior(F.col("scores"), F.lit(1)).alias("p"))
        _made[key] = written(spark, d.drop("text").join(found, "id").withColumn("p", F.transform("p", r6)))
    return _made[key]


def predictions(spark, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of the language over word lengths, a weak model that is often sure and wrong: id, y_true, source, n_chars, fold, p, conf, y_pred."""
    rows = posteriors(spark, sf_dir, "lengths").withColumnRenamed("label", "y_true")
    return rows.withColumns({"conf": F.array_max("p"), "y_pred": A.argmax_label(F.col("p"), list(LABELS))})


def family(c):
    return F.when(c.isin("de", "en"), "germanic").otherwise("romance")


FAMILIES = ("germanic", "romance")


def family_posteriors(spark, sf_dir: str) -> DataFrame:
    """As posteriors, of the language's family."""
    return posteriors(spark, sf_dir, "families", family(F.col("lang")), FAMILIES)


_LIST = "['de','en','es','fr']"


def _bayes_sql(s: str, label: str) -> str:
    """Tables d0, po (id, p) and what leads there, their names ending in s."""
    return f"""d0{s} AS (SELECT doc_id AS id, {label} AS lang, source, n_chars, doc_id % {FOLDS} AS g, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda x: least(length(x), 12)) AS w FROM documents),
tok{s} AS (SELECT id, g, lang, token, count(*) AS tf FROM (SELECT id, g, lang, unnest(w) AS token FROM d0{s}) GROUP BY ALL), own{s} AS (SELECT g, lang, token, sum(tf) AS c FROM tok{s} GROUP BY ALL), fs{s} AS (SELECT DISTINCT g FROM d0{s}),
fo{s} AS (SELECT f.g, o.lang, token, sum(c) AS c FROM fs{s} f JOIN own{s} o ON o.g <> f.g GROUP BY ALL), vo{s} AS (SELECT g, count(DISTINCT token) AS v FROM fo{s} GROUP BY g), tot{s} AS (SELECT g, lang, sum(c) AS total FROM fo{s} GROUP BY ALL),
dc{s} AS (SELECT f.g, d.lang, count(*) AS n FROM fs{s} f JOIN d0{s} d ON d.g <> f.g GROUP BY ALL), dn{s} AS (SELECT g, sum(n) AS n FROM dc{s} GROUP BY g),
cl{s} AS (SELECT g, lang, ln(a.n / b.n::DOUBLE) AS prior, total, v FROM dc{s} a JOIN dn{s} b USING (g) JOIN tot{s} USING (g, lang) JOIN vo{s} USING (g)), kn{s} AS (SELECT DISTINCT g, token FROM fo{s}), tk{s} AS (SELECT g, id, token, tf FROM tok{s} JOIN kn{s} USING (g, token)),
sm{s} AS (SELECT k.g, id, l.lang, sum(tf * ln((coalesce(f.c, 0) + 0.1::DOUBLE) / (total + 0.1::DOUBLE * v))) AS s FROM tk{s} k JOIN cl{s} l ON l.g = k.g LEFT JOIN fo{s} f ON f.g = k.g AND f.token = k.token AND f.lang = l.lang GROUP BY ALL),
px{s} AS (SELECT d.id, list(prior + coalesce(s, 0) ORDER BY l.lang) AS xs FROM d0{s} d JOIN cl{s} l ON l.g = d.g LEFT JOIN sm{s} m ON m.id = d.id AND m.lang = l.lang GROUP BY d.id),
pe{s} AS (SELECT id, list_transform(xs, lambda x: exp(x - list_max(xs))) AS es FROM px{s}), po{s} AS (SELECT id, list_transform(es, lambda e: round(e / list_sum(es), 6)) AS p FROM pe{s})"""


PRED = f"""WITH {_bayes_sql("", "lang")},
pp AS (SELECT id, lang AS y_true, source, n_chars, g AS fold, p, list_max(p) AS conf, ({_LIST})[list_position(p, list_max(p))] AS y_pred FROM po JOIN d0 USING (id)), pr AS (SELECT * EXCLUDE (p) FROM pp)"""
#: As PRED, and pf (id, c): the posterior of the family.
PRED_FAMILY = PRED.replace("WITH ", "WITH " + _bayes_sql("_f", "CASE WHEN lang IN ('de','en') THEN 'germanic' ELSE 'romance' END") + ", pf AS (SELECT id, p AS c FROM po_f), ", 1)


def rounded(c, digits: int):
    """As DuckDB's round does it: the product with the power of ten is rounded, half away from zero. Spark's own rounds the decimal that a double is shown as, and differs where that ends in a five."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 10.0**digits) / 10.0**digits


def r6(c):
    return rounded(c, 6)
