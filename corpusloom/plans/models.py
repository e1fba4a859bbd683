"""Probability-array, conformal, fusion and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.operators import evaluation as E, hierarchy as H, models as M
from corpusloom.plans.registry import query
from corpusloom.plans.tables import FAMILIES, LABELS, PRED, PRED_FAMILY, family_posteriors, predictions, r6, rounded, samples, table

_L = "['de','en','es','fr']"
CLASSES = list(LABELS)
_ENT = "-list_sum(list_transform({0}, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END))"


@query(PRED + f" SELECT id, round({_ENT.format('p')}, 6) + 0 AS entropy FROM pp")
def entropy(spark, sf):
    return predictions(spark, sf).select("id", r6(A.entropy(F.col("p"))).alias("entropy"))


@query(PRED + " SELECT id, round(-list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) / ln(4.0::DOUBLE), 6) AS score FROM pp ORDER BY score DESC, id LIMIT 50")
def acquisition_ranking(spark, sf):
    return predictions(spark, sf).select("id", r6(A.normalised_entropy(F.col("p"))).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query(PRED + " SELECT id, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin, round(1 - list_max(p), 6) AS least_confidence FROM pp")
def margin_scores(spark, sf):
    return predictions(spark, sf).select("id", r6(A.margin(F.col("p"))).alias("margin"), r6(A.least_confidence(F.col("p"))).alias("least_confidence"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS x FROM embeddings) SELECT vec_id, round(list_max(x) / list_sum(x), 5) AS top, round(list_min(x) / list_sum(x), 5) AS low FROM e")
def softmax(spark, sf):
    s = A.softmax(F.transform("embedding", lambda v: v.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", s.alias("s")).select("vec_id", F.round(F.array_max("s"), 5).alias("top"), F.round(F.array_min("s"), 5).alias("low"))


@query(PRED + " SELECT id, list_transform(CASE WHEN list_sum(q) > 0 THEN list_transform(q, lambda v: v / list_sum(q)) ELSE list_transform(q, lambda v: 0.25::DOUBLE) END, lambda v: round(v, 6)) AS p FROM (SELECT id, list_transform(p, lambda v: CASE WHEN v > 0.3 THEN v ELSE 0.0::DOUBLE END) AS q FROM pp)")
def renormalize(spark, sf):
    q = F.transform("p", lambda v: F.when(v > 0.3, v).otherwise(0.0))
    return predictions(spark, sf).select("id", q.alias("q")).select("id", F.transform(A.renormalise(F.col("q")), r6).alias("p"))


_SCORE = PRED + f", s AS (SELECT id, y_true, p, 1 - p[list_position({_L}, y_true)] AS score FROM pp)"


def _scores(spark, sf):
    labels = F.array(*map(F.lit, CLASSES))
    return predictions(spark, sf).withColumn("score", 1 - F.element_at("p", F.array_position(labels, F.col("y_true")).cast("int")))


@query(_SCORE + ", k AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM s) SELECT round(coalesce(min(score) FILTER (r = ceil((n + 1) * 0.9::DOUBLE)), 1), 6) AS q FROM k")
def conformal_quantile(spark, sf):
    return E.conformal_quantile(_scores(spark, sf), 0.1).select(r6("q").alias("q"))


@query(_SCORE + ", k AS (SELECT y_true, score, row_number() OVER (PARTITION BY y_true ORDER BY score) AS r, count(*) OVER (PARTITION BY y_true) AS n FROM s) SELECT y_true, round(coalesce(min(score) FILTER (r = ceil((n + 1) * 0.9::DOUBLE)), 1), 6) AS q FROM k GROUP BY y_true")
def conformal_mondrian(spark, sf):
    return E.conformal_quantile(_scores(spark, sf), 0.1, "y_true", CLASSES).select("y_true", r6("q").alias("q"))


_SETS = PRED + f", z AS (SELECT id, y_true, list_filter(range(1, 5), lambda i: 1 - p[i] <= 0.7::DOUBLE) AS k, p FROM pp)"


@query(_SETS + f" SELECT id, CASE WHEN len(k) = 0 THEN 1 ELSE len(k) END::BIGINT AS size, CASE WHEN len(k) = 0 THEN {_L}[list_position(p, list_max(p))] = y_true ELSE list_contains(list_transform(k, lambda i: {_L}[i]), y_true) END AS covered FROM z")
def conformal_sets(spark, sf):
    s = A.conformal_set(F.col("p"), F.lit(0.7), CLASSES)
    return predictions(spark, sf).select("id", F.size(s).cast("long").alias("size"), F.array_contains(s, F.col("y_true")).alias("covered"))


@query(_SETS + " SELECT id, len(k) = 0 AS novel FROM z")
def openset_flags(spark, sf):
    return predictions(spark, sf).select("id", (F.size(A.conformal_set(F.col("p"), F.lit(0.7), CLASSES, False)) == 0).alias("novel"))


_HALF = PRED + f", s AS (SELECT id, y_true, p, 1 - p[list_position({_L}, y_true)] AS score FROM pp), q AS (SELECT coalesce(min(score) FILTER (r = ceil((n + 1) * 0.9::DOUBLE - 1e-9)), 1) AS q FROM (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM s WHERE id % 2 = 0))"


def _halves(spark, sf):
    """Scores of the calibrating half, and the other half."""
    s = _scores(spark, sf)
    return s.where("id % 2 = 0"), s.where("id % 2 = 1")


@query(_HALF + f", t AS (SELECT y_true, p, list_filter(range(1, 5), lambda i: 1 - p[i] <= q) AS k FROM s, q WHERE id % 2 = 1), u AS (SELECT CASE WHEN len(k) = 0 THEN 1 ELSE len(k) END AS size, CASE WHEN len(k) = 0 THEN {_L}[list_position(p, list_max(p))] = y_true ELSE list_contains(list_transform(k, lambda i: {_L}[i]), y_true) END AS hit FROM t) SELECT count(*) AS n, round(avg(hit::INT), 6) AS coverage, round(avg(size), 6) AS mean_set_size FROM u")
def conformal_coverage(spark, sf):
    """Coverage of the sets on rows that did not set the threshold."""
    fit, rest = _halves(spark, sf)
    q = E.conformal_quantile(fit, 0.1).first()["q"]
    report = E.conformal_coverage(rest.withColumn("members", A.conformal_set(F.col("p"), F.lit(q), CLASSES)), "members")
    return report.select("n", r6("coverage").alias("coverage"), r6("mean_set_size").alias("mean_set_size"))


_KNOWN = ["de", "en", "es"]


@query(_HALF.replace("WHERE id % 2 = 0", "WHERE id % 2 = 0 AND y_true <> 'fr'") + """, t AS (SELECT y_true <> 'fr' AS known, list_transform(list_filter(range(1, 4), lambda i: 1 - p[i] <= q), lambda i: ['de','en','es'][i]) AS k, y_true, round(1 - list_max(p[1:3]), 6) AS novelty FROM s, q WHERE id % 2 = 1),
a AS (SELECT (sum(r) FILTER (NOT known) - count_if(NOT known) * (count_if(NOT known) + 1) / 2.0::DOUBLE) / (count_if(NOT known) * count_if(known)) AS auc FROM (SELECT known, rank() OVER (ORDER BY novelty) + (count(*) OVER (PARTITION BY novelty) - 1) / 2.0::DOUBLE AS r FROM t))
SELECT count_if(known)::BIGINT AS n_known, count_if(NOT known)::BIGINT AS n_novel, round(count_if(known AND list_contains(k, y_true)) / count_if(known)::DOUBLE, 6) AS known_coverage, round(count_if(known AND len(k) = 0) / count_if(known)::DOUBLE, 6) AS false_novelty_rate,
round(count_if(NOT known AND len(k) = 0) / count_if(NOT known)::DOUBLE, 6) AS detection_rate, round(any_value(auc), 6) AS novelty_auc FROM t, a""")
def openset_report(spark, sf):
    """One label is held to be unknown: thresholds from the known rows of one half, report on the other."""
    fit, rest = _halves(spark, sf)
    q = E.conformal_quantile(fit.where("y_true != 'fr'"), 0.1).first()["q"]
    p = F.slice("p", 1, 3)
    scored = rest.withColumns({"members": A.conformal_set(p, F.lit(q), _KNOWN, False), "novelty": r6(1 - F.array_max(p))})
    report = E.openset_report(scored, "members", "novelty", _KNOWN)
    return report.select("n_known", "n_novel", *[r6(c).alias(c) for c in ("known_coverage", "false_novelty_rate", "detection_rate", "novelty_auc")])


def _members(p):
    return F.array(p, F.reverse(p), F.transform(p, lambda v: F.lit(0.25) + 0 * v))


@query(PRED + f""", m AS (SELECT id, [p, list_reverse(p), [0.25, 0.25, 0.25, 0.25]::DOUBLE[]] AS m FROM pp), a AS (SELECT id, m, list_transform(range(1, 5), lambda i: (m[1][i] + m[2][i] + m[3][i]) / 3) AS c FROM m)
SELECT id, round({_ENT.format('c')}, 6) AS total, round(({_ENT.format('m[1]')} + {_ENT.format('m[2]')} + {_ENT.format('m[3]')}) / 3, 6) AS aleatoric, round(greatest({_ENT.format('c')} - ({_ENT.format('m[1]')} + {_ENT.format('m[2]')} + {_ENT.format('m[3]')}) / 3, 0), 6) AS epistemic FROM a""")
def uncertainty_decomposition(spark, sf):
    u = A.uncertainty(F.col("m"))
    return predictions(spark, sf).select("id", _members(F.col("p")).alias("m")).select("id", *[r6(c).alias(k) for k, c in u.items()])


def _fused(kind, expr):
    sql = PRED + f", m AS (SELECT id, p AS a, CASE WHEN id % 4 = 0 THEN NULL ELSE list_reverse(p) END AS b FROM pp), f AS (SELECT id, a, b, list_transform(range(1, 5), lambda i: {expr}) AS x FROM m) SELECT id, list_transform(CASE WHEN b IS NULL THEN a ELSE list_transform(x, lambda v: v / list_sum(x)) END, lambda v: round(v, 9)) AS p FROM f"

    def run(spark, sf):
        b = F.when(F.col("id") % 4 != 0, F.reverse("p"))
        return predictions(spark, sf).select("id", F.col("p").alias("a"), b.alias("b")).select("id", F.transform(A.fuse([F.col("a"), F.col("b")], kind, [0.6, 0.4] if kind in ("weighted", "logpool") else None), lambda v: F.round(v, 9)).alias("p"))

    run.__name__ = f"fusion_{kind}"
    query(sql)(run)


_fused("weighted", "0.6::DOUBLE * a[i] + 0.4::DOUBLE * b[i]")
_fused("maximum", "greatest(a[i], b[i])")
_fused("confidence", "list_max(a) * a[i] + list_max(b) * b[i]")
_fused("logpool", "exp(0.6::DOUBLE * ln(greatest(a[i], 1e-12)) + 0.4::DOUBLE * ln(greatest(b[i], 1e-12)))")


_TREE = PRED_FAMILY + """, h AS (SELECT id, p, c, list_max(c) AS cp, CASE WHEN c[1] >= c[2] THEN 'germanic' ELSE 'romance' END AS fam FROM pp JOIN pf USING (id)),
k AS (SELECT *, list_transform(range(1, 5), lambda i: CASE WHEN (i <= 2) = (fam = 'germanic') THEN p[i] ELSE 0 END) AS q FROM h), j AS (SELECT *, CASE WHEN list_sum(q) > 0 THEN list_transform(q, lambda v: cp * v / list_sum(q)) END AS joint FROM k)"""
_PARENTS = {"de": "germanic", "en": "germanic", "es": "romance", "fr": "romance"}


def _two_levels(spark, sf):
    """Posteriors of languages and of families, each from a model of its own."""
    return predictions(spark, sf).select("id", F.col("p").alias("fine_p")).join(family_posteriors(spark, sf).select("id", F.col("p").alias("coarse_p")), "id")


@query(_TREE + " SELECT id, fam AS family, list_transform(joint, lambda v: round(v, 8)) AS p FROM j")
def hierarchy_projection(spark, sf):
    """Languages within the likelier family, scaled to its probability."""
    d = _two_levels(spark, sf).withColumns({"family": A.argmax_label(F.col("coarse_p"), list(FAMILIES)), "top": F.array_max("coarse_p")})
    p = H.projected(F.col("fine_p"), CLASSES, F.col("family"), F.col("top"), _PARENTS)
    return d.select("id", "family", F.transform(p, lambda v: rounded(v, 8)).alias("p"))


@query(_TREE + f""", s AS (SELECT *, list_reverse_sort(joint) AS t FROM j)
SELECT id, CASE WHEN joint IS NOT NULL AND t[1] >= 0.6 AND (t[1] - t[2] >= 0.9 OR t[1] >= 0.97) THEN {_L}[list_position(joint, list_max(joint))] ELSE fam END AS label, CASE WHEN joint IS NOT NULL AND t[1] >= 0.6 AND (t[1] - t[2] >= 0.9 OR t[1] >= 0.97) THEN 'fine' ELSE 'coarse' END AS level FROM s""")
def hierarchy_backoff(spark, sf):
    """A policy of three predicates, read from its text form."""
    policy = H.Policy.from_json('{"kind": "all_of", "children": [{"kind": "confidence_threshold", "value": 0.6}, {"kind": "any_of", "children": [{"kind": "margin_threshold", "value": 0.9}, {"kind": "confidence_threshold", "value": 0.97}]}]}')
    return H.decide(_two_levels(spark, sf), CLASSES, list(FAMILIES), _PARENTS, policy).select("id", "label", "level")


@query(PRED + f" SELECT id, {_L}[list_position(x, list_max(x))] AS label FROM (SELECT id, list_transform(range(1, 5), lambda i: round((2 * p[i] + p[5 - i]) / 3, 9)) AS x FROM pp)")
def voting_soft(spark, sf):
    x = F.zip_with("p", F.reverse("p"), lambda a, b: F.round((2 * a + b) / 3, 9))
    return predictions(spark, sf).select("id", x.alias("x")).select("id", A.argmax_label(F.col("x"), CLASSES).alias("label"))


@query("SELECT lang AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS prior FROM documents GROUP BY lang")
def majority_prior(spark, sf):
    return M.majority_prior(samples(spark, sf), "dialect").select(F.col("dialect").alias("label"), "n", r6("prior").alias("prior"))


@query("SELECT lang AS label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM documents GROUP BY lang")
def class_weights(spark, sf):
    return M.class_weights(samples(spark, sf), "dialect").select(F.col("dialect").alias("label"), r6("weight").alias("weight"))


@query(r"""WITH d AS (SELECT doc_id AS id, lang, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+') AS w FROM documents), tr AS (SELECT * FROM d WHERE id % 5 <> 0), te AS (SELECT * FROM d WHERE id % 5 = 0),
c AS (SELECT lang, token, count(*) AS c FROM (SELECT lang, unnest(w) AS token FROM tr) GROUP BY ALL), v AS (SELECT count(DISTINCT token) AS v FROM c),
k AS (SELECT lang, count(*) AS docs FROM tr GROUP BY lang), tot AS (SELECT lang, sum(c) AS total FROM c GROUP BY lang),
cl AS (SELECT lang, ln(docs / (SELECT count(*) FROM tr)::DOUBLE) AS prior, total, v FROM k JOIN tot USING (lang), v),
tk AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(w) AS token FROM te) WHERE token IN (SELECT token FROM c) GROUP BY ALL),
s AS (SELECT id, cl.lang, sum(tf * ln((coalesce(c.c, 0) + 0.1::DOUBLE) / (total + 0.1::DOUBLE * v))) AS s FROM tk CROSS JOIN cl LEFT JOIN c ON c.token = tk.token AND c.lang = cl.lang GROUP BY ALL)
SELECT id, arg_min(lang, (-round(x, 6), lang)) AS y_pred FROM (SELECT te.id, cl.lang, prior + coalesce(s, 0) AS x FROM te CROSS JOIN cl LEFT JOIN s ON s.id = te.id AND s.lang = cl.lang) GROUP BY id""")
def naive_bayes_sql(spark, sf):
    d = samples(spark, sf).select("id", "text", "dialect")
    return M.naive_bayes(d.where("id % 5 != 0"), d.where("id % 5 = 0").select("id", "text"), "dialect")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT query, vec_id, similarity FROM (SELECT a.vec_id AS query, b.vec_id, round({_COS}, 5) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 5) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE r <= 5")
def nearest_examples(spark, sf):
    """The stated queries (ids divisible by 20), in blocks of 512, against all rows: each block is a matrix of a fixed size, and a task sends its five best for each query."""
    import numpy as np
    import pyarrow as pa

    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    queries, out = e.where("vec_id % 20 = 0"), None
    spark_context = spark.sparkContext

    def best(sent):
        def run(batches):
            ids, q = sent.value
            for b in batches:
                x = np.stack(b.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                own = b.column("vec_id").to_numpy()
                s = np.round(x @ q.T, 5)
                for j, i in enumerate(ids.tolist()):
                    order = np.lexsort((own, -s[:, j]))
                    order = order[own[order] != i][:5]
                    yield pa.RecordBatch.from_pydict({"query": pa.array(np.full(len(order), i)), "vec_id": pa.array(own[order]), "similarity": pa.array(s[order, j])})

        return run

    block: list = []

    def search(block):
        q = np.array([r["embedding"] for r in block], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)
        return e.mapInArrow(best(spark_context.broadcast((np.array([r["vec_id"] for r in block]), q))), "query long, vec_id long, similarity double")

    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == 512:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block or out is None:
        found = search(block) if block else e.select(F.col("vec_id").alias("query"), "vec_id", F.lit(0.0).alias("similarity")).limit(0)
        out = found if out is None else out.unionByName(found)
    from pyspark.sql import Window

    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("r", F.row_number().over(order)).where("r <= 5").drop("r")


def _fit(kind):
    def run(spark, sf):
        d = samples(spark, sf).select("id", "text", "dialect")
        p = M.fit_predict(kind, d.where("id % 5 != 0"), d.where("id % 5 = 0"), "dialect")
        return E.averaged(E.class_metrics(p)).select(r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))

    run.__name__ = f"{kind}_fit"
    query()(run)


for _k in ("logistic_regression", "linear_svm", "random_forest"):
    _fit(_k)


@query()
def self_training(spark, sf):
    d = samples(spark, sf).select("id", "text", "dialect")
    return M.self_train(d.where("id % 10 = 0"), d.where("id % 10 != 0"), "dialect")
