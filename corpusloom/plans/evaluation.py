"""Evaluation queries over the out-of-fold predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import calibrators as K, evaluation as E
from corpusloom.plans.registry import query
from corpusloom.plans.tables import LABELS, PRED, predictions, r6

_EDGES = [i / 15 for i in range(16)]
_CLASS = PRED + """, e AS (SELECT y_true AS label, 1 AS t, 0 AS p, (y_true = y_pred)::INT AS hit FROM pr UNION ALL SELECT y_pred, 0, 1, 0 FROM pr),
c AS (SELECT label, sum(hit) AS tp, sum(p) AS predicted, sum(t) AS support FROM e GROUP BY label),
m AS (SELECT label, support, tp, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall, 2.0::DOUBLE * tp / (predicted + support) AS f1 FROM c)"""


@query(PRED + " SELECT y_true, y_pred, count(*) AS n FROM pr GROUP BY ALL")
def confusion(spark, sf):
    return E.confusion(predictions(spark, sf))


@query(PRED + ", c AS (SELECT y_true, y_pred, count(*) AS n FROM pr GROUP BY ALL) SELECT y_true, y_pred, n, round(n / sum(n) OVER (PARTITION BY y_true)::DOUBLE, 6) AS share FROM c")
def confusion_normalized(spark, sf):
    return E.confusion_normalised(predictions(spark, sf)).withColumn("share", r6("share"))


@query(_CLASS + " SELECT label, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def class_metrics(spark, sf):
    return E.class_metrics(predictions(spark, sf)).select("label", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(_CLASS + """ SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision * support) / sum(support), 6) AS weighted_precision,
round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM m""")
def macro_weighted_metrics(spark, sf):
    return E.averaged(E.class_metrics(predictions(spark, sf))).select(*[r6(f"{a}_{c}").alias(f"{a}_{c}") for a in ("macro", "weighted") for c in ("precision", "recall", "f1")])


@query(_CLASS + " SELECT round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy FROM m")
def balanced_accuracy(spark, sf):
    return E.averaged(E.class_metrics(predictions(spark, sf))).select(r6("balanced_accuracy").alias("balanced_accuracy"), r6("accuracy").alias("accuracy"))


_RANK = "(sum(r) FILTER (pos) - count_if(pos) * (count_if(pos) + 1) / 2.0::DOUBLE) / (count_if(pos) * count_if(NOT pos))"


@query(PRED + f", s AS (SELECT y_true = y_pred AS pos, rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2.0::DOUBLE AS r FROM pr) SELECT round({_RANK}, 6) AS auc FROM s")
def roc_auc_binary(spark, sf):
    return E.auc(predictions(spark, sf), "conf", F.col("y_true") == F.col("y_pred")).select(r6("auc").alias("auc"))


@query(PRED + f""", x AS (SELECT y_true, unnest(['de','en','es','fr']) AS label, unnest(p) AS score FROM pp), s AS (SELECT label, y_true = label AS pos, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0::DOUBLE AS r FROM x),
a AS (SELECT label, {_RANK} AS auc FROM s GROUP BY label) SELECT round(avg(auc), 6) AS auc FROM a""")
def roc_auc_macro_ovr(spark, sf):
    p = predictions(spark, sf)
    each = p.select("y_true", F.explode(F.arrays_zip(F.array(*map(F.lit, ("de", "en", "es", "fr"))).alias("label"), F.col("p").alias("score"))).alias("x")).select("y_true", "x.*")
    return E.auc(each, "score", F.col("y_true") == F.col("label"), "label").agg(r6(F.avg("auc")).alias("auc"))


_INNER = "[" + ", ".join(f"{e!r}::DOUBLE" for e in _EDGES[1:-1]) + "]"
_BINS = PRED + f", b AS (SELECT len(list_filter({_INNER}, lambda e: conf > e))::INT AS bin, count(*) AS n, avg(conf) AS confidence, avg((y_true = y_pred)::INT) AS accuracy FROM pr GROUP BY 1)"


@query(_BINS + " SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def calibration_uniform(spark, sf):
    return E.calibration(predictions(spark, sf), _EDGES).select("bin", "n", r6("confidence").alias("confidence"), r6("accuracy").alias("accuracy"))


@query(_BINS + " SELECT round(sum(abs(accuracy - confidence) * n) / sum(n), 6) AS ece, round(max(abs(accuracy - confidence)), 6) AS mce FROM b")
def calibration_errors(spark, sf):
    return E.calibration_errors(E.calibration(predictions(spark, sf), _EDGES)).select(r6("ece").alias("ece"), r6("mce").alias("mce"))


#: Edges as the interpolated quantiles of confidence.
_QUANTILES = PRED + """, sh AS (SELECT unnest(range(1, 10)) / 10.0::DOUBLE AS q), ra AS (SELECT conf, row_number() OVER (ORDER BY conf) - 1 AS k, count(*) OVER () AS n FROM pr),
ps AS (SELECT q, (any_value(n) - 1) * q AS x FROM sh, ra GROUP BY q), ed AS (SELECT list(DISTINCT a.conf + (coalesce(b.conf, a.conf) - a.conf) * (x - floor(x))) AS e FROM ps JOIN ra a ON a.k = floor(x)::BIGINT LEFT JOIN ra b ON b.k = floor(x)::BIGINT + 1)
SELECT len(list_filter(e, lambda v: v < 1 AND conf > v))::INT AS bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg((y_true = y_pred)::INT), 6) AS accuracy FROM pr, ed GROUP BY 1"""


@query(_QUANTILES)
def calibration_quantile(spark, sf):
    """Ten bins of equal counts; ties make fewer."""
    p = predictions(spark, sf)
    return E.calibration(p, E.quantile_edges(p, 10)).select("bin", "n", r6("confidence").alias("confidence"), r6("accuracy").alias("accuracy"))


_TRUTH = "list_position(['de','en','es','fr'], y_true)"
_LOSS = PRED + f""", lg AS (SELECT list_transform(p, lambda x: ln(least(greatest(x, 1e-12), 1))) AS l, {_TRUTH} AS t FROM pp WHERE {_TRUTH} IS NOT NULL), gr AS (SELECT exp(ln(0.01) + (ln(100) - ln(0.01)) * unnest(range(0, 4001)) / 4000.0::DOUBLE) AS temp UNION ALL SELECT 1.0::DOUBLE),
ls AS (SELECT temp, avg(least(ln(list_sum(list_transform(l, lambda x: exp((x - list_max(l)) / temp)))) - (l[t] - list_max(l)) / temp, -ln(1e-12))) AS loss FROM lg, gr GROUP BY temp)
SELECT round(any_value(loss) FILTER (temp = 1.0), 4) AS loss_before, round(min(loss), 4) AS loss_after FROM ls"""


@query(_LOSS)
def calibration_temperature(spark, sf):
    """Mean log loss as it is and at the best temperature; the SQL tries 4,001 temperatures."""
    p = predictions(spark, sf).withColumn("t", F.array_position(F.array(*map(F.lit, LABELS)), F.col("y_true")))
    best = K.fit_temperature(p, "p", F.col("t"))
    return p.where("t > 0").agg(*[F.round(F.avg(K.log_loss(F.col("p"), F.col("t"), t)), 4).alias(n) for n, t in (("loss_before", 1.0), ("loss_after", best))])


#: The max-min form of the isotonic fit, over all pairs of distinct probabilities of a label.
_ISOTONIC = PRED + """, ex AS (SELECT id, i, p[i] AS x, (y_true = (['de','en','es','fr'])[i])::INT AS y FROM pp, unnest(range(1, 5)) u(i)), pt AS (SELECT i, x, count(*) AS n, sum(y) AS s FROM ex GROUP BY i, x),
cu AS (SELECT i, x, row_number() OVER w AS k, sum(n) OVER w AS cn, sum(s) OVER w AS cs, n, s FROM pt WINDOW w AS (PARTITION BY i ORDER BY x)),
me AS (SELECT a.i, a.k AS j, b.k, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)::DOUBLE AS m FROM cu a JOIN cu b ON a.i = b.i AND b.k >= a.k),
lo AS (SELECT i, j, k, min(m) OVER (PARTITION BY i, j ORDER BY k DESC) AS m FROM me), fi AS (SELECT i, k, max(m) AS v FROM lo GROUP BY i, k), va AS (SELECT i, x, v FROM cu JOIN fi USING (i, k)),
rw AS (SELECT id, list(v ORDER BY i) AS v FROM ex JOIN va USING (i, x) GROUP BY id)
SELECT id, list_transform(v, lambda x: round(CASE WHEN list_sum(v) > 0 THEN x / list_sum(v) ELSE 0.25 END, 6)) AS p FROM rw"""


@query(_ISOTONIC)
def calibration_isotonic(spark, sf):
    """Probabilities after isotonic regression on the same rows."""
    p = predictions(spark, sf)
    out = K.apply_isotonic(p, "id", "p", K.fit_isotonic(p, "p", F.col("y_true"), list(LABELS)), list(LABELS))
    return out.select("id", F.transform("p", r6).alias("p"))


@query(PRED + " SELECT round(avg(list_sum(list_transform(list_zip(p, ['de','en','es','fr']), lambda z: pow(z[1] - (z[2] = y_true)::INT, 2)))), 6) AS brier FROM pp")
def brier(spark, sf):
    from corpusloom.functions import arrays as A

    return predictions(spark, sf).agg(r6(F.avg(A.brier(F.col("p"), F.col("y_true"), ["de", "en", "es", "fr"]))).alias("brier"))


_RISK = PRED + ", k AS (SELECT id, row_number() OVER (ORDER BY conf DESC, id) AS k, sum((y_true <> y_pred)::INT) OVER (ORDER BY conf DESC, id) AS bad, count(*) OVER () AS n FROM pr)"


@query(_RISK + " SELECT id, k, round(k / n::DOUBLE, 6) AS coverage, round(bad / k::DOUBLE, 6) AS risk FROM k")
def risk_coverage(spark, sf):
    return E.risk_coverage(predictions(spark, sf)).select("id", F.col("k").cast("long").alias("k"), r6("coverage").alias("coverage"), r6("risk").alias("risk"))


@query(_RISK + " SELECT round(avg(bad / k::DOUBLE), 6) AS aurc, round(max(CASE WHEN bad / k::DOUBLE <= 0.2 + 1e-12 THEN k / n::DOUBLE END), 6) AS coverage_at_20 FROM k")
def selective_targets(spark, sf):
    return E.risk_coverage(predictions(spark, sf)).agg(r6(F.avg("risk")).alias("aurc"), r6(F.max(F.when(F.col("risk") <= 0.2 + 1e-12, F.col("coverage")))).alias("coverage_at_20"))


@query(_RISK + """, c AS (SELECT k / n::DOUBLE AS coverage, bad / k::DOUBLE AS risk FROM k), t AS (SELECT unnest([0.5, 0.8, 0.9, 1.0]::DOUBLE[]) AS t), e AS (SELECT unnest([0.01, 0.05, 0.1, 0.2]::DOUBLE[]) AS e)
SELECT 'aurc' AS kind, NULL::DOUBLE AS target, NULL::DOUBLE AS coverage, round(avg(risk), 6) AS risk FROM c UNION ALL SELECT 'coverage', t, round(min(coverage), 6), round(arg_min(risk, coverage), 6) FROM t JOIN c ON coverage >= t - 1e-12 GROUP BY t
UNION ALL SELECT 'error', e, round(coalesce(max(coverage), 0), 6), round(arg_max(risk, coverage), 6) FROM e LEFT JOIN c ON risk <= e + 1e-12 GROUP BY e""")
def selective_report(spark, sf):
    r = E.selective_report(E.risk_coverage(predictions(spark, sf)))
    return r.withColumns({"coverage": r6("coverage"), "risk": r6("risk")})


_PARENT = "CASE WHEN {} IN ('de','en') THEN 'germanic' ELSE 'romance' END"


def _family(c):
    return F.when(c.isin("de", "en"), "germanic").otherwise("romance")


@query(PRED + f""", f AS (SELECT y_true = y_pred AS e, {_PARENT.format('y_true')} = {_PARENT.format('y_pred')} AS f FROM pr) SELECT round(avg(e::INT), 6) AS exact, round(avg(f::INT), 6) AS family,
round(avg(CASE WHEN e THEN 1.0::DOUBLE WHEN f THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS partial, round(2.0::DOUBLE * sum(CASE WHEN e THEN 2 WHEN f THEN 1 ELSE 0 END) / (4 * count(*)), 6) AS ancestor_f1 FROM f""")
def hierarchical_metrics(spark, sf):
    h = E.hierarchical(predictions(spark, sf), _family)
    return h.select(*[r6(c).alias(c) for c in h.columns])


_SLICE = PRED + """, s AS (SELECT 'source' AS dimension, source AS value, y_true, y_pred FROM pr UNION ALL SELECT 'length', CASE WHEN n_chars <= 40 THEN '<=40' WHEN n_chars <= 80 THEN '41-80' WHEN n_chars <= 160 THEN '81-160' ELSE '>160' END, y_true, y_pred FROM pr),
e AS (SELECT dimension, value, y_true AS label, 1 AS t, 0 AS p, (y_true = y_pred)::INT AS hit FROM s UNION ALL SELECT dimension, value, y_pred, 0, 1, 0 FROM s),
c AS (SELECT dimension, value, label, sum(hit) AS tp, sum(p) AS predicted, sum(t) AS support FROM e GROUP BY ALL),
m AS (SELECT dimension, value, avg(2.0::DOUBLE * tp / (predicted + support)) AS macro_f1, sum(tp) / sum(support)::DOUBLE AS accuracy, sum(support)::BIGINT AS n FROM c GROUP BY ALL)"""


@query(_SLICE + " SELECT dimension, value, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, n, n < 5 AS low_support FROM m")
def slice_metrics(spark, sf):
    s = E.slices(predictions(spark, sf))
    return s.withColumns({"accuracy": r6("accuracy"), "macro_f1": r6("macro_f1")})


_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _nested(terms) -> str:
    return f"({terms[0]}::DOUBLE + t * {_nested(terms[1:])})" if len(terms) > 1 else f"{terms[0]}::DOUBLE"


@query(_SLICE + f""", g AS (SELECT dimension, count(*) AS groups, arg_min(struct_pack(v := value, n := n), (-accuracy, value)) AS b, arg_min(struct_pack(v := value, n := n), (accuracy, value)) AS w, max(accuracy) AS hi, min(accuracy) AS lo FROM m GROUP BY dimension HAVING count(*) >= 2),
o AS (SELECT *, (lo * w.n + hi * b.n) / (w.n + b.n) AS pool FROM g), x AS (SELECT *, (hi - lo) / sqrt(pool * (1 - pool) * (1.0::DOUBLE / b.n + 1.0::DOUBLE / w.n)) / sqrt(2) AS x FROM o), y AS (SELECT *, 1 / (1 + x / 2) AS t FROM x),
p AS (SELECT *, CASE WHEN pool > 0 AND pool < 1 THEN t * exp(-x * x + {_nested(_ERFC)}) ELSE 1 END AS p FROM y), r AS (SELECT *, row_number() OVER (ORDER BY p, dimension) AS k, count(*) OVER () AS c FROM p)
SELECT dimension, groups, b.v AS best, w.v AS worst, round(hi - lo, 6) AS gap, round(CASE WHEN hi > 0 THEN lo / hi END, 6) AS ratio, round(p, 6) AS p, round(least(1.0::DOUBLE, max((c - k + 1) * p) OVER (ORDER BY k)), 6) AS adjusted FROM r""")
def fairness_gaps(spark, sf):
    return E.fairness(E.slices(predictions(spark, sf))).withColumns({c: r6(c) for c in ("gap", "ratio", "p", "adjusted")})


@query(PRED + " SELECT y_true, y_pred, count(*) AS n FROM pr WHERE y_true <> y_pred GROUP BY ALL ORDER BY n DESC, y_true, y_pred LIMIT 10")
def confused_pairs(spark, sf):
    return E.confused(predictions(spark, sf))


@query(PRED + " SELECT id, y_true, y_pred, conf FROM pr WHERE y_true <> y_pred ORDER BY conf DESC, id LIMIT 20")
def hardest_errors(spark, sf):
    return predictions(spark, sf).where("y_true != y_pred").select("id", "y_true", "y_pred", "conf").orderBy(F.desc("conf"), "id").limit(20)


@query(PRED + " SELECT id, conf FROM pr ORDER BY conf, id LIMIT 20")
def least_confident(spark, sf):
    return predictions(spark, sf).select("id", "conf").orderBy("conf", "id").limit(20)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def request_tallies(spark, sf):
    from corpusloom.plans.tables import table
    from corpusloom.streaming.jobs import tallies

    return tallies(table(spark, sf, "events")).withColumn("total", F.round("total", 4))
