"""Queries on what sets languages apart, character TF-IDF, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import lexicons as L, text as X
from corpusloom.operators import explain as P, models as M
from corpusloom.operators.corpus import shared_folder
from corpusloom.plans.features import _RULE_SQL, _isin
from corpusloom.plans.registry import query
from corpusloom.plans.tables import PRED, predictions, r6, samples, table
from corpusloom.streaming import jobs

_MARKERS = _isin(sorted({m for ms in L.MARKERS.values() for m in ms}))
_FIRED = " UNION ALL ".join(f"SELECT id, lang, 'phonological', '{n}', {_RULE_SQL[f'{n}_fired']} FROM t" for n, rule in L.RULES.items() if rule[1])
_FEATURES = rf"""t AS (SELECT doc_id AS id, lang, regexp_extract_all(lower(text), '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS w FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
k AS (SELECT id, lang, unnest(w) AS x FROM t),
f AS (SELECT id, lang, 'lexical' AS category, x AS feature, count(*) AS c FROM k WHERE list_contains({_MARKERS}, x) GROUP BY ALL
  UNION ALL SELECT id, lang, 'morphological', '-' || right(x, 3) AS feature, count(*) FROM k WHERE length(x) > 3 GROUP BY ALL
  UNION ALL SELECT * FROM ({_FIRED}) p(id, lang, category, feature, c) WHERE c > 0)"""


@query(f"""WITH {_FEATURES}, s AS (SELECT count_if(lang = 'de') AS a, count_if(lang = 'es') AS b FROM documents WHERE trim(text) <> ''),
g AS (SELECT category, feature, count_if(lang = 'de') AS n_a, count_if(lang = 'es') AS n_b FROM f WHERE lang IN ('de', 'es') GROUP BY ALL HAVING count(*) >= 5),
r AS (SELECT *, n_a / a::DOUBLE AS rate_a, n_b / b::DOUBLE AS rate_b, (n_a + n_b) / (a + b)::DOUBLE AS p, ln(((n_a + 0.5::DOUBLE) * (b - n_b + 0.5::DOUBLE)) / ((a - n_a + 0.5::DOUBLE) * (n_b + 0.5::DOUBLE))) AS o FROM g, s)
SELECT category, feature, n_a, n_b, round(rate_a, 6) AS rate_a, round(rate_b, 6) AS rate_b, round(o, 6) AS log_odds,
  round(CASE WHEN p * (1 - p) > 0 THEN (rate_a - rate_b) / sqrt(p * (1 - p) * (1.0::DOUBLE / a + 1.0::DOUBLE / b)) ELSE 0 END, 6) AS z, CASE WHEN o >= 0 THEN 'de' ELSE 'es' END AS favoured FROM r""")
def contrast_log_odds(spark, sf):
    c = P.contrast(samples(spark, sf), "dialect", "de", "es")
    return c.select("category", "feature", "n_a", "n_b", *[r6(x).alias(x) for x in ("rate_a", "rate_b", "log_odds", "z")], "favoured")


@query(f"""WITH {_FEATURES}, s AS (SELECT lang, count(*) AS size FROM t GROUP BY lang), n AS (SELECT count(*) AS n FROM t),
e AS (SELECT category, feature, lang, count(*) AS c, sum(c) AS o FROM f GROUP BY ALL), l AS (SELECT *, (c * n)::DOUBLE / size AS x FROM e JOIN s USING (lang), n),
r AS (SELECT *, sum(c) OVER w AS carriers, sum(o) OVER w AS occurrences, row_number() OVER (PARTITION BY category, feature ORDER BY x DESC, c DESC, lang) AS k FROM l WINDOW w AS (PARTITION BY category, feature))
SELECT category, feature, carriers::BIGINT AS carriers, occurrences::BIGINT AS occurrences, lang AS top_class, round(x / carriers, 6) AS lift, round(c / carriers::DOUBLE, 6) AS share, carriers < 3 AS low_support FROM r WHERE k = 1""")
def evidence_lift(spark, sf):
    e = P.evidence(samples(spark, sf), "dialect")
    return e.withColumns({"lift": r6("lift"), "share": r6("share")})


@query(r"""WITH w AS (SELECT doc_id AS id, ' ' || unnest(list_filter(string_split_regex(lower(text), '[\s\x{a0}]+'), lambda x: x <> '')) || ' ' AS w FROM documents),
g AS (SELECT id, CASE WHEN length(w) <= n THEN [w] ELSE list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n)) END AS g FROM w, (VALUES (2), (3), (4), (5)) v(n) WHERE n = 2 OR length(w) > n - 1),
c AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(g) AS token FROM g) GROUP BY ALL), n AS (SELECT count(DISTINCT id) AS n FROM c),
i AS (SELECT token, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM c, n GROUP BY token, n HAVING count(*) >= 2), x AS (SELECT id, token, (1 + ln(tf)) * idf AS w FROM c JOIN i USING (token)),
y AS (SELECT id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM x)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, token) AS rank FROM y) WHERE rank <= 5""")
def char_tfidf_top(spark, sf):
    """The five heaviest character n-grams of each document."""
    return M.char_wb_tfidf(samples(spark, sf), 5)


def _evidence_sql() -> str:
    lexicon = ", ".join(f"('{m}', '{key}')" for key, markers in L.MARKERS.items() for m in markers)
    rules = []
    for name, (_, detectable, final, pairs, stop) in L.RULES.items():
        body = "|".join(sorted([b if detectable else a for a, b in pairs], key=lambda x: (-len(x), x)))
        left = f" WHERE NOT list_contains({_isin(list(stop))}, t)" if stop else ""
        rules.append(f"SELECT id, {1 if detectable else 2}, '{name}', unnest(regexp_extract_all(t, '{f'(?:{body})$' if final else body}')) AS s, n FROM w{left}")
    fired = " UNION ALL ".join(f"SELECT id, k, l, {'s' if d else chr(39) * 2} AS s, n FROM ({r}) x(id, k, l, s, n)" for r, d in zip(rules, (rule[1] for rule in L.RULES.values())))
    return rf"""WITH w AS (SELECT id, t, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nl}}\p{{No}}]+')) AS t FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
e AS (SELECT id, 0 AS k, l, w.t AS s, n FROM w JOIN (VALUES {lexicon}) v(t, l) ON v.t = w.t UNION ALL {fired}), c AS (SELECT id, k, l, s, sum(n)::BIGINT AS n FROM e GROUP BY ALL), x AS (SELECT *, n * [1.5, 2.0, -0.5][k + 1]::DOUBLE AS weight FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(weight) DESC, k, n DESC, l, s) AS rank FROM x)
SELECT id, rank, ['marker', 'isogloss_fired', 'isogloss_environment'][k + 1] AS kind, l AS label, s AS surface, n AS count, weight FROM r WHERE rank <= 15"""


@query(_evidence_sql())
def dialect_evidence(spark, sf):
    """The heaviest markers, fired rules and standing environments of each document."""
    return P.dialect_evidence(samples(spark, sf))


@query(PRED + f""", w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+') AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT id, {_RULE_SQL["soft_labials_fired"]} > 0 AS present FROM w), e AS (SELECT 'soft_labials' AS rule, present, y_true = y_pred AS r FROM f JOIN pr USING (id) WHERE y_true IN ('en', 'fr')),
a AS (SELECT rule, count_if(present)::BIGINT AS n_present, avg(r::INT) FILTER (present) AS p, count_if(NOT present)::BIGINT AS n_absent, avg(r::INT) FILTER (NOT present) AS q FROM e GROUP BY rule)
SELECT rule, n_present, round(p, 6) AS accuracy_present, n_absent, round(q, 6) AS accuracy_absent, round(p - q, 6) AS delta, n_present < 5 OR n_absent < 5 AS low_support FROM a""")
def isogloss_diagnostics(spark, sf):
    """Accuracy with and without the rule that can be told in texts of two labels."""
    d = P.isogloss_diagnostics(predictions(spark, sf).select("id", "y_true", "y_pred"), samples(spark, sf).select("id", "text"), {"soft_labials": ["en", "fr"]})
    return d.withColumns({c: r6(c) for c in ("accuracy_present", "accuracy_absent", "delta")})


def _streamed(spark, sf, name: str, change, mode: str):
    """A table as a stream of files, changed and written until all is read; then what was written."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = change(spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]"))  # a pattern, as a stream takes no path of one file

    def write(batch, _):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streaming_dedup(spark, sf):
    """First arrivals of each user's kinds of event; a key is kept for ten years of event time."""
    key = F.struct("user_id", "event_type")
    return _streamed(spark, sf, "events", lambda s: jobs.dedup_stream(s.select("user_id", "event_type", "ts"), key, late="3650 days"), "append").select("user_id", "event_type")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
r AS (SELECT user_id, ts, t, k, 2.0::DOUBLE AS tokens, true AS allowed FROM e WHERE k = 1 UNION ALL
SELECT user_id, ts, t, k, x - (x >= 1)::INT, x >= 1 FROM (SELECT e.*, least(3.0::DOUBLE, r.tokens + (e.t - r.t) / 604800.0::DOUBLE) AS x FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT user_id, count(*) AS n, count_if(allowed)::BIGINT AS allowed FROM r GROUP BY user_id""")
def token_bucket(spark, sf):
    """Events of each user that a bucket of three tokens, one more a week, lets through."""
    out = _streamed(spark, sf, "events", lambda s: jobs.token_bucket(s.select("user_id", "ts"), 1 / 604800, 3.0), "append")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_tallies(spark, sf):
    return _streamed(spark, sf, "events", lambda s: jobs.tallies(s), "complete").withColumn("total", F.round("total", 4))
