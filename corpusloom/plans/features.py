"""Text-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import arrays as A, lexicons as L, text as X
from corpusloom.operators import counted as K, models as M
from corpusloom.plans.registry import query
from corpusloom.plans.tables import r6, samples, table

_T = r"SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+') AS w FROM documents"
def _each(spark, sf, columns):
    return table(spark, sf, "documents").select("doc_id", *[r6(c).alias(n) for n, c in columns.items()])


def _per_100(pattern: str) -> str:
    return f"round(CASE WHEN c > 0 THEN 100.0::DOUBLE * len(regexp_extract_all(t, '{pattern}')) / c ELSE 0 END, 6)"


_QUOTED = L.STYLE_QUOTES.replace("'", "''")
_STYLE = rf"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS c FROM documents),
r AS (SELECT doc_id, t, c, regexp_extract_all(lower(t), '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS w, list_filter(list_transform(string_split_regex(t, '[.!?…]+'), lambda x: len(regexp_extract_all(x, '[\p{{L}}\p{{Nl}}\p{{No}}]+'))), lambda k: k > 0) AS s FROM b),
k AS (SELECT doc_id, count(*) AS types, count_if(k = 1) AS once, sum(k * k) AS m2, sum(k) AS n FROM (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM r) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, len(s)::DOUBLE AS sentence_count, round(coalesce(list_avg(s), 0), 6) AS sentence_length_words_mean, round(coalesce(list_aggregate(s, 'stddev_pop'), 0), 6) AS sentence_length_words_std,
round(coalesce(list_avg(list_transform(w, lambda x: length(x))), 0), 6) AS word_length_mean, round(coalesce(list_aggregate(list_transform(w, lambda x: length(x)), 'stddev_pop'), 0), 6) AS word_length_std,
{_per_100(',')} AS commas_per_100_chars, {_per_100('[.]')} AS periods_per_100_chars, {_per_100('[?]')} AS question_marks_per_100_chars, {_per_100('!')} AS exclamations_per_100_chars,
{_per_100(f'[{L.STYLE_DASHES}]')} AS dashes_per_100_chars, {_per_100('[.]{3}|…')} AS ellipses_per_100_chars, {_per_100(f'[{_QUOTED}]')} AS quotes_per_100_chars,
round(CASE WHEN c > 0 THEN len(regexp_extract_all(t, '\p{{Nd}}'))::DOUBLE / c ELSE 0 END, 6) AS digit_ratio,
round(CASE WHEN len(regexp_extract_all(t, '\p{{L}}')) > 0 THEN len(regexp_extract_all(t, '\p{{Lu}}'))::DOUBLE / len(regexp_extract_all(t, '\p{{L}}')) ELSE 0 END, 6) AS uppercase_ratio,
round(coalesce(types / n::DOUBLE, 0), 6) AS type_token_ratio, round(coalesce(once / n::DOUBLE, 0), 6) AS hapax_legomena_ratio, round(coalesce(1e4 * (m2 - n) / (n * n)::DOUBLE, 0), 6) AS yules_k FROM r LEFT JOIN k USING (doc_id)"""


@query(_STYLE)
def stylometry_counts(spark, sf):
    s = X.stylometry(table(spark, sf, "documents"))
    return s.select("doc_id", *[r6(c).alias(c) for c in s.columns[1:]])


@query(f"""WITH t AS ({_T}), c AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM t) GROUP BY ALL),
s AS (SELECT doc_id, sum(k) AS n, sum(k * k) AS m2, count_if(k = 1) AS once FROM c GROUP BY doc_id)
SELECT doc_id, round(1e4 * (m2 - n) / (n * n)::DOUBLE, 6) AS yule_k, round(once / n::DOUBLE, 6) AS hapax FROM s""")
def stylometry_lexical(spark, sf):
    counts = K.token_rows(_words(table(spark, sf, "documents"), "doc_id"), ["doc_id"])
    s = counts.groupBy("doc_id").agg(F.sum("tf").alias("n"), F.sum(F.col("tf") * F.col("tf")).alias("m2"), F.count_if(F.col("tf") == 1).alias("once"))
    return s.select("doc_id", r6(1e4 * (F.col("m2") - F.col("n")) / (F.col("n") * F.col("n"))).alias("yule_k"), r6(F.col("once") / F.col("n")).alias("hapax"))


def _words(df, key):
    return K.one_row(df.select(key, X.words(F.col("text"), True).alias("w")), key)


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS token FROM t),
c AS (SELECT doc_id AS id, token, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(DISTINCT id) AS n FROM c),
i AS (SELECT token, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM c, n GROUP BY token, n HAVING count(*) >= 2), w AS (SELECT id, token, (1 + ln(tf)) * idf AS w FROM c JOIN i USING (token))
SELECT id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""")
def word_tfidf(spark, sf):
    return M.gram_tfidf(samples(spark, sf)).withColumn("weight", r6("weight"))


@query(r"""WITH w AS (SELECT doc_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '[\s\x{a0}]+'), lambda x: x <> '')) || ' ' AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN length(w) <= n THEN [w] ELSE list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n)) END AS g FROM w, (VALUES (2), (3), (4), (5)) v(n) WHERE n = 2 OR length(w) > n - 1)
SELECT doc_id, count(*) AS n, count(DISTINCT x) AS kinds FROM (SELECT doc_id, unnest(g) AS x FROM g) GROUP BY doc_id""")
def char_wb_ngrams(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", X.spaced_words(F.col("text")).alias("w"))
    return K.totals(K.one_row(w, "doc_id"), ["doc_id"], K.char_wb_pieces)


_AFFIX = f"""WITH t AS ({_T}), k AS (SELECT doc_id, unnest(w) AS x, len(w) AS n FROM t),
a AS (SELECT doc_id, n, 'pre:' || left(x, l) AS affix FROM k, (VALUES (2), (3), (4)) v(l) WHERE length(x) > l UNION ALL SELECT doc_id, n, 'suf:' || right(x, l) FROM k, (VALUES (2), (3), (4)) v(l) WHERE length(x) > l)"""


def _affix_words(spark, sf, *keys):
    w = table(spark, sf, "documents").select("doc_id", X.words(F.col("text"), True).alias("w")).select("doc_id", F.size("w").alias("n"), "w")
    return K.one_row(w, *keys)


@query(_AFFIX + " SELECT doc_id, affix, round(count(*) / n::DOUBLE, 6) AS frequency FROM a GROUP BY doc_id, affix, n")
def affix_frequency(spark, sf):
    rows = K.token_rows(_affix_words(spark, sf, "doc_id", "n"), ["doc_id", "n"], K.affix_pieces)
    return rows.select("doc_id", F.col("token").alias("affix"), r6(F.col("tf") / F.col("n")).alias("frequency"))


@query(_AFFIX + " SELECT affix, count(DISTINCT doc_id) AS df FROM a GROUP BY affix ORDER BY df DESC, affix LIMIT 300")
def affix_vocabulary_topn(spark, sf):
    rows = _affix_words(spark, sf, "doc_id").where("doc_id IS NOT NULL")
    return K.document_frequency(rows, K.affix_pieces).select(F.col("token").alias("affix"), "df").orderBy(F.desc("df"), "affix").limit(300)


def _isin(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_HITS = {d: f"len(list_filter(w, lambda x: list_contains({_isin(m)}, x)))" for d, m in L.MARKERS.items()}


@query(f"WITH t AS ({_T}) SELECT doc_id, " + ", ".join(f"round(CASE WHEN len(w) > 0 THEN 1000.0::DOUBLE * {h} / len(w) ELSE 0 END, 6) AS {d}" for d, h in (_HITS | {"total": "(" + " + ".join(_HITS.values()) + ")"}).items()) + " FROM t")
def keyword_rates(spark, sf):
    return _rates(spark, sf, X.keyword_hits(), 1000.0)


def _rates(spark, sf, hits, per=1.0):
    rates = X.token_rates(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", hits, per)
    return rates.select("doc_id", *[r6(n).alias(n) for n in hits])


def _count(pattern: str, stop=()) -> str:
    kept = f"list_filter(w, lambda x: NOT list_contains({_isin(stop)}, x))" if stop else "w"
    return f"len(regexp_extract_all(coalesce(array_to_string({kept}, ' '), ''), '{pattern}'))"


@query(f"WITH t AS ({_T}) SELECT doc_id, round(CASE WHEN len(w) > 0 THEN {_count(L.SOFT_LABIAL_PATTERN, L.SOFT_LABIAL_STOP)}::DOUBLE / len(w) ELSE 0 END, 6) AS rate FROM t")
def isogloss_pattern_rate(spark, sf):
    w = X.words(F.col("text"), True)
    return _each(spark, sf, {"rate": X.rate(X.pattern_hits(w, L.SOFT_LABIAL_PATTERN, L.SOFT_LABIAL_STOP), F.size(w))})


@query(f"WITH t AS ({_T}) SELECT doc_id, round(CASE WHEN len(w) > 0 THEN {_count('|'.join(L.SIBILANT_DIGRAPHS))}::DOUBLE / len(w) ELSE 0 END, 6) AS rate FROM t")
def digraph_rate(spark, sf):
    w = X.words(F.col("text"), True)
    return _each(spark, sf, {"rate": X.rate(X.pattern_hits(w, "|".join(L.SIBILANT_DIGRAPHS)), F.size(w))})


_RULE_SQL = {}
for _n, (_, _d, _f, _p, _s) in L.RULES.items():
    _pat = lambda parts, final=_f: (f"({'|'.join(sorted(parts, key=lambda x: (-len(x), x)))})" + ("( |$)" if final else ""))
    _RULE_SQL[f"{_n}_applicable"] = _count(_pat([a for a, _ in _p]), _s)
    if _d:
        _RULE_SQL[f"{_n}_fired"] = _count(_pat([b for _, b in _p]), _s)
_RULE_RATE = {k: f"(CASE WHEN len(w) > 0 THEN {v}::DOUBLE / len(w) ELSE 0 END)" for k, v in _RULE_SQL.items()}


@query(f"WITH t AS ({_T}) SELECT doc_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _RULE_RATE.items()) + " FROM t")
def rule_fired_rates(spark, sf):
    return _rates(spark, sf, X.rule_hits())


@query(f"WITH t AS ({_T}) SELECT doc_id, round(1 - exp(-(8.0::DOUBLE * (CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains({_isin(sorted({m for ms in L.MARKERS.values() for m in ms}))}, x)))::DOUBLE / len(w) ELSE 0 END) + 8.0::DOUBLE * {_RULE_RATE['soft_labials_fired']})), 6) AS intensity FROM t")
def dialect_intensity(spark, sf):
    return _each(spark, sf, {"intensity": X.intensity(F.col("text"))})


def _chain(pairs_stop, x: str) -> str:
    for final, pairs, stop in pairs_stop:
        inner = x
        for a, b in sorted(pairs, key=lambda p: -len(p[0])):
            inner = f"regexp_replace({inner}, '{a}{'$' if final else ''}', '{b}', 'g')"
        x = f"CASE WHEN list_contains({_isin(stop)}, {x}) THEN {x} ELSE {inner} END" if stop else inner
    return x


def _stepwise(rules) -> str:
    """The rules one after the other, each in its own subquery."""
    sql, w = f"WITH t0 AS ({_T})", "w"
    for i, rule in enumerate(rules):
        sql += f", t{i + 1} AS (SELECT doc_id, list_transform({w}, lambda x: {_chain([rule], 'x')}) AS w FROM t{i})"
    return sql + f" SELECT doc_id, coalesce(array_to_string(w, ' '), '') AS text FROM t{len(rules)}"


@query(_stepwise([(f, p, s) for _, _, f, p, s in L.RULES.values()]))
def apply_rules(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.apply_rules(F.col("text")).alias("text"))


@query(_stepwise([(f, [(b, a) for a, b in p], s) for _, d, f, p, s in L.RULES.values() if d]))
def normalize_rules(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.to_standard(F.col("text")).alias("text"))


@query("SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 5) AS mean, round(list_aggregate(embedding::DOUBLE[], 'stddev_pop'), 5) AS std, round(list_aggregate(embedding::DOUBLE[], 'median'), 5) AS median, round(list_min(embedding)::DOUBLE, 5) AS low, round(list_max(embedding)::DOUBLE, 5) AS high FROM embeddings")
def pooled_stats(spark, sf):
    e = F.transform("embedding", lambda v: v.cast("double"))
    n = F.size("embedding")
    mean = A.total(e) / n
    s = F.sort_array(e)
    mid = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2
    out = {"mean": mean, "std": F.sqrt(A.total(F.transform(e, lambda v: (v - mean) * (v - mean))) / n), "median": mid, "low": F.array_min(e), "high": F.array_max(e)}
    return table(spark, sf, "embeddings").select("vec_id", *[F.round(c, 5).alias(k) for k, c in out.items()])
