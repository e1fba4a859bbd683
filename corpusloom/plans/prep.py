"""Corpus-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import lexicons as L, text as X
from corpusloom.operators import active as AL, corpus as C, digests as D, minhash as MH, shingle_join as S
from corpusloom.plans.registry import query
from corpusloom.plans.tables import r6, samples, table

_WORDS = r"regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]+')"
_COLLAPSED = r"trim(regexp_replace(text, '[\s\x{a0}]+', ' ', 'g'), ' ')"


@query(f"""WITH t AS (SELECT lang, {_WORDS} AS w FROM documents)
SELECT lang, count(*) AS docs, sum(len(w))::BIGINT AS tokens, round(avg(len(w)), 6) AS mean_tokens,
  round(avg(CASE WHEN len(w) > 0 THEN len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w)::DOUBLE ELSE 0 END), 6) AS mean_ttr FROM t GROUP BY lang""")
def tokens_by_lang(spark, sf):
    w = table(spark, sf, "documents").select("lang", X.words(F.col("text")).alias("w"))
    ttr = X.rate(F.size(F.array_distinct(F.transform("w", F.lower))), F.size("w"))
    return w.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size("w")).alias("tokens"), r6(F.avg(F.size("w"))).alias("mean_tokens"), r6(F.avg(ttr)).alias("mean_ttr"))


_SPACE = r"[\s\x{a0}]"
_PAUSED = rf"(^|{_SPACE})(?:-+|[.]{{3,}}|…)({_SPACE}|$)"
_NOTES = L.PARENTHESISED.format("|".join(L.ANNOTATIONS))


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{L.BRACKETED}', ' ', 'g'), '(?i){_NOTES}', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{_PAUSED}', '\1 \2', 'g'), '{_PAUSED}', '\1 \2', 'g') AS t FROM a)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
  '[.]{{4,}}', '...', 'g'), '!{{2,}}', '!', 'g'), '[?]{{2,}}', '?', 'g'), ',{{2,}}', ',', 'g'), ';{{2,}}', ';', 'g'), ':{{2,}}', ':', 'g') AS text FROM b""")
def clean_artifacts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.strip_artifacts(F.col("text")).alias("text"))


@query("""SELECT doc_id, replace(translate(text, '„“”‟«»‘’‚‛‹›‒–—―−', '\"\"\"\"\"\"''''''''''''-----'), '…', '...') AS text FROM documents""")
def clean_punct(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.plain_punctuation(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_COLLAPSED} AS text FROM documents")
def clean_whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.collapse_spaces(F.col("text")).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def clean_nfc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.nfc(F.col("text")).alias("text"))


@query()
def clean_all(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean(X.nfc(F.col("text"))).alias("text"))


@query("SELECT doc_id AS id, length(text) AS n FROM documents WHERE text IS NULL OR length(text) >= 60")
def min_length_filter(spark, sf):
    return C.min_length(samples(spark, sf), 60).select("id", F.length("text").cast("long").alias("n"))


@query(f"SELECT id FROM (SELECT doc_id AS id, text, row_number() OVER (PARTITION BY lower({_COLLAPSED}) ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR trim(coalesce(text, '')) = ''")
def exact_dedup_keep_first(spark, sf):
    return C.keep_first(samples(spark, sf), X.hash_text(F.col("text"))).select("id")


@query()
def exact_dedup_casefold(spark, sf):
    return C.keep_first(samples(spark, sf), X.fingerprint(F.col("text"))).select("id")


_PAIRS = f"""WITH n AS (SELECT doc_id AS id, lower({_COLLAPSED}) AS t FROM documents),
s AS (SELECT DISTINCT id, substr(t, i, 5) AS g FROM (SELECT id, t, unnest(range(1, greatest(length(t) - 4, 1) + 1)) AS i FROM n WHERE length(t) > 0)),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id), r AS (SELECT g, count(*) AS df FROM s GROUP BY g),
o AS (SELECT s.id, s.g, c.n, row_number() OVER (PARTITION BY s.id ORDER BY r.df, hash(s.g), s.g) AS k FROM s JOIN r USING (g) JOIN c ON c.id = s.id),
f AS (SELECT * FROM o WHERE k <= n - ceil(n * 0.85::DOUBLE) + 1),
p AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM f a JOIN f b ON a.g = b.g AND a.id < b.id AND b.n >= a.n * 0.85 AND a.n >= b.n * 0.85),
i AS (SELECT p.a, p.b, na, nb, count(*) AS common FROM p JOIN s x ON x.id = p.a JOIN s y ON y.id = p.b AND y.g = x.g GROUP BY ALL)
SELECT a, b, round(common / (na + nb - common)::DOUBLE, 6) AS jaccard FROM i WHERE common / (na + nb - common)::DOUBLE >= 0.85"""


@query(_PAIRS)
def shingle_jaccard_pairs(spark, sf):
    return C.similar_pairs(samples(spark, sf)).select("a", "b", r6("jaccard").alias("jaccard"))


@query()
def minhash_lsh_candidates(spark, sf):
    """Near copies found by 128 permutations in 32 bands; rows with equal shingle sets meet once, by their first."""
    return MH.lsh_pairs(samples(spark, sf))[0].withColumn("jaccard", r6("jaccard"))


@query()
def minhash_dedup(spark, sf):
    return MH.deduplicate(samples(spark, sf)).select("id")


@query()
def near_dedup_greedy(spark, sf):
    return C.greedy_keep(*S.kept_rows(samples(spark, sf))).select("id")  # equal texts go first, so they are never paired


@query("SELECT source, coalesce(nullif(lang, ''), '__unlabelled__') AS label, count(*) AS n FROM documents GROUP BY ALL")
def class_distribution(spark, sf):
    return C.class_distribution(samples(spark, sf), "dialect", "source")


@query("""WITH c AS (SELECT source AS speaker_id, lang, count(*) AS c FROM documents GROUP BY ALL)
SELECT speaker_id, sum(c)::BIGINT AS size, arg_max(lang, (c, lang)) AS majority FROM c GROUP BY speaker_id""")
def majority_label_per_group(spark, sf):
    return C.majority_label(samples(spark, sf), "speaker_id", "dialect")


@query("""WITH f AS (SELECT count_if(text IS NULL OR trim(text) = '') AS a, count_if(lang IS NOT NULL) AS b, count_if(nullif(trim(source), '') IS NULL) AS c, count_if(nullif(trim(source), '') IS NOT NULL) AS d FROM documents),
t AS (SELECT count(*) AS e FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1))
SELECT * FROM (SELECT 'error' AS severity, 'duplicate-id' AS code, e::BIGINT AS n FROM t UNION ALL SELECT 'warning', 'empty-rows', a::BIGINT FROM f UNION ALL SELECT 'warning', 'unknown-dialect', b::BIGINT FROM f
UNION ALL SELECT 'warning', 'missing-speaker', c::BIGINT FROM f UNION ALL SELECT 'info', 'speaker-present', d::BIGINT FROM f) WHERE n > 0""")
def validation_issues(spark, sf):
    return C.validation_issues(samples(spark, sf))


@query("SELECT text_key, count(*) AS n FROM (SELECT md5(text) AS text_key FROM documents) GROUP BY text_key HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("text_key")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT doc_id, 'spk-' || left(sha256(concat_ws('|', source, lang)), 16) AS speaker FROM documents")
def surrogate_speaker(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("spk-"), F.left(F.sha2(F.concat_ws("|", "source", "lang"), 256), F.lit(16))).alias("speaker"))


@query()
def group_split_sizes(spark, sf):
    return C.group_split(samples(spark, sf), "speaker_id", "dialect").groupBy("split", "dialect").agg(F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS shared_groups, count(*) AS n FROM documents")
def split_disjointness(spark, sf):
    s = C.group_split(samples(spark, sf), "speaker_id", "dialect")
    shared = s.groupBy("speaker_id").agg(F.count_distinct("split").alias("k"), F.count("*").alias("c"))
    return shared.agg(F.count_if(F.col("k") > 1).alias("shared_groups"), F.sum("c").alias("n"))


@query()
def grouped_kfold(spark, sf):
    return C.grouped_kfold(samples(spark, sf), "speaker_id", "dialect").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("speaker_id").alias("groups"))


@query("""SELECT count(*) AS n, (sum(('0x' || left(sha256(concat_ws(chr(31), doc_id::VARCHAR, text, lang, source)), 15))::BIGINT::HUGEINT) % 2305843009213693951)::BIGINT AS digest FROM documents""")
def split_digest(spark, sf):
    return C.split_digest(table(spark, sf, "documents"), "doc_id", "text", "lang", "source")


@query("""SELECT corpus, count(*) AS n, sum(chars)::BIGINT AS chars FROM (SELECT 'documents' AS corpus, length(text) AS chars FROM documents UNION ALL SELECT 'benchmark', length(text) FROM benchmark UNION ALL SELECT 'conversations', length(text) FROM conversations) GROUP BY corpus""")
def union_corpora(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(t).alias("corpus"), F.length("text").alias("chars")) for t in ("documents", "benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("corpus").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("""WITH s AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL), t AS (SELECT lang, sum(c) AS c FROM s GROUP BY lang)
SELECT h.source AS held_out, t.lang, (t.c - coalesce(s.c, 0))::BIGINT AS n FROM (SELECT DISTINCT source FROM s) h CROSS JOIN t LEFT JOIN s ON s.source = h.source AND s.lang = t.lang""")
def leave_one_source_out(spark, sf):
    s = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("c"))
    held = s.select(F.col("source").alias("held_out")).distinct()
    t = s.groupBy("lang").agg(F.sum("c").alias("t"))
    grid = held.crossJoin(F.broadcast(t))  # one row for each source and label
    return grid.join(s.withColumnRenamed("source", "held_out"), ["held_out", "lang"], "left").select("held_out", "lang", (F.col("t") - F.coalesce("c", F.lit(0))).alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS snippet FROM documents")
def text_snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("SELECT CASE WHEN n_chars <= 40 THEN '<=40' WHEN n_chars <= 80 THEN '41-80' WHEN n_chars <= 160 THEN '81-160' ELSE '>160' END AS band, count(*) AS n FROM documents GROUP BY band")
def length_bands(spark, sf):
    return table(spark, sf, "documents").groupBy(X.length_band(F.col("n_chars")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size <= 19 THEN '<=19' WHEN p_size <= 29 THEN '20-29' WHEN p_size <= 44 THEN '30-44' WHEN p_size <= 59 THEN '45-59' ELSE '60+' END AS band, count(*) AS n FROM part GROUP BY band")
def age_bands(spark, sf):
    return table(spark, sf, "part").groupBy(X.age_band(F.col("p_size").cast("string")).alias("band")).agg(F.count("*").alias("n"))


_DIALECTS = sorted(L.FAMILY_OF)
_FAMILY_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in L.FAMILY_OF.items())
_PLACE_VALUES = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in L.DIALECT_PLACES.items())
_NAMED = "list_extract([" + ", ".join(f"'{d}'" for d in _DIALECTS) + f"], (doc_id % {len(_DIALECTS)})::INT + 1)"


def _named():
    return F.element_at(F.array(*map(F.lit, _DIALECTS)), (F.col("doc_id") % len(_DIALECTS)).cast("int") + 1)


@query(f"SELECT f.family, count(*) AS n FROM (SELECT {_NAMED} AS dialect FROM documents) d JOIN (VALUES {_FAMILY_VALUES}) f(dialect, family) USING (dialect) GROUP BY f.family")
def family_derivation(spark, sf):
    return table(spark, sf, "documents").groupBy(X.family_of(F.upper(_named())).alias("family")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, dialect, lat, lon FROM (SELECT doc_id, {_NAMED} AS dialect FROM documents) LEFT JOIN (VALUES {_PLACE_VALUES}) p(dialect, lat, lon) USING (dialect)")
def centroid_join(spark, sf):
    places = spark.createDataFrame([(k, *v) for k, v in L.DIALECT_PLACES.items()], "dialect string, lat double, lon double")
    return table(spark, sf, "documents").select("doc_id", _named().alias("dialect")).join(F.broadcast(places), "dialect", "left").select("doc_id", "dialect", "lat", "lon")


@query(r"""SELECT page_id, p AS paragraph, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM
 (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: x <> '') AS ps FROM pages))""")
def html_paragraphs(spark, sf):
    found = F.regexp_extract_all("html", F.lit("(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    texts = F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != "")
    return table(spark, sf, "pages").select("page_id", F.posexplode(texts).alias("pos", "paragraph")).select("page_id", "paragraph", F.col("pos").cast("long").alias("pos"))


@query("""WITH r AS (SELECT lang, md5('0|' || doc_id::VARCHAR) AS h, doc_id FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM r)
SELECT doc_id AS id, lang AS dialect FROM k WHERE rn <= greatest(1, ceil(0.25::DOUBLE * n))""")
def stratified_prefix(spark, sf):
    return C.stratified_prefix(samples(spark, sf), "dialect", 0.25).select("id", "dialect")


@query("SELECT source, doc_id AS id, n_chars, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def topk_per_class(spark, sf):
    return C.top_per_class(samples(spark, sf), "source", [F.desc("n_chars"), F.col("id")], 3).select("source", "id", "n_chars", F.col("rank").cast("long").alias("rank"))


@query("""SELECT c_mktsegment AS label, n_name AS nation, r_name AS region, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def level_rollup(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("c_mktsegment").alias("label"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT lang, source, grouping(lang, source)::BIGINT AS level, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def datasheet_levels(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("_datasheet")
    return spark.sql("SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS n FROM _datasheet GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")


_LANES = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) AS l{i}" for i in range(8))
_CARRIES = "l7 AS t7"
for _i in reversed(range(7)):
    _CARRIES += f", l{_i} + t{_i + 1} // 4294967296 AS t{_i}"
_HEX = " || ".join(f"lpad(lower(to_hex((t{i} % 4294967296)::BIGINT)), 8, '0')" for i in range(8))


@query(f"""WITH s AS (SELECT (doc_id % 3)::VARCHAR AS split, sha256(to_json({{'id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text}})::VARCHAR) AS h FROM documents),
a AS (SELECT split, count(*) AS n, {_LANES} FROM s GROUP BY split), c AS (SELECT split, n, {_CARRIES} FROM a), e AS (SELECT split, n, sha256({_HEX} || ':' || n) AS digest FROM c)
SELECT * FROM e UNION ALL SELECT NULL, sum(n)::BIGINT, sha256(string_agg(split || ':' || digest, chr(10) ORDER BY split || ':' || digest)) FROM e""")
def corpus_digest(spark, sf):
    """Digests of three splits and of all."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars", "source", "text", (F.col("doc_id") % 3).cast("string").alias("split"))
    return D.corpus_digest(d, ["id", "lang", "n_chars", "source", "text"], "split")


@query(f"""WITH r AS (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS turn FROM documents WHERE lang IS NOT NULL) SELECT id FROM r ORDER BY turn, lang LIMIT 20""")
def round_robin_seed(spark, sf):
    """Twenty rows, one of each class in turn."""
    pool = samples(spark, sf).select("id", "dialect")
    return AL.round_robin_seed(pool, "dialect", 20, order=[F.md5(F.col("id").cast("string").cast("binary")), F.col("id")])


@query()
def active_learning(spark, sf):
    """Five rounds of labelling by entropy, scored on held-out rows."""
    d = samples(spark, sf).select("id", "text", F.col("dialect").alias("label"))
    return AL.active_loop(d.where("id % 5 != 0"), d.where("id % 5 = 0"), ["de", "en", "es", "fr"], batch_size=20)


@query()
def learning_curve(spark, sf):
    """Accuracy on held-out rows by models of nested parts of the others."""
    d = samples(spark, sf).select("id", "text", F.col("dialect").alias("label"))
    return AL.learning_curve(d.where("id % 5 != 0"), d.where("id % 5 = 0"), ["de", "en", "es", "fr"], [0.01, 0.1, 0.5, 1.0])
