"""Naive Bayes by folds: every token is counted once for all folds, and a fold's model is the whole counts less its own."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpusloom.functions import text as X
from corpusloom.operators import counted
from corpusloom.operators.corpus import written


def _counted(df: DataFrame, words: Column, *keep: str) -> DataFrame:
    return counted.token_rows(df.select("id", *keep, words.alias("w")), ["id", *keep])


def word_tokens(df: DataFrame, *keep: str) -> DataFrame:
    """(id, kept, token, tf) of lower-cased words, counted where a document lies; rows that share an id have a count each."""
    return _counted(df, X.words(F.col("text"), True), *keep)


def ending_tokens(df: DataFrame, *keep: str, size: int = 2) -> DataFrame:
    """(id, kept, token, tf) of the last letters of words."""
    return _counted(df, F.transform(X.words(F.col("text"), True), lambda w: F.right(w, F.lit(size))), *keep)


def length_tokens(df: DataFrame, *keep: str, longest: int = 12) -> DataFrame:
    """(id, kept, token, tf) of the lengths of words, those over the longest as one."""
    return _counted(df, F.transform(X.words(F.col("text"), True), lambda w: F.least(F.length(w), F.lit(longest)).cast("string")), *keep)


def out_of_fold(rows: DataFrame, tokens: DataFrame, labels: list[str], alpha: float = 0.1) -> DataFrame:
    """(id, fold, label, n, scores): log joint probabilities, in order of labels, by the model of all other folds' labelled rows.

    rows: id, fold, label (null: scored, not learnt from). tokens: id, fold, label, token, tf, stored. n: known tokens.
    A token that the other folds lack is left out. Counts are one column for each label, so a token of a fold is one row.
    """
    is_label = [F.col("label") == x for x in labels]
    k = range(len(labels))
    own = written(tokens.sparkSession, tokens.groupBy("fold", "token").agg(*[F.sum(F.when(c, F.col("tf")).otherwise(0)).alias(f"c{i}") for i, c in enumerate(is_label)]))
    whole = own.groupBy("token").agg(*[F.sum(f"c{i}").alias(f"w{i}") for i in k])
    other = own.join(whole, "token").select("fold", "token", *[(F.col(f"w{i}") - F.col(f"c{i}")).alias(f"o{i}") for i in k], _sum([F.col(f"w{i}") for i in k]).alias("w"))
    known = _sum([F.col(f"o{i}") for i in k]) > 0
    size = whole.where(_sum([F.col(f"w{i}") for i in k]) > 0).agg(F.count("*").alias("v"))
    only = other.where(~known & (F.col("w") > 0)).groupBy("fold").agg(F.count("*").alias("only"))
    totals = own.groupBy("fold").agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in k])
    docs = rows.groupBy("fold").agg(*[F.count_if(c).alias(f"d{i}") for i, c in enumerate(is_label)])
    facts = docs.join(totals, "fold", "left").join(only, "fold", "left").crossJoin(size).collect()  # one row for each fold
    sums = {f"{x}{i}": sum(r[f"{x}{i}"] or 0 for r in facts) for x in "td" for i in k}
    models = []
    for r in facts:
        v = r["v"] - (r["only"] or 0)
        n = [sums[f"d{i}"] - r[f"d{i}"] for i in k]
        total = [sums[f"t{i}"] - (r[f"t{i}"] or 0) + alpha * v for i in k]
        models.append((r["fold"], [float(x) / sum(n) if sum(n) else 1.0 / len(labels) for x in n], [float(x) for x in total]))
    model = rows.sparkSession.createDataFrame(models, "fold int, prior array<double>, total array<double>")
    gains = other.where(known).select("fold", "token", *[F.ln((F.col(f"o{i}") + alpha) / alpha).alias(f"g{i}") for i in k])  # less what an unseen token has
    sums_ = tokens.select("id", "fold", "token", "tf").join(gains, ["fold", "token"]).groupBy("id").agg(F.sum("tf").alias("n"), *[F.sum(F.col("tf") * F.col(f"g{i}")).alias(f"s{i}") for i in k])
    joined = rows.join(F.broadcast(model), "fold").join(sums_, "id", "left")
    n = F.coalesce("n", F.lit(0))
    score = [F.when(F.col("prior")[i] > 0, F.ln(F.col("prior")[i]) + n * F.ln(F.lit(alpha) / F.col("total")[i]) + F.coalesce(f"s{i}", F.lit(0.0))) for i in k]
    return joined.select("id", "fold", "label", n.alias("n"), F.array(*[F.coalesce(c, F.lit(float("-inf"))) for c in score]).alias("scores"))


def word_blocks_by(rows: DataFrame, labels: list[str], *keep: str, slot: Column | None = None, other: bool = False) -> DataFrame:
    """Blocks of rows (id, text, label, kept); ``_g`` is the place of slot and label among all of them, -1 without one. other: labels that are not named have a place too, the last."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, labels)), F.col("label")), F.lit(0)) - 1, F.when(F.col("label").isNotNull() & F.lit(other), len(labels)))
    at = at if slot is None else slot * (len(labels) + other) + at
    return counted.word_blocks(rows.select("id", *keep, F.coalesce(at.cast("int"), F.lit(-1)).alias("_g"), "text"))


def sparse(counts: DataFrame, place: str = "_g") -> DataFrame:
    """(token, place, c) of counts (place, token, c), arrays of what lies at places of 0 and above; a token without any stays."""
    z = F.collect_list(F.when(F.col(place) >= 0, F.struct(F.col(place).alias("p"), "c")))
    return counts.groupBy("token").agg(z.alias("z")).select("token", F.col("z.p").alias("place"), F.col("z.c").alias("c"))


def words_out_of_fold(rows: DataFrame, labels: list[str], folds: int, alpha: float = 0.1) -> DataFrame:
    """As out_of_fold, of the words of rows (id, fold, label, text). A word travels with its counts by fold and label, once for each block of documents; its gains are made where they are summed."""
    k, width = range(len(labels)), len(labels) + 1
    blocks = word_blocks_by(rows, labels, "fold", slot=F.col("fold"))
    counts = written(rows.sparkSession, sparse(counted.block_counts(blocks, "_g")).where(F.size("place") > 0))
    cells = counts.select("token", F.inline(F.arrays_zip("place", "c"))).withColumns({"fold": F.floor(F.col("place") / len(labels)), "_l": F.pmod("place", F.lit(len(labels)))})
    totals = {(r["fold"], r["_l"]): r["t"] for r in cells.groupBy("fold", "_l").agg(F.sum("c").alias("t")).collect()}  # a row for each fold and label
    in_folds = F.array_distinct(F.transform("place", lambda p: F.floor(p / len(labels))))
    met = counts.agg(F.count("*").alias("v"), *[F.count_if((F.size(in_folds) == 1) & (in_folds[0] == f)).alias(f"only{f}") for f in range(folds)]).first()
    docs = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    models = []
    for f in range(folds):
        n = [sum(docs.get((g, x), 0) for g in range(folds) if g != f) for x in labels]
        v = met["v"] - met[f"only{f}"]
        total = [sum(totals.get((g, i), 0) for g in range(folds) if g != f) + alpha * v for i in k]
        models.append((f, [float(x) / sum(n) if sum(n) else 1.0 / len(labels) for x in n], [float(x) for x in total]))
    model = rows.sparkSession.createDataFrame(models, "fold int, prior array<double>, total array<double>")

    def gains(c):
        c = c.reshape(len(c), folds, len(labels))
        other = c.sum(axis=1, keepdims=True) - c
        known = other.sum(axis=2, keepdims=True) > 0
        return np.concatenate([known, np.log((other + alpha) / alpha)], axis=2).reshape(len(c), folds * width)

    shared = counts.where(F.size(in_folds) > 1) if all(x in labels for _, x in docs) else counts  # where all rows have labels, a word of one fold is in no document whose model knows it
    sums = counted.block_sums(blocks, shared, folds * len(labels), gains, width, "fold")
    joined = rows.select("id", "fold", "label").join(F.broadcast(model), "fold").join(sums, "id", "left")
    n = F.coalesce(F.col("s")[0], F.lit(0.0))
    score = [F.when(F.col("prior")[i] > 0, F.ln(F.col("prior")[i]) + n * F.ln(F.lit(alpha) / F.col("total")[i]) + F.coalesce(F.col("s")[i + 1], F.lit(0.0))) for i in k]
    return joined.select("id", "fold", "label", n.cast("long").alias("n"), F.array(*[F.coalesce(c, F.lit(float("-inf"))) for c in score]).alias("scores"))


def scored_blocks(blocks: DataFrame, counts: DataFrame, prior: np.ndarray, none: np.ndarray, alpha: float = 0.1) -> DataFrame:
    """The blocks and, for each document, the place of its best label (y; the first, where scores are equal to six digits) and that label's posterior (confidence).

    counts: (token, place, c), how often each label has a word. prior: logarithms, minus infinity for labels that are never an answer; none: log probability of an unseen word.
    """
    keys = [c for c in blocks.columns if c not in ("block", "tokens", "n", "at", "tf")]
    more = [T.StructField("y", T.ArrayType(T.IntegerType())), T.StructField("confidence", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*[blocks.schema[c] for c in ("block", *keys, "tokens", "n", "at", "tf")], *more])

    def score(docs, n, at, tf, tokens, g):
        gains = np.where(g.any(axis=1, keepdims=True), np.log((g + alpha) / alpha) + none, 0)  # a word that no label has is left out
        s, row = np.tile(prior, (len(n), 1)), np.repeat(np.arange(len(n)), n)
        step = max(1, counted.SLICE // len(prior))
        for k in range(0, len(row), step):
            r = row[k : k + step]
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            s[r[first]] += np.add.reduceat(gains[at[k : k + step]] * tf[k : k + step, None], first)
        with np.errstate(invalid="ignore"):
            confidence = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
        y = np.argmax(np.floor(s * 1e6 + 0.5), axis=1)
        columns = [*[docs[c] for c in keys], tokens, *[pa.array(x) for x in (n, at, tf, y.astype(np.int32), confidence)]]
        columns = [counted.one_list(c) for c in columns]
        return pa.table([pa.array([uuid.uuid4().hex]), *columns], schema.names)

    return counted.with_answers(blocks, counts, len(prior), score, schema)


def model_tokens(tokens: DataFrame, labels: list[str], by: str, alpha: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The models of the rows of each value of ``by``: (by, token, g: gains of each label over an unseen token) and (by, prior, none: log probability of an unseen token; nulls for labels without rows). tokens: by, id, label, token, tf."""
    is_label = [F.col("label") == x for x in labels]
    k = range(len(labels))
    counts = tokens.groupBy(by, "token").agg(*[F.sum(F.when(c, F.col("tf")).otherwise(0)).alias(f"c{i}") for i, c in enumerate(is_label)])
    gains = counts.select(by, "token", F.array(*[F.ln((F.col(f"c{i}") + alpha) / alpha) for i in k]).alias("g"))
    totals = counts.groupBy(by).agg(F.count("*").alias("v"), *[F.sum(f"c{i}").alias(f"t{i}") for i in k])
    facts = totals.select(by, F.array(*[F.ln(F.lit(alpha) / (F.col(f"t{i}") + alpha * F.col("v"))) for i in k]).alias("none"))
    return gains, facts


def across(docs: DataFrame, labels: list[str], by: str, alpha: float = 0.1) -> DataFrame:
    """(by, id, y_pred): every row of docs (id, by, label, text) by the model of each value of ``by``. Words of the rows are summed by model where they are cut; a word has one vector with the gains of all models that know it, and documents are scored in blocks."""
    rows = docs.select("id", F.col(by).alias("_by"), "label", X.words(F.col("text"), True).alias("w"))
    n = rows.groupBy("_by").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == x).alias(f"d{i}") for i, x in enumerate(labels)]).where(F.col("_by").isNotNull())
    k, width = range(len(labels)), len(labels) + 1
    place = n.select("_by", (F.row_number().over(Window.orderBy("_by")) - 1).alias("_m"))  # a row for each model
    models = written(rows.sparkSession, n.join(place, "_by"))
    counts = rows.select("_by", "label", F.explode("w").alias("token")).groupBy("_by", "token").agg(*[F.count_if(F.col("label") == x).alias(f"c{i}") for i, x in enumerate(labels)])
    counts = written(rows.sparkSession, counts.join(F.broadcast(models.select("_by", "_m")), "_by"))
    gains = F.array(F.lit(1.0), *[F.ln((F.col(f"c{i}") + alpha) / alpha) for i in k])
    held = counts.select("token", F.arrays_zip(F.transform(F.array(*map(F.lit, range(width))), lambda i: (F.col("_m") * width + i).cast("int")).alias("at"), gains.alias("g")).alias("z")).select("token", F.filter("z", lambda x: x["g"] != 0).alias("z"))
    vectors = held.groupBy("token").agg(F.flatten(F.collect_list("z")).alias("z")).select("token", F.col("z.at").alias("at"), F.col("z.g").alias("g"))
    totals = counts.groupBy("_m").agg(F.count("*").alias("v"), *[F.sum(f"c{i}").alias(f"t{i}") for i in k])
    facts = models.join(totals, "_m").select("_by", "_m", F.array(*[F.when(F.col(f"d{i}") > 0, F.ln(F.col(f"d{i}") / F.col("n"))) for i in k]).alias("prior"), F.array(*[F.ln(F.lit(alpha) / (F.col(f"t{i}") + alpha * F.col("v"))) for i in k]).alias("none"))
    sums = counted.dotted(rows.select("id", F.array_join("w", " ").alias("t")), vectors, width * models.count())
    pairs = sums.crossJoin(F.broadcast(facts))  # rows by models is the result's own size
    s = F.slice("s", F.col("_m") * width + 1, F.lit(width))
    scored = pairs.select("_by", "id", "prior", "none", s.alias("s"))
    score = F.array(*[F.coalesce(F.col("prior")[i] + F.col("s")[0] * F.col("none")[i] + F.col("s")[i + 1], F.lit(float("-inf"))) for i in k])
    return scored.select(F.col("_by").alias(by), "id", best_label(score, labels).alias("y_pred"))


def word_contributions(rows: DataFrame, labels: list[str], k: int = 10, alpha: float = 0.1) -> DataFrame:
    """As top_contributions, of the words of rows (id, label, text). A block of documents gets the counts of each of its words once, and gives the words that stay; nothing else of a document travels."""
    same = counted.one_row(rows.select("id", "label", F.array("text").alias("w")), "id", "label").select("id", "label", F.array_join("w", " ").alias("text"))
    blocks = word_blocks_by(same, labels)
    counts = written(rows.sparkSession, sparse(counted.block_counts(blocks, "_g")))
    totals = {r["place"]: r["t"] for r in counts.select(F.inline(F.arrays_zip("place", "c"))).groupBy("place").agg(F.sum("c").alias("t")).collect()}  # a row for each label
    v = counts.count()
    none = np.log(alpha / np.array([totals.get(i, 0) + alpha * max(v, 1) for i in range(len(labels))]))
    schema = T.StructType([rows.schema["id"], T.StructField("token", T.StringType()), T.StructField("weight", T.DoubleType())])

    def best(docs, n, at, tf, tokens, g):
        gains = np.log((g + alpha) / alpha)
        c = gains - gains.mean(axis=1, keepdims=True) + none - none.mean()
        row, label = np.repeat(np.arange(len(n)), n), docs["_g"].to_numpy()
        scaled = np.abs(x := tf * c[at, label[row]]) * 1e6
        w = np.sign(x) * (np.floor(scaled) + (scaled - np.floor(scaled) >= 0.5)) / 1e6
        name = np.empty(len(tokens), np.int64)
        name[pc.array_sort_indices(tokens).to_numpy()] = np.arange(len(tokens))
        kept = []
        for some in (np.flatnonzero((w > 0) & (label[row] >= 0)), np.flatnonzero((w < 0) & (label[row] >= 0))):
            some = some[np.lexsort((name[at[some]], -np.abs(w[some]), row[some]))]
            first = np.flatnonzero(np.append(True, row[some][1:] != row[some][:-1])) if len(some) else np.zeros(0, np.int64)
            kept.append(some[np.arange(len(some)) - np.repeat(first, np.diff(np.append(first, len(some)))) < k])
        kept = np.concatenate(kept)
        return pa.table([docs["id"].take(pa.array(row[kept])), tokens.take(pa.array(at[kept])), pa.array(w[kept])], ["id", "token", "weight"])

    found = counted.with_answers(blocks, counts, len(labels), best, schema)
    order = Window.partitionBy("id", F.col("weight") > 0).orderBy(F.desc(F.abs("weight")), "token")  # an id may have rows of several labels
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.when(F.col("weight") > 0, F.col("rank")).otherwise(-F.col("rank")))


def top_contributions(tokens: DataFrame, labels: list[str], chosen: DataFrame, k: int = 10) -> DataFrame:
    """(id, token, weight, rank): what each token adds to the chosen label's score beyond the mean of all labels, tf times coefficient; per row the k largest and the k least.

    Ranks are cut to k in every task before rows meet. chosen: id, label. tokens: id, label, token, tf, of the rows learnt from and explained.
    """
    gains, facts = model_tokens(tokens.withColumn("_all", F.lit(0)), labels, "_all")
    none = facts.first()["none"]
    mean = sum(none) / len(none)
    c = F.transform(F.col("g"), lambda g: g - F.aggregate("g", F.lit(0.0), lambda a, x: a + x) / len(labels))
    coefficients = gains.select("token", F.zip_with(c, F.array(*[F.lit(x - mean) for x in none]), lambda a, b: a + b).alias("c"))
    at = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int")
    rows = tokens.select("id", "token", "tf").join(chosen.select("id", at.alias("at")), "id").join(coefficients, "token")
    rows = rows.select("id", "token", F.round(F.col("tf") * F.element_at("c", F.col("at")), 6).alias("weight"))
    best, least = Window.partitionBy("id").orderBy(F.desc("weight"), "token"), Window.partitionBy("id").orderBy("weight", "token")
    up = rows.where("weight > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    down = rows.where("weight < 0").withColumn("rank", -F.row_number().over(least)).where(F.col("rank") >= -k)
    return up.unionByName(down)


def posterior(scores: Column, n: Column) -> Column:
    """Shares of the labels by the mean log probability of a token: a long text does not make every answer certain."""
    each = F.transform(scores, lambda s: s / F.greatest(n, F.lit(1)))
    top = F.array_max(each)
    weights = F.transform(each, lambda s: F.exp(s - top))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def best_label(scores: Column, labels: list[str], digits: int = 6) -> Column:
    """The first label of the largest score."""
    rounded = F.transform(scores, lambda s: F.round(s, digits))
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(rounded, F.array_max(rounded)).cast("int"))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
