"""Classifiers and what surrounds them: naive Bayes as aggregates, MLlib fits, TF-IDF, self-training."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpusloom.functions import text as X
from corpusloom.operators import bayes, counted
from corpusloom.operators.corpus import written


def token_counts(df: DataFrame, *keep: str) -> DataFrame:
    """(id, kept columns, token, tf), counted where a document lies."""
    return bayes.word_tokens(df, *keep)


def gram_tfidf(df: DataFrame) -> DataFrame:
    """(id, token, weight) of words of letters, digits and underscores, and of pairs of neighbours joined by a space."""
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    return counted.tfidf_by_block(df.select("id", F.array_join(w, " ").alias("t")), counted.word_pairs).drop("rank")


def char_wb_tfidf(df: DataFrame, best: int) -> DataFrame:
    """(id, token, weight, rank) of character n-grams inside space-padded words, the heaviest of each document. A padded word no longer than n is emitted whole, once."""
    return counted.tfidf_by_block(df.select("id", F.array_join(X.spaced_words(F.col("text")), " ").alias("t")), cut=counted.char_wb_pieces, best=best)


def naive_bayes(train: DataFrame, test: DataFrame, label: str, alpha: float = 0.1, confidence: bool = False, by: tuple[str, ...] = (), chars: int | None = None) -> DataFrame:
    """(id, by, y_pred, and the posterior of that if confidence): multinomial naive Bayes, unseen test tokens left out; ties go to the smallest label.

    The prior is the share of training rows; a document without known tokens gets the most frequent label.
    by: columns of train and test; each of their values has a model of its own, so that folds or corpora are fitted in one job.
    Training words are summed by label where they are cut, test words are scored in blocks of documents.
    chars: of all test texts, about, if they are dear to make.
    """
    labels = sorted(r[0] for r in train.where(F.col(label).isNotNull()).select(label).distinct().collect())  # a row for each label
    k = range(len(labels))
    train = train.where(F.col(label).isNotNull()).select(*by, F.col(label).alias("label"), X.words(F.col("text"), True).alias("w"))
    each = lambda c, name: [F.sum(F.when(F.col("label") == x, c).otherwise(0)).alias(f"{name}{i}") for i, x in enumerate(labels)]
    counts = written(train.sparkSession, train.select(*by, "label", F.explode("w").alias("token")).groupBy(*by, "token").agg(*each(F.lit(1), "c")))
    one = F.lit(0).alias("_one")
    size = counts.groupBy(*by, one).agg(F.count("*").alias("v"), *[F.sum(f"c{i}").alias(f"t{i}") for i in k])
    models = train.groupBy(*by, one).agg(F.count("*").alias("docs"), *each(F.lit(1), "d")).join(size, [*by, "_one"])
    unseen = [F.ln(alpha / (F.col(f"t{i}") + alpha * F.col("v"))) for i in k]
    prior = [F.when(F.col(f"t{i}") > 0, F.ln(F.col(f"d{i}") / F.col("docs"))) for i in k]  # a label without words is never an answer
    models = F.broadcast(models.select(*by, "_one", F.array(*prior).alias("prior"), F.array(*unseen).alias("none")))  # a row for each model
    vectors = counts.select(*by, "token", F.array(*map(F.lit, range(len(labels) + 1))).alias("at"), F.array(F.lit(1.0), *[F.ln((F.col(f"c{i}") + alpha) / alpha) for i in k]).alias("g"))
    sums = counted.dotted(test.select("id", *by, F.array_join(X.words(F.col("text"), True), " ").alias("t")), vectors, len(labels) + 1, by, chars=chars)
    scored = sums.withColumn("_one", one).join(models, [*by, "_one"])
    score = F.array(*[F.coalesce(F.col("prior")[i] + F.col("s")[0] * F.col("none")[i] + F.col("s")[i + 1], F.lit(float("-inf"))) for i in k])
    scored = scored.select("id", *by, score.alias("scores"))
    out = scored.select("id", *by, bayes.best_label(F.col("scores"), labels).alias("y_pred"), "scores")
    if confidence:
        top = F.array_max("scores")
        return out.select("id", *by, "y_pred", (1 / F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("confidence"))
    return out.drop("scores")


def cross_validated(df: DataFrame, label: str, folds: int, fold) -> DataFrame:
    """(id, fold, y_true, y_pred): each row's prediction by a naive Bayes model of the other folds' rows. fold: a Column, 0 to folds - 1."""
    labels = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    rows = df.select("id", "text", F.col(label).alias("label"), fold.cast("int").alias("fold"))
    found = bayes.words_out_of_fold(rows, labels, folds)
    return found.select("id", "fold", F.col("label").alias("y_true"), bayes.best_label(F.col("scores"), labels).alias("y_pred"))


def majority_prior(train: DataFrame, label: str) -> DataFrame:
    n = train.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """n / (k * count)."""
    n = train.groupBy(label).agg(F.count("*").alias("count"))
    return n.withColumn("weight", F.sum("count").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("count")))


def classifier(kind: str, label: str, features: int = 1 << 14, trees: int = 100) -> Pipeline:
    """TF-IDF of hashed words and an MLlib classifier: logistic_regression, linear_svm or random_forest. Rows are weighted by the column weight."""
    made = {
        "logistic_regression": lambda: LogisticRegression(labelCol="y", featuresCol="x", weightCol="weight", family="multinomial", regParam=1e-4, maxIter=100, tol=1e-4),
        "linear_svm": lambda: OneVsRest(classifier=LinearSVC(featuresCol="x", labelCol="y", maxIter=20, tol=1e-4, regParam=1e-3), labelCol="y", featuresCol="x", weightCol="weight", parallelism=4),
        "random_forest": lambda: RandomForestClassifier(labelCol="y", featuresCol="x", weightCol="weight", numTrees=trees, maxDepth=8, seed=42),
    }[kind]()
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip")
    return Pipeline(stages=[index, HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="x"), made])


#: Rows of one task of a forest: it holds a row as one number for each feature, 64 KB with 2**14 features.
FOREST_ROWS = 4096


def fitted(kind: str, rows: DataFrame, label: str) -> PipelineModel:
    """The classifier fitted on rows (text, label, weight). Texts are cut and hashed once and stored as sparse vectors; a forest is grown in tasks of so many rows, however many there are."""
    index, hashing, idf, norm, made = classifier(kind, label).getStages()
    index = index.fit(rows)
    hashed = hashing.transform(index.transform(rows.withColumn("tokens", X.words(F.col("text"), True))))
    hashed = written(rows.sparkSession, hashed.select("y", "weight", "tf"))
    idf = idf.fit(hashed)
    vectors = norm.transform(idf.transform(hashed)).select("y", "weight", "x")
    if kind == "random_forest":
        vectors = vectors.repartition(max(-(-hashed.count() // FOREST_ROWS), rows.sparkSession.sparkContext.defaultParallelism))
    return PipelineModel([index, hashing, idf, norm, made.fit(vectors)])


def fit_predict(kind: str, train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """(id, y_true, y_pred) of a fitted classifier on other rows; classes weigh the same."""
    weights = F.broadcast(class_weights(train.where(F.col(label).isNotNull()), label).select(label, "weight"))  # a row for each label
    model = fitted(kind, train.join(weights, label), label)
    names = F.array(*map(F.lit, model.stages[0].labels))
    scored = model.transform(test.withColumn("tokens", X.words(F.col("text"), True)))
    return scored.select("id", F.col(label).alias("y_true"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("y_pred"))


def self_train(train: DataFrame, pool: DataFrame, label: str, rounds: int = 3, threshold: float = 0.90, cap: int | None = None, alpha: float = 0.1) -> DataFrame:
    """(label, n, round): pool rows that naive Bayes is sure of (posterior at the threshold or above) join the training rows, round after round, until none does.

    cap: the most confident rows a round may add; without it all that pass. Pool rows that share an id (null is one) are judged as one and join together.
    Texts are cut once, into blocks of documents. A round gives each block the counts of its words, adds the words of what is sure to the
    counts, and leaves the other documents to the next: the model is that of a fit from scratch, but no text is read or sent again.
    """
    spark = train.sparkSession
    learnt = train.where(F.col(label).isNotNull())
    docs = {r[label]: r["count"] for r in learnt.groupBy(label).count().collect()}  # a row for each label
    labels = sorted(docs)
    k, found = range(len(labels)), []
    if labels:
        own = bayes.word_blocks_by(learnt.select("id", "text", F.col(label).alias("label")), labels)
        counts = _label_counts(counted.counts_in_blocks(own, "_g"), len(labels))
        same = counted.one_row(pool.select("id", F.array("text").alias("w")), "id")
        left = counted.word_blocks(same.select("id", F.size("w").alias("rows"), F.array_join("w", " ").alias("text")))
    for r in range(rounds if labels else 0):
        size = counts.agg(F.count("*").alias("v"), *[F.sum(F.col("c")[i]).alias(f"t{i}") for i in k]).first()
        total = np.array([size[f"t{i}"] or 0 for i in k], float)
        prior = np.log(np.array([docs[x] for x in labels]) / sum(docs.values()))
        prior[total == 0] = -np.inf  # a label without words is never an answer
        scored = written(spark, bayes.scored_blocks(left, counts, prior, np.log(alpha / (total + alpha * max(size["v"], 1))), alpha))
        passes = lambda x: (x["confidence"] >= threshold) & ~F.isnan(x["confidence"])
        if cap is not None:
            each = scored.select(F.inline(F.arrays_zip("id", "confidence"))).where(passes({c: F.col(c) for c in ("id", "confidence")}))
            last = each.orderBy(F.desc("confidence"), "id").limit(cap).orderBy("confidence", F.desc("id")).first()
            if last is None:
                break
            sure = lambda x: passes(x) & ((x["confidence"] > last["confidence"]) | (x["confidence"] == last["confidence"]) & (x["id"].isNull() | F.coalesce(x["id"] <= F.lit(last["id"]), F.lit(False))))
        else:
            sure = passes
        scored = scored.withColumn("_g", F.transform(F.arrays_zip("id", "y", "confidence"), lambda x: F.when(sure(x), x["y"]).otherwise(F.lit(-1))))
        added = {a["_g"]: a for a in scored.select(F.inline(F.arrays_zip("_g", "rows"))).groupBy("_g").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).collect()}  # a row for each label
        rest = added.pop(-1, None)
        if not added:
            break
        found += [(labels[i], a["n"], r) for i, a in sorted(added.items())]
        if rest is None or r == rounds - 1:
            break
        docs = {x: docs[x] + (added[i]["rows"] if i in added else 0) for i, x in enumerate(labels)}
        before = counts.select(F.posexplode("c").alias("_g", "c"), "token").select("_g", "token", "c").where("c > 0")
        counts = _label_counts(counted.counts_in_blocks(scored, "_g").unionByName(before), len(labels))
        left = written(spark, counted.documents_left(scored.drop("y", "confidence"), "_g").drop("_g"))
    kinds = [T.StructField(label, train.schema[label].dataType), T.StructField("n", T.LongType(), False), T.StructField("round", T.IntegerType(), False)]
    return spark.createDataFrame(found, T.StructType(kinds))  # a row for each round and label


def _label_counts(rows: DataFrame, labels: int) -> DataFrame:
    """(token, place, c), stored, of rows (_g, token, c): how often each label has a word; those without one (-1) are left out."""
    sums = rows.where("_g >= 0").groupBy("token").agg(F.array(*[F.sum(F.when(F.col("_g") == i, F.col("c")).otherwise(0)) for i in range(labels)]).alias("c"))
    return written(rows.sparkSession, sums.select("token", F.array(*[F.lit(i) for i in range(labels)]).alias("place"), "c"))
