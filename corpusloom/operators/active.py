"""Active learning with naive Bayes: counts take in what is newly labelled by addition; nothing is counted twice."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import arrays as A, text as X
from corpusloom.operators import bayes as B, counted
from corpusloom.operators.corpus import written

STRATEGIES = ("entropy", "margin", "least_confidence", "intensity_gated", "random")


def _order(id_: str, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), F.col(id_)), F.col(id_)]


def round_robin_seed(pool: DataFrame, label: str, size: int, seed: int = 0, order: list[Column] | None = None) -> DataFrame:
    """(id): one row of each class in turn, classes in order of name, rows of a class in a seeded order, until there are ``size``. Classes that run out are passed over.

    Only the first ``size`` rows of a class can be taken, so each task drops the others before rows meet.
    """
    turn = Window.partitionBy(label).orderBy(*(order or _order("id", seed)))
    ranked = pool.where(F.col(label).isNotNull()).select("id", label).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= size)
    return ranked.orderBy("turn", label).limit(size).select("id")


def acquisition_score(strategy: str, p: Column, intensity: Column, least: float = 0.0) -> Column:
    """How much a label would tell. intensity_gated: entropy times the text's dialect intensity, 0 under the least intensity."""
    if strategy == "entropy":
        return A.normalised_entropy(p)
    if strategy == "margin":
        return 1 - A.margin(p)
    if strategy == "least_confidence":
        return A.least_confidence(p)
    if strategy == "intensity_gated":
        return A.normalised_entropy(p) * F.when(intensity >= least, intensity).otherwise(0.0)
    raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")


class Counts:
    """Naive Bayes counts that grow: of rows by label, and of tokens by label, stored after every addition."""

    def __init__(self, labels: list[str], alpha: float = 0.1) -> None:
        self.labels, self.alpha, self.docs, self.tokens = labels, alpha, None, None

    def add(self, rows: DataFrame, tokens: DataFrame) -> Counts:
        """rows: id, label; tokens: id, token, tf of any rows. Those of ``rows`` are added."""
        spark = rows.sparkSession
        met = tokens.select("id", "token", "tf").join(rows.select("id", "label"), "id")
        docs, new = rows.groupBy("label").agg(F.count("*").alias("n")), met.groupBy("label", "token").agg(F.sum("tf").alias("c"))
        self.docs = written(spark, docs if self.docs is None else self.docs.unionByName(docs).groupBy("label").agg(F.sum("n").alias("n")))
        self.tokens = written(spark, new if self.tokens is None else self.tokens.unionByName(new).groupBy("label", "token").agg(F.sum("c").alias("c")))
        return self

    def learn(self, rows: DataFrame) -> Counts:
        """The counts of rows (id, text, label), summed where the words are cut."""
        spark, place = rows.sparkSession, F.array(*map(F.lit, self.labels))
        counts = counted.block_counts(B.word_blocks_by(rows, self.labels), "_g").where("_g >= 0")
        self.docs = written(spark, rows.groupBy("label").agg(F.count("*").alias("n")))
        self.tokens = written(spark, counts.select(F.element_at(place, F.col("_g") + 1).alias("label"), "token", "c"))
        return self

    def scored(self, texts: DataFrame) -> DataFrame:
        """As posteriors, of rows (id, text): a block of them gets the counts of each of its words once."""
        at = (F.array_position(F.array(*map(F.lit, self.labels)), F.col("label")) - 1).cast("int")
        counts, size = B.sparse(self.tokens.select(at.alias("_g"), "token", "c")), len(self.labels)
        alpha = self.alpha
        known = lambda c: np.concatenate([c.sum(axis=1, keepdims=True) > 0, np.log((c + alpha) / alpha)], axis=1)
        sums = counted.block_sums(counted.word_blocks(texts.select("id", "text")), counts, size, known, size + 1)
        return self._scores(texts.select("id"), sums.select("id", F.col("s")[0].cast("long").alias("n"), *[F.col("s")[i + 1].alias(f"s{i}") for i in range(size)]))

    def posteriors(self, ids: DataFrame, tokens: DataFrame) -> DataFrame:
        """(id, n, scores) of rows by id."""
        labels, k = self.labels, range(len(self.labels))
        wide = self.tokens.groupBy("token").agg(*[F.sum(F.when(F.col("label") == x, F.col("c")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(labels)])
        gains = wide.select("token", *[F.ln((F.col(f"c{i}") + self.alpha) / self.alpha).alias(f"g{i}") for i in k])
        sums = tokens.select("id", "token", "tf").join(ids, "id", "left_semi").join(gains, "token").groupBy("id").agg(F.sum("tf").alias("n"), *[F.sum(F.col("tf") * F.col(f"g{i}")).alias(f"s{i}") for i in k])
        return self._scores(ids.select("id"), sums)

    def _scores(self, ids: DataFrame, sums: DataFrame) -> DataFrame:
        labels, k = self.labels, range(len(self.labels))
        v = self.tokens.select("token").distinct().count()
        totals = {r["label"]: r["t"] for r in self.tokens.groupBy("label").agg(F.sum("c").alias("t")).collect()}  # a row for each label
        docs = {r["label"]: r["n"] for r in self.docs.collect()}
        n = F.coalesce("n", F.lit(0))
        total = sum(docs.values())

        def score(i: int, label: str) -> Column:
            if not docs.get(label):
                return F.lit(float("-inf"))
            return F.ln(F.lit(docs[label] / total)) + n * F.ln(F.lit(self.alpha / (totals.get(label, 0) + self.alpha * max(v, 1)))) + F.coalesce(f"s{i}", F.lit(0.0))

        return ids.join(sums, "id", "left").select("id", n.alias("n"), F.array(*[score(i, x) for i, x in enumerate(labels)]).alias("scores"))


def active_loop(pool: DataFrame, test: DataFrame, labels: list[str], strategy: str = "entropy", seed_size: int = 20, batch_size: int = 20, rounds: int = 5, seed: int = 0) -> DataFrame:
    """(round, n_labeled, accuracy, f1_macro): rows of the pool (id, text, label) are labelled round by round, the most telling first, ties by id; every round is scored on the same test rows. Ends when the pool does. Rows without a label are never asked for."""
    if min(seed_size, batch_size, rounds) < 1:
        raise ValueError("seed_size, batch_size and rounds must be 1 or more")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    from corpusloom.operators.evaluation import averaged, class_metrics

    spark = pool.sparkSession
    pool = written(spark, pool.where(F.col("label").isNotNull()).select("id", "text", "label"))
    if seed_size > pool.count():
        raise ValueError(f"seed_size {seed_size} is more than the pool holds")
    tokens, held_out = written(spark, B.word_tokens(pool)), written(spark, B.word_tokens(test.select("id", "text")))
    new = written(spark, round_robin_seed(pool, "label", seed_size, seed).join(pool.select("id", "label"), "id"))
    taken, counts, out = new.select("id"), Counts(labels), []
    for r in range(rounds + 1):
        if r:
            left = pool.select("id").join(taken, "id", "left_anti")
            if strategy == "random":
                ranked = left.orderBy(*_order("id", seed + r))
            else:
                found = counts.posteriors(left, tokens).join(pool.select("id", X.intensity(F.col("text")).alias("intensity")) if strategy == "intensity_gated" else left.select("id", F.lit(0.0).alias("intensity")), "id")
                score = acquisition_score(strategy, B.posterior(F.col("scores"), F.lit(1)), F.col("intensity"))
                ranked = found.withColumn("score", F.round(F.greatest(score, F.lit(0.0)), 6)).orderBy(F.desc("score"), "id")
            new = written(spark, ranked.limit(batch_size).select("id").join(pool.select("id", "label"), "id"))
            if new.isEmpty():
                break
            taken = written(spark, taken.unionByName(new.select("id")))
        counts.add(new, tokens)
        found = counts.posteriors(test.select("id"), held_out).select("id", B.best_label(F.col("scores"), labels).alias("y_pred"))
        m = averaged(class_metrics(found.join(test.select("id", F.col("label").alias("y_true")), "id").where("y_true IS NOT NULL"))).first()
        out.append((r, taken.count(), m["accuracy"], m["macro_f1"]))
    return spark.createDataFrame(out, "round int, n_labeled long, accuracy double, f1_macro double")


def learning_curve(train: DataFrame, test: DataFrame, labels: list[str], fractions: list[float], seed: int = 0) -> DataFrame:
    """(fraction, n_train, accuracy, f1_macro): of each class the first max(1, ceil(fraction * n)) rows in a seeded order, so that a larger part holds a smaller one and its counts take in only what is new.

    Where a class's part ends is an order statistic of its rows' draws: no task ranks a class.
    """
    from corpusloom.operators.evaluation import averaged, class_metrics
    from corpusloom.operators.ranks import order_statistics

    parts = sorted(set(fractions))
    if not parts or not 0 < parts[0] <= parts[-1] <= 1:
        raise ValueError("fractions must lie in (0, 1]")
    spark = train.sparkSession
    draw = F.floor(F.xxhash64(F.lit(seed), "id") / 2048).cast("double")
    rows = train.where(F.col("label").isNotNull()).select("id", "text", "label", draw.alias("draw"))
    drawn = written(spark, rows.select("label", "draw"))
    size = lambda f, n: max(1, math.ceil(f * n - 1e-9))
    n = {r["label"]: r["n"] for r in drawn.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row for each label
    ends = order_statistics(drawn, "draw", lambda k: [size(f, k) for f in parts], "label")
    of = F.element_at(F.create_map(*[x for label, k in n.items() for x in (F.lit(label), F.array(*[F.lit(ends[label, size(f, k)]) for f in parts]))]), F.col("label"))
    part = F.size(F.filter(of, lambda e: e < F.col("draw")))  # the first that holds a row
    docs = {(r["part"], r["label"]): r["n"] for r in drawn.groupBy(part.alias("part"), "label").agg(F.count("*").alias("n")).collect()}
    p, k, width = len(parts), len(labels) + 1, len(labels) + 1  # the last place is that of labels that are not named
    slot = F.when(part < p, part)
    counts = written(spark, B.sparse(counted.block_counts(B.word_blocks_by(rows, labels, slot=slot, other=True), "_g")).where(F.size("place") > 0))
    totals = {r["place"]: r["t"] for r in counts.select(F.inline(F.arrays_zip("place", "c"))).groupBy("place").agg(F.sum("c").alias("t")).collect()}  # a row for each part and label
    first = {r["part"]: r["n"] for r in counts.groupBy(F.floor(F.array_min("place") / k).alias("part")).agg(F.count("*").alias("n")).collect()}
    alpha = 0.1

    def gains(c):
        c = c.reshape(len(c), p, k).cumsum(axis=1)
        return np.concatenate([c.sum(axis=2, keepdims=True) > 0, np.log((c[:, :, :-1] + alpha) / alpha)], axis=2).reshape(len(c), p * width)

    sums = counted.block_sums(counted.word_blocks(test.select("id", "text")), counts, p * k, gains, p * width)
    scored, out = written(spark, test.select("id", F.col("label").alias("y_true")).join(sums, "id", "left")), []
    for j, f in enumerate(parts):
        have = {x: sum(docs.get((i, x), 0) for i in range(j + 1)) for x in n}
        v, whole = max(sum(first.get(i, 0) for i in range(j + 1)), 1), sum(have.values())
        s = lambda i: F.coalesce(F.col("s")[j * width + i], F.lit(0.0))  # noqa: B023, E731
        score = [F.lit(math.log(have[x] / whole)) + s(0) * F.lit(math.log(alpha / (sum(totals.get(q * k + i, 0) for q in range(j + 1)) + alpha * v))) + s(i + 1) if have.get(x) else F.lit(float("-inf")) for i, x in enumerate(labels)]
        m = averaged(class_metrics(scored.select("id", "y_true", B.best_label(F.array(*score), labels).alias("y_pred")).where("y_true IS NOT NULL"))).first()
        out.append((f, whole, m["accuracy"], m["macro_f1"]))
    return spark.createDataFrame(out, "fraction double, n_train long, accuracy double, f1_macro double")
