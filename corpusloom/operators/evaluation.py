"""Evaluation of prediction rows (id, y_true, y_pred, conf, p, source, n_chars): all as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions import text as X
from corpusloom.operators.ranks import falling, order_statistics, quantiles, running


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_normalised(df: DataFrame) -> DataFrame:
    c = confusion(df)
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y_true")))


def class_metrics(df: DataFrame, *by: str) -> DataFrame:
    """precision, recall, f1, support of each observed label; 0 where undefined."""
    each = df.select(*by, F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("e"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("hit"))
    each = each.groupBy(*by, "e.label").agg(F.sum(F.col("e.t") * F.col("hit")).alias("tp"), F.sum("e.p").alias("predicted"), F.sum("e.t").alias("support"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    each = each.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    return each.withColumn("f1", ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")))


def averaged(metrics: DataFrame, *by: str) -> DataFrame:
    """Macro over observed labels, weighted by support, balanced over labels with support, accuracy."""
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return metrics.groupBy(*by).agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")], F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), (F.sum("tp") / F.sum("support")).alias("accuracy")
    )


def auc(df: DataFrame, score: str, positive, *by: str) -> DataFrame:
    """Area under the ROC curve from counts by distinct score: rows with one score are one row before anything is ranked."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    below = running(counts, [F.col(score)], {"n": F.col("n")}, by).withColumn("less", F.col("n_upto") - F.col("n"))
    return below.groupBy(*by).agg((F.sum(F.col("p") * (F.col("less") + F.col("n") / 2)) / F.when(F.sum("p") * F.sum("n") > 0, (F.sum("p") * F.sum("n")).cast("double"))).alias("auc"))


def calibration(df: DataFrame, edges: list[float]) -> DataFrame:
    """Right-closed bins of confidence, empty ones left out: bin, n, confidence, accuracy."""
    inner = F.array(*[F.lit(e) for e in edges[1:-1]])
    bin_ = F.size(F.filter(inner, lambda e: F.col("conf") > e))
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("confidence"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def calibration_errors(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return bins.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def quantile_edges(df: DataFrame, n_bins: int, value: str = "conf") -> list[float]:
    """Edges of bins of equal counts, from 0 to 1, equal ones once."""
    inner = quantiles(df, value, [i / n_bins for i in range(1, n_bins)]).get(0, [])
    return sorted({0.0, 1.0, *inner})


def risk_coverage(df: DataFrame) -> DataFrame:
    """By falling confidence, ties in order of id: coverage and risk after each row, from running sums over ranges."""
    wrong = (F.col("y_true") != F.col("y_pred")).cast("long")
    rows = running(df.select("id", "conf", "y_true", "y_pred"), [falling(F.col("conf")), F.col("id")], {"one": F.lit(1), "wrong": wrong})
    n = df.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(n)).select("id", F.col("one_upto").alias("k"), (F.col("one_upto") / F.col("n")).alias("coverage"), (F.col("wrong_upto") / F.col("one_upto")).alias("risk"))


def selective_report(curve: DataFrame, coverages: tuple = (0.5, 0.8, 0.9, 1.0), errors: tuple = (0.01, 0.05, 0.1, 0.2)) -> DataFrame:
    """(kind, target, coverage, risk) from ``risk_coverage``: aurc, the mean risk; at each coverage the first row that reaches it; at each error the largest coverage whose risk is not above it (none: 0, null)."""
    first = [F.min_by(F.struct("coverage", "risk"), F.when(F.col("coverage") >= c - 1e-12, F.col("coverage"))).alias(f"c{i}") for i, c in enumerate(coverages)]
    most = [F.max_by(F.struct("coverage", "risk"), F.when(F.col("risk") <= e + 1e-12, F.col("coverage"))).alias(f"e{i}") for i, e in enumerate(errors)]
    one = curve.agg(F.avg("risk").alias("aurc"), *first, *most)
    row = lambda kind, target, coverage, risk: F.struct(F.lit(kind).alias("kind"), F.lit(target).cast("double").alias("target"), coverage.alias("coverage"), risk.alias("risk"))
    rows = [row("aurc", None, F.lit(None).cast("double"), F.col("aurc"))]
    rows += [row("coverage", c, F.col(f"c{i}.coverage"), F.col(f"c{i}.risk")) for i, c in enumerate(coverages)]
    rows += [row("error", e, F.coalesce(F.col(f"e{i}.coverage"), F.lit(0.0)), F.col(f"e{i}.risk")) for i, e in enumerate(errors)]
    return one.select(F.inline(F.array(*rows)))


def hierarchical(df: DataFrame, parent) -> DataFrame:
    """Exact, family, half-credit and ancestor-set F1. parent: Column function from label to family."""
    exact, family = F.col("y_true") == F.col("y_pred"), parent(F.col("y_true")) == parent(F.col("y_pred"))
    shared = F.when(exact, 2).when(family, 1).otherwise(0)
    return df.agg(F.avg(exact.cast("double")).alias("exact"), F.avg(family.cast("double")).alias("family"), F.avg(F.when(exact, 1.0).when(family, 0.5).otherwise(0.0)).alias("partial"), (2 * F.sum(shared) / (4 * F.count("*"))).alias("ancestor_f1"))


def slices(df: DataFrame, low_support: int = 5) -> DataFrame:
    """Accuracy and macro-F1 by (dimension, value)."""
    each = df.select("y_true", "y_pred", F.explode(F.array(F.struct(F.lit("source").alias("dimension"), F.col("source").alias("value")), F.struct(F.lit("length").alias("dimension"), X.length_band(F.col("n_chars")).alias("value")))).alias("s")).select("y_true", "y_pred", "s.*").where("value IS NOT NULL")
    both = averaged(class_metrics(each, "dimension", "value"), "dimension", "value").select("dimension", "value", "accuracy", "macro_f1")
    n = each.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return both.join(n, ["dimension", "value"]).withColumn("low_support", F.col("n") < low_support)


def fairness(sliced: DataFrame) -> DataFrame:
    """Best and worst value of each dimension with two or more (ties to the smallest name), gap and ratio; p of a two-sided two-proportion z-test of the two (1 where all or none are right), and Holm's over the dimensions."""
    best, worst = F.min(F.struct(-F.col("accuracy"), "value", "n")), F.min(F.struct("accuracy", "value", "n"))
    out = sliced.groupBy("dimension").agg(F.count("*").alias("groups"), best.alias("b"), worst.alias("w"), (F.max("accuracy") - F.min("accuracy")).alias("gap"), F.when(F.max("accuracy") > 0, F.min("accuracy") / F.max("accuracy")).alias("ratio")).where("groups >= 2")
    n_b, n_w = F.col("b.n"), F.col("w.n")
    pooled = (F.col("w.accuracy") * n_w + (F.col("w.accuracy") + F.col("gap")) * n_b) / (n_w + n_b)
    z = F.col("gap") / F.sqrt(pooled * (1 - pooled) * (1 / n_b + 1 / n_w))
    tested = out.withColumn("p", F.when((pooled > 0) & (pooled < 1), two_sided(z)).otherwise(1.0))
    return holm(tested, "p", "dimension").select("dimension", "groups", F.col("b.value").alias("best"), F.col("w.value").alias("worst"), "gap", "ratio", "p", "adjusted")


def two_sided(z):
    """Two-sided p of a standard normal z, of relative error under 1.2e-7, as one expression: a fitted form of the complementary error function."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    inner = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        inner = F.lit(c) + t * inner
    return t * F.exp(-x * x + inner)


def confused(df: DataFrame, k: int = 10) -> DataFrame:
    return confusion(df).where("y_true != y_pred").orderBy(F.desc("n"), "y_true", "y_pred").limit(k)


def holm(df: DataFrame, p: str, order: str) -> DataFrame:
    """Step-down adjusted p-values over a small table of tests."""
    w = Window.orderBy(p, order)
    n = F.count("*").over(Window.partitionBy())
    return df.withColumn("_s", (n - F.row_number().over(w) + 1) * F.col(p)).withColumn("adjusted", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def conformal_quantile(df: DataFrame, alpha: float, by: str | None = None, classes: list[str] | None = None) -> DataFrame:
    """(by, q): the ceil((n + 1)(1 - alpha))-th smallest score, 1 where there are too few. Of the classes named, those without a score get that of all rows."""

    def of(key: str | None) -> dict:
        rank = lambda n: math.ceil((n + 1) * (1 - alpha) - 1e-9)
        found = order_statistics(df, "score", lambda n: [rank(n)] if rank(n) <= n else [], key)
        groups = [r[0] for r in df.where("score IS NOT NULL AND NOT isnan(score)").select(F.col(key) if key else F.lit(0)).distinct().collect()]
        got = {g: q for (g, _), q in found.items()}
        return {g: got.get(g, 1.0) for g in groups}

    spark = df.sparkSession
    if by is None:
        return spark.createDataFrame([(of(None).get(0, 1.0),)], "q double")
    each = of(by)
    if missing := set(classes or ()) - set(each):
        each |= dict.fromkeys(missing, of(None).get(0, 1.0))
    return spark.createDataFrame(list(each.items()), f"{by} string, q double")


def conformal_coverage(df: DataFrame, members: str, truth: str = "y_true") -> DataFrame:
    """(n, coverage, mean_set_size) of sets of labels."""
    return df.agg(F.count("*").alias("n"), F.avg(F.array_contains(members, F.col(truth)).cast("double")).alias("coverage"), F.avg(F.size(members)).alias("mean_set_size"))


def openset_report(df: DataFrame, members: str, score: str, classes: list[str], truth: str = "y_true") -> DataFrame:
    """Of rows whose label is among the classes: coverage and false novelty; of others: detection; area under the curve of the novelty score. An empty set says novel."""
    novel, empty = ~F.coalesce(F.col(truth).isin(*classes), F.lit(False)), F.size(members) == 0
    share = lambda hit, of: F.count_if(hit & of) / F.when(F.count_if(of) > 0, F.count_if(of))
    known = df.agg(F.count_if(~novel).alias("n_known"), F.count_if(novel).alias("n_novel"), F.coalesce(share(F.array_contains(members, F.col(truth)), ~novel), F.lit(0.0)).alias("known_coverage"), F.coalesce(share(empty, ~novel), F.lit(0.0)).alias("false_novelty_rate"), share(empty, novel).alias("detection_rate"))
    return known.crossJoin(F.broadcast(auc(df, score, novel).withColumnRenamed("auc", "novelty_auc")))  # one row each


def bootstrap(df: DataFrame, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(metric, value, low, high): percentile intervals of accuracy and macro-F1.

    Rows drawn with replacement fill the confusion table's cells as a multinomial draw does, so the cells
    (labels by labels, however many rows) are all that is drawn from. No rows give no rows.
    """
    import numpy as np
    import pandas as pd

    def metrics(n, t, p, k):
        hit = np.where(t == p, n, 0)
        each = np.stack([np.where((t == i).astype(int) + (p == i) > 0, n * ((t == i).astype(int) + (p == i)), 0).sum(axis=-1) for i in range(k)])
        right = np.stack([np.where(t == i, hit, 0).sum(axis=-1) for i in range(k)])
        f1 = np.where(each > 0, 2 * right / np.maximum(each, 1), 0.0)
        present = np.maximum((each > 0).sum(axis=0), 1)
        return hit.sum(axis=-1) / n.sum(axis=-1), f1.sum(axis=0) / present

    def draw(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["y_true", "y_pred"], ignore_index=True)
        codes, names = pd.factorize(pd.concat([cells["y_true"], cells["y_pred"]]), use_na_sentinel=False)
        t, p, n = codes[: len(cells)], codes[len(cells) :], cells["n"].to_numpy()
        drawn = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), resamples)
        whole, sample = metrics(n, t, p, len(names)), metrics(drawn, t, p, len(names))
        return pd.DataFrame([(m, float(v), *np.quantile(x, [0.025, 0.975]).tolist()) for m, v, x in zip(("accuracy", "macro_f1"), whole, sample)], columns=["metric", "value", "low", "high"])

    return confusion(df).groupBy().applyInPandas(draw, "metric string, value double, low double, high double")


def mcnemar(df: DataFrame, *by: str) -> DataFrame:
    """(by, a_only, b_only, n, p) from rows with flags a_right and b_right: the exact two-sided binomial p of the discordant rows, 1 where there are none."""
    out = df.groupBy(*by).agg(F.count_if(F.col("a_right") & ~F.col("b_right")).alias("a_only"), F.count_if(F.col("b_right") & ~F.col("a_right")).alias("b_only"), F.count("*").alias("n"))
    term = "named_struct('s', a.s + exp(a.l), 'l', a.l + coalesce(ln((d - i) / (i + 1)), 0D))"
    p = f"aggregate(sequence(0L, least(a_only, b_only)), named_struct('s', 0D, 'l', -d * ln(2D)), (a, i) -> {term}, a -> least(1D, 2 * a.s))"
    return out.withColumn("d", F.col("a_only") + F.col("b_only")).withColumn("p", F.expr(p)).drop("d")
