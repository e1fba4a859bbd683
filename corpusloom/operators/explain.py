"""What sets classes apart: features of documents, their contrast between two classes, and evidence by class."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions import lexicons as L, text as X
from corpusloom.operators import counted as K
from corpusloom.operators.evaluation import holm


def document_features(df: DataFrame, *keep: str, ending: int = 3) -> DataFrame:
    """(id, kept columns, category, feature, count): markers, detectable rules that fired, and word endings of each document."""
    w = df.select("id", *keep, X.words(F.col("text"), True).alias("w")).where(F.size("w") > 0)
    rates = X.rule_rates(F.col("w"))
    fired = [F.struct(F.lit("phonological").alias("category"), F.lit(n).alias("feature"), F.round(rates[f"{n}_fired"] * F.size("w")).cast("long").alias("count")) for n, rule in L.RULES.items() if rule[1]]
    known = {m for ms in L.MARKERS.values() for m in ms}
    cut = lambda t: [f"lexical\x1f{t}"] * (t in known) + [f"morphological\x1f-{t[-ending:]}"] * (len(t) > ending)
    found = K.token_rows(K.one_row(w, "id", *keep), ["id", *keep], cut)
    part = F.split("token", "\x1f")
    counted = found.select("id", *keep, part[0].alias("category"), part[1].alias("feature"), F.col("tf").alias("count"))
    return counted.unionByName(w.select("id", *keep, F.inline(F.array(*fired))).where("count > 0"))


def contrast(df: DataFrame, label: str, a: str, b: str, min_support: int = 5) -> DataFrame:
    """Features in at least min_support documents of two classes: documents and rates in each, 0.5-smoothed log-odds (positive: a), pooled z.

    One row of a document's feature is summed map-side; only one row for each
    feature is left after the first exchange.
    """
    if a == b:
        raise ValueError("a class cannot be contrasted with itself")
    both = df.where(F.col(label).isin(a, b) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    sizes = both.agg(F.count_if(F.col(label) == a).alias("a"), F.count_if(F.col(label) == b).alias("b"))
    seen = document_features(both, label).groupBy("category", "feature").agg(F.count_if(F.col(label) == a).alias("n_a"), F.count_if(F.col(label) == b).alias("n_b"))
    x = seen.where(F.col("n_a") + F.col("n_b") >= min_support).crossJoin(F.broadcast(sizes))  # sizes: one row
    share = (F.col("n_a") + F.col("n_b")) / (F.col("a") + F.col("b"))
    x = x.withColumns({"rate_a": F.col("n_a") / F.col("a"), "rate_b": F.col("n_b") / F.col("b")})
    odds = ((F.col("n_a") + 0.5) * (F.col("b") - F.col("n_b") + 0.5)) / ((F.col("a") - F.col("n_a") + 0.5) * (F.col("n_b") + 0.5))
    spread = share * (1 - share) * (1 / F.col("a") + 1 / F.col("b"))
    x = x.withColumns({"log_odds": F.ln(odds), "z": F.when(spread > 0, (F.col("rate_a") - F.col("rate_b")) / F.sqrt(spread)).otherwise(0.0)})
    return x.withColumn("favoured", F.when(F.col("log_odds") >= 0, a).otherwise(b)).drop("a", "b")


def with_p_values(contrasted: DataFrame) -> DataFrame:
    """Two-sided p-values of z, and Holm's over all features (one row each, so a small table)."""

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))

    named = contrasted.withColumns({"p": two_sided("z"), "_name": F.concat_ws("\x1f", "category", "feature")})
    return holm(named, "p", "_name").drop("_name")


def evidence(df: DataFrame, label: str, min_support: int = 3) -> DataFrame:
    """Each feature's carriers, occurrences, and the class with the largest lift (ties: more carriers, then the smaller name).

    Lift is carriers in the class * documents / (carriers * documents of the class).
    """
    known = df.where(F.col(label).isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy(label).agg(F.count("*").alias("size"))
    each = document_features(known, label).groupBy("category", "feature", label).agg(F.count("*").alias("c"), F.sum("count").alias("occurrences"))
    each = each.join(sizes, label).crossJoin(F.broadcast(known.agg(F.count("*").alias("n"))))
    top = F.min(F.struct((-(F.col("c") * F.col("n")) / F.col("size")).alias("less"), (-F.col("c")).alias("c"), F.col(label).alias("top_class")))
    out = each.groupBy("category", "feature").agg(F.sum("c").alias("carriers"), F.sum("occurrences").alias("occurrences"), top.alias("t"))
    return out.select("category", "feature", "carriers", "occurrences", "t.top_class", (-F.col("t.less") / F.col("carriers")).alias("lift"), (-F.col("t.c") / F.col("carriers")).alias("share"), (F.col("carriers") < min_support).alias("low_support"))


#: What a fired rule, a marker and a merger's standard environment weigh.
FIRED_WEIGHT, MARKER_WEIGHT, ENVIRONMENT_WEIGHT = 2.0, 1.5, -0.5


def _evidence_of(markers: dict, rules: dict):
    """A function of a word: kind, label and surface, joined by a separator, of each piece of evidence in it."""
    labels: dict = {}
    for key, words in markers.items():
        for m in words:
            labels.setdefault(m, []).append(f"0\x1f{key}\x1f{m}")
    patterns = [(n, d, re.compile(X.token_pattern([b if d else a for a, b in pairs], final)), frozenset(stop)) for n, (_, d, final, pairs, stop) in rules.items()]

    def of(word: str) -> list[str]:
        out = list(labels.get(word, ()))
        for name, fired, pattern, stop in patterns:
            if word not in stop:
                out += [f"{1 if fired else 2}\x1f{name}\x1f{s if fired else ''}" for s in pattern.findall(word)]
        return out

    return of


def dialect_evidence(df: DataFrame, k: int = 15) -> DataFrame:
    """(id, rank, kind, label, surface, count, weight): the markers a text holds, the sound rules that fired in it and the environments
    that mergers left as they are, the k heaviest by absolute weight; ties by kind (marker, fired, environment), count, label, surface.

    Words are cut and looked through where a document lies; only its evidence is shuffled, cut to k in every task before.
    """
    one = K.one_row(df.select("id", X.words(F.col("text"), True).alias("w")), "id")
    found = K.token_rows(one, ["id"], _evidence_of(L.MARKERS, L.RULES))
    part = F.split("token", "\x1f")
    counted = found.select("id", part[0].cast("int").alias("kind"), part[1].alias("label"), part[2].alias("surface"), F.col("tf").alias("count"))
    weight = F.col("count") * F.when(F.col("kind") == 0, MARKER_WEIGHT).when(F.col("kind") == 1, FIRED_WEIGHT).otherwise(ENVIRONMENT_WEIGHT)
    order = Window.partitionBy("id").orderBy(F.desc(F.abs("weight")), "kind", F.desc("count"), "label", "surface")
    ranked = counted.withColumn("weight", weight).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = F.element_at(F.array(*map(F.lit, ("marker", "isogloss_fired", "isogloss_environment"))), F.col("kind") + 1)
    return ranked.select("id", "rank", names.alias("kind"), "label", "surface", "count", "weight")


def family_evidence(df: DataFrame) -> DataFrame:
    """(id, family, count): markers and fired rules of each text by the families they speak for, of all of them, not only the heaviest."""
    spark = df.sparkSession
    families = [(key, f) for key in L.MARKERS if (f := L.FAMILY_OF.get(key, f"{key}n" if f"{key}n" in L.FAMILIES else None))] + [(n, f) for n, rule in L.RULES.items() for f in rule[0]]
    each = dialect_evidence(df, k=1 << 30).where("kind != 'isogloss_environment'")
    return each.join(F.broadcast(spark.createDataFrame(families, "label string, family string")), "label").groupBy("id", "family").agg(F.sum("count").alias("count"))


def isogloss_diagnostics(predictions: DataFrame, texts: DataFrame, scope: dict[str, list[str]] | None = None, low: int = 5) -> DataFrame:
    """(rule, n_present, accuracy_present, n_absent, accuracy_absent, delta, low_support): accuracy on rows in whose text a detectable rule fired, and on those where it did not, of the labels that the rule stands for (scope; its families if not given; all labels if empty).

    predictions: id, y_true, y_pred; texts: id, text. Rules are counted where the words are cut, and one row of each text meets its prediction.
    """
    rules = {n: list(rule[0]) for n, rule in L.RULES.items() if rule[1]} if scope is None else scope
    fired = X.token_rates(texts.where(F.col("text").isNotNull()), "id", {n: f for n, f in X.rule_hits().items() if n.removesuffix("_fired") in rules and n.endswith("_fired")})
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), (F.col(f"{n}_fired") > 0).alias("present"), (F.lower("y_true").isin(*labels) if labels else F.lit(True)).alias("inside")) for n, labels in rules.items()]))
    rows = predictions.join(fired, "id").select((F.col("y_true") == F.col("y_pred")).cast("double").alias("right"), each.alias("e")).select("right", "e.*").where("inside")
    of = lambda x: F.avg(F.when(x, F.col("right")))
    out = rows.groupBy("rule").agg(F.count_if("present").alias("n_present"), of(F.col("present")).alias("accuracy_present"), F.count_if(~F.col("present")).alias("n_absent"), of(~F.col("present")).alias("accuracy_absent"))
    return out.withColumns({"delta": F.col("accuracy_present") - F.col("accuracy_absent"), "low_support": (F.col("n_present") < low) | (F.col("n_absent") < low)})
