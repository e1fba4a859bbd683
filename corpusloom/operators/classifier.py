"""A text classifier from fit to evaluation: naive Bayes or an MLlib model, probabilities, calibration, abstention, prediction sets, and the fitted whole in a folder."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import arrays as A, text as X
from corpusloom.operators import bayes as B, calibrators as K, evaluation as E, models as M
from corpusloom.operators.active import Counts
from corpusloom.operators.corpus import written

KINDS = ("naive_bayes", "logistic_regression", "random_forest")


class Classifier:
    """Fitted on rows (id, text, label); rows without a label are not learnt from. Every method gives one row for each row of df."""

    def __init__(self, kind: str = "naive_bayes", abstain_below: float | None = None) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
        if abstain_below is not None and not 0 <= abstain_below <= 1:
            raise ValueError("abstain_below must lie in [0, 1]")
        self.kind, self.abstain_below, self.labels, self.model = kind, abstain_below, [], None
        self.temperature, self.isotonic, self.thresholds, self.alpha = None, None, None, None

    def fit(self, df: DataFrame) -> Classifier:
        rows = df.where(F.col("label").isNotNull()).select("id", "text", "label")
        self.labels = sorted(r[0] for r in rows.select("label").distinct().collect())  # the label vocabulary
        if len(self.labels) < 2:
            raise ValueError(f"rows of two labels or more are needed, found {self.labels}")
        self.temperature = self.isotonic = self.thresholds = None
        if self.kind == "naive_bayes":
            self.model = Counts(self.labels).learn(rows)
        else:
            weights = F.broadcast(M.class_weights(rows, "label").select("label", "weight"))  # a row for each label
            self.model = M.fitted(self.kind, rows.join(weights, "label"), "label")
        return self

    def probabilities(self, df: DataFrame) -> DataFrame:
        """(id, p) in order of ``labels``, calibrated if a calibrator is fitted."""
        raw = self._raw(df)
        if self.temperature is not None:
            raw = raw.withColumn("p", K.scaled(F.col("p"), self.temperature))
        if self.isotonic is not None:
            raw = K.apply_isotonic(raw, "id", "p", self.isotonic, self.labels)
        return raw

    def _raw(self, df: DataFrame) -> DataFrame:
        self._fitted()
        rows = df.select("id", "text")
        if self.kind == "naive_bayes":
            found = self.model.scored(rows)
            return found.select("id", B.posterior(F.col("scores"), F.lit(1)).alias("p"))
        scored = self.model.transform(rows.withColumns({"tokens": X.words(F.col("text"), True), "label": F.lit(self.labels[0])}))
        return scored.select("id", vector_to_array("probability").alias("p"))

    def _fitted(self) -> None:
        if self.model is None:
            raise ValueError("fit comes first")

    def _place(self, label: str | Column = "label") -> Column:
        return F.array_position(F.array(*map(F.lit, self.labels)), F.col(label) if isinstance(label, str) else label)

    def _held_out(self, df: DataFrame) -> DataFrame:
        """(id, p, label) of rows whose label the model knows."""
        rows = written(df.sparkSession, self.probabilities(df).join(df.select("id", "label"), "id").where(self._place() > 0))  # read many times
        if rows.isEmpty():
            raise ValueError("no row has a label that the model knows")
        return rows

    def calibrate(self, df: DataFrame, kind: str = "temperature") -> Classifier:
        """On rows not learnt from: identity, temperature or isotonic."""
        if kind not in ("identity", "temperature", "isotonic"):
            raise ValueError(f"unknown calibrator {kind!r}")
        self.temperature = self.isotonic = self.thresholds = None
        rows = self._held_out(df)
        if kind == "temperature":
            self.temperature = K.fit_temperature(rows, "p", self._place())
        elif kind == "isotonic":
            self.isotonic = K.fit_isotonic(rows, "p", F.col("label"), self.labels)
        return self

    def conform(self, df: DataFrame, alpha: float = 0.1, by_class: bool = False) -> Classifier:
        """Thresholds of prediction sets from rows not learnt from; by class, one without rows has that of all."""
        if not 0 < alpha < 1:
            raise ValueError("alpha must lie in (0, 1)")
        scores = self._held_out(df).select("label", (1 - F.element_at("p", self._place().cast("int"))).alias("score"))
        if by_class:
            found = {r["label"]: r["q"] for r in E.conformal_quantile(scores, alpha, "label", self.labels).collect()}
            self.thresholds = [found[x] for x in self.labels]
        else:
            self.thresholds = [E.conformal_quantile(scores, alpha).first()["q"]] * len(self.labels)
        self.alpha = alpha
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, label, confidence, abstained, p): label is null for an abstention."""
        rows = self.probabilities(df).withColumn("confidence", F.array_max("p"))
        abstained = F.col("confidence") < F.lit(self.abstain_below if self.abstain_below is not None else -1.0)
        return rows.select("id", F.when(~abstained, A.argmax_label(F.col("p"), self.labels)).alias("label"), "confidence", abstained.alias("abstained"), "p")

    def predict_sets(self, df: DataFrame, never_empty: bool = True) -> DataFrame:
        """(id, members, novelty): labels within their thresholds, most probable first; an empty set (if allowed) says that the text is like no known class. novelty: 1 - largest probability."""
        if self.thresholds is None:
            raise ValueError("conform comes first")
        limits = F.array(*map(F.lit, self.thresholds))
        order = A.ranked(F.col("p"), self.labels)
        kept = F.filter(order, lambda s: 1.0 - s["p"] <= F.element_at(limits, (1 - s["i"]).cast("int")))
        members = F.transform(kept, lambda s: s["label"])
        members = F.when(F.size(members) == 0, F.array(order[0]["label"])).otherwise(members) if never_empty else members
        return self.probabilities(df).select("id", members.alias("members"), (1 - F.array_max("p")).alias("novelty"))

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Macro, weighted and balanced metrics, accuracy, mean log loss and Brier score of rows whose label the model knows."""
        rows = self._held_out(df).withColumns({"y_true": F.col("label"), "y_pred": A.argmax_label(F.col("p"), self.labels)})
        losses = rows.agg(F.avg(K.log_loss(F.col("p"), self._place("y_true"), 1.0)).alias("log_loss"), F.avg(A.brier(F.col("p"), F.col("y_true"), self.labels)).alias("brier"))
        return E.averaged(E.class_metrics(rows)).crossJoin(losses)  # one row each

    def save(self, path: str, spark: SparkSession) -> None:
        """The whole in a folder of the shared file system."""
        self._fitted()
        facts = {"kind": self.kind, "abstain_below": self.abstain_below, "labels": self.labels, "temperature": self.temperature, "thresholds": self.thresholds, "alpha": self.alpha, "isotonic": self.isotonic is not None}
        spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/facts")
        if self.kind == "naive_bayes":
            self.model.docs.write.parquet(f"{path}/docs")
            self.model.tokens.write.parquet(f"{path}/tokens")
        else:
            self.model.save(f"{path}/model")
        if self.isotonic is not None:
            self.isotonic.write.parquet(f"{path}/isotonic")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Classifier:
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        out = cls(facts["kind"], facts["abstain_below"])
        out.labels, out.temperature, out.thresholds, out.alpha = facts["labels"], facts["temperature"], facts["thresholds"], facts["alpha"]
        if out.kind == "naive_bayes":
            out.model = Counts(out.labels)
            out.model.docs, out.model.tokens = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/tokens")
        else:
            out.model = PipelineModel.load(f"{path}/model")
        out.isotonic = spark.read.parquet(f"{path}/isotonic") if facts["isotonic"] else None
        return out
