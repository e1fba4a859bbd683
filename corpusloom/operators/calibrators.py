"""Maps from a classifier's probabilities to better ones: temperature and isotonic, fitted by aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import arrays as A
from corpusloom.operators.corpus import written

#: The least probability under a logarithm, and the temperatures looked at.
CLIP = 1e-12
BOUNDS = (1e-2, 1e2)
STEPS = 24  # temperatures tried in one aggregate
FAN_IN = 16
CELLS = 4096


def logits(p: Column) -> Column:
    return F.transform(p, lambda x: F.ln(F.least(F.greatest(x, F.lit(CLIP)), F.lit(1.0))))


def scaled(p: Column, temperature: float | Column) -> Column:
    """softmax(ln p / temperature)."""
    return A.softmax(F.transform(logits(p), lambda x: x / temperature))


def log_loss(p: Column, truth: Column, temperature: float | Column) -> Column:
    """-ln of the true label's probability (truth: its place in p, from 1) at a temperature."""
    z = F.transform(logits(p), lambda x: x / temperature)
    top = F.array_max(z)
    spread = top + F.ln(A.total(F.transform(z, lambda x: F.exp(x - top))))
    return F.least(spread - F.element_at(z, truth.cast("int")), F.lit(-math.log(CLIP)))


def fit_temperature(df: DataFrame, p: str, truth: Column, tolerance: float = 1e-6) -> float:
    """The temperature of least mean log loss. Each step tries ``STEPS`` values in one aggregate and goes on between the neighbours of the best; the loss has one minimum. 1 for no rows."""
    low, high = (math.log(b) for b in BOUNDS)
    rows = df.select(F.col(p).alias("p"), truth.alias("t")).where("p IS NOT NULL AND t > 0")
    while high - low > tolerance:
        tried = [low + (high - low) * i / (STEPS - 1) for i in range(STEPS)]
        losses = rows.agg(*[F.avg(log_loss(F.col("p"), F.col("t"), math.exp(x))).alias(f"l{i}") for i, x in enumerate(tried)]).first()
        if losses[0] is None:
            return 1.0
        best = min(range(STEPS), key=lambda i: losses[i])
        low, high = tried[max(best - 1, 0)], tried[min(best + 1, STEPS - 1)]
    return math.exp((low + high) / 2)


def pooled(blocks):
    """Pool adjacent violators: blocks (lo, hi, n, s) in order of lo, merged until their means s / n rise. Pooling parts first changes nothing in the result."""
    out: list = []
    for lo, hi, n, s in blocks:
        while out and out[-1][3] * n >= s * out[-1][2]:
            a, _, m, t = out.pop()
            lo, n, s = a, n + m, s + t
        out.append((lo, hi, n, s))
    return out


_BLOCK = "label string, part int, lo double, hi double, n double, s double"


def fit_isotonic(df: DataFrame, p: str, truth: Column, labels: list[str]) -> DataFrame:
    """(label, lo, hi, value): rising blocks of each label's probability, one against the rest; truth: a Column of labels.

    Equal probabilities are one block from the start. Blocks are dealt to ranges; each task pools its own, then every ``FAN_IN``
    neighbouring ranges of a label are pooled together, and again, until each label is one range. What is pooled shrinks with every step.
    """
    import pandas as pd

    each = df.select(truth.alias("t"), F.posexplode(p).alias("i", "lo"))
    label = F.element_at(F.array(*map(F.lit, labels)), F.col("i") + 1)
    points = each.groupBy(label.alias("label"), "lo").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("t").eqNullSafe(label)).cast("double").alias("s"))
    placed = points.repartitionByRange("label", "lo").withColumn("part", F.spark_partition_id())
    blocks = written(df.sparkSession, placed.select("label", "part", "lo", F.col("lo").alias("hi"), "n", "s"))

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lo")
        found = pooled(rows[["lo", "hi", "n", "s"]].itertuples(index=False, name=None))
        out = pd.DataFrame(found, columns=["lo", "hi", "n", "s"])
        return out.assign(label=rows["label"].iloc[0], part=rows["part"].iloc[0])[["label", "part", "lo", "hi", "n", "s"]]

    parts = blocks.agg(F.coalesce(F.max("part"), F.lit(0)).alias("m")).first()["m"] + 1
    while True:
        blocks = written(df.sparkSession, blocks.groupBy("label", "part").applyInPandas(pool, _BLOCK))
        if parts == 1:
            return blocks.select("label", "lo", "hi", (F.col("s") / F.col("n")).alias("value"))
        blocks, parts = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")), -(-parts // FAN_IN)


def apply_isotonic(df: DataFrame, key: str, p: str, blocks: DataFrame, labels: list[str]) -> DataFrame:
    """(key, p): each probability through its label's blocks, straight lines between them, the ends beyond; rows renormalised, uniform where all are 0.

    The blocks are cut to cells of [0, 1], so that a row meets those of its cell only, by an equal-key join of any size.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("lo")
    steps = blocks.withColumns({"next": F.lead("lo").over(w), "after": F.lead("value").over(w), "first": F.lag("lo").over(w).isNull()})
    cell = lambda x: F.greatest(F.least(F.floor(x * CELLS), F.lit(CELLS - 1)), F.lit(0)).cast("int")
    begin, end = F.when(F.col("first"), F.lit(0)).otherwise(cell(F.col("lo"))), F.when(F.col("next").isNull(), F.lit(CELLS - 1)).otherwise(cell(F.col("next")))
    cut = steps.select("label", "lo", "hi", "value", "next", "after", "first", F.explode(F.sequence(begin, end)).alias("cell"))
    label = F.element_at(F.array(*map(F.lit, labels)), F.col("i") + 1)
    each = df.select(F.col(key).alias("key"), F.posexplode(p).alias("i", "x")).withColumns({"label": label, "cell": cell(F.col("x"))})
    inside = (F.col("first") | (F.col("x") >= F.col("lo"))) & (F.col("next").isNull() | (F.col("x") < F.col("next")))
    share = (F.col("x") - F.col("hi")) / (F.col("next") - F.col("hi"))
    value = F.when((F.col("x") <= F.col("hi")) | F.col("next").isNull(), F.col("value")).otherwise(F.col("value") + share * (F.col("after") - F.col("value")))
    met = each.join(cut, ["label", "cell"]).where(inside).select("key", "i", value.alias("y"))
    rows = met.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda s: s["y"]).alias("y"))
    return rows.select(F.col("key").alias(key), A.renormalise(F.col("y")).alias(p))
