"""Rounding as the SQL has it, also where a product's decimals end in a five."""

import duckdb
from pyspark.sql import functions as F

from corpusloom.plans.tables import r6, rounded


def test_rounded_is_duckdbs_round(spark):
    halves = [(a, b) for a in (0.9995, 0.958137, 0.999795, 0.5) for b in (0.99999, 0.500005, 0.041658, 0.99985)]
    halves += [(k / 1e6, (2 * k + 1) / 1e3) for k in range(1, 400)] + [(-0.0000125, 1.0), (0.0000125, 1.0)]
    df = spark.createDataFrame(halves, "a double, b double").select("a", "b", rounded(F.col("a") * F.col("b"), 8).alias("x"), r6(F.col("a") * F.col("b")).alias("y"))
    got = [(r["x"], r["y"]) for r in df.collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE * ?::DOUBLE, 8), round(?::DOUBLE * ?::DOUBLE, 6)", [a, b, a, b]).fetchone() for a, b in halves]
    assert got == want and any(F_round(a * b) != w[0] for (a, b), w in zip(halves, want))


def F_round(x):
    """What Spark's round gives: the shown decimal, half up."""
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal("1e-8"), ROUND_HALF_UP))
