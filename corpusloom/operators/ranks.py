"""Order statistics and running sums of whole columns, exact, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators.corpus import written

BUCKETS = 1024


def order_statistics(df: DataFrame, value: str, ranks: Callable[[int], list[int]], by: str | None = None) -> dict:
    """{(group, k): the k-th smallest of the group's values}, k from 1, for the ranks asked of a group of n.

    Counts by range find the range that holds a rank, counts within it the next, until its smallest and
    largest value are one. A step is one aggregate over the rows; what the driver sees is at most
    ``BUCKETS`` rows for each rank asked for. Groups are few (labels, dimensions); null and NaN are left out.
    """
    group = F.col(by) if by is not None else F.lit(0)
    rows = df.select(group.alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    found, open_ = {}, []
    for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        for k in sorted(set(ranks(r["n"]))):
            if not 1 <= k <= r["n"]:
                raise ValueError(f"rank {k} of {r['n']} values")
            if r["lo"] == r["hi"]:
                found[r["g"], k] = r["lo"]
            else:
                open_.append((r["g"], k, k, r["lo"], r["hi"]))
    while open_:
        ranges = sorted({(g, lo, hi) for g, _, _, lo, hi in open_}, key=repr)
        table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("g"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (g, lo, hi) in enumerate(ranges)])
        met = rows.select("v", F.explode(F.filter(table, lambda t: t["g"].eqNullSafe(F.col("g")) & (F.col("v") >= t["lo"]) & (F.col("v") <= t["hi"]))).alias("t"))
        place = F.least(F.floor((F.col("v") - F.col("t.lo")) / (F.col("t.hi") - F.col("t.lo")) * BUCKETS), F.lit(BUCKETS - 1))
        cells: dict = {}
        for r in met.groupBy("t.i", place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            cells.setdefault(ranges[r["i"]], []).append((r["b"], r["n"], r["lo"], r["hi"]))
        left = []
        for g, k, rest, lo, hi in open_:
            for _, n, a, b in sorted(cells[g, lo, hi]):
                if rest <= n:
                    break
                rest -= n
            if a == b:
                found[g, k] = a
            else:
                left.append((g, k, rest, a, b))
        open_ = left
    return found


def quantiles(df: DataFrame, value: str, shares: list[float], by: str | None = None) -> dict:
    """{group: quantiles by linear interpolation between neighbouring order statistics}; a group of no values is not there."""
    asked: dict = {}

    def ranks(n: int) -> list[int]:
        at = [(n - 1) * q for q in shares]
        return [k for x in at for k in (int(x) + 1, min(int(x) + 2, n))]

    found = order_statistics(df, value, ranks, by)
    sizes: dict = {}
    for g, k in found:
        sizes.setdefault(g, []).append(k)
    group = F.col(by) if by is not None else F.lit(0)
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect()
    for r in counts:
        out = []
        for q in shares:
            x = (r["n"] - 1) * q
            a, b = found[r["g"], int(x) + 1], found[r["g"], min(int(x) + 2, r["n"])]
            out.append(a + (b - a) * (x - int(x)))
        asked[r["g"]] = out
    return asked


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """df with, for each named sum, ``<name>_upto``: its total over the group's rows up to this one in the order, which must have no ties.

    Rows are dealt to ranges of the order and stored; a small table holds the sums of the ranges before each
    (one row for each range and group), so a window only ever spans one range of one group.
    """
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    marked = df.withColumns(sums | {k: _bare(c) for k, c in keys.items()})
    order = [_as(c, k) for k, c in keys.items()]
    placed = written(df.sparkSession, marked.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))
    ranges = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"{c}_upto") for c in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = ranges.select(*by, "_part", *[F.coalesce(F.sum(f"{c}_upto").over(before), F.lit(0)).alias(f"_{c}_before") for c in sums])
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumns({f"{c}_upto": F.sum(c).over(own) for c in sums})
    same = [joined[c].eqNullSafe(heads[c]) for c in by]
    out = joined.join(F.broadcast(heads), [joined["_part"] == heads["_part"], *same])
    return out.select(*[joined[c] for c in df.columns if c not in sums], *[joined[c] for c in sums], *[(joined[f"{c}_upto"] + heads[f"_{c}_before"]).alias(f"{c}_upto") for c in sums])


def _bare(c) -> Column:
    """The column of a sort order."""
    return c[0] if isinstance(c, tuple) else c


def _as(c, name: str) -> Column:
    return F.col(name).desc() if isinstance(c, tuple) else F.col(name).asc()


def falling(c: Column) -> tuple:
    """For ``running``: this column from the largest down."""
    return (c, "desc")
