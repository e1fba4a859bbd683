"""Digests of corpora that no order of rows changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LANES = 8  # of 32 bits, each summed apart


def canonical(df: DataFrame, fields: list[str], files: tuple[str, ...] = ()) -> Column:
    """A row as JSON with its keys in order, nulls written out; of file paths only the name."""
    shown = [F.regexp_extract(F.col(c), r"([^/\\]*)$", 1) if c in files else F.col(c) for c in sorted(fields)]
    shown = [F.when(F.col(c).isNotNull(), x) for c, x in zip(sorted(fields), shown)]
    return F.to_json(F.struct(*[x.alias(c) for c, x in zip(sorted(fields), shown)]), {"ignoreNullFields": "false"})


def multiset_digest(df: DataFrame, row: Column, *by: str) -> DataFrame:
    """(by, n, digest): the sum of the rows' SHA-256, by lanes of 32 bits with carries modulo 2**256, and their number, hashed again.

    Sums are merged map-side; rows are neither sorted nor gathered. Any row more, less or changed gives another digest.
    """
    sha = F.sha2(row, 256)
    lanes = [F.sum(F.conv(F.substring("_sha", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"_l{i}") for i in range(LANES)]
    sums = df.withColumn("_sha", sha).groupBy(*by).agg(F.count("*").alias("n"), *lanes)
    carry, parts = F.lit(0).cast("long"), []
    for i in reversed(range(LANES)):
        total = F.coalesce(F.col(f"_l{i}"), F.lit(0)) + carry
        parts.append(F.lpad(F.lower(F.hex(F.pmod(total, F.lit(1 << 32)))), 8, "0"))
        carry = F.floor(total / (1 << 32)).cast("long")
    return sums.select(*by, "n", F.sha2(F.concat(*reversed(parts), F.lit(":"), F.col("n").cast("string")), 256).alias("digest"))


def corpus_digest(df: DataFrame, fields: list[str], split: str, files: tuple[str, ...] = ()) -> DataFrame:
    """(split, n, digest) of each split, and of all of them by their names and digests (split null)."""
    each = multiset_digest(df, canonical(df, fields, files), split).withColumnRenamed(split, "split")
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "split", "digest")))  # one row for each split
    return each.unionByName(each.agg(F.lit(None).cast("string").alias("split"), F.sum("n").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest")).select("split", "n", "digest"))


def drift(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(split, expected_n, n) of the splits whose number or digest is not as expected; none if all reproduce."""
    a, e = actual.where("split IS NOT NULL").alias("a"), expected.where("split IS NOT NULL").alias("e")
    both = a.join(e, F.col("a.split") == F.col("e.split"), "full")
    same = F.col("a.digest").eqNullSafe(F.col("e.digest")) & F.col("a.n").eqNullSafe(F.col("e.n"))
    return both.where(~same).select(F.coalesce("a.split", "e.split").alias("split"), F.col("e.n").alias("expected_n"), F.col("a.n").alias("n"))
