"""What several operators share: row keys, tasks over Arrow batches, the shared folder."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns, nothing else, so that no other column's name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def row_keys(*more: str) -> dict:
    """did (doc_id, 0 for null) and text_key; rows that the two can't tell apart have the same doc_id, text and further columns named."""
    parts = [x for c in ("text", "doc_id", *more) for x in (F.col(c), F.col(c).isNull())]
    return {"did": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "text_key": F.xxhash64(*parts)}


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Adds the row keys to columns that the operator has chosen itself."""
    return docs.withColumns(row_keys(*more))


def nested(docs: DataFrame, *more: str) -> DataFrame:
    """row (all of the user's columns in one struct, so that no name clashes), did, text_key."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in row_keys(*more).items()])


def in_tasks(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow; when a task ends, its worker gives free memory back. Spark keeps idle workers, whose pools would add up from stage to stage."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session must name it, unless both are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_old_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what has been stored meanwhile: it does so when the driver collects garbage, which may not happen for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BITMAP_BITS = 1 << 23


def perhaps_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key (a hash) is one of keys, and some others: by a bitmap of one size for all inputs, 1 MB, so that most rows need not be sent anywhere to be found unwanted."""
    return _with_bits(rows, keys, key, "inner").where("_met").select(*rows.columns)


def met(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """All rows and a column met: false where the key is surely none of keys."""
    return _with_bits(rows, keys, key, "left").select(*rows.columns, F.coalesce("_met", F.lit(False)).alias("met"))


def _with_bits(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    bit = F.pmod(F.col(key), F.lit(BITMAP_BITS))
    bits = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(bits), F.bitmap_bucket_number(bit) == F.col("bucket"), how)
    return joined.withColumn("_met", F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
