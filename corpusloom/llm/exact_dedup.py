"""Exact dedup by Grace hashing.

Rows are deduplicated twice by the same routine, first within the partition
they are read in, so that a text travels at most once from each, then within
the partition that its hash sends it to. The routine partitions records into
spill files by bits of their hash, and each of these again by further bits,
until a bucket fits the memory given; the bucket is then put through an
open-addressing table that compares whole texts. Spill files last as long as
the call. What remains of each text (its hash, smallest doc_id and count) is
joined with the rows by the hash; Spark splits that join where one hash is on
many rows.

Defined results: a null text counts as empty, so null and empty texts are one
group. Among ids null is the largest: it is the keep_id only of a group whose
ids are all null. kept is true on every row whose doc_id is the keep_id, so
repeated rows all carry it; group_size counts every row.
"""

from __future__ import annotations

import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import documents

MEMORY_BYTES = 48 << 20
FANOUT = 16
SPACE = "[\\x20\\x09-\\x0D]+"
_ENTRY = "sha binary, text string, min_id long, n long"


class Table:
    """Open addressing with linear probing; a slot holds the place of an entry, or -1."""

    def __init__(self) -> None:
        self.slots, self.entries = [-1] * 64, []

    def add(self, sha: bytes, text: str, min_id: int | None, n: int) -> int:
        """Adds to the entry whose text is the same, or a new one. Returns the bytes that it takes."""
        mask = len(self.slots) - 1
        at = int.from_bytes(sha[-8:], "little") & mask
        while (k := self.slots[at]) >= 0:
            e = self.entries[k]
            if e[0] == sha and e[1] == text:
                e[2] = min_id if e[2] is None else e[2] if min_id is None else min(e[2], min_id)
                e[3] += n
                return 0
            if e[0] == sha:
                raise ValueError(f"two different texts share the SHA-256 {sha.hex()}")
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([sha, text, min_id, n])
        if 3 * len(self.entries) > 2 * len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for k, e in enumerate(self.entries):
                at = int.from_bytes(e[0][-8:], "little") & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k
        return 2 * len(text) + 200


def distinct(records, memory_bytes: int = MEMORY_BYTES, level: int = 0):
    """Entries (sha, text, min_id, n) of the distinct texts among the records, which are such entries too.

    As long as the table fits, nothing is written. Then the table's entries
    and all further records go to FANOUT files by four bits of the hash.
    """
    table, size, files = Table(), 0, None
    for r in records:
        if files is None:
            size += table.add(*r)
            if size > memory_bytes and len(table.entries) > 1 and level < 32:
                files = [tempfile.TemporaryFile() for _ in range(FANOUT)]
                for e in table.entries:
                    pickle.dump(tuple(e), files[_branch(e[0], level)], pickle.HIGHEST_PROTOCOL)
                table = None
        else:
            pickle.dump(tuple(r), files[_branch(r[0], level)], pickle.HIGHEST_PROTOCOL)
    if files is None:
        yield from table.entries
        return
    for f in files:
        f.seek(0)
        yield from distinct(_read(f), memory_bytes, level + 1)
        f.close()


def _branch(sha: bytes, level: int) -> int:
    return sha[level // 2] >> 4 * (level % 2) & 15


def _read(f):
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _rows(batches):
    for batch in batches:
        yield from zip(batch.column("sha").to_pylist(), batch.column("text").to_pylist(), batch.column("min_id").to_pylist(), batch.column("n").to_pylist())


def _grace(with_text: bool, memory_bytes: int):
    def run(batches):
        block, size = [], 0
        for e in distinct(_rows(batches), memory_bytes):
            block.append(e)
            size += len(e[1]) if with_text else 64
            if size > 1 << 22:
                yield _batch(block, with_text)
                block, size = [], 0
        if block:
            yield _batch(block, with_text)

    return run


def _batch(block, with_text: bool) -> pa.RecordBatch:
    shas, texts, ids, n = zip(*block)
    out = {"sha": pa.array(shas, pa.binary())} | ({"text": pa.array(texts, pa.string())} if with_text else {}) | {"min_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64())}
    return pa.RecordBatch.from_pydict(out)


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, text with each run of white space as one space, and its SHA-256 (32 bytes)."""
    return documents(docs).withColumn("text", F.regexp_replace("text", SPACE, " ")).withColumn("sha", F.unhex(F.sha2("text", 256)))


def groups(docs: DataFrame, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """sha, min_id, n of each distinct normalised text."""
    local = normalised(docs).select("sha", "text", F.col("doc_id").alias("min_id"), F.lit(1).cast("long").alias("n")).mapInArrow(_grace(True, memory_bytes), _ENTRY)
    return local.repartition("sha").mapInArrow(_grace(False, memory_bytes), "sha binary, min_id long, n long")


def deduplicate(docs: DataFrame, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    kept is true where doc_id equals keep_id, both null included.
    """
    found = groups(docs, memory_bytes).withColumnsRenamed({"min_id": "keep_id", "n": "group_size"})
    return normalised(docs).select("doc_id", "sha").join(found, "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
