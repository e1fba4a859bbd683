"""Text files as numbered records: lines and quotes are counted by block, so that every record of a file of any size knows its line and whether a quote was open before it."""

from __future__ import annotations

import csv
import io
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

JSONL = (".jsonl", ".ndjson")
TABS = (".tsv", ".tab")
MOST_LINES = 100_000  # of one quoted record; a quote that is never closed is an error, not the rest of the file in one cell
_LINE = "file string, line long, first long, value string, valid boolean"


def delimiter_of(path: str) -> str:
    return "\t" if path.rstrip("/").lower().endswith(TABS) else ","


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return raw.select("file", "block", F.make_valid_utf8("value").alias("value"), F.is_valid_utf8("value").alias("valid"))


def numbered(spark: SparkSession, path: str, quoted: bool) -> DataFrame:
    """(file, line, first, value, valid): lines from 1, and the line at which the record of each begins (its own, if not quoted); valid: whether it was UTF-8.

    Two passes. The first counts each block's lines and quotes, and finds its last line that begins a record if no quote is open
    before it, or if one is. The driver adds the blocks up, one row for each, as it does when it lists them to be read.
    """

    def count(batches):
        held: dict = {}
        for batch in batches:
            for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist()):
                h = held.setdefault((file, block), [0, 0, -1, -1])
                h[2 + h[1] % 2] = h[0]
                h[0] += 1
                h[1] += value.count('"') if quoted else 0
        keys = list(held)
        yield pa.RecordBatch.from_pydict({"file": pa.array([k[0] for k in keys], pa.string()), "block": pa.array([k[1] for k in keys], pa.int64()), **{c: pa.array([held[k][i] for k in keys], pa.int64()) for i, c in enumerate(("lines", "quotes", "last0", "last1"))}})

    counted = _lines(spark, path).select("file", "block", "value").mapInArrow(count, "file string, block long, lines long, quotes long, last0 long, last1 long")
    before, file, at = {}, None, [0, 0, 1]
    for r in sorted(counted.collect(), key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, at = r["file"], [0, 0, 1]
        before[file, r["block"]] = tuple(at)
        last = r["last1"] if at[1] % 2 else r["last0"]
        at = [at[0] + r["lines"], at[1] + r["quotes"], at[0] + last + 1 if last >= 0 else at[2]]

    def number(batches):
        key, line, quotes, first = None, 0, 0, 1
        for batch in batches:
            out: list = [[], []]
            values = batch.column("value").to_pylist()
            for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), values):
                if (file, block) != key:
                    key = (file, block)
                    line, quotes, first = before[key]
                line += 1
                first = line if quotes % 2 == 0 else first
                quotes += value.count('"') if quoted else 0
                out[0].append(line)
                out[1].append(first)
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), batch.column("value"), batch.column("valid")], ["file", "line", "first", "value", "valid"])

    return _lines(spark, path).mapInArrow(number, _LINE)


def records(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """(file, line, cells, code, message) of each record of a manifest: CSV or TSV with a header in each file, or JSON lines.

    line is a record's last. Cells are text as it stands; cells beyond the header are dropped, missing ones null, blank lines no
    records. A record that can't be read has a code: encoding, malformed-row (JSON), parse-error (a quote left open), and no cells.
    """
    if delimiter is None and path.rstrip("/").lower().endswith(JSONL):
        rows = numbered(spark, path, False)

        def parse(batches):
            for batch in batches:
                out = []
                for line, value, valid in zip(batch.column("line").to_pylist(), batch.column("value").to_pylist(), batch.column("valid").to_pylist()):
                    value = (value.lstrip("﻿") if line == 1 else value).strip()
                    if valid and not value:
                        out.append((None, "blank", None))
                        continue
                    try:
                        record = json.loads(value) if valid else None
                        bad = None if isinstance(record, dict) else ("malformed-row", "expected a JSON object per line") if valid else ("encoding", "not valid UTF-8")
                    except json.JSONDecodeError as e:
                        record, bad = None, ("malformed-row", f"invalid JSON: {e}")
                    out.append(([(k, None if v is None else v if isinstance(v, str) else str(v)) for k, v in record.items()], None, None) if bad is None else (None, *bad))
                yield _parsed(batch, out)

        found = rows.select("file", "line", "value", "valid").mapInArrow(parse, _RECORD)
    else:
        sep = delimiter or delimiter_of(path)
        rows = numbered(spark, path, True)
        whole = rows.withColumn("alone", (F.col("first") == F.col("line")) & (F.regexp_count("value", F.lit('"')) % 2 == 0))
        single = whole.where("alone").select("file", "line", "first", "value", "valid", F.lit(False).alias("open"))
        parts = whole.where("NOT alone")
        spans = parts.groupBy("file", "first").agg(F.max("line").alias("end"), F.sum(F.regexp_count("value", F.lit('"'))).alias("quotes"))
        joined = parts.join(spans, ["file", "first"])
        open_ = (F.col("quotes") % 2 == 1) | (F.col("end") - F.col("first") >= MOST_LINES)
        several = joined.where(~open_).groupBy("file", "first").agg(F.max("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda s: s["value"]), "\n").alias("value"), F.bool_and("valid").alias("valid"))
        lost = spans.where(open_).select("file", F.col("end").alias("line"), "first", F.lit("").alias("value"), F.lit(True).alias("valid"), F.lit(True).alias("open"))
        every = single.unionByName(several.withColumn("open", F.lit(False))).unionByName(lost)
        header = every.where("first = 1").select("file", F.col("value").alias("header"), F.col("line").alias("upto"))

        def parse_cells(batches):
            for batch in batches:
                out, names, known = [], None, None
                for value, valid, open_, head, line, upto in zip(*[batch.column(c).to_pylist() for c in ("value", "valid", "open", "header", "line", "upto")]):
                    if head is not None and head != known:
                        known, names = head, next(csv.reader(io.StringIO(head.lstrip("﻿"), newline=""), delimiter=sep), [])
                    if line == upto:
                        out.append((None, "header", None) if valid else (None, "encoding", "not valid UTF-8"))
                    elif open_:
                        out.append((None, "parse-error", "a quote is not closed"))
                    elif not valid:
                        out.append((None, "encoding", "not valid UTF-8"))
                    else:
                        cells = next(csv.reader(io.StringIO(value, newline=""), delimiter=sep), [])
                        given = dict(zip(names or [], cells))
                        out.append(([(n, given.get(n)) for n in dict.fromkeys(names or [])], None, None) if cells else (None, "blank", None))
                yield _parsed(batch, out)

        found = every.join(header, "file", "left").select("file", "line", "value", "valid", "open", "header", "upto").mapInArrow(parse_cells, _RECORD)
    return found.where("code IS NULL OR code NOT IN ('blank', 'header')")


_RECORD = "file string, line long, cells map<string,string>, code string, message string"


def _parsed(batch, out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [batch.column("file"), batch.column("line"), pa.array([x[0] for x in out], pa.map_(pa.string(), pa.string())), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["file", "line", "cells", "code", "message"],
    )
