"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share
the whole size of the corpus; a source's target stops at three times its
size and what is over is shared again by weight (``targets``). The targets
are then turned into equal blocks of words by highest quotients, first over
the sources, then, for each source, over its shards (``sainte_lague``). A
block has ``BLOCK_WORDS`` words, or a ``LEAST_BLOCKS``-th of a corpus too small
for that many blocks.

Within a shard of a source the documents stand in a seeded order and are cut
into blocks. The shard takes its quota as whole rounds of all its blocks, and
the rest by a seeded order of the blocks, the last one cut to what is left.

A source that is to give three times its size gives all its documents three
times. Shards are chosen by a hash of doc_id; their number grows with the
corpus so that a shard of one source stays within one task. One row for each
source goes through the driver, and one for each shard of a source through a
task. No text is sorted or ranked; ``mixed_documents`` sends each once, to the
row of the plan that it belongs to.

Defined results: a null or empty text has size 0 and gives nothing. Rows alike
in doc_id, text and source take alike (where their common share does not
divide, what is left over is not taken). No rows give no rows; a corpus of few
words is mixed by single words.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import nested, keyed, stored
from .words import U, mix as spread

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK_WORDS = 256
LEAST_BLOCKS = 4096
SHARD_WORDS = 20_000_000
SHARD_ROWS = 500_000
SEED = "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"
_PLAN = "did long, text_key long, source_id int, rounds long, parts array<struct<a:long,b:long>>"


def targets(sizes: list[int], weights: list[int], limit: int = LIMIT) -> list[float]:
    """Shares of sum(sizes) by weight, none above limit times its size."""
    out: list[float] = [0.0] * len(sizes)
    left, weight = sum(sizes), sum(weights)
    for i in sorted(range(len(sizes)), key=lambda i: (limit * sizes[i] / weights[i], i)):
        if limit * sizes[i] * weight <= left * weights[i]:  # full: what is left is shared by the others
            out[i] = float(limit * sizes[i])
            left, weight = left - limit * sizes[i], weight - weights[i]
        else:
            out[i] = left / weight * weights[i]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1); ties go to the first.

    A quotient that no more than the seats exceed is found by bisection. Each
    party starts with one seat less than it has quotients above that; the few
    seats left are dealt one by one.
    """
    v = np.array(votes, float)
    if seats <= 0 or not (v > 0).any():
        return [0] * len(v)
    above = lambda t: np.maximum(np.ceil((v / t - 1) / 2), 0)
    low, high = v.sum() / (2 * seats + 2 * len(v) + 2), v.max() * 2
    for _ in range(200):
        t = (low + high) / 2
        if not low < t < high:
            break
        low, high = (t, high) if above(t).sum() > seats else (low, t)
    out = np.maximum(above(high) - 1, 0).astype(np.int64).tolist()
    heap = [(-x / (2 * k + 1), i) for i, (x, k) in enumerate(zip(v.tolist(), out)) if x > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-float(v[i]) / (2 * out[i] + 1), i))
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, did, text_key, source, size of each row, in the shared folder: texts are read once."""
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"), "source")
    return stored(rows.select("doc_id", "did", "text_key", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")


def _shares(block_words: int):
    """A shard of one source: what is taken of each kind of row."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "did", "size", "text_key"], kind="stable", ignore_index=True)
        size, copies = group["size"].to_numpy(), group["copies"].to_numpy()
        end = np.cumsum(size * copies)
        begin, total, words = end - size * copies, int(end[-1]), int(group["words"].iloc[0])
        rounds, rest = divmod(words, total) if total else (0, 0)
        blocks = -(-total // block_words)
        length = np.full(blocks, block_words, np.int64)
        length[blocks - 1 :] = total - block_words * (blocks - 1)
        seed = U(int(key[0]) << 32 | int(key[1]))
        order = np.argsort(spread(np.arange(blocks, dtype=U) + spread(np.full(1, seed))), kind="stable")
        before = np.cumsum(length[order]) - length[order]
        taken = np.zeros(blocks + 1, np.int64)
        taken[order] = np.clip(rest - before, 0, length[order])
        upto = np.append(0, np.cumsum(taken))
        within = lambda x: upto[x // block_words] + np.minimum(x % block_words, taken[x // block_words])
        part = within(end) - within(begin)
        at = np.flatnonzero(taken[:-1])  # stretches that are taken, neighbours as one
        joined = (taken[at[:-1]] == block_words) & (np.diff(at) == 1)
        a = (at * block_words)[np.append(True, ~joined)[: len(at)]]
        b = (at * block_words + taken[at])[np.append(~joined, True)[: len(at)]]
        first, last = np.searchsorted(b, begin, "right"), np.searchsorted(a, end)
        cuts: list = [[] for _ in range(len(group))]
        for i in np.flatnonzero(part).tolist():
            if copies[i] > 1:
                cuts[i] = [(0, int(part[i] // copies[i]))] if part[i] >= copies[i] else []
            else:
                x, y = a[first[i] : last[i]], b[first[i] : last[i]]
                cuts[i] = [(p, q) for p, q in zip((np.maximum(x, begin[i]) - begin[i]).tolist(), (np.minimum(y, end[i]) - begin[i]).tolist()) if q > p]
        cuts = [[{"a": p, "b": q} for p, q in c] for c in cuts]
        return pd.DataFrame({"did": group["did"], "text_key": group["text_key"], "source_id": np.int32(key[0]), "rounds": np.where(size > 0, rounds, 0), "parts": cuts})

    return run


def plan(rows: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """From ``sized``: what is taken of each kind of row (did, text_key): rounds (whole times) and parts [a, b) of its words; and the sources' facts."""
    spark = rows.sparkSession
    per_source = sorted(rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [r["n"] for r in per_source]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]) if sizes else []
    block = min(block_words, max(1, sum(sizes) // LEAST_BLOCKS))
    quota = sainte_lague(goal, round(sum(goal) / block))
    shards = max(1, -(-sum(sizes) // shard_words), -(-sum(r["rows"] for r in per_source) // SHARD_ROWS))
    facts = spark.createDataFrame([(i, r["source"], n, g, q) for i, (r, n, g, q) in enumerate(zip(per_source, sizes, goal, quota))], "source_id int, source string, source_size long, target double, quota long")
    kinds = rows.groupBy("did", "text_key").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("copies"))
    kinds = kinds.withColumn("place", F.xxhash64(F.lit(SEED), "doc_id", "text_key")).withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), F.lit("shard"), "doc_id", "text_key"), F.lit(shards)).cast("int"))
    kinds = kinds.alias("k").join(facts.alias("f"), F.col("k.source").eqNullSafe(F.col("f.source"))).select("k.*", "f.source_id", "f.source_size", "f.target", "f.quota")

    def apportion(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard", kind="stable", ignore_index=True)
        n = group["n"].to_numpy()
        full = bool(group["target"].iloc[0] >= LIMIT * group["source_size"].iloc[0])
        words = LIMIT * n if full else np.minimum(LIMIT * n, block * np.array(sainte_lague(n.tolist(), int(group["quota"].iloc[0])), np.int64))
        return group.assign(words=words)[["source_id", "shard", "words"]]

    per_shard = kinds.groupBy("source_id", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("quota").alias("quota"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    words = per_shard.groupBy("source_id").applyInPandas(apportion, "source_id int, shard int, words long")
    shared = kinds.select("source_id", "shard", "did", "text_key", "size", "copies", "place").join(words, ["source_id", "shard"])
    return shared.groupBy("source_id", "shard").applyInPandas(_shares(block), _PLAN), facts


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of docs."""
    rows = sized(docs)
    planned, facts = plan(rows, block_words, shard_words)
    part = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["b"] - p["a"])
    planned = planned.select("did", "text_key", "source_id", "rounds", part.alias("part")).join(facts.select("source_id", "source_size", "target"), "source_id")
    return rows.join(planned, ["did", "text_key"]).select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix as rows of docs: a text taken once is unchanged; one taken more often, or in part, is what is taken of it, in lines. Rows that give nothing go."""
    planned, _ = plan(sized(docs), block_words, shard_words)
    planned = planned.where("rounds > 0 OR size(parts) > 0").select("did", "text_key", "rounds", "parts").hint("shuffle_hash")  # texts are streamed past it, not sorted
    found = nested(docs, "source").join(planned, ["did", "text_key"])
    words = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    parts = F.when(F.size("parts") == 0, F.array().cast("array<string>")).otherwise(F.transform("parts", lambda p: F.array_join(F.slice(words, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), " ")))
    text = F.when((F.col("rounds") == 1) & (F.size("parts") == 0), F.col("row.text")).otherwise(F.concat_ws("\n", F.array_repeat("row.text", F.col("rounds").cast("int")), parts))
    out = found.select("row", text.alias("text"))
    fields = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*fields)
