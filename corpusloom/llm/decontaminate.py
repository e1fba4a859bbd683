"""Benchmark decontamination as a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item (a shorter item is one
window). The shingles of a window (3 words, or the whole item if shorter) are
ordered by their rarity in the documents. All of them must occur for the
window to occur, so the necessary prefix is one shingle: the rarest. Document
shingles are joined with these prefixes, the shingle's place in the window
and the window's length bound where the window would lie, and the words there
are compared exactly.

The index is made by Spark: tasks cut and hash the windows, count the
benchmark's shingles in all documents, and choose each window's prefix. It is
broadcast in blocks of at most about ``INDEX_BYTES``, and documents pass
through the blocks in turn without a shuffle.

Defined results: a null or empty text, or one without words, has no words and
is not contaminated. Items without words have no window. Items that share an
item_id count once; a null item_id counts as one item whose id is the empty
string. Each input row gives one row, repeated rows included.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W
from .common import documents, in_tasks, stored

WINDOW = 13
SHINGLE = 3
INDEX_BYTES = 16 << 20
_FILTER = 1 << 22
_WINDOWS = "words binary, n int, hash long, size int, shingles array<long>, item string"


def _items(column: pa.Array):
    """Chunks of items; one of few but very long words is not cut."""
    for c in W.chunks(column, W.ALNUM, W.LOWER, WINDOW - 1):
        if not c.whole and c.final and c.base + len(c.starts) < WINDOW:
            for d in W.chunks(column.slice(c.lo, 1), W.ALNUM, W.LOWER, cut=False):
                d.lo, d.hi = c.lo, c.hi
                yield d
        else:
            yield c


def _cut(batches):
    """The windows of each item, with their hashes and those of their shingles."""
    for batch in batches:
        items = ["" if x is None else x for x in batch.column("item").to_pylist()]
        for c in _items(W.text_column(batch)):
            h = c.hashes()
            rows = [(i, WINDOW) for i in c.begins(WINDOW).tolist()]
            if c.whole:
                rows += [(a, b - a) for a, b in zip(c.first[:-1].tolist(), c.first[1:].tolist()) if 0 < b - a < WINDOW]
            by_size = {n: W.grams(h, n) for n in {n for _, n in rows} | {min(SHINGLE, n) for _, n in rows}}
            out = []
            for i, n in rows:
                g = min(SHINGLE, n)
                out.append((c.text(i, n), n, by_size[n][i].view(np.int64), g, by_size[g][i : i + n - g + 1].view(np.int64), items[c.lo + int(c.doc[i])]))
            if out:
                kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], ["words", "n", "hash", "size", "shingles", "item"])


def shingle_hashes(h: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """Shingles of a chunk; 0 where too few words are left."""
    return np.where(left >= size, W.grams(h, size), 0)


def _members(h: np.ndarray, seen: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in h of members of sorted_keys, and their places there."""
    at = np.flatnonzero(seen[(h & W.U(_FILTER - 1)).astype(np.int64)])
    place = np.minimum(np.searchsorted(sorted_keys, h[at]), len(sorted_keys) - 1)
    same = sorted_keys[place] == h[at]
    return at[same], place[same]


def _bits(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(_FILTER, bool)
    seen[(keys & W.U(_FILTER - 1)).astype(np.int64)] = True
    return seen


def _blocks(df: DataFrame, by: str, n_bytes: int):
    """df in parts of about so many bytes at most, by a hash of a column; each as an Arrow table. df has a column bytes."""
    total = df.agg(F.sum("bytes")).first()[0] or 0
    parts = -(-int(total) // n_bytes)
    for k in range(parts):
        yield df.where(F.pmod(F.xxhash64(by), F.lit(parts)) == k).drop("bytes").toArrow()


def rarity(docs: DataFrame, shingles: DataFrame, n_bytes: int) -> DataFrame:
    """size, g, often: how often each of the given shingles occurs in all documents, where it does."""
    out = None
    for part in _blocks(shingles.withColumn("bytes", F.lit(12)), "g", n_bytes):
        size, g = part.column("size").to_numpy(), part.column("g").to_numpy().view(W.U)
        sent = docs.sparkSession.sparkContext.broadcast({int(s): np.sort(g[size == s]) for s in np.unique(size)})

        def count(batches, sent=sent):
            keys = sent.value
            seen = {s: _bits(k) for s, k in keys.items()}
            total = {s: np.zeros(len(k), np.int64) for s, k in keys.items()}
            for batch in batches:
                for c in W.chunks(W.text_column(batch), W.ALNUM, W.LOWER, SHINGLE - 1):
                    h = c.hashes()
                    for s, k in keys.items():
                        _, place = _members(shingle_hashes(h, c.left, s)[: c.mine], seen[s], k)
                        total[s] += np.bincount(place, minlength=len(k))
            for s, k in keys.items():
                some = np.flatnonzero(total[s])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), pa.array(k[some].view(np.int64)), pa.array(total[s][some])], ["size", "g", "often"])

        counted = in_tasks(docs.select("text"), count, "size int, g long, often long").groupBy("size", "g").agg(F.sum("often").alias("often"))
        out = counted if out is None else out.unionByName(counted)
    return out


def index(docs: DataFrame, benchmark: DataFrame, n_bytes: int) -> DataFrame | None:
    """words, n, hash, size, items, prefix (its rarest shingle), place (that one's in the window), bytes: one row for each window; None without windows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = stored(in_tasks(items, _cut, _WINDOWS), "windows")
    windows = found.groupBy("words").agg(*[F.first(c).alias(c) for c in ("n", "hash", "size", "shingles")], F.array_sort(F.collect_set("item")).alias("items"))
    places = windows.select("words", "size", F.posexplode("shingles").alias("place", "g"))
    often = rarity(docs, places.select("size", "g").distinct(), n_bytes)
    if often is None:
        return None
    rarest = places.join(often, ["size", "g"], "left").groupBy("words").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g", "place")).alias("r"))
    out = windows.join(rarest, "words").select("words", "n", "hash", "size", "items", F.col("r.g").alias("prefix"), F.col("r.place").alias("place"))
    ids = F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 8)
    return stored(out.withColumn("bytes", F.octet_length("words") + ids + 64), "index")


def _arranged(part: pa.Table) -> dict:
    """One block of the index, by shingle size in order of the prefixes."""
    part = part.combine_chunks().sort_by([("size", "ascending"), ("prefix", "ascending")])
    column = lambda c: part.column(c).combine_chunks()
    size, prefix = column("size").to_numpy(), column("prefix").to_numpy().view(W.U)
    by_size = {}
    for s in np.unique(size).tolist():
        own = np.flatnonzero(size == s)
        own = own[np.argsort(prefix[own], kind="stable")]
        keys, first = np.unique(prefix[own], return_index=True)
        by_size[s] = (keys, np.append(first, len(own)), own)
    return {"words": column("words"), "items": column("items"), "n": column("n").to_numpy().astype(np.int64), "hash": column("hash").to_numpy().view(W.U), "place": column("place").to_numpy().astype(np.int64), "by_size": by_size}


def _search(c: W.Chunk, ix: dict, seen: dict):
    """(first word, window) of every occurrence that begins in the chunk's own words."""
    h = c.hashes()
    by_length: dict[int, np.ndarray] = {}
    for g, (keys, first, own) in ix["by_size"].items():
        at, place = _members(shingle_hashes(h, c.left, g), seen[g], keys)
        n = first[place + 1] - first[place]
        at, entry = np.repeat(at, n), np.repeat(first[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        k = own[entry]
        start = at - ix["place"][k]
        # positional and length bounds: the window must lie within the document of its prefix
        inside = (start >= c.first[c.doc[at]]) & (start < c.mine) & (ix["place"][k] + c.left[at] >= ix["n"][k])
        start, k = start[inside], k[inside]
        for size in np.unique(ix["n"][k]).tolist():
            some = ix["n"][k] == size
            if size not in by_length:
                by_length[size] = W.grams(h, size)
            likely = by_length[size][start[some]] == ix["hash"][k[some]]
            for s, w in zip(start[some][likely].tolist(), k[some][likely].tolist()):
                if c.text(s, size) == ix["words"][w].as_py():
                    yield s, w


def _text(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("row").field("text").cast(pa.string()).fill_null("")


def _hit(batch: pa.RecordBatch, ix: dict, seen: dict) -> pa.RecordBatch:
    """The batch with one block's hits (pairs of first word and length) and items added to each row."""
    hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
    for c in W.chunks(_text(batch), W.ALNUM, W.LOWER, WINDOW - 1):
        found: dict[int, list[tuple[int, int]]] = {}
        for s, w in _search(c, ix, seen):
            found.setdefault(int(c.doc[s]), []).append((int(c.pos[s]), w))
        for d, x in found.items():
            hits[c.lo + d] += np.array([(s, ix["n"][w]) for s, w in x], np.int64).tobytes()
            items[c.lo + d] = sorted({*items[c.lo + d], *(i for w in {w for _, w in x} for i in ix["items"][w].as_py())})
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["row", "hits", "items"])


def _judged(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Words, and words inside hits, of each row."""
    text = _text(batch)
    n_words, n_hit = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    for c in W.chunks(text, W.ALNUM, W.LOWER):
        n_words[c.lo : c.hi] += np.diff(np.minimum(c.first, c.mine))
    for i, raw in enumerate(batch.column("hits").to_pylist()):
        if raw:
            step = np.zeros(n_words[i] + 1, np.int64)
            pairs = np.frombuffer(raw, np.int64).reshape(-1, 2)
            np.add.at(step, pairs[:, 0], 1)
            np.add.at(step, pairs[:, 0] + pairs[:, 1], -1)
            n_hit[i] = np.count_nonzero(np.cumsum(step[:-1]))
    return n_words, n_hit


def _contaminated(n_words: np.ndarray, n_hit: np.ndarray) -> np.ndarray:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    n_words, n_hit = _judged(batch)
    items = batch.column("items").to_pylist()
    return pa.RecordBatch.from_arrays(
        [batch.column("row").field("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array(_contaminated(n_words, n_hit))],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def _clean(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.select(["row"]).filter(pa.array(~_contaminated(*_judged(batch)), pa.bool_()))


def searched(docs: DataFrame, benchmark: DataFrame, finish, schema, n_bytes: int = INDEX_BYTES) -> DataFrame:
    """finish (batch of row, hits, items -> batch of schema) of docs, each row in one struct; the last block's pass applies it.

    hits: pairs of 64-bit integers (first word, number of words).
    """
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(b"").cast("binary").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    plain = documents(docs)

    def run(sent, last: bool):
        def passed(batches):
            ix = sent.value if sent is not None else None
            seen = {g: _bits(keys) for g, (keys, *_) in ix["by_size"].items()} if ix else {}
            for batch in batches:
                batch = _hit(batch, ix, seen) if ix else batch
                yield finish(batch) if last else batch

        return passed

    sent, made = None, index(plain, benchmark, n_bytes)
    for part in _blocks(made, "words", n_bytes) if made is not None else ():
        if part.num_rows:
            if sent is not None:
                out = in_tasks(out, run(sent, False), out.schema)
            sent = docs.sparkSession.sparkContext.broadcast(_arranged(part))
    return in_tasks(out, run(sent, True), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs."""
    return searched(documents(docs), benchmark, _digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", n_bytes)


def clean_documents(docs: DataFrame, benchmark: DataFrame, n_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    kept = T.StructType([T.StructField("row", docs.schema)])
    return searched(docs, benchmark, _clean, kept, n_bytes).select("row.*")
