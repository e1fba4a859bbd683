"""Token counts with a map-side two-tier lookup.

First the frequent pre-tokens of all documents are found: each task counts
its own, keeping a bounded number, and the tasks' summaries are merged in two
steps, so no pre-token is shuffled. Their token counts make a compact hash
table (a blob of pre-tokens and one byte each), which is broadcast: at most
``TABLE`` entries. A text's tokens are then the sum of its pre-tokens' counts,
from that table, or else from the worker's cache, which encodes what it has
not seen. The table decides speed only, never a result.

Defined results: a null or empty text has no bytes and no tokens. Each input
row gives one row, whatever its doc_id.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pretokens as P
from .common import documents

TABLE = 1 << 15
SUMMARY = 1 << 17
LIMIT = 2048


def _bounded(counter: Counter, most: int) -> Counter:
    """The most frequent entries, ties by pre-token."""
    if len(counter) <= most:
        return counter
    return Counter(dict(sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:most]))


def _pack(counter: Counter) -> pa.RecordBatch:
    blob = zlib.compress(pickle.dumps(dict(_bounded(counter, TABLE))), 1)
    return pa.RecordBatch.from_pydict({"summary": pa.array([blob], pa.binary())})


def _count(batches):
    counter: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if P.plain(text):
                counter.update(P.WORD_BPE(text.lower()))
                if len(counter) > 2 * SUMMARY:
                    counter = _bounded(counter, SUMMARY)
    yield _pack(counter)


def _merge(batches):
    counter: Counter = Counter()
    for batch in batches:
        for blob in batch.column("summary").to_pylist():
            counter = _bounded(counter + Counter(pickle.loads(zlib.decompress(blob))), SUMMARY)
    yield _pack(counter)


def frequent(docs: DataFrame) -> list[str]:
    """At most TABLE pre-tokens, the most frequent first."""
    summaries = docs.select("text").mapInArrow(_count, "summary binary")
    some = max(1, math.isqrt(summaries.rdd.getNumPartitions()))
    total: Counter = Counter()
    for row in summaries.repartition(some).mapInArrow(_merge, "summary binary").toLocalIterator():
        total = _bounded(total + Counter(pickle.loads(zlib.decompress(row["summary"]))), SUMMARY)
    return list(_bounded(total, TABLE))


_caches: dict = {}


def _cache(path: str, run: str, sent) -> P.Cache:
    """The worker's cache of one run; that of the run before is dropped."""
    if (path, run) not in _caches:
        _caches.clear()
        t = P.tokenizer(path)
        names, lengths = sent.value
        ends = P.marked(t, lambda x: x.endswith("</w>"))

        def encode(tokens):
            cuts, tokens = P.split_ids(t, tokens, ends)
            return dict(zip(tokens, np.diff(cuts).tolist()))

        _caches[path, run] = P.Cache(encode, zip(names.split("\n"), np.frombuffer(lengths, np.uint8).tolist()) if lengths else ())
    return _caches[path, run]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs, as word_bpe_49k.json gives them."""
    plain = documents(docs)
    table = frequent(plain)
    t = P.tokenizer(tokenizer_path)
    known = [(x, n) for x, n in zip(table, (len(e) for e in t.encode_batch(table, add_special_tokens=False))) if n < 256]
    run = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(("\n".join(x for x, _ in known), bytes(n for _, n in known)))

    def count(batches):
        lengths, whole = _cache(tokenizer_path, run, sent), P.tokenizer(tokenizer_path)
        for batch in batches:
            texts, n = batch.column("text").to_pylist(), []
            for lo, hi in P.blocks(texts):
                tokens = [P.WORD_BPE(x.lower()) if P.plain(x) else None for x in texts[lo:hi]]
                get = lengths.table(set().union(*(x for x in tokens if x is not None))).__getitem__
                n += [len(whole.encode(x, add_special_tokens=False)) if found is None else sum(map(get, found)) for x, found in zip(texts[lo:hi], tokens)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = plain.withColumn("n_bytes", F.octet_length("text").cast("long")).select("doc_id", "n_bytes", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
