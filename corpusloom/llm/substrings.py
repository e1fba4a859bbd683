"""Substring dedup with prefix-partitioned suffix trees.

A window is 35 consecutive words of one document: the first 35 words of the
suffix that starts there. It repeats if its suffix lies below an internal
node of string depth 35 or more of the corpus's suffix tree. That tree is
never built whole:

1. Suffixes are partitioned by a prefix of variable length, 8 to 35 words,
   that ends with the window's least 8-gram (by hash). Equal windows have
   equal prefixes. A run of neighbouring suffixes mostly shares its least
   8-gram, so one row stands for a run of them.
2. The runs of each prefix are counted. A prefix with one run holds only
   leaves and is pruned. A prefix of more than ``GROUP_RUNS`` runs is
   lengthened, for each of its suffixes, to all 35 words, and its suffixes are
   dealt to as many parts as the count asks for.
3. For what is left the words of the runs follow. Each group becomes a
   subtree cut at depth 35: words are numbered, suffixes are ranked by
   doubling the number of words compared, and a rank that two suffixes share
   is an internal node of that depth. Of a lengthened prefix each part passes
   on one suffix for each rank, and these meet once more.
4. Neighbouring repeated windows make the maximal repeats, and words that one
   covers are removed.

Before the first shuffle, a block of documents settles what repeats within the
block (there by 64-bit hashes of whole windows), and sends one suffix for each
distinct window. So a passage that many documents share gives at most a row
for each block, not one for each copy. Across blocks, words are compared.

Defined results: a null or empty text, or one without words, has no words and
its kept text is the empty string. Texts of fewer than 35 words lose nothing.
Repeated rows repeat each other's windows. Each input row gives one row.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import documents, keyed

WINDOW = 35
GRAM = 8
BLOCK_WINDOWS = 1_500_000
GROUP_RUNS = 1024
_RUN = "m long, local boolean, did long, text_key long, p long, n int"
#: again: the key under which a lengthened prefix's parts meet, else null
_WORDS = _RUN + ", again long, words binary"


def least_grams(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each word, the least hash of the grams within the window of words from there (of no use near a document's end)."""
    g, width, span = W.grams(h, gram), window - gram + 1, 1
    while span < width:
        step = min(span, width - span)
        if len(g) > step:
            g = np.append(np.minimum(g[:-step], g[step:]), g[-step:])
        span += step
    return g


def runs(p: np.ndarray, row: np.ndarray, m: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive positions of a row (with the same m) begin, and their lengths."""
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (row[1:] != row[:-1])
    if m is not None:
        new[1:] |= m[1:] != m[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(p)))


def _settle(whash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are the first of their kind, and which occur more than once, within a block."""
    order = np.argsort(whash, kind="stable")
    s = whash[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(s)))
    first, many = np.zeros(len(s), bool), np.zeros(len(s), bool)
    first[order[new]] = True
    many[order] = np.repeat(size > 1, size)
    return first, many


def _run_rows(m, local: bool, did, key, p, n, again=None, words=None) -> pa.RecordBatch:
    if local:  # settled: no need to meet others, so dealt evenly
        m = W.mix(key.view(W.U) ^ p.view(W.U))
    out = {"m": pa.array(m.view(np.int64)), "local": pa.array(np.full(len(p), local)), "did": pa.array(did), "text_key": pa.array(key), "p": pa.array(p), "n": pa.array(n.astype(np.int32))}
    return pa.RecordBatch.from_pydict(out if words is None else out | {"again": again, "words": words})


def _prefixes(window: int, gram: int):
    def flush(parts):
        whash, m, row, p, did, key = (np.concatenate(x) for x in zip(*parts))
        first, many = _settle(whash)
        for some, local in ((first, False), (many, True)):
            at = np.flatnonzero(some)
            if len(at):
                a, n = runs(p[at], row[at], None if local else m[at])
                a = at[a]
                yield _run_rows(m[a], local, did[a], key[a], p[a], n)

    def run(batches):
        parts, size, rows = [], 0, 0
        for batch in batches:
            did, key = batch.column("did").to_numpy(), batch.column("text_key").to_numpy()
            for c in W.chunks(W.text_column(batch), W.SPACED, overlap=window):
                h = c.hashes()
                at = c.begins(window)
                if len(at):
                    doc = c.doc[at] + c.lo
                    parts.append((W.grams(h, window)[at], least_grams(h, window, gram)[at], doc + rows, c.pos[at], did[doc], key[doc]))
                    size += len(at)
                if size >= BLOCK_WINDOWS:
                    yield from flush(parts)
                    parts, size = [], 0
            rows += batch.num_rows
        if parts:
            yield from flush(parts)

    return run


def _suffixes(window: int, gram: int, group_runs: int):
    """From each text and the runs that remain of it, the runs with their words; those of a crowded prefix suffix by suffix."""

    def run(batches):
        for batch in batches:
            did, key, found = batch.column("did").to_numpy(), batch.column("text_key").to_numpy(), batch.column("runs")
            for c in W.chunks(W.text_column(batch), W.SPACED, overlap=window):
                h = c.hashes()
                whole, least = W.grams(h, window), least_grams(h, window, gram)
                own, few, many = [], [], []
                for d in range(c.hi - c.lo):
                    shift = int(c.first[d]) - c.base
                    until = int(c.first[d + 1]) - shift if c.whole else c.base + c.mine
                    for r in found[c.lo + d].as_py():
                        p, end = max(r["p"], c.base), min(r["p"] + r["n"], until)
                        if p < end:
                            parts = -(-(r["met"] or 0) // group_runs)
                            if r["local"]:
                                own.append((c.lo + d, p + shift, p, end - p, 0))
                            elif parts < 2:
                                few.append((c.lo + d, p + shift, p, end - p, 0))
                            else:
                                many.extend((c.lo + d, q + shift, q, 1, parts) for q in range(p, end))
                raw = c.data.data
                for local, rows, longer in ((True, own, False), (False, few, False), (False, many, True)):
                    if not rows:
                        continue
                    d, at, p, n, parts = (np.array(x, np.int64) for x in zip(*rows))
                    m, again, words = least[at], pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())
                    if not local:
                        ends = c.ends[at + n + window - 2]
                        words = pa.array([bytes(raw[x:y]) for x, y in zip(c.starts[at].tolist(), ends.tolist())], pa.binary())
                    if longer:
                        part = W.mix(key[d].view(W.U)) % parts.view(W.U)
                        m, again = W.mix(whole[at] ^ W.mix(part + W.U(1))), pa.array(whole[at].view(np.int64))
                    yield _run_rows(m, local, did[d], key[d], p, n, again, words)

    return run


def ranks(ids: np.ndarray, window: int) -> np.ndarray:
    """The rank of each suffix by its first ``window`` ids; equal ranks for equal ones. The last window - 1 have no use."""
    rank, span = ids.astype(np.int64), 1
    while span < window:
        step = min(span, window - span)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.append(np.unique(pair, return_inverse=True)[1], np.zeros(step, np.int64))
        span += step
    return rank


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the strings, equal for equal words, and where each string's words begin."""
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    edges = np.cumsum(size) - size
    starts, ends = W._runs(raw, W.SPACED, edges)
    letters = raw[W.SPACED[raw] == 1].tobytes()
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy(), np.searchsorted(starts, edges)


def _subtrees(window: int):
    """Sorted by prefix group: suffixes that share their window with another, as settled runs; of a lengthened prefix also one suffix for each window, to meet again."""

    def settled(did, key, p, n):
        if len(p):
            yield _run_rows(p, True, did, key, p, n, pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.binary()))

    def emit(t: pa.Table):
        did, key, p, n = (t.column(x).to_numpy() for x in ("did", "text_key", "p", "n"))
        local = t.column("local").to_numpy(zero_copy_only=False)
        own = np.flatnonzero(local)
        yield from settled(did[own], key[own], p[own], n[own])
        own = np.flatnonzero(~local)
        if not len(own):
            return
        words = t.column("words").combine_chunks().take(pa.array(own))
        ids, first = word_ids(words)
        size = n[own].astype(np.int64)
        row = np.repeat(np.arange(len(own)), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        rank = ranks(ids, window)[first[row] + step]
        _, begin, node, count = np.unique(rank, return_index=True, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[node] > 1)
        if len(at):
            a, k = runs(p[own][row[at]] + step[at], row[at])
            a = at[a]
            yield from settled(did[own][row[a]], key[own][row[a]], p[own][row[a]] + step[a], k)
        again = t.column("again").combine_chunks().take(pa.array(own))
        open_ = row[begin][again.is_valid().to_numpy(zero_copy_only=False)[row[begin]]]  # rows of one suffix each
        if len(open_):
            pick = pa.array(open_)
            yield _run_rows(again.take(pick).to_numpy(), False, did[own][open_], key[own][open_], p[own][open_], n[own][open_], pa.nulls(len(open_), pa.int64()), words.take(pick))

    def run(batches):
        held = None
        for batch in batches:  # the last group of a batch may go on in the next
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            m = held.column("m").to_numpy()
            if len(m) and m[0] != m[-1]:
                cut = int(np.searchsorted(m, m[-1]))
                yield from emit(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield from emit(held)

    return run


def _remove(window: int):
    def run(batches):
        for batch in batches:
            texts, found = batch.column("text").to_pylist(), batch.column("found").to_pylist()
            total, removed, digests = [], [], []
            for text, windows in zip(texts, found):
                words = text.encode("utf-8").split()  # ASCII white space
                total.append(len(words))
                if windows:
                    step = np.zeros(len(words) + 1, np.int64)
                    for r in windows:
                        step[r["p"]] += 1
                        step[r["p"] + r["n"] - 1 + window] -= 1
                    keep = np.cumsum(step[:-1]) == 0
                    words = list(compress(words, keep.tolist()))
                removed.append(total[-1] - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeats(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, group_runs: int = GROUP_RUNS) -> DataFrame:
    """did, text_key, found: the runs (first start, number of starts) of each row's repeated windows, where it has any."""
    prefixes = rows.select("did", "text_key", "text").mapInArrow(_prefixes(window, gram), _RUN)
    met = prefixes.where("not local").groupBy("m").agg(F.count("*").alias("met")).where("met > 1")
    alive = prefixes.join(met, "m", "left").where("local or met is not null")
    of_row = alive.groupBy("did", "text_key").agg(F.collect_list(F.struct("local", "p", "n", "met")).alias("runs"))
    deep = rows.join(of_row, ["did", "text_key"]).mapInArrow(_suffixes(window, gram, group_runs), _WORDS)
    for _ in range(2):  # the second time for lengthened prefixes alone; settled runs pass
        deep = deep.repartition("m").sortWithinPartitions("m").mapInArrow(_subtrees(window), _WORDS)
    return deep.where("local").groupBy("did", "text_key").agg(F.collect_list(F.struct("p", "n")).alias("found"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_runs: int = GROUP_RUNS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of docs."""
    rows = keyed(documents(docs)).select("did", "text_key", "text", "doc_id")  # the same columns both times: one exchange serves both joins
    return rows.join(repeats(rows, window, gram, group_runs), ["did", "text_key"], "left").select("doc_id", "text", "found").mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
