"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

Within a task the words of a chunk of whole documents are one sequence of
symbols (document, word), each document ended by a symbol of its own, so that
no repeat crosses documents. Words are told apart by their bytes. Prefix
doubling sorts the suffixes; the ranks of each doubling are kept, as two of
them tell in one look whether two stretches of 2**k words are alike, which
gives the LCP array and the leftward extensions. Each LCP interval of depth d
is found by the nearest smaller LCPs on both sides, and its children by the
places of its own LCP value; no tree is built. Of every interval the suffixes
i of all children but the largest are tried: if i + d (or i - d) has its rank
in the interval and the words after differ, a square of period d ends there.
That square is rotated to the left as far as it goes, which merges all of its
rotations into one run. A stretch found with several periods keeps the
smallest. A document is handled as a whole: some 150 bytes of memory for each
of its words, and work n log n whatever the words are.

Defined results: a null or empty text has no words and no runs. A null doc_id
has no decimal, so its text stays as it is. Repeated rows each have their row.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import documents, in_tasks
from .words import SPACED, chunks, text_column

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
_SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def sources(doc_ids: list, first: np.ndarray) -> np.ndarray:
    """For each word of a chunk the word that stands there: every tenth document by hash repeats a stretch of itself."""
    out = np.arange(first[-1])
    for k, (doc_id, lo, n) in enumerate(zip(doc_ids, first[:-1].tolist(), np.diff(first).tolist())):
        if doc_id is None or not n:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[lo + a : lo + n] = lo + a + np.arange(n - a) % p
    return out


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by the first 1, 2, 4, ... symbols; the last tell all suffixes apart). Every document must end in a symbol that occurs once."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    key, slots, h = symbols[order], np.arange(n), 1
    rank, levels = np.zeros(n, np.int32), []
    while True:
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(key)))
        rank = rank.copy()
        rank[order[slots]] = np.repeat(slots[heads], sizes)
        levels.append(rank)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return order, levels
        at = order[slots]
        key = rank[at].astype(np.int64) * n + rank[at + h]
        by = np.argsort(key, kind="stable")
        order[slots], key, h = at[by], key[by], 2 * h


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix with the one before it; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    j = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, length = order[j - 1], order[j], np.zeros(len(j), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][a + length] == levels[k][b + length]) * (1 << k)
    lcp[j] = length
    return lcp


def previous_smaller(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value; values[0] must be smaller than all asked for."""
    mins = [values]
    while len(mins[-1]) > 1:
        last = mins[-1] if len(mins[-1]) % 2 == 0 else np.append(mins[-1], mins[-1][-1])
        mins.append(last.reshape(-1, 2).min(axis=1))
    limit, node, level = values[at], at.copy(), np.full(len(at), -1)
    left = np.arange(len(at))
    for k, m in enumerate(mins):  # up: the first block wholly before the place that holds a smaller value
        side = node[left] - 1
        hit = (node[left] % 2 == 1) & (m[side] < limit[left])
        level[left[hit]], node[left[hit]] = k, side[hit]
        left = left[~hit]
        node[left] >>= 1
    for k in range(len(mins) - 1, 0, -1):  # down: the rightmost such value in it
        here = np.flatnonzero(level == k)
        right = np.minimum(2 * node[here] + 1, len(mins[k - 1]) - 1)
        node[here] = np.where(mins[k - 1][right] < limit[here], right, 2 * node[here])
        level[here] = k - 1
    return node


def branching_squares(order: np.ndarray, levels: list[np.ndarray], longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, d): words i .. i+d-1 stand again at i+d, and what follows differs. longest: by place, the largest period that can matter."""
    none = np.zeros(0, np.int64)
    lcp, n = common_prefixes(order, levels), len(order)
    j = np.flatnonzero((lcp > 0) & (lcp <= longest[order]))
    if not len(j):
        return none, none
    lo, hi = previous_smaller(lcp, j), _next_smaller(lcp, j)
    d = lcp[j]
    by = np.lexsort((j, d, lo))
    j, d, lo, hi = j[by], d[by], lo[by], hi[by]
    new = np.ones(len(j), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (d[1:] != d[:-1])
    group = np.cumsum(new) - 1  # the interval of each place of its LCP value
    heads = np.flatnonzero(new)
    m = np.diff(np.append(heads, len(j)))
    first = heads + np.arange(len(heads))  # its first child; m + 1 children
    begins = np.empty(len(j) + len(heads), np.int64)
    begins[first], begins[np.arange(len(j)) + group + 1] = lo[heads], j
    ends = np.append(begins[1:], 0)
    ends[first + m] = hi[heads]
    of = np.repeat(np.arange(len(heads)), m + 1)
    sizes = ends - begins
    largest = np.maximum.reduceat(sizes, first)[of] == sizes
    large = np.flatnonzero(largest)
    small = np.ones(len(sizes), bool)
    small[large[np.unique(of[large], return_index=True)[1]]] = False  # one largest child of each is left out
    sizes, begins, of = sizes[small], begins[small], of[small]
    x = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    of = heads[np.repeat(of, sizes)]
    i, d, lo, hi = order[x], d[of], lo[of], hi[of]
    rank, symbol = levels[-1], levels[0]
    found = []
    for other, start in ((i + d, i), (i - d, i - d)):
        k = np.flatnonzero((other >= 0) & (other < n))
        r = rank[other[k]]
        k = k[(r >= lo[k]) & (r < hi[k])]
        k = k[symbol[start[k] + d[k]] != symbol[start[k] + 2 * d[k]]]
        found.append((start[k], d[k]))
    start, d = (np.concatenate(c) for c in zip(*found))
    if not len(start):
        return none, none
    return tuple(np.unique(np.stack([start, d]), axis=1))


def _next_smaller(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The nearest place after each with a smaller value, or the length."""
    back = np.append(values, -1)[::-1].copy()
    return len(values) - previous_smaller(back, len(values) - at)


def runs(symbols: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of length max(6, 4 * period) or more, by start, then period."""
    order, levels = suffix_ranks(symbols)
    i, d = branching_squares(order, levels, longest)
    back = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):  # rotate to the left
        at = i - back - (1 << k)
        ok = np.flatnonzero(at >= 0)
        ok = ok[levels[k][at[ok]] == levels[k][at[ok] + d[ok]]]
        back[ok] += 1 << k
    start, length = i - back, 2 * d + back
    keep = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * d)
    start, length, d = start[keep], length[keep], d[keep]
    by = np.lexsort((d, length, start))
    start, length, d = start[by], length[by], d[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, d = start[new], length[new], d[new]
    by = np.lexsort((d, start))
    return start[by], length[by], d[by]


def _words(chunk) -> pa.LargeStringArray:
    offsets = np.zeros(len(chunk.starts) + 1, np.int64)
    np.cumsum(chunk.ends - chunk.starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(chunk.starts), pa.py_buffer(offsets), pa.py_buffer(chunk.data[SPACED[chunk.data] == 1]))


def _chunk_rows(doc_ids: list, chunk) -> pa.RecordBatch:
    first, n_docs = chunk.first, len(doc_ids)
    words, source = _words(chunk), sources(doc_ids, chunk.first)
    n = np.diff(first)
    codes = words.dictionary_encode().indices.to_numpy()[source].astype(np.int64)
    n_codes = int(codes.max(initial=-1)) + 2
    at = np.arange(len(source)) + chunk.doc  # a place after each document is its end
    doc_at = np.repeat(np.arange(n_docs), n + 1)
    symbols = doc_at * n_codes + n_codes - 1
    symbols[at] -= n_codes - 1 - codes
    start, length, period = runs(symbols, (n // LEAST_EXPONENT)[doc_at])
    doc = doc_at[start]
    begin = first[:-1] + np.arange(n_docs)
    n_runs = np.bincount(doc, minlength=n_docs)

    edges = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.cumsum(edges[:-1])[at] == 0
    left = np.zeros(n_docs + 1, np.int64)
    np.cumsum(np.bincount(chunk.doc[kept], minlength=n_docs), out=left[1:])
    spaced = pc.binary_join_element_wise(words, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())).take(pa.array(source[kept]))
    _, places, data = spaced.buffers()
    places = np.frombuffer(places, np.int64)[left]
    data = memoryview(data) if data is not None else b""
    collapsed = [data[a : max(a, b - 1)] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]

    start = start - begin[doc]
    best = np.lexsort((period, start, -length, doc))
    best = best[np.unique(doc[best], return_index=True)[1]]
    top = [np.zeros(n_docs, np.int64) for _ in range(4)]
    for column, values in zip(top, (start, length, period, 1000 * length // np.maximum(period, 1))):
        column[doc[best]] = values[best]
    lines = [f"{s},{m},{p}\n" for s, m, p in zip(start.tolist(), length.tolist(), period.tolist())]
    ends = np.cumsum(n_runs).tolist()
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    empty = n_runs == 0
    columns = [pa.array(doc_ids, pa.int64()), pa.array(n), pa.array(n_runs), *[pa.array(c, mask=empty) for c in top]]
    columns += [pa.array([sha("".join(lines[b - k : b]).encode()) for b, k in zip(ends, n_runs.tolist())]), pa.array([sha(x) for x in collapsed])]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _SCHEMA.split(", ")])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256 of each row of docs, its text periodised as ``sources`` says."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for chunk in chunks(text_column(batch), SPACED, cut=False):
                yield _chunk_rows(ids[chunk.lo : chunk.hi], chunk)

    return in_tasks(documents(docs), run, _SCHEMA)
