"""SimHash near-dedup with a pigeonring filter.

A fingerprint is the majority of the XXH64 of a text's word shingles, bit by
bit. Two fingerprints link at ``DISTANCE`` (3) or fewer differing bits. Take
the 64 bits as a ring of 16 segments of 4 bits. If the total is at most 3,
some segment starts a chain of which each prefix of l segments differs in at
most floor(3 l / 16) bits: none in the first 5 segments, at most 1 in 10, 2 in
15, 3 in 16. So fingerprints are dealt, for each of the 16 places on the ring,
by the 20 bits of the first 5 segments, and, as the next 20 bits hold at most
one difference, by either 10-bit half of these: 32 keys of 30 bits that lose
no pair. Within a key the chain conditions prune pairs before the full
Hamming check.

Only distinct fingerprints are dealt, equal ones having been grouped first. A
key's fingerprints give the edges of a spanning forest of their links, so no
key emits pairs by the square; large keys are split by further bits in the
same way first. The forests' union has the components of all links, found by
large-star/small-star rounds on stored edges.

Defined results: a null or empty text, or one without words, has fingerprint
zero and links like any other. Fewer words than a shingle: the whole sequence
is the one shingle. component_id is the smallest doc_id of the component,
null only if all are null. Each input row gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import documents, in_tasks, stored
from .words import U

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS = 16
DENSE = 1024
_SOME = 1 << 16
_LANES = U(0x0101010101010101)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included."""
    joined = b" ".join(text.encode("utf-8").lower().split())
    if not joined:
        return np.zeros(0, U)
    cuts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(cuts) < size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], U)
    first, last = np.append(0, cuts + 1), np.append(cuts, len(joined))[size - 1 :]
    digest, out = xxhash.xxh64_intdigest, np.empty(len(last), U)
    for i in range(0, len(last), _SOME):
        out[i : i + _SOME] = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first[i : i + _SOME].tolist(), last[i : i + _SOME].tolist())), U)
    return out


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The bits set in over half of the shingle hashes."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 255 * 256):  # byte lanes hold counts up to 255
        part = h[i : i + 255 * 256]
        groups = np.arange(0, len(part), 255)
        for bit in range(8):
            lanes = np.add.reduceat(part >> U(bit) & _LANES, groups)
            counts[bit::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > len(h)).tolist()))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs with fp (the fingerprint's 64 bits as a signed integer) in place of text."""
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t or "", size) for t in batch.column("text").to_pylist()], U)
            yield batch.select([f.name for f in rest]).append_column("fp", pa.array(fp.view(np.int64)))

    return in_tasks(docs, run, T.StructType([*rest, T.StructField("fp", T.LongType())]))


def _keys(fp: np.ndarray) -> np.ndarray:
    """The 32 keys of each fingerprint, each led by its number."""
    out = np.empty((len(fp), 2 * SEGMENTS), np.int64)
    for s in range(SEGMENTS):
        k = U(4 * s)
        turned = fp if s == 0 else (fp << k) | (fp >> (U(64) - k))
        head = turned >> U(44)
        for half in range(2):
            rest = turned >> U(34 - 10 * half) & U(1023)
            out[:, 2 * s + half] = ((U(2 * s + half) << U(30)) | (head << U(10)) | rest).astype(np.int64)
    return out


_CHAINS = [(20, 0), (40, 1), (60, 2), (64, 3)]  # bits of the chain's prefix, differences allowed


def _linked(a: np.ndarray, b: np.ndarray, place: int) -> np.ndarray:
    """Which pairs pass the chain conditions from a place on the ring, and the Hamming check."""
    k = U(4 * place)
    d = a ^ b
    d = d if place == 0 else (d << k) | (d >> (U(64) - k))
    ok = np.bitwise_count(d >> U(24)) <= 1
    ok[ok] = np.bitwise_count(d[ok] >> U(4)) <= 2
    ok[ok] = np.bitwise_count(d[ok]) <= DISTANCE
    return ok


def forest(fp: np.ndarray, place: int, free: tuple[int, ...] | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the links among distinct fingerprints that share a key.

    Up to DENSE of them are compared with each other. More are split by the
    value of each fourth of the bits still free; at most 3 differences leave
    one fourth equal, so no link is lost.
    """
    root = list(range(len(fp)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []

    def union(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            edges.append((int(fp[i]), int(fp[j])))

    def dense(at: np.ndarray) -> None:
        for k, i in enumerate(at[:-1].tolist()):
            rest = at[k + 1 :]
            for j in rest[_linked(fp[rest], np.full(len(rest), fp[i]), place)].tolist():
                union(i, j)

    def split(at: np.ndarray, bits: list[int]) -> None:
        if len(at) <= DENSE or len(bits) < DISTANCE + 1:
            dense(at)
            return
        for q in range(DISTANCE + 1):
            mask = U(sum(1 << b for b in bits[q :: DISTANCE + 1]))
            value = fp[at] & mask
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            if not len(cuts):  # all equal here: the other fourths split them
                split(at, [b for b in bits if not int(mask) >> b & 1])
                return
            for part in np.split(order, cuts):
                if len(part) > 1:
                    split(at[part], [b for b in bits if not int(mask) >> b & 1])

    varying = int(np.bitwise_or.reduce(fp) ^ np.bitwise_and.reduce(fp)) if len(fp) else 0
    split(np.arange(len(fp)), [b for b in range(64) if varying >> b & 1])
    return edges


def links(distinct: DataFrame) -> DataFrame:
    """Edges a > b (as signed integers) of which the components are those of all links between distinct fingerprints fp."""

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(U)
            if len(fp):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(fp).ravel()), pa.array(np.repeat(fp, 2 * SEGMENTS).view(np.int64))], ["key", "fp"])

    def meet(batches):
        for key, fp in whole_keys(batches):
            yield from _edges(key, fp.view(U))

    dealt = in_tasks(distinct, deal, "key long, fp long")
    return in_tasks(dealt.repartition("key").sortWithinPartitions("key"), meet, "a long, b long")


def whole_keys(batches):
    """The columns of batches sorted by the first, cut where it changes: the last key of a batch may go on in the next."""
    held: list = []
    for batch in batches:
        now = [batch.column(k).to_numpy() for k in range(batch.num_columns)]
        if not len(now[0]):
            continue
        if held and held[0][0][0] == now[0][-1]:  # still the same key
            held.append(now)
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in now])]
        held = [[x[cut:] for x in now]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _edges(key: np.ndarray, fp: np.ndarray):
    if len(key) < 2:
        return
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    found: list[tuple[int, int]] = []
    two = first[size == 2]
    for place in range(SEGMENTS):
        own = two[(key[two] >> 31) == place]
        ok = _linked(fp[own], fp[own + 1], place)
        found += zip(fp[own][ok].tolist(), fp[own + 1][ok].tolist())
    for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        found += forest(np.unique(fp[a : a + n]), int(key[a] >> 31))
    if found:
        pairs = np.array(found, U).view(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of edges a > b, by large-star and small-star rounds (Kiveris et al. 2014)."""
    edges = stored(edges.distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def labelled(fps: DataFrame) -> DataFrame:
    """fp, root for each distinct fingerprint: the components of all links."""
    distinct = fps.select("fp").distinct()
    roots = components(links(distinct))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row for each row of docs."""
    fps = stored(fingerprints(documents(docs), size), "fingerprints")
    # least doc_id first by fingerprint, so that a fingerprint of many rows is one row when components meet
    least = labelled(fps).join(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    by_fp = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
