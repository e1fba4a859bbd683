"""Near copies by fingerprints (op6) and the Jaccard similarity of five-word shingle sets, found without loss.

Two texts link if the similarity of their sets is 4/5 or more. First those
meet whose fingerprints (op6) link, and an exact check follows; at this
similarity fingerprints lose links, which the sets' shingles then find. Shingles are
put in one order, those met often in a sample of the texts last; of n of them
a set sends its first n - ceil(4 n / 5) + 1. Two sets that link share one of
these, so that no link is lost whatever the order is; it only keeps common
passages from meeting. Pairs that meet must pass the bounds that their sizes
and places allow; then the parities of the sets' shingles in 2,048 classes,
which differ in no more classes than the sets in shingles; then the comparison
of whole sets. A group of many near copies is not compared pair by pair: sets
that are in one component already need not meet (``links``).

Only distinct sets meet. Shingles and sets are compared by 64-bit hashes.
Words are split at ASCII white space, A-Z lower-cased. Fewer words than a
shingle: the whole sequence is the one shingle. Texts without words have the
empty set and link with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop_old_shuffles, in_tasks, nested, perhaps_in, row_keys, stored
from .simhash import components, fingerprints, links as fingerprint_links
from .words import LOWER, SPACED, U, chunks, grams, mix, text_column

SHINGLE = 5
#: Of the texts, one in this many is sampled for common shingles; of those met COMMON times there, the first MOST are ordered last.
SAMPLE = 16
COMMON = 4
MOST = 1 << 17
#: Sets are compared with one set of the key's largest component as long as one in FEW of these pairs links.
FEW = 8
_CLASSES = 1 << 11


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """The distinct shingle hashes of each text, in ascending order; a long text's pieces are gathered."""
    held: list = []
    for c in chunks(column, SPACED, LOWER, size):
        h = c.hashes()
        full = grams(h, size)
        if not c.whole:
            held.append(full[c.begins(size)])
            if c.final:
                yield np.unique(np.concatenate(held)) if c.base + len(c.starts) >= size else _short(h, size)
                held = []
            continue
        for a, b in zip(c.first[:-1].tolist(), c.first[1:].tolist()):
            yield np.unique(full[a : b - size + 1]) if b - a >= size else _short(h[a:b], size)


def _short(h: np.ndarray, size: int) -> np.ndarray:
    """Fewer words than a shingle: the whole sequence, if there is one."""
    return grams(h, len(h))[:1] if len(h) else np.zeros(0, U)


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def similar(na, nb, common):
    """Whether sets of na and nb shingles, common to both so many, have a similarity of 4/5 or more."""
    return 9 * common >= 4 * (na + nb)


def parities(s: np.ndarray) -> np.ndarray:
    """For each class of shingle hashes, by their first bits, whether it holds an odd number of the set's; 64 classes an integer."""
    return np.packbits(np.bincount((s >> U(53)).astype(np.int64), minlength=_CLASSES) & 1 == 1).view(np.int64)


def common_shingles(rows: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """The shingles of many sampled texts, the most common last."""

    def run(batches):
        for batch in batches:
            for s in shingle_sets(text_column(batch), size):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["g"])

    sampled = rows.where(F.pmod(F.col("text_key"), F.lit(SAMPLE)) == 0).select("text")
    found = in_tasks(sampled, run, "g long").groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.array([r["g"] for r in found.orderBy(F.desc("n"), "g").limit(MOST).collect()][::-1], np.int64).view(U)


def prefixes(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """did, text_key, last, sid (the set), n (its size), prefix (its first shingles' hashes) and its parities of each row."""
    last = common_shingles(rows, size)
    order = np.argsort(last)
    sent = rows.sparkSession.sparkContext.broadcast((last[order], order))

    def run(batches):
        often, rank = sent.value
        for batch in batches:
            sid, n, first, odd = [], [], [], []
            for s in shingle_sets(text_column(batch), size):
                place = np.zeros(len(s), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    place = np.where(often[at] == s, rank[at] + 1, 0)
                sid.append(np.array([len(s), s.sum(dtype=U), mix(s).sum(dtype=U)], "<u8").tobytes())
                n.append(len(s))
                odd.append(parities(s))
                first.append(s[np.argsort(place, kind="stable")[: prefix_length(len(s))]].tobytes())
            yield batch.select(["did", "text_key", "last"]).append_column("sid", pa.array(sid, pa.binary())).append_column("n", pa.array(n, pa.int32())).append_column("prefix", pa.array(first, pa.binary())).append_column("parities", pa.array(odd, pa.list_(pa.int64())))

    return in_tasks(rows.select("did", "text_key", "last", "text"), run, "did long, text_key long, last boolean, sid binary, n int, prefix binary, parities array<long>")


def members(all_: DataFrame) -> DataFrame:
    """key, node, n, pos, rep, ok, many: the rows of each shingle that opens more than one set. all_: node, n, prefix; a task sends a set once.

    rep is the key's smallest node, ok whether the bounds let it link with the
    row's, many whether there are more than two. A long key is streamed, not held.
    """

    def deal(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            node, at = np.unique(batch.column("node").to_numpy(), return_index=True)
            batch = batch.take(pa.array(at[~np.isin(node, seen)]))
            seen = np.union1d(seen, node)
            first = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
            if sum(map(len, first)):
                many = np.array([*map(len, first)])
                node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in many.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.repeat(node, many)), pa.array(np.repeat(n, many)), pa.array(pos)], ["key", "node", "n", "pos"])

    def meet(batches):
        held, rep, sent, seen = [np.zeros(0, np.int64)] * 4, None, 0, None  # of the last key: rows not yet sent, its first row, how many were sent; the last row
        for batch in batches:
            now = [batch.column(k).to_numpy().astype(np.int64) for k in range(4)]
            if not len(now[0]):
                continue
            new = np.append((now[0][0], now[1][0]) != seen, (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]))  # tasks may have sent one set each
            seen, now = (now[0][-1], now[1][-1]), [np.append(x, y[new]) for x, y in zip(held, now)]
            if not len(now[0]):
                continue
            first = np.flatnonzero(np.append(True, now[0][1:] != now[0][:-1]))
            size = np.diff(np.append(first, len(now[0])))
            group = np.repeat(np.arange(len(first)), size)
            reps = np.stack([x[first] for x in now])
            if sent and reps[0, 0] == rep[0]:
                reps[:, 0], size[0] = rep, size[0] + sent
            stop = int(first[-1]) if size[-1] <= 2 else len(group)
            yield from rows([x[:stop] for x in now], reps[:, group[:stop]], size[group[:stop]])
            held, rep, sent = [x[stop:] for x in now], reps[:, -1], 0 if size[-1] <= 2 else int(size[-1])
        if len(held[0]):
            yield from rows(held, np.repeat(rep[:, None], len(held[0]), axis=1), np.full(len(held[0]), len(held[0])))

    def rows(now, reps, size):
        at = np.flatnonzero(size > 1)
        if len(at):
            (key, node, n, pos), (_, rep, m, place) = (x[at] for x in now), reps[:, at]
            ok = similar(n, m, np.minimum(n - pos, m - place))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(n), pa.array(pos), pa.array(rep), pa.array(ok), pa.array(size[at] > 2)], ["key", "node", "n", "pos", "rep", "ok", "many"])

    dealt = in_tasks(all_.select("node", "n", "prefix"), deal, "key long, node long, n int, pos int")
    return in_tasks(dealt.repartition("key").sortWithinPartitions("key", "node"), meet, "key long, node long, n long, pos long, rep long, ok boolean, many boolean")


def pair(a, b):
    return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")


def unsettled(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of keys whose sets are not all in one component: key, node, n, pos, root, and major (its key's most common component)."""
    rows = found.select("key", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    top = each.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("top"), F.count("*").alias("roots")).where("roots > 1")
    return rows.join(top, "key").select("key", "node", "n", "pos", "root", (F.col("root") == F.col("top")).alias("major"))


def stars(open_: DataFrame, turn: int) -> DataFrame:
    """Pairs of each set outside its key's most common component with one set of that."""
    rep = open_.where("major").groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("rep")))["rep"].alias("rep"))
    return open_.where("NOT major").join(rep, "key").select(*pair("node", "rep")).distinct()


def _differ(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def crossing(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of sets that share a key but no component, as far as their sizes, places and parities allow a link."""
    rows = open_.join(sets.select("node", "parities"), "node")
    x, y = rows.where("NOT major").alias("x"), rows.alias("y")
    reach = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    likely = (F.col("x.root") != F.col("y.root")) & similar(F.col("x.n"), F.col("y.n"), reach) & (9 * _differ("x.parities", "y.parities") <= F.col("x.n") + F.col("y.n"))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & likely).select(*pair("x.node", "y.node")).distinct()


def close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose parities allow a link: sets that link differ in a ninth of their sizes' sum at most."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parities").alias(f"p{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(9 * _differ("pa", "pb") <= F.col("na") + F.col("nb")).select("a", "b")


def fingerprint_pairs(rows: DataFrame, all_: DataFrame) -> DataFrame:
    """Pairs a > b of nodes whose fingerprints link by op6, enough of them for its components: of one fingerprint each node with the smallest, of two that link the smallest ones. rows: did, text_key, text. all_: did, text_key, node."""
    fps = stored(fingerprints(rows.select("did", "text_key", "text")), "fingerprints")
    each = stored(all_.select("did", "text_key", "node").distinct().join(fps.distinct(), ["did", "text_key"]).select("fp", "node").distinct(), "nodes")
    least = each.groupBy("fp").agg(F.min("node").alias("rep"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}"))
    across = fingerprint_links(least.select("fp")).distinct().join(of("a"), "a").join(of("b"), "b").select(*pair("rep_a", "rep_b"))
    return each.join(least, "fp").select(*pair("node", "rep")).union(across).where("a != b").distinct()


def links(rows: DataFrame, all_: DataFrame, sets: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Pairs a > b of nodes that link, enough of them for the components of all links.

    First those are compared whose fingerprints link (op6), and each key's sets with its smallest one. Only sets of
    different components that share a key are compared further: with one of
    the key's most common component as long as many of these link, then all.
    rows: did, text_key, text. all_: node, n, prefix. sets: node, n, parities,
    and did and text_key of one row for each node.
    """
    spark, met = rows.sparkSession, stored(members(all_), "members")

    def run(batches):
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(text_column(batch), size)]
            yield batch.select(["node"]).append_column("s", pa.array(found, pa.list_(pa.int64())))

    def linked(pairs):
        likely = stored(close(pairs, sets), "likely")
        wanted = sets.select("node", "did", "text_key").join(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        texts = perhaps_in(rows.select("did", "text_key", "text"), wanted, "text_key").join(wanted, ["did", "text_key"]).select("node", "text")
        whole = stored(in_tasks(texts, run, "node long, s array<long>"), "shingles")
        both = likely.join(whole.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(whole.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
        return stored(both.where(similar(F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y")))).select("a", "b").distinct(), "links")

    checked = stored(fingerprint_pairs(rows, all_).union(met.where("ok AND node != rep").select(*pair("node", "rep"))).distinct(), "pairs")
    found, last, turn, open_ = linked(checked), False, 0, met.where("many")
    gain, tried = found.count(), checked.count()
    while not last:
        drop_old_shuffles(spark)
        open_ = stored(unsettled(open_, components(found).select("node", "root")), "unsettled")
        if open_.isEmpty():
            break
        last = gain * FEW <= tried  # stars decide speed only: where they find little, all pairs that are left
        pairs = stored((crossing(open_, sets) if last else stars(open_, turn)).join(checked, ["a", "b"], "left_anti"), "pairs")
        new = linked(pairs)
        found, checked, turn = found.union(new), checked.union(pairs), turn + 1
        gain, tried = new.count(), pairs.count()
    drop_old_shuffles(spark)
    return found


def representatives(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of docs, with all its columns, for each component of links: that of the smallest doc_id (null last).

    Texts are sent twice, to what says whether they are wanted, and never
    sorted; whole rows meet only where doc_id and text are repeated.
    """
    rows = docs.select(*[c.alias(k) for k, c in row_keys().items()], F.col("doc_id").isNull().alias("last"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    all_ = stored(prefixes(rows, size).withColumn("node", F.xxhash64("sid")).drop("sid"), "prefixes")
    rank = F.struct("last", "did", "text_key")
    one = all_.groupBy("node").agg(F.min(rank).alias("k"), F.first("n").alias("n"), F.first("parities").alias("parities"))
    sets = stored(one.select("node", "k.*", "n", "parities"), "sets")
    roots = components(links(rows, all_, sets, size)).withColumnRenamed("node", "_node")
    least = sets.join(roots, F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(rank).alias("k"))
    often = all_.groupBy("did", "text_key").agg(F.count("*").alias("copies"))
    kept = stored(least.select("k.did", "k.text_key").join(often, ["did", "text_key"]), "kept")
    chosen = lambda x: nested(docs).join(kept.where(x).select("did", "text_key").hint("shuffle_hash"), ["did", "text_key"], "left_semi")
    out = chosen("copies = 1").select("row.*")
    if not kept.where("copies > 1").isEmpty():
        out = out.unionByName(chosen("copies > 1").dropDuplicates(["did", "text_key"]).select("row.*"))
    return out
