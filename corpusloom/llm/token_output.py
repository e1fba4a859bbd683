"""Token-ID output compressed by Re-Pair grammars.

Documents in ascending order of doc_id (range partitions, each sorted) are
encoded and cut into shards of whole documents. In each shard frequent pairs
of ids are replaced by nonterminals, round after round, until no pair has
LEAST_USES places or the symbols are used up; pairs never reach across a
document's end. A shard is written with its rules, the number of ids
that each rule expands to, and the place of each document in the sequence, so
that any document, or any id by its place, is decoded without the rest.

A shard's bytes (all numbers little-endian):

    8   magic "RPAIR001"
    8*3 number of documents d, of rules r, of symbols s (uint64)
    8*d doc_id (int64), and d/8 bytes of bits that mark null ids
    8*(d+1) place of each document's first symbol, and s (uint64)
    8*(d+1) ids before each document in the shard, and all (uint64)
    4*2*r left and right symbol of each rule (uint32); symbol vocab + i is rule i
    4*r ids that each rule expands to (uint32)
    4   vocab (uint32)
    2*s or 4*s symbols (uint16 if vocab + r <= 65536)

Files are Parquet tables of one row for each shard: part, before (ids before
it in its part), n_tokens, shard. They lie in the session's shared folder.

Defined results: a null or empty text gives the end id alone. Null ids come
first; rows with one doc_id stand in order of their texts. No rows give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import pretokens as P
from .common import documents, in_tasks, scratch

END = 2
SHARD_TOKENS = 1 << 20
RULES_A_ROUND = 2048
LEAST_USES = 4
CACHED = 150_000  # stretches in each of two generations of a worker's cache: memory against time, the ids are the same
_MAGIC = b"RPAIR001"
_BUCKETS = 1 << 18


def frequent(pair: np.ndarray, places: np.ndarray, after: np.ndarray, shift: int, closed: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to room of the pairs (at places of the sequence) that have LEAST_USES places or more that do not overlap, the most frequent first; and all pairs that have so many places and may be replaced now or later."""
    kind, more = pair.dtype.type, LEAST_USES - 1
    order = np.sort(pair)
    if len(order) <= more:
        return order[:0], order[:0]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], order[more:] == order[:-more], [False]]).view(np.int8)))
    found, count = order[edges[::2]], edges[1::2] - edges[::2] + more
    left, right = found >> kind(shift), found & ((kind(1) << kind(shift)) - kind(1))
    hot = ~closed[left.astype(np.int64)]
    found, count, own = found[hot], count[hot], np.flatnonzero((left == right)[hot])  # a pair of one symbol overlaps itself
    open_pairs = found
    if len(own):
        same = np.flatnonzero(pair >> kind(shift) == (pair & ((kind(1) << kind(shift)) - kind(1))))
        apart, n = np.unique(pair[same[every_other(places[same], after)]], return_counts=True)
        count[own] = n[np.searchsorted(apart, found[own])]
    found, count = found[count >= LEAST_USES], count[count >= LEAST_USES]
    if len(found) > room:
        at = np.argpartition(count, -room)[-room:]
        found, count = found[at], count[at]
    return found[np.argsort(-count, kind="stable")], open_pairs


def every_other(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of some ascending places are taken, where of overlapping ones every other is, from the left. after: the place that follows each."""
    new = np.append(True, after[at[:-1]] != at[1:])
    first = np.flatnonzero(new)
    return np.flatnonzero((np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0)


def compress(ids: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence with frequent pairs replaced until none is left or the symbols are used up, and the rules (pairs of symbols). No left symbol of a pair ends with END."""
    small = vocab < 65536  # then no symbol takes more than 16 bits, and a pair fits 32
    limit, shift, kind = (65535 - vocab, 16, np.uint32) if small else (1 << 16, 32, np.uint64)
    spread, down = (kind(0x9E3779B1), kind(14)) if small else (kind(0x9E3779B97F4A7C15), kind(46))
    seq, rules = ids.astype(kind), np.zeros((0, 2), np.uint32)
    closed = np.zeros(vocab + limit, bool)  # symbols whose last id is END
    closed[END] = True
    n = len(seq)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # of each place the next and the last one that still hold a symbol
    held, live = np.ones(n, bool), np.ones(n + 1, bool)  # live: places whose pair may still have enough uses; a pair of old symbols only loses places
    places = np.arange(max(n - 1, 0))
    while len(places) and len(rules) < limit:
        pair = seq[places] << kind(shift) | seq[after[places]]
        heavy, hot = frequent(pair, places, after, shift, closed, min(RULES_A_ROUND, limit - len(rules)))
        if not len(heavy):
            break
        bucket = (pair * spread >> down).astype(np.int64)
        for some in (heavy[::-1], heavy[:1]):  # where the places of many leave none enough, the first pair alone
            chosen_pair = np.full(_BUCKETS, ~kind(0), kind)
            own = (some * spread >> down).astype(np.int64)
            chosen_pair[own] = some  # one pair a bucket, the most frequent
            taken = np.zeros(_BUCKETS, bool)
            taken[own] = True
            at = np.flatnonzero(taken[bucket])
            at = at[chosen_pair[bucket[at]] == pair[at]]
            at = at[every_other(places[at], after)]
            uses = np.bincount(bucket[at], minlength=_BUCKETS)
            chosen = np.unique(own)
            chosen = chosen[uses[chosen] >= LEAST_USES]
            if len(chosen):
                break
        number = np.zeros(_BUCKETS, kind)
        number[chosen] = vocab + len(rules) + np.arange(len(chosen))
        at = at[number[bucket[at]] > 0]
        right = (chosen_pair[chosen] & ((kind(1) << kind(shift)) - kind(1))).astype(np.int64)
        closed[vocab + len(rules) + np.arange(len(chosen))] = closed[right]
        rules = np.concatenate([rules, np.stack([(chosen_pair[chosen] >> kind(shift)).astype(np.int64), right], axis=1).astype(np.uint32)])
        often = np.zeros(_BUCKETS, bool)
        often[(hot * spread >> down).astype(np.int64)] = True
        live[places] = often[bucket]
        new = places[at]
        gone = after[new]
        seq[new] = number[bucket[at]]
        after[new] = after[gone]
        before[after[gone]] = new
        held[gone] = False
        live[before[new]] = live[new] = True  # pairs of a new symbol
        live[gone] = live[before[n]] = live[-1] = False  # the last place has no pair
        places = np.flatnonzero(live)
    return seq[held], rules


def expansion_lengths(rules: np.ndarray, vocab: int) -> np.ndarray:
    """Ids that each rule expands to; a rule only names symbols of earlier rounds."""
    out = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    while len(todo):
        size = np.ones((len(todo), 2), np.int64)
        inner = rules[todo] >= vocab
        size[inner] = out[rules[todo][inner].astype(np.int64) - vocab]
        done = (size > 0).all(axis=1)
        out[todo[done]] = size[done].sum(axis=1)
        todo = todo[~done]
    return out


def expansions(rules: np.ndarray, vocab: int) -> np.ndarray:
    """The ids of all rules, one after the other."""
    ids = np.arange(vocab, vocab + len(rules), dtype=np.uint32)
    while len(at := np.flatnonzero(ids >= vocab)):
        pair = rules[ids[at].astype(np.int64) - vocab]
        out = np.repeat(ids, np.where(ids >= vocab, 2, 1))
        to = at + np.arange(len(at))
        out[to], out[to + 1] = pair[:, 0], pair[:, 1]
        ids = out
    return ids


def table(rules: np.ndarray, lengths: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol, ids included, where its expansion begins and how long it is; and the expansions."""
    own = np.arange(vocab, dtype=np.int32)
    begins = np.concatenate([own, vocab + np.cumsum(lengths) - lengths]).astype(np.int32)
    return begins, np.concatenate([np.ones(vocab, np.int32), lengths]).astype(np.int32), np.concatenate([own, expansions(rules, vocab)]).astype("<u4")


def expand(seq: np.ndarray, symbols: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a stretch of symbols."""
    begins, lengths, flat = symbols
    n = lengths[seq]
    last = np.cumsum(n, dtype=np.int64)
    source = np.repeat(begins[seq] - (last - n), n)
    source += np.arange(len(source))
    return flat[source]


def pack(doc_ids: list, ids: list[np.ndarray], vocab: int) -> bytes:
    """A shard of documents, each with its end id."""
    seq, rules = compress(np.concatenate(ids), vocab)
    lengths = expansion_lengths(rules, vocab)
    size = np.ones(len(seq), np.int64)
    size[seq >= vocab] = lengths[seq[seq >= vocab].astype(np.int64) - vocab]
    before = np.append(0, np.cumsum(size))
    starts = np.cumsum([0, *map(len, ids)])
    places = np.searchsorted(before, starts)
    nulls = np.packbits(np.array([x is None for x in doc_ids], bool))
    wide = "<u2" if vocab + len(rules) <= 65536 else "<u4"
    return b"".join([
        _MAGIC, np.array([len(ids), len(rules), len(seq)], "<u8").tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), nulls.tobytes(),
        places.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), np.array([vocab], "<u4").tobytes(), seq.astype(wide).tobytes(),
    ])


class Shard:
    """A packed shard; ``document(i)`` and ``ids(a, b)`` decode no more than they need."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != _MAGIC:
            raise ValueError("not a shard")
        d, r, s = np.frombuffer(raw, "<u8", 3, 8).astype(int).tolist()
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        ids = take("<i8", d)
        nulls = np.unpackbits(take("u1", (d + 7) // 8), count=d)
        self.doc_ids = [None if null else x for x, null in zip(ids.tolist(), nulls.tolist())]
        self.places, self.starts = take("<u8", d + 1).astype(np.int64), take("<u8", d + 1).astype(np.int64)
        self.rules, self.lengths = take("<u4", 2 * r).reshape(-1, 2), take("<u4", r).astype(np.int64)
        self.vocab = int(take("<u4", 1)[0])
        self.seq = take("<u2" if self.vocab + r <= 65536 else "<u4", s)
        self.symbols = table(self.rules, self.lengths, self.vocab)

    def document(self, i: int) -> np.ndarray:
        return expand(self.seq[self.places[i] : self.places[i + 1]], self.symbols)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a .. b-1 of the shard, found by the expansion lengths."""
        i, j = int(np.searchsorted(self.starts, a, "right")) - 1, int(np.searchsorted(self.starts, b))
        part = self.seq[self.places[i] : self.places[j]]
        size = np.ones(len(part), np.int64)
        inner = part >= self.vocab
        size[inner] = self.lengths[part[inner].astype(np.int64) - self.vocab]
        before = self.starts[i] + np.append(0, np.cumsum(size))
        x, y = int(np.searchsorted(before, a, "right")) - 1, int(np.searchsorted(before, b))
        return expand(part[x:y], self.symbols)[a - before[x] : b - before[x]]


_caches: dict = {}
_plain: dict = {}
_ALNUM = np.array([chr(x).isalnum() for x in range(128)] + [False] * 128)
_LATIN = np.array([chr(x).isalnum() for x in range(0x250)])
_TAIL = "!\"#$%&()*+,-./:;=?@[]^_`{|}~"


def _cache(path: str, most: int) -> P.Cache:
    """Ids of stretches that follow a space, that space included."""
    if (path, most) not in _caches:
        t, plain = P.tokenizer(path), _of_letters(path)
        begins, wide = P.marked(t, lambda x: x.startswith("\u0120")), _wide(t)

        def encode(stretches):
            letters = [x for x in stretches if x.isascii() and x.isalpha()]
            others = [x for x in stretches if not (x.isascii() and x.isalpha())]
            return told(letters, plain, "\u0120") | told(others, t, " ")

        def told(stretches, t_, space):
            if not stretches:
                return {}
            ids = np.array(t_.encode_batch_fast([space + space.join(stretches)], add_special_tokens=False)[0].ids, wide)
            cuts = np.append(np.flatnonzero(begins[ids]), len(ids))  # a stretch holds no other space, so only its first id begins with one
            if len(cuts) != len(stretches) + 1:
                return {x: np.array(t.encode(" " + x, add_special_tokens=False).ids, wide).tobytes() for x in stretches}
            raw, cuts = ids.tobytes(), (cuts * ids.itemsize).tolist()
            return {x: raw[a:b] for x, a, b in zip(stretches, cuts, cuts[1:])}

        _caches[path, most] = P.Cache(encode, most=most)
    return _caches[path, most]


def _of_letters(path: str):
    """The library's tokenizer for words of ASCII letters after a space that is written as its vocabulary writes it: such a word is one pre-token, and its bytes are written as they are, so it is only cut before spaces."""
    if path not in _plain:
        from tokenizers import Tokenizer, pre_tokenizers

        t = _plain[path] = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        t.pre_tokenizer = pre_tokenizers.Split("\u0120", "merged_with_next")
    return _plain[path]


def _wide(t):
    return np.uint16 if t.get_vocab_size() <= 65536 else np.uint32


def _ends(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length in bytes, first byte and last byte of each string (0 where it is empty)."""
    at, data = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, 8 * strings.offset), np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    n, some = np.diff(at), np.append(data, np.uint8(0))
    return n, np.where(n > 0, some[np.minimum(at[:-1], len(data))], 0), np.where(n > 0, some[at[1:] - 1], 0).astype(np.int64)


def _last(strings: pa.Array, n: np.ndarray) -> pa.Array:
    """The last n bytes of each string."""
    at, data = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, 8 * strings.offset), np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.append(0, np.cumsum(n))), pa.py_buffer(_gather(at[1:] - n, n, data)))


def _latin(strings: pa.Array) -> np.ndarray:
    """Whether each string, not empty, ends with a letter or digit below U+0250."""
    at, data = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, 8 * strings.offset), np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    last, lead = data[at[1:] - 1].astype(np.int64), data[np.maximum(at[1:] - 2, 0)].astype(np.int64)
    point = np.where(last < 128, last, (lead & 31) << 6 | last & 63)  # two bytes, if the first of them is a lead byte below 0xCA
    return ((last < 128) | (lead >= 0xC2) & (lead < 0xCA)) & _LATIN[np.minimum(point, 0x24F)]


def _joined(raw: list[bytes], wide) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each value's ids begin, how many they are, and all ids."""
    n = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(wide).itemsize
    return np.cumsum(n) - n, n, np.frombuffer(b"".join(raw), wide)


def _gather(begins: np.ndarray, n: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The stretches of flat, one after the other."""
    source = np.repeat(begins - (np.cumsum(n) - n), n)
    source += np.arange(len(source))
    return flat[source]


def encode_texts(texts: list[str], path: str, cached: int = CACHED):
    """The ids of each text, without the end id.

    A text is cut before its spaces: the tokenizer begins a pre-token at any
    space that no white space follows, and between a letter or digit and the
    punctuation after it, so that each distinct stretch is encoded once and
    its punctuation apart. Texts with other spaces, or with the opening of a
    special token, go to the library whole.
    """
    t, cache = P.tokenizer(path), _cache(path, cached)
    wide = _wide(t)

    def alone(text):
        return np.array(t.encode(text, add_special_tokens=False).ids, wide)

    for lo, hi in P.blocks(texts, 1 << 22):
        cut = pc.split_pattern(pa.array(texts[lo:hi], pa.large_string()), " ")
        bounds, found = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        code, distinct = found.indices.to_numpy(), found.dictionary
        size, head, _ = _ends(distinct)
        odd = np.array(pc.match_substring(distinct, P.SPECIAL).to_numpy(zero_copy_only=False)) | (size == 0)
        for i in np.flatnonzero((head <= 32) | np.isin(head, (0xC2, 0xE1, 0xE2, 0xE3))).tolist():  # where all white space begins
            x = distinct[i].as_py()
            odd[i] |= x[:1].isspace() or x[:1] == "\u180e"
        first = np.zeros(len(code), bool)
        first[bounds[:-1]] = True
        whole = np.logical_or.reduceat(odd[code] & ~first, bounds[:-1])
        met = np.zeros(len(distinct), bool)
        met[code[~(first | np.repeat(whole, np.diff(bounds)))]] = True
        distinct = distinct.filter(pa.array(met))
        size, _, final = _ends(distinct)

        stems = pc.ascii_rtrim(distinct, characters=_TAIL)
        kept, _, last = _ends(stems)
        tail = np.where((last < 128) & ~_ALNUM[last], 0, size - kept)  # bytes of punctuation to encode apart
        wider = np.flatnonzero((last >= 128) & (tail > 0))
        tail[wider[~_latin(stems.take(pa.array(wider)))]] = 0
        stems = pc.if_else(pa.array(tail > 0), stems, distinct).dictionary_encode()
        words = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
        marks, many = np.unique(final[tail == 1]), np.flatnonzero(tail > 1)  # one mark of punctuation, by its byte, or more
        tails = _last(distinct.take(pa.array(many)), tail[many]).dictionary_encode()
        number = np.zeros(128, np.int64)
        number[marks] = np.arange(1, len(marks) + 1)
        which = number[np.where(tail == 1, final, 0)]
        which[many] = 1 + len(marks) + tails.indices.to_numpy()
        which += len(words)
        ends = [*map(chr, marks.tolist()), *tails.dictionary.to_pylist()]
        begins, n, flat = _joined([*cache.values(words), b"", *(alone(x).tobytes() for x in ends)], wide)
        pairs = np.stack([stems.indices.to_numpy().astype(np.int64), which], axis=1).ravel()
        flat = _gather(begins[pairs], n[pairs], flat)
        lengths, places = np.zeros(len(met), np.int64), np.zeros(len(met), np.int64)
        lengths[met] = n[pairs].reshape(-1, 2).sum(axis=1)
        places[met] = np.cumsum(lengths[met]) - lengths[met]
        sizes = np.where(first | np.repeat(whole, np.diff(bounds)), 0, lengths[code])
        flat = _gather(places[code], sizes, flat)
        ends = np.append(0, np.cumsum(sizes))[bounds].tolist()

        leads = {}
        for text, other, a, b in zip(texts[lo:hi], whole.tolist(), ends, ends[1:]):
            lead = text.partition(" ")[0]
            if other or P.SPECIAL in lead:
                yield alone(text)
            else:
                if lead not in leads:
                    leads[lead] = alone(lead)
                yield np.concatenate([leads[lead], flat[a:b]])


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, shard_tokens: int = SHARD_TOKENS, cached: int = CACHED) -> None:
    """Writes the shards of docs as a Parquet table."""

    def encode(batches):
        vocab = P.tokenizer(tokenizer_path).get_vocab_size()
        doc_ids, ids, size, before, part = [], [], 0, 0, 0

        def shard():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "before": pa.array([before]), "n_tokens": pa.array([size]), "shard": pa.array([pack(doc_ids, ids, vocab)], pa.binary())})

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encode_texts(batch.column("text").to_pylist(), tokenizer_path, cached)):
                found = np.append(found, found.dtype.type(END))
                if ids and size + len(found) > shard_tokens:
                    yield shard()
                    before, doc_ids, ids, size = before + size, [], [], 0
                doc_ids.append(doc_id)
                ids.append(found)
                size += len(found)
        if ids:
            yield shard()

    place = [F.col("doc_id").asc_nulls_first(), F.col("k")]  # the rows of one doc_id may be many
    ordered = documents(docs).withColumn("k", F.xxhash64("text")).repartitionByRange(*place).sortWithinPartitions(*place, "text").drop("k")
    in_tasks(ordered.withColumn("part", F.spark_partition_id()), encode, "part int, before long, n_tokens long, shard binary").write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""
    shards = spark.read.schema("part int, before long, n_tokens long, shard binary").parquet(path)
    total, first = 0, {}
    for row in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toLocalIterator():  # a row for each range partition
        first[row["part"]] = total
        total += row["n"]
    sent = spark.sparkContext.broadcast(first)

    def decode(batches):
        _caches.clear()  # tasks that encode hand them on; idle workers would keep them after that
        for batch in batches:
            for part, before, raw in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("shard").to_pylist()):
                shard = Shard(raw)
                n = np.diff(shard.starts)
                ids = memoryview(expand(shard.seq, shard.symbols).tobytes())
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1] + before + sent.value[part]), pa.array(n), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return in_tasks(shards.select("part", "before", "shard"), decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS, cached: int = CACHED) -> DataFrame:
    """Writes the shards and reads them back: doc_id, start, n_tokens, ids_crc32, one row for each row of docs."""
    path = scratch(docs.sparkSession, "token-shards")
    write_shards(docs, tokenizer_path, path, shard_tokens, cached)
    return read_shards(docs.sparkSession, path)
