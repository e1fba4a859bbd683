"""Counts of what a document holds, made where the document lies: its words reach one task together, so nothing of them is shuffled to be counted."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpusloom.operators.corpus import written

#: Pieces of words that are handled at once, distinct words whose pieces a task remembers, and characters of text in a block of documents.
SLICE = 1 << 21
REMEMBERED = 1 << 17
BLOCK_CHARS = 1 << 22


def char_wb_pieces(word: str, shortest: int = 2, longest: int = 5) -> list[str]:
    """Character n-grams of a space-padded word; a padded word no longer than n is emitted whole, once."""
    w = f" {word} "
    out = [w[i : i + n] for n in range(shortest, longest + 1) if len(w) > n for i in range(len(w) - n + 1)]
    return out + [w] if len(w) <= longest else out


def affix_pieces(word: str, shortest: int = 2, longest: int = 4) -> list[str]:
    """Labelled prefixes and suffixes of words at least one character longer."""
    return [x for k in range(shortest, longest + 1) if len(word) > k for x in ("pre:" + word[:k], "suf:" + word[-k:])]


def one_row(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, w) with one row for each value of the keys: w, an array, of rows that repeat one are put together. Only if there are such rows is anything but keys shuffled."""
    again = written(df.sparkSession, df.groupBy(*keys).agg(F.count("*").alias("_c")).where("_c > 1").select(*[F.col(k).alias(f"_{k}") for k in keys]))
    rows = df.select(*keys, "w")
    if again.isEmpty():
        return rows
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").groupBy(*keys).agg(F.flatten(F.collect_list("w")).alias("w")))


class _Pieces:
    """The pieces of words by number; a task remembers those of so many words."""

    def __init__(self, cut: Callable[[str], list[str]] | None) -> None:
        self.cut, self.of, self.number, self.names = cut, {}, {}, []

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(numbers of all words' pieces, how many each word has, the pieces' names)."""
        if self.cut is None:
            return np.arange(len(words)), np.ones(len(words), np.int64), words
        if len(self.of) > REMEMBERED:
            self.of, self.number, self.names = {}, {}, []
        found = []
        for word in words.to_pylist():
            got = self.of.get(word)
            if got is None:
                got = []
                for piece in self.cut(word):
                    at = self.number.get(piece)
                    if at is None:
                        at = self.number[piece] = len(self.names)
                        self.names.append(piece)
                    got.append(at)
                got = self.of[word] = np.array(got, np.int64)
            found.append(got)
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), np.array([*map(len, found)], np.int64), pa.array(self.names, pa.string())


def summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order and the sums of their weights."""
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(weight, first) if len(first) else weight


def _pieces_by_row(lists: pa.Array, pieces: _Pieces):
    """(rows, numbers, counts, names of pieces) of some rows at a time, in ascending order of row and number; a row's are together."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    words = pc.list_flatten(lists).dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    if not len(words):
        return
    size = len(words.dictionary)
    key, k = summed(pc.list_parent_indices(lists).to_numpy().astype(np.int64) * size + words.indices.to_numpy(), np.ones(len(words), np.int64))
    row, word = key // size, key % size
    flat, many, names = pieces(words.dictionary)
    first, m = np.cumsum(many) - many, many[word]
    ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))  # where a row's words end
    upto, a = np.cumsum(m), 0
    while a < len(row):
        done = upto[a - 1] if a else 0
        at = np.searchsorted(ends, a, side="right")
        b = int(ends[max(at, np.searchsorted(upto[ends - 1], done + SLICE, side="right") - 1)])
        n = m[a:b]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        each, c = summed(np.repeat(row[a:b], n) * len(names) + flat[np.repeat(first[word[a:b]], n) + inside], np.repeat(k[a:b], n))
        yield each // max(len(names), 1), each % max(len(names), 1), c, names
        a = b


def token_rows(df: DataFrame, keys: list[str], cut: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(keys, token, tf) of rows (keys, w): what a row's words, or their pieces by ``cut``, are and how often."""

    def run(batches):
        pieces = _Pieces(cut)
        for batch in batches:
            for row, number, count, names in _pieces_by_row(batch.column("w"), pieces):
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row)) for k in keys], names.take(pa.array(number)), pa.array(count)], [*keys, "token", "tf"])

    kinds = [T.StructField(k, df.schema[k].dataType) for k in keys]
    return df.select(*keys, "w").mapInArrow(run, T.StructType([*kinds, T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())]))


def totals(df: DataFrame, keys: list[str], cut: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(keys, n, kinds) of rows (keys, w): all pieces of a row, and the distinct ones; a row without any is left out."""

    def run(batches):
        pieces = _Pieces(cut)
        for batch in batches:
            for row, _, count, _ in _pieces_by_row(batch.column("w"), pieces):
                if len(row):
                    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row[first])) for k in keys], pa.array(np.add.reduceat(count, first)), pa.array(np.diff(np.append(first, len(row))))], [*keys, "n", "kinds"])

    kinds = [T.StructField(k, df.schema[k].dataType) for k in keys]
    return df.select(*keys, "w").mapInArrow(run, T.StructType([*kinds, T.StructField("n", T.LongType()), T.StructField("kinds", T.LongType())]))


def document_frequency(df: DataFrame, cut: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(token, df): how many rows (w) hold each piece; a batch of rows sends a piece once."""

    def run(batches):
        pieces = _Pieces(cut)
        for batch in batches:
            for _, number, _, names in _pieces_by_row(batch.column("w"), pieces):
                each, n = np.unique(number, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(each)), pa.array(n.astype(np.int64))], ["token", "df"])

    return df.select("w").mapInArrow(run, "token string, df long").groupBy("token").agg(F.sum("df").alias("df"))


def word_pairs(words: pa.Array) -> pa.Array:
    """Lists of words, each followed by its pairs of neighbours, joined by a space."""
    return pa.array([w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in words.to_pylist()], pa.list_(pa.string()))


def in_blocks(df: DataFrame, block_chars: int = BLOCK_CHARS, by: tuple[str, ...] = (), chars: int | None = None) -> DataFrame:
    """(by, block, id, t) of rows (by, id, t), t words joined by a space: rows that share an id are in one block, and a block holds so many characters, or one text. chars: of all texts, about; else they are made to be counted."""
    if chars is None:
        chars = df.agg(F.sum(F.length("t"))).first()[0] or 0
    return df.select(*by, F.pmod(F.xxhash64("id"), F.lit(chars // block_chars + 1)).alias("block"), "id", "t")


def _numbered(ids: pa.Array) -> np.ndarray:
    """A number for each value, in order of appearance; also of structs."""
    if not pa.types.is_nested(ids.type):
        return ids.dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    seen: dict = {}
    return np.array([seen.setdefault(repr(x), len(seen)) for x in ids.to_pylist()], np.int64)


def _block_pieces(table: pa.Table, expand, cut):
    """(ids, rows, numbers, counts, names) of a block's documents, as _pieces_by_row has them."""
    table = table.filter(pc.greater(pc.utf8_length(pc.fill_null(table.column("t"), "")), 0)).sort_by("id").combine_chunks()
    if not table.num_rows:
        return
    ids, words = table.column("id").combine_chunks(), pc.split_pattern(table.column("t"), " ").combine_chunks()
    words = words if expand is None else expand(words)
    code = _numbered(ids)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    if len(first) < len(code):  # rows that share an id
        ends = words.offsets.to_numpy()[np.append(first, len(code))]
        words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.values)
    ids = ids.take(pa.array(first))
    for found in _pieces_by_row(words, _Pieces(cut)):
        yield (ids, *found)


def tfidf_by_block(df: DataFrame, expand=None, cut: Callable[[str], list[str]] | None = None, min_df: int = 2, best: int | None = None, digits: int = 6, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, token, weight, rank) of rows (id, t): 1 + ln tf, smoothed idf + 1, rows of length 1, over tokens in at least min_df documents.

    expand: of lists of words, what is counted; cut: the pieces of a word. best: only so many of a document's tokens, the heaviest
    by weights rounded to so many digits, ties by token; else rank is null.
    A block of documents sends each of its tokens once and gets back those that enough documents hold, so that no document's tokens travel.
    """
    rows = in_blocks(df, block_chars)
    kind = df.schema["id"].dataType.simpleString()
    none = pa.table({"block": pa.array([], pa.int64()), "token": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

    def held(table: pa.Table) -> pa.Table:
        out, block = [none], table.column("block")[0].as_py() if table.num_rows else 0
        for _, _, number, _, names in _block_pieces(table, expand, cut):
            each, n = np.unique(number, return_counts=True)
            out.append(pa.table({"block": pa.array(np.full(len(each), block)), "token": names.take(pa.array(each)), "n": pa.array(n.astype(np.int64))}))
        return pa.concat_tables(out)

    def weigh(table: pa.Table, idf: pa.Table) -> pa.Table:
        out = [pa.table({"id": pa.array([], table.schema.field("id").type), "token": pa.array([], pa.string()), "weight": pa.array([], pa.float64()), "rank": pa.array([], pa.int32())})]
        idf = idf.combine_chunks()
        known, value = idf.column("token").combine_chunks() if idf.num_rows else pa.array([], pa.string()), idf.column("idf").to_numpy()
        for ids, row, number, count, names in _block_pieces(table, expand, cut):
            at = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False)[number]
            row, number, w = row[at >= 0], number[at >= 0], (1 + np.log(count[at >= 0])) * value[at[at >= 0]]
            if not len(row):
                continue
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            size = np.diff(np.append(first, len(row)))
            w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, first)), size)
            rank = None
            if best is not None:
                scaled = w * 10.0**digits
                w = (np.floor(scaled) + (scaled - np.floor(scaled) >= 0.5)) / 10.0**digits
                order = np.lexsort((-w, row))
                last = w[order[first + np.minimum(size, best) - 1]]  # of each row, the least weight that may stay
                order = order[w[order] >= np.repeat(last, size)]
                text = names.take(pa.array(number[order])).to_pylist()
                order = [o for _, _, _, o in sorted(zip(row[order].tolist(), (-w[order]).tolist(), (t.encode("utf-8", "surrogatepass") for t in text), order.tolist()))]
                order = np.array(order)
                row, number, w = row[order], number[order], w[order]
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) + 1
                row, number, w, rank = row[rank <= best], number[rank <= best], w[rank <= best], rank[rank <= best]
            out.append(pa.table({"id": ids.take(pa.array(row)), "token": names.take(pa.array(number)), "weight": pa.array(w), "rank": pa.nulls(len(row), pa.int32()) if rank is None else pa.array(rank.astype(np.int32))}))
        return pa.concat_tables(out)

    n = df.where("t != ''").agg(F.count_distinct("id").alias("docs"))
    sent = rows.groupBy("block").applyInArrow(held, "block long, token string, n long")
    often = sent.withColumn("df", F.sum("n").over(Window.partitionBy("token"))).where(F.col("df") >= min_df).crossJoin(F.broadcast(n))
    often = often.select("block", "token", (F.ln((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    return rows.groupBy("block").cogroup(often.groupBy("block")).applyInArrow(weigh, f"id {kind}, token string, weight double, rank int")


def dotted(df: DataFrame, vectors: DataFrame, size: int, by: tuple[str, ...] = (), block_chars: int = BLOCK_CHARS, chars: int | None = None) -> DataFrame:
    """(by, id, s) of rows (by, id, t), t words joined by a space: the sum of the vectors of a document's words, which words of no vector leave as it is.

    vectors: (by, token, at, g), the places and values of what is not 0 among ``size`` numbers, one row for each token and value of by.
    A block of documents asks for each of its words once, so that neither words nor counts of a document travel.
    """
    rows = in_blocks(df, block_chars, by, chars)
    kinds = [T.StructField(c, df.schema[c].dataType) for c in by]
    none = [T.StructField("block", T.LongType()), T.StructField("token", T.StringType())]

    def held(table: pa.Table) -> pa.Table:
        out = [table.select([*by, "block"]).slice(0, 0).append_column("token", pa.array([], pa.string()))]
        words = pc.unique(pc.list_flatten(pc.split_pattern(table.column("t"), " ")))
        words = words.filter(pc.not_equal(words, ""))
        if len(words):
            out.append(table.select([*by, "block"]).take(pa.array(np.zeros(len(words), np.int64))).append_column("token", words))
        return pa.concat_tables(out)

    def add(table: pa.Table, found: pa.Table) -> pa.Table:
        names = [*by, "id", "s"]
        if not table.num_rows:
            return pa.table([table.column(c) for c in [*by, "id"]] + [pa.array([], pa.list_(pa.float64()))], names)
        found = found.combine_chunks()
        g = np.zeros((found.num_rows + 1, size))  # the last is that of unknown words
        if found.num_rows:
            at, value = found.column("at").combine_chunks(), found.column("g").combine_chunks()
            g[pc.list_parent_indices(at).to_numpy(), pc.list_flatten(at).to_numpy()] = pc.list_flatten(value).to_numpy()
        ids = table.column("id").combine_chunks()
        code = _numbered(ids)
        first = np.unique(code, return_index=True)[1]
        sums = np.zeros((len(first), size))
        known = found.column("token").combine_chunks() if found.num_rows else pa.array([], pa.string())
        lists = pc.split_pattern(pc.fill_null(table.column("t"), ""), " ").combine_chunks()
        place = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = code[pc.list_parent_indices(lists).to_numpy()]
        key, tf = summed((row * len(g) + place)[place >= 0], np.ones(int((place >= 0).sum()), np.int64))
        row, place = key // len(g), key % len(g)
        step = max(1, SLICE // size)
        for k in range(0, len(key), step):
            r = row[k : k + step]
            cut = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            sums[r[cut]] += np.add.reduceat(g[place[k : k + step]] * tf[k : k + step, None], cut)
        where = pa.array(first)
        s = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * size, pa.int32()), pa.array(sums.ravel()))
        return pa.table([table.column(c).take(where) for c in by] + [ids.take(where), s], names)

    keys = [*by, "block"]
    asked = rows.groupBy(*keys).applyInArrow(held, T.StructType([*kinds, *none]))
    answers = asked.join(vectors.select(*by, "token", "at", "g"), [*by, "token"]).select(*keys, "token", "at", "g")
    out = T.StructType([*kinds, T.StructField("id", df.schema["id"].dataType), T.StructField("s", T.ArrayType(T.DoubleType()))])
    return rows.groupBy(*keys).cogroup(answers.groupBy(*keys)).applyInArrow(add, out)


_NOT_WORDS = r"[^\p{L}\p{Nl}\p{No}]+"


def cut_words(lowered: pa.Array) -> pa.ListArray:
    """The words of lower-cased texts, as ``functions.text.words`` cuts them."""
    spaced = pc.utf8_trim(pc.replace_substring_regex(pc.fill_null(lowered, ""), _NOT_WORDS, " "), " ")
    lists = pc.split_pattern(spaced, " ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    empty = pc.equal(spaced, "").to_numpy(zero_copy_only=False)
    if not empty.any():
        return lists
    flat, keep = pc.list_flatten(lists), np.ones(len(lists.values), bool)
    ends = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
    keep[ends[:-1][empty]] = False  # an empty text is split into one empty word
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.diff(ends) * ~empty)), pa.int32()), flat.filter(pa.array(keep)))


def one_list(values: pa.Array) -> pa.ListArray:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def word_blocks(df: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (keys, text) as blocks of what lies together, stored: (block, keys: arrays of a value for each document, tokens: the block's distinct words, n: how many of them a document holds, at: their places in tokens, tf). Words are cut once, and nothing is shuffled."""
    keys = [c for c in df.columns if c != "text"]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                held.append(part)
                size += part.column("text").nbytes
                if size >= block_chars:
                    yield block(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield block(pa.Table.from_batches(held))

    def block(table):
        words, table = cut_words(table.column("text").combine_chunks()), table.combine_chunks()
        found = pc.list_flatten(words).dictionary_encode()
        width = max(len(found.dictionary), 1)
        every = np.sort(pc.list_parent_indices(words).to_numpy().astype(np.int64) * width + found.indices.to_numpy())
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        key, tf = every[first], np.diff(np.append(first, len(every)))
        n = np.bincount(key // width, minlength=table.num_rows)
        made = [one_list(table.column(k).chunk(0)) for k in keys]
        made += [one_list(found.dictionary), *[one_list(pa.array(x.astype(np.int32))) for x in (n, key % width, tf)]]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *made], ["block", *keys, "tokens", "n", "at", "tf"])

    arrays = [T.StructField(k, T.ArrayType(df.schema[k].dataType)) for k in keys]
    arrays += [T.StructField("tokens", T.ArrayType(T.StringType())), *[T.StructField(k, T.ArrayType(T.IntegerType())) for k in ("n", "at", "tf")]]
    rows = df.select(*keys, F.lower("text").alias("text"))
    return written(df.sparkSession, rows.mapInArrow(run, T.StructType([T.StructField("block", T.StringType()), *arrays])))


def _of(column, i: int = 0) -> pa.Array:
    """The values of a row's array."""
    x = column.slice(i, 1)
    return pc.list_flatten(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)


def block_counts(blocks: DataFrame, group: str) -> DataFrame:
    """(group, token, c): how often the documents of each group (a column of small integers, -1 for none) hold each word; a block's sums are made where it lies."""
    return counts_in_blocks(blocks, group).groupBy(group, "token").agg(F.sum("c").alias("c"))


def counts_in_blocks(blocks: DataFrame, group: str) -> DataFrame:
    """As block_counts, with a row for each block that holds the word."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = _of(batch.column("tokens"), i)
                own = np.repeat(pc.fill_null(_of(batch.column(group), i), -1).to_numpy(zero_copy_only=False).astype(np.int64), _of(batch.column("n"), i).to_numpy())
                key, c = summed((own + 1) * max(len(tokens), 1) + _of(batch.column("at"), i).to_numpy(), _of(batch.column("tf"), i).to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((key // max(len(tokens), 1) - 1).astype(np.int32)), tokens.take(pa.array(key % max(len(tokens), 1))), pa.array(c)], [group, "token", "c"])

    return blocks.select(group, "tokens", "n", "at", "tf").mapInArrow(run, f"{group} int, token string, c long")


def documents_left(blocks: DataFrame, group: str) -> DataFrame:
    """The blocks with only those documents that have no group (-1), and their words; a block without any is left out."""
    names = [c for c in blocks.columns if c not in ("block", "tokens", "n", "at", "tf")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                stay = pc.equal(_of(batch.column(group), i), -1).to_numpy(zero_copy_only=False)
                if not stay.any():
                    continue
                n, at, tf = [_of(batch.column(k), i).to_numpy() for k in ("n", "at", "tf")]
                inside = np.repeat(stay, n)
                words, at = np.unique(at[inside], return_inverse=True)
                made = [one_list(_of(batch.column(k), i).filter(pa.array(stay))) for k in names]
                made += [one_list(_of(batch.column("tokens"), i).take(pa.array(words))), *[one_list(pa.array(x.astype(np.int32))) for x in (n[stay], at, tf[inside])]]
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), *made], ["block", *names, "tokens", "n", "at", "tf"])

    return blocks.select("block", *names, "tokens", "n", "at", "tf").mapInArrow(run, T.StructType([blocks.schema[c] for c in ("block", *names, "tokens", "n", "at", "tf")]))


def with_answers(blocks: DataFrame, vectors: DataFrame, size: int, work, schema: T.StructType) -> DataFrame:
    """What ``work`` (documents' columns, n, at, tf, tokens, dense numbers of each token) makes of each block, once the block has the numbers of its words.

    vectors: (token, place, c), the places and values of what is not 0 among ``size`` numbers. A block asks for each of its words once.
    """
    keys = [c for c in blocks.columns if c not in ("block", "tokens", "n", "at", "tf")]
    asked = blocks.select(F.col("block").alias("_b"), F.posexplode("tokens").alias("word", "token"))
    answers = asked.join(vectors, "token").select("_b", "word", "place", "c")

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for i in range(table.num_rows):
            tokens, found = _of(table.column("tokens"), i), found.combine_chunks()
            g = np.zeros((len(tokens), size))
            if found.num_rows:
                place = found.column("place").combine_chunks()
                word = found.column("word").to_numpy()[pc.list_parent_indices(place).to_numpy()]
                g[word, pc.list_flatten(place).to_numpy()] = pc.list_flatten(found.column("c").combine_chunks()).to_numpy()
            docs = {k: _of(table.column(k), i) for k in keys}
            out.append(work(docs, *[_of(table.column(k), i).to_numpy() for k in ("n", "at", "tf")], tokens, g))
        return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], t) for f, t in zip(schema.fields, empty)})

    from pyspark.sql.pandas.types import to_arrow_type

    empty = [to_arrow_type(f.dataType) for f in schema.fields]
    return blocks.groupBy("block").cogroup(answers.groupBy("_b")).applyInArrow(run, schema)


def block_sums(blocks: DataFrame, vectors: DataFrame, size: int, values=None, width: int | None = None, slot: str | None = None) -> DataFrame:
    """(id, s): the sum over a document's words of a row of numbers; those of rows that share an id are added up.

    values: of a matrix of ``size`` numbers a token, the matrix of numbers that are summed, ``width`` a token; slot: a column of
    documents, which says whose ``width`` numbers of several sets a document takes (values gives sets side by side).
    """
    width = width or size
    kind = blocks.schema["id"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), T.StructField("s", T.ArrayType(T.DoubleType()))])

    def work(docs, n, at, tf, tokens, g):
        g = g if values is None else values(g)
        sums, row = np.zeros((len(n), width)), np.repeat(np.arange(len(n)), n)
        own = None if slot is None else np.repeat(pc.fill_null(docs[slot], 0).to_numpy(zero_copy_only=False).astype(np.int64), n)
        step = max(1, SLICE // width)
        for k in range(0, len(row), step):
            r, x = row[k : k + step], g[at[k : k + step]] if own is None else g.reshape(len(g), -1, width)[at[k : k + step], own[k : k + step]]
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            sums[r[first]] += np.add.reduceat(x * tf[k : k + step, None], first)
        s = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * width, pa.int32()), pa.array(sums.ravel()))
        return pa.table([docs["id"], s], ["id", "s"])

    one = with_answers(blocks, vectors, size, work, schema)
    return one.groupBy("id").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
