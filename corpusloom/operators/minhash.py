"""Near copies by MinHash and locality-sensitive hashing over character shingles."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.operators import shingle_join as S
from corpusloom.operators.corpus import perhaps_in, similar_to_kept, without, written

#: The modulus of the permutations, and the sizes of signature and bands.
PRIME = (1 << 61) - 1
PERMUTATIONS, BANDS = 128, 32
_STEP = 1024


def gram_hashes(text: str, size: int) -> np.ndarray:
    """The distinct 32-bit hashes of a text's character n-grams, sorted; a shorter text is its only one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(0, np.uint32)
    size = min(size, len(points))
    h = np.zeros(max(len(points) - size + 1, 0), np.uint64)
    for k in range(size):
        h = (h ^ points[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return S.sorted_set((h >> np.uint64(16)).astype(np.uint32))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands below the modulus: smaller factors would hardly leave the order of small hashes, and signatures would agree too often."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, n, np.uint64), rng.integers(0, PRIME, n, np.uint64)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def permuted(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a x + b) modulo 2**61 - 1 for 32-bit x, without products over 64 bits."""
    high = x * (a >> np.uint64(32))  # times 2**32, of which the upper part comes back by 61 bits
    low = _fold(x * (a & np.uint64(0xFFFFFFFF)))
    return _fold(_fold((high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))) + low + b)


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least (a x + b) modulo 2**61 - 1 of a set for each permutation; in steps. Only values that come near the least by their first bits are worked out."""
    fraction = lambda v, shift: np.array([(int(x) << shift) // PRIME & (1 << 32) - 1 for x in v], np.uint32)
    high, low, rest = (v[:, None] for v in (fraction(a, 48), fraction(a, 32), fraction(b, 32)))  # of the prime, in 32 bits: high is for 2**16 times as much
    near = np.uint32(1 << 18)  # more than a value from these falls short of the true one
    least, rows, places = np.full((len(a), 1), ~np.uint32(0)), [], []
    for k in range(0, len(grams), _STEP):
        x = grams[k : k + _STEP]
        value = (x >> np.uint32(16)) * high
        value += (x & np.uint32(0xFFFF)) * low
        value += rest
        np.minimum(least, value.min(axis=1, keepdims=True), out=least)
        value += near  # one that is short of a true 0 is a great one, and a small one now
        at, row = np.divmod(np.flatnonzero(value <= np.minimum(least, ~(near + near)) + near + near), len(x))
        rows.append(row + k)
        places.append(at)
    out = np.full(len(a), np.uint64(PRIME))
    if rows:
        at = np.concatenate(places)
        np.minimum.at(out, at, permuted(grams[np.concatenate(rows)].astype(np.uint64), a[at], b[at]))
    return out


def parities(grams: np.ndarray) -> np.ndarray:
    """For each of 2,048 classes of hashes, by their first bits, whether it holds an odd number of the set's; 64 classes an integer. Two sets differ in at least as many hashes as classes."""
    return np.packbits(np.bincount(grams >> np.uint32(21), minlength=1 << 11) & 1 == 1).view(np.int64)


def cleaned(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFC", text or "").split()).casefold()


def signatures(df: DataFrame, size: int = 5, number: int = PERMUTATIONS, bands: int = BANDS, seed: int = 0, threshold: float = 0.85) -> DataFrame:
    """(id, key, set_key, n, bands, bits, keys) of rows whose text is not blank: a hash of the text and of its shingle set, the set's size, its sketches as of ``shingle_join.cut_for``, 32 bits of a hash of each band of its signature."""
    if number < 1 or bands < 1 or number % bands:
        raise ValueError("the signature's length must be a positive multiple of the number of bands")
    short = lambda raw, n: hashlib.blake2b(raw, digest_size=n).digest()

    def run(batches):
        a, b = permutations(number, seed)
        for batch in batches:
            out: dict = {c: [] for c in ("at", "set_key", "n", "bands", "bits", "keys")}
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not (text := cleaned(text)):
                    continue
                grams = gram_hashes(text, size)
                parts = signature(grams, a, b).reshape(bands, -1)
                keys = b"".join(short(p.tobytes(), 4) for p in parts)
                for c, v in zip(out, (i, int.from_bytes(short(grams.tobytes(), 8), "little", signed=True), len(grams), *S.cut_for(grams.astype(np.uint64) << np.uint64(32), threshold), keys)):
                    out[c].append(v)
            at = pa.array(out["at"], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("key").take(at), pa.array(out["set_key"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["bands"], pa.list_(pa.int32())), pa.array(out["bits"], pa.list_(pa.binary())), pa.array(out["keys"], pa.binary())], ["id", "key", *list(out)[1:]])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", _text_key(), "text").mapInArrow(run, f"id {kind}, key string, set_key long, n int, bands array<int>, bits array<binary>, keys binary")


def _text_key():
    return F.coalesce(F.md5("text"), F.lit("")).alias("key")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """For sets at hand (``lsh_pairs`` cuts texts again): (a, b, jaccard) of the pairs whose sets have at least that Jaccard similarity. No set travels but those of the pairs that sizes and parities leave."""
    spark, size = pairs.sparkSession, lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"odd{c}"))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    differ = F.aggregate(F.zip_with("odda", "oddb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    likely = (small >= threshold * large) & (differ * (1 + threshold) <= (1 - threshold) * (F.col("na") + F.col("nb")) + 1e-6)
    sized = written(spark, pairs.join(size("a"), "a").join(size("b"), "b").where(likely).select("a", "b"))
    ids = sized.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = perhaps_in(sets.select("id", "grams"), ids)

    def run(batches):
        for batch in batches:
            found = []
            for x, y in zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                found.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "jaccard"])

    kind = sets.schema["id"].dataType.simpleString()
    of = lambda c: held.select(F.col("id").alias(c), F.col("grams").alias(f"g{c}"))
    joined = sized.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ga", "gb")
    return joined.mapInArrow(run, f"a {kind}, b {kind}, jaccard double").where(F.col("jaccard") >= threshold)


def lsh_pairs(df: DataFrame, threshold: float = 0.85, size: int = 5, number: int = PERMUTATIONS, bands: int = BANDS, seed: int = 0, crowded: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, members). pairs: (a, b, jaccard), a < b, of rows that share a band of their signatures and have that Jaccard similarity. members: (id, a) of rows whose shingle set is that of an earlier row a; those are in no pair.

    All rows of a band meet, however many they are: in blocks of sets of about one size, since others are unlike, and where the sets'
    sketches differ too much, no further. ``crowded``: rows of a block at most, of which a size has more only in several.
    """
    spark = df.sparkSession
    signed = written(spark, signatures(df, size, number, bands, seed, threshold).where("id IS NOT NULL").withColumn("no", F.monotonically_increasing_id()))
    first = written(spark, signed.groupBy("set_key", "n").agg(F.min(F.struct("id", "no")).alias("f")).select("set_key", "n", F.col("f.id").alias("a"), F.col("f.no").alias("no")))
    members = signed.select("id", "set_key", "n").join(first.drop("no"), ["set_key", "n"]).where("id != a").select("id", "a")
    pairs = S.met(signed.join(first.select("no"), "no", "left_semi"), threshold, crowded)
    linked = written(spark, pairs.select(F.explode(F.array("x", "y")).alias("no")).distinct().join(signed.select("no", "id", "key", "n"), "no"))
    again = perhaps_in(df.select("id", "text"), linked.select("id")).select("id", _text_key(), F.col("text").alias("t"))
    texts = linked.join(again, ["id", "key"]).select("no", "t")
    return S.named(S.checked(pairs, linked, texts, threshold, lambda t: gram_hashes(cleaned(t), size)), linked, "jaccard"), members


def deduplicate(df: DataFrame, threshold: float = 0.85, **options) -> DataFrame:
    """df without later rows whose text, cleaned for hashing, is that of an earlier one or whose shingles are like those of an earlier row that stays; by id. Blank and null texts stay."""
    pairs, members = lsh_pairs(df, threshold, **options)
    gone = members.select("id").unionByName(similar_to_kept(pairs))
    return without(df, written(df.sparkSession, gone.distinct()))
