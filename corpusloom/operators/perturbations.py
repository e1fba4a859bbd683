"""Perturbed texts as Columns: every place of a text draws from a hash of key, name and place, so that a change depends on nothing else, and what a low level changes a higher one changes too."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import text as X

#: What a transcription makes of letters with marks.
TRANSCRIBED = {
    "ą": ["a", "om"], "ć": ["c"], "ę": ["e", "em"], "ł": ["l", "w"], "ń": ["n"], "ó": ["u", "o"], "ś": ["s"], "ź": ["z"], "ż": ["z", "rz"],
}
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Characters of the texts whose changed forms make one batch.
_BATCH_CHARS = 1 << 19


def neighbours() -> dict[str, list[str]]:
    """Each key's neighbours: beside it, the two it touches in the row above, the two below; a row stands half a key to the right of the one above."""
    out = {}
    for r, row in enumerate(KEY_ROWS):
        for i, key in enumerate(row):
            near = [(r, i - 1), (r, i + 1), (r - 1, i), (r - 1, i + 1), (r + 1, i - 1), (r + 1, i)]
            out[key] = [KEY_ROWS[a][b] for a, b in near if 0 <= a < len(KEY_ROWS) and 0 <= b < len(KEY_ROWS[a])]
    return out


def draw(key: Column, name: str, place: Column) -> Column:
    """A number in [0, 1) for a place (from 0) of a text."""
    digest = F.md5(F.concat_ws("|", F.lit(name), key.cast("string"), place.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _tokens(rewrite: Callable[[Column], Column], name: str):
    def run(text: Column, key: Column, level: Column) -> Column:
        changed = F.transform(X.words(text, True), lambda t, i: F.when(draw(key, name, i) < level, rewrite(t)).otherwise(t))
        return F.when((level <= 0) | text.isNull(), text).otherwise(F.array_join(changed, " "))

    return run


def drawn(key: str, name: str, place: int) -> float:
    """``draw`` in Python."""
    return int(hashlib.md5(f"{name}|{key}|{place}".encode()).hexdigest()[:8], 16) / float(1 << 32)


def rewritten(text: str, key: str, table: dict[str, list[str]], name: str, levels: list[float]) -> list[str]:
    """A text at each level: of its characters that the table has, those whose draw is below the level are replaced. Places are drawn once for all levels."""
    top, places = max(levels), []
    for i, c in enumerate(text):
        if (choices := table.get(low := c.lower())) and (x := drawn(key, name, i)) < top:
            chosen = choices[int(drawn(key, f"{name}-choice", i) * len(choices))]
            places.append((i, x, chosen if c == low else chosen[:1].upper() + chosen[1:]))
    out = []
    for level in levels:
        parts = list(text)
        for i, x, chosen in places:
            if x < level:
                parts[i] = chosen
        out.append("".join(parts))
    return out


def _characters(df: DataFrame, names: list[str], levels: list[float]) -> DataFrame:
    """``swept`` by names of ``BY_CHARACTER``."""

    def table(batch, at, each):
        names, levels, texts = zip(*each)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(levels, pa.float64()), batch.column("key").take(pa.array(at, pa.int64())), pa.array(texts, pa.string())], ["name", "level", "key", "text"])

    def run(batches):
        for batch in batches:
            at, each, chars = [], [], 0
            for i, (key, text) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("text").to_pylist())):
                for n in names:
                    made = [None] * len(levels) if text is None else rewritten(text, key or "", *BY_CHARACTER[n], levels)
                    each += [(n, float(x), t) for x, t in zip(levels, made)]
                    at += [i] * len(levels)
                chars += len(text or "")
                if chars >= _BATCH_CHARS:
                    yield table(batch, at, each)
                    at, each, chars = [], [], 0
            if each:
                yield table(batch, at, each)

    kind = df.schema["key"].dataType.simpleString()
    return df.select("key", F.col("key").cast("string").alias("_key"), "text").mapInArrow(run, f"name string, level double, key {kind}, text string")


def _dropped(text: Column, key: Column, level: Column) -> Column:
    kept = F.filter(X.words(text, True), lambda _, i: draw(key, "drop", i) >= level)
    return F.when((level <= 0) | text.isNull(), text).otherwise(F.array_join(kept, " "))


#: By name the table of characters, and the name that places are drawn by.
BY_CHARACTER = {"asr_noise": (TRANSCRIBED, "asr"), "typo_noise": (neighbours(), "typo")}
_BY_WORD = {"intensity_dial": _tokens(X.apply_rules_to, "dial"), "standardize": _tokens(X.standard_of, "standard"), "word_dropout": _dropped}
PERTURBATIONS = ("intensity_dial", "standardize", "asr_noise", "typo_noise", "word_dropout")


def swept(df, names: list[str], levels: list[float]):
    """(name, level, key, text): each row of df (key, text) at each level of each perturbation, multiplied where it lies. Level 0 or null text: as it is."""
    words, characters = [n for n in names if n in _BY_WORD], [n for n in names if n in BY_CHARACTER]
    out = None
    if words:
        each = df.select("key", "text", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(x)).alias("level")) for n in words for x in levels])).alias("s")).select("key", "text", "s.*")
        text = None
        for n in words:
            one = _BY_WORD[n](F.col("text"), F.col("key"), F.col("level"))
            text = F.when(F.col("name") == n, one) if text is None else text.when(F.col("name") == n, one)
        out = each.select("name", "level", "key", text.alias("text"))
    if characters:
        some = _characters(df, characters, levels)
        out = some if out is None else out.unionByName(some)
    return out


def slope(level: str, value: str) -> Column:
    """Least-squares slope over levels, as an aggregate; 0 for one level."""
    return F.coalesce(F.regr_slope(F.col(value), F.col(level)), F.lit(0.0))


def breakdown(level: str, value: str, clean: Column, share: float = 0.5) -> Column:
    """The lowest level whose value is under a share of the clean one, null if none is."""
    return F.min(F.when(F.col(value) < share * clean, F.col(level)))
