"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import lexicons as L

WORDS = "[\\p{L}\\p{Nl}\\p{No}]+"


def words(text: Column, lowercase: bool = False) -> Column:
    """Words of letters; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(WORDS), F.lit(0))


def spaced_words(text: Column) -> Column:
    """Lower-cased words between white space; null counts as empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), "")


def rate(count: Column, size: Column, per: float = 1.0) -> Column:
    """per * count / size, 0 for size 0."""
    return F.when(size > 0, F.lit(per) * count / size).otherwise(0.0)


def total(array: Column, value) -> Column:
    """Sum of value(x) over an array of whatever."""
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + value(x))


# cleaning


def strip_artifacts(text: Column) -> Column:
    """Bracketed notes, parenthesised annotations, pause marks; squeezes repeated punctuation."""
    text = F.regexp_replace(text, L.BRACKETED, " ")
    text = F.regexp_replace(text, "(?iuU)" + L.PARENTHESISED.format("|".join(L.ANNOTATIONS)), " ")
    text = F.regexp_replace(text, "(?U)" + L.PAUSE, " ")
    return F.regexp_replace(F.regexp_replace(text, L.LONG_STOPS, "..."), L.REPEATED_MARKS, "$1")


def plain_punctuation(text: Column) -> Column:
    """Typographic quotes, dashes and ellipses as ASCII."""
    source = L.DOUBLE_QUOTES + L.SINGLE_QUOTES + L.DASHES
    return F.replace(F.translate(text, source, '"' * len(L.DOUBLE_QUOTES) + "'" * len(L.SINGLE_QUOTES) + "-" * len(L.DASHES)), F.lit("…"), F.lit("..."))


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def clean(text: Column, *, artifacts: bool = True, punctuation: bool = True, spaces: bool = True, lowercase: bool = False) -> Column:
    """The cleaning chain in its fixed order, without NFC (see ``nfc``)."""
    for wanted, step in ((artifacts, strip_artifacts), (punctuation, plain_punctuation), (spaces, collapse_spaces), (lowercase, F.lower)):
        text = step(text) if wanted else text
    return text


def nfc(text: Column) -> Column:
    """Unicode NFC, by an Arrow UDF: Spark has no such function."""
    import unicodedata

    @F.pandas_udf("string")
    def normalise(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return normalise(text)


def fingerprint(text: Column) -> Column:
    """BLAKE2b-128 of the case-folded, space-collapsed NFC text."""
    import hashlib
    import unicodedata

    @F.pandas_udf("string")
    def digest(s):
        return s.map(lambda x: None if x is None else hashlib.blake2b(" ".join(unicodedata.normalize("NFC", x).split()).casefold().encode(), digest_size=16).hexdigest())

    return digest(text)


def hash_text(text: Column) -> Column:
    """Space-collapsed lower-cased text: the key of exact dedup that SQL can compute too."""
    return F.lower(collapse_spaces(text))


def shingles(text: Column, size: int = 5) -> Column:
    """The distinct character n-grams; a shorter text is its only one, an empty one has none. One pass over the text."""
    whole = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) <= size, whole).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


# lexical features


def marker_hits(tokens: Column, markers) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*markers)))


def keyword_rates(tokens: Column, per: float = 1000.0) -> dict[str, Column]:
    hits = {d: marker_hits(tokens, m) for d, m in L.MARKERS.items()}
    hits["total"] = reduce(lambda a, b: a + b, hits.values())
    return {d: rate(h, F.size(tokens), per) for d, h in hits.items()}


def pattern_hits(tokens: Column, pattern: str, stop=()) -> Column:
    """Matches of a pattern inside tokens that are not stop words."""
    if stop:
        tokens = F.filter(tokens, lambda t: ~t.isin(*stop))
    return F.regexp_count(F.array_join(tokens, " "), F.lit(pattern))


def token_pattern(parts, final: bool) -> str:
    """The longest of the parts at a place, at the token's end if final."""
    body = "|".join(sorted(parts, key=lambda x: (-len(x), x)))
    return f"(?:{body})(?= |$)" if final else body


def rule_rates(tokens: Column) -> dict[str, Column]:
    """applicable and fired rate of each sound rule, by token."""
    out = {}
    for name, (_, detectable, final, pairs, stop) in L.RULES.items():
        out[f"{name}_applicable"] = rate(pattern_hits(tokens, token_pattern([a for a, _ in pairs], final), stop), F.size(tokens))
        if detectable:
            out[f"{name}_fired"] = rate(pattern_hits(tokens, token_pattern([b for _, b in pairs], final), stop), F.size(tokens))
    return out


def _rewrite(token: Column, pairs, final: bool, stop) -> Column:
    out = token
    for a, b in sorted(pairs, key=lambda p: -len(p[0])):
        out = F.regexp_replace(out, a + ("$" if final else ""), b)
    return F.when(token.isin(*stop), token).otherwise(out) if stop else out


def keyword_hits() -> dict:
    """Functions of a token Column that count markers, by dialect and in all."""
    each = {d: (lambda t, m=tuple(m): t.isin(*m).cast("int")) for d, m in L.MARKERS.items()}
    return each | {"total": lambda t: reduce(lambda a, b: a + b, (f(t) for f in each.values()))}


def rule_hits() -> dict:
    """Functions of a token Column that count a rule's standard parts, and its dialect parts if they can be told."""

    def counter(parts, final, stop):
        pattern = F.lit(token_pattern(parts, final))
        return lambda t: F.when(t.isin(*stop), 0).otherwise(F.regexp_count(t, pattern)) if stop else F.regexp_count(t, pattern)

    out = {}
    for name, (_, detectable, final, pairs, stop) in L.RULES.items():
        out[f"{name}_applicable"] = counter([a for a, _ in pairs], final, stop)
        if detectable:
            out[f"{name}_fired"] = counter([b for _, b in pairs], final, stop)
    return out


def token_rates(df: DataFrame, key: str, hits: dict, per: float = 1.0) -> DataFrame:
    """(key, one rate for each function of hits): words are cut once, and summed where they are cut; one row of each text is shuffled."""
    tokens = df.select(key, F.explode_outer(words(F.col("text"), True)).alias("t"))
    sums = tokens.groupBy(key).agg(F.count("t").alias("_n"), *[F.coalesce(F.sum(f(F.col("t"))), F.lit(0)).alias(n) for n, f in hits.items()])
    return sums.select(key, *[rate(F.col(n), F.col("_n"), per).alias(n) for n in hits])


def apply_rules_to(token: Column) -> Column:
    """Each rule in turn on one token."""
    for _, _, final, pairs, stop in L.RULES.values():
        token = _rewrite(token, pairs, final, stop)
    return token


def standard_of(token: Column) -> Column:
    """The detectable rules in reverse on one token; mergers can't be undone."""
    for _, detectable, final, pairs, stop in L.RULES.values():
        if detectable:
            token = _rewrite(token, [(b, a) for a, b in pairs], final, stop)
    return token


def apply_rules(text: Column) -> Column:
    """Standard spelling to dialect spelling."""
    return F.array_join(F.transform(words(text, True), apply_rules_to), " ")


def to_standard(text: Column) -> Column:
    """Dialect spelling to standard spelling."""
    return F.array_join(F.transform(words(text, True), standard_of), " ")


def intensity(text: Column, marker_weight: float = 8.0, fired_weight: float = 8.0) -> Column:
    """1 - exp(-(weighted marker and fired-rule density)); 0 without words."""
    tokens = words(text, True)
    every = sorted({m for ms in L.MARKERS.values() for m in ms})
    fired = reduce(lambda a, b: a + b, (c for k, c in rule_rates(tokens).items() if k.endswith("_fired")))
    return F.lit(1.0) - F.exp(-(marker_weight * rate(marker_hits(tokens, every), F.size(tokens)) + fired_weight * fired))


def stylometry(df: DataFrame) -> DataFrame:
    """doc_id and 17 measures of sentences, words, punctuation and vocabulary; population deviations, 0 where there is nothing to divide by.

    The vocabulary's measures come from counts that are made where a document lies.
    """
    from corpusloom.operators import counted

    base = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", words(F.col("t"), True).alias("w"), F.length("t").alias("c"))
    sentences = F.filter(F.transform(F.split("t", "[.!?…]+"), lambda s: F.size(F.regexp_extract_all(s, F.lit(WORDS), F.lit(0)))), lambda k: k > 0)
    rows = base.select("doc_id", "t", "c", F.size("w").alias("n"), F.transform("w", F.length).alias("lengths"), sentences.alias("s"))
    mean = lambda a: rate(total(F.col(a), lambda x: x), F.size(a))
    spread = lambda a: F.sqrt(F.greatest(rate(total(F.col(a), lambda x: x.cast("double") * x), F.size(a)) - mean(a) * mean(a), F.lit(0.0)))
    per_100 = lambda pattern: rate(F.regexp_count("t", F.lit(pattern)), F.col("c"), 100.0)
    measured = rows.select(
        "doc_id", F.size("s").cast("double").alias("sentence_count"), mean("s").alias("sentence_length_words_mean"), spread("s").alias("sentence_length_words_std"), mean("lengths").alias("word_length_mean"), spread("lengths").alias("word_length_std"),
        per_100(",").alias("commas_per_100_chars"), per_100("\\.").alias("periods_per_100_chars"), per_100("\\?").alias("question_marks_per_100_chars"), per_100("!").alias("exclamations_per_100_chars"),
        per_100(f"[{L.STYLE_DASHES}]").alias("dashes_per_100_chars"), per_100("\\.{3}|…").alias("ellipses_per_100_chars"), per_100(f"[{L.STYLE_QUOTES}]").alias("quotes_per_100_chars"),
        rate(F.regexp_count("t", F.lit("\\p{Nd}")), F.col("c")).alias("digit_ratio"), rate(F.regexp_count("t", F.lit("\\p{Lu}")), F.regexp_count("t", F.lit("\\p{L}"))).alias("uppercase_ratio"), "n",
    )
    counts = counted.token_rows(counted.one_row(df.select("doc_id", words(F.col("text"), True).alias("w")), "doc_id"), ["doc_id"])
    kinds = counts.groupBy("doc_id").agg(F.count("*").alias("types"), F.count_if(F.col("tf") == 1).alias("once"), F.sum(F.col("tf") * F.col("tf")).alias("m2"))
    out = measured.join(kinds, "doc_id", "left")
    n = F.col("n")
    return out.select(*measured.drop("n").columns, F.coalesce(rate(F.col("types"), n), F.lit(0.0)).alias("type_token_ratio"), F.coalesce(rate(F.col("once"), n), F.lit(0.0)).alias("hapax_legomena_ratio"), F.coalesce(rate(F.col("m2") - n, n.cast("double") * n, 1e4), F.lit(0.0)).alias("yules_k"))


def affixes(token: Column, shortest: int = 2, longest: int = 4) -> Column:
    """Labelled prefixes and suffixes of tokens at least one character longer."""
    parts = [F.when(F.length(token) > k, label) for k in range(shortest, longest + 1) for label in (F.concat(F.lit("pre:"), F.left(token, F.lit(k))), F.concat(F.lit("suf:"), F.right(token, F.lit(k))))]
    return F.array_compact(F.array(*parts))


def char_wb(text: Column, shortest: int = 2, longest: int = 5) -> Column:
    """Character n-grams inside space-padded words; a padded word no longer than n is emitted whole, once."""
    padded = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def pieces(word: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))

    def of(word: Column) -> Column:
        grams = []
        for n in range(shortest, longest + 1):
            short = F.length(word) <= n
            once = short if n == shortest else short & (F.length(word) > n - 1)
            grams.append(F.when(~short, pieces(word, n)).when(once, F.array(word)).otherwise(F.array().cast("array<string>")))
        return F.concat(*grams)

    return F.flatten(F.transform(padded, of))


# bands and labels


def band(value: Column, bands, above: str) -> Column:
    out = F.when(value.isNull(), None)
    for top, name in bands:
        out = out.when(value <= top, name)
    return out.otherwise(above)


def length_band(n: Column) -> Column:
    return band(n, L.LENGTH_BANDS, ">160")


def age_band(age: Column) -> Column:
    """Bands of truncated numbers; what is no number passes through."""
    number = age.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.nullif(F.trim(age), F.lit(""))).otherwise(band(number.cast("long"), L.AGE_BANDS, "60+"))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def family_of(dialect: Column) -> Column:
    return F.try_element_at(literal_map(L.FAMILY_OF), F.lower(F.trim(dialect)))


def snippet(text: Column, width: int = 80) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
