"""Named corpora in their own layouts under a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import text as X
from corpusloom.sources.lines import records
from corpusloom.sources.manifest import ManifestError, faults, probed, read_manifest

#: Corpora that are a manifest in their folder; the labels that some imply are in ``manifest.DEFAULTS``.
MANIFESTS = ("manifest", "dgp", "dialektarium", "korpus_spiski", "mackowce", "spokes", "nkjp", "bigos")
#: The columns of a Common Voice release.
VOICE_COLUMNS = ("client_id", "path", "sentence")
VOICE_METADATA = ("age", "gender", "accents", "accent", "variant", "locale", "segment")


def load(spark: SparkSession, name: str, root: str, **options) -> DataFrame:
    """The samples of a corpus by name."""
    if name == "common_voice_pl":
        return common_voice(spark, root, **options)
    if name not in MANIFESTS:
        raise ValueError(f"unknown corpus {name!r}; known: {', '.join((*MANIFESTS, 'common_voice_pl'))}")
    return read_manifest(spark, root, source=name, **options)


def common_voice(spark: SparkSession, root: str, tsv: str = "validated.tsv", accents: dict[str, str] | None = None) -> DataFrame:
    """A release's TSV with its clips beside it. Read standard speech: family standard, unless a row's accent (case does not matter) is given a dialect in ``accents``. Rows without a speaker, or with neither sentence nor clip, are left out."""
    path = probed(spark, f"{root.rstrip('/')}/{tsv}")
    rows = records(spark, path, "\t")
    wrong = faults(rows, {c: c for c in VOICE_COLUMNS} | {"text": "sentence", "audio_path": "path"}).orderBy("file", "line").limit(1).collect()
    if wrong:
        raise ManifestError(f"{wrong[0]['file']}:{wrong[0]['line']}: {wrong[0]['message']}")
    cell = lambda c: F.nullif(F.trim(F.try_element_at("cells", F.lit(c))), F.lit(""))
    known = {k.strip().lower(): v for k, v in (accents or {}).items()}
    accent = F.lower(F.coalesce(cell("accents"), cell("accent")))
    dialect = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), accent) if known else F.lit(None).cast("string")
    kept = F.array(*[F.struct(F.lit(c).alias("key"), cell(c).alias("value")) for c in VOICE_METADATA])
    none = F.lit(None).cast("string")
    stem = F.regexp_replace(F.regexp_extract(cell("path"), "([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    out = rows.select(
        F.coalesce(F.concat(F.lit("common_voice_pl-"), stem), F.concat(F.lit("common_voice_pl-"), F.col("line").cast("string"))).alias("id"), cell("sentence").alias("text"), F.concat(F.lit(f"{root.rstrip('/')}/clips/"), cell("path")).alias("audio_path"), cell("client_id").alias("speaker_id"),
        F.struct(F.when(dialect.isNull(), F.lit("standard")).otherwise(X.family_of(dialect)).alias("family"), dialect.alias("dialect"), *[none.alias(c) for c in ("region", "village", "voivodeship")]).alias("labels"),
        F.lit("common_voice_pl").alias("source"), F.map_from_entries(F.filter(kept, lambda s: s["value"].isNotNull())).alias("metadata"),
    )
    return out.where("speaker_id IS NOT NULL AND (text IS NOT NULL OR audio_path IS NOT NULL)")
