"""Manifest files (CSV, TSV, JSON lines) as sample rows, and splits written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import lexicons as L, text as X
from corpusloom.sources.lines import records

CORE = ("id", "text", "audio_path", "speaker_id", *L.LEVELS)
DEFAULTS = {"korpus_spiski": {"dialect": "spisz"}, "mackowce": {"dialect": "podolia"}, "spokes": {"family": "standard"}, "nkjp": {"family": "standard"}}


class ManifestError(ValueError):
    """What is wrong with a manifest, with file and line where it is a record's."""


def probed(spark: SparkSession, path: str) -> str:
    """The path, or that of a file of the name manifest in it: .csv, .tsv or .jsonl, in this order."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path) and fs.getFileStatus(fs_path).isDirectory():
        for end in (".csv", ".tsv", ".jsonl"):
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(fs_path, f"manifest{end}")):
                return f"{path.rstrip('/')}/manifest{end}"
    if not any(True for _ in (fs.globStatus(fs_path) or [])):
        raise ManifestError(f"manifest file not found: {path}")
    return path


def read_manifest(spark: SparkSession, path: str, *, source: str = "unknown", columns: dict[str, str | None] | None = None, defaults: dict[str, str] | None = None, delimiter: str | None = None) -> DataFrame:
    """Rows of a manifest as samples; the first thing wrong with it is an error that names file and line.

    Cells are trimmed and blank ones null. columns maps core fields to the file's names, which must then exist (null: no such
    field); defaults fill labels, though a default family gives way to a row's own dialect; what is not a core field goes to
    metadata. A row without an id gets one from source, file and line; one without a speaker, one from source and places, or
    source and file. Rows with neither text nor audio are left out.
    """
    path = probed(spark, path)
    rows = records(spark, path, delimiter)
    wrong = faults(rows, columns or {}).orderBy("file", "line").limit(1).collect()
    if wrong:
        raise ManifestError(f"{wrong[0]['file']}:{wrong[0]['line']}: {wrong[0]['message']}")
    if rows.isEmpty() and spark.read.text(path).isEmpty():
        raise ManifestError(f"manifest {path} is empty (no header row)")
    return project(rows, source, columns or {}, (defaults or {}) | DEFAULTS.get(source, {}))


def faults(rows: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """(file, line, code, message) of records that can't be read or lack a column asked for, and of files without any text or audio column."""
    asked = sorted(n for n in columns.values() if n is not None)
    missing = F.filter(F.array(*map(F.lit, asked)).cast("array<string>"), lambda n: ~F.array_contains(F.map_keys("cells"), n))
    text, audio = columns.get("text", "text"), columns.get("audio_path", "audio_path")
    content = F.lit(False)
    for n in (text, audio):
        content = content | (F.array_contains(F.map_keys("cells"), F.lit(n)) if n is not None else F.lit(False))
    bad = rows.where("code IS NOT NULL").select("file", "line", "code", "message")
    lacking = rows.where(F.col("code").isNull() & (F.size(missing) > 0)).select("file", "line", F.lit("missing-column").alias("code"), F.concat(F.lit("missing required column(s): "), F.array_join(missing, ", ")).alias("message"))
    none = rows.where("code IS NULL").groupBy("file").agg(F.min("line").alias("line"), F.bool_or(content).alias("has")).where("NOT has")
    return bad.unionByName(lacking).unionByName(none.select("file", "line", F.lit("no-content-column").alias("code"), F.lit(f"neither a text column ({text!r}) nor an audio path column ({audio!r})").alias("message")))


def digest8(text):
    """BLAKE2b-64 in hexadecimal, by an Arrow UDF: Spark has no such function."""
    import hashlib

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda x: hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest())

    return run(text)


def project(rows: DataFrame, source: str, columns: dict[str, str | None], defaults: dict[str, str]) -> DataFrame:
    """Records (file, line, cells) to sample columns."""
    name = {c: columns.get(c, c) for c in CORE}
    cell = {c: F.nullif(F.trim(F.try_element_at("cells", F.lit(n))), F.lit("")) if n is not None else F.lit(None).cast("string") for c, n in name.items()}
    dialect = F.coalesce(cell["dialect"], F.lit(defaults.get("dialect")).cast("string"))
    family = F.coalesce(cell["family"], F.when(dialect.isNull(), F.lit(defaults.get("family")).cast("string")), X.family_of(dialect))
    places = {c: F.coalesce(cell[c], F.lit(defaults.get(c)).cast("string")) for c in ("region", "village", "voivodeship")}
    file = F.regexp_extract("file", "([^/]+)$", 1)
    parts = F.concat_ws("|", places["village"], places["region"], places["voivodeship"], dialect)
    surrogate = F.concat_ws("|", F.lit(source), F.when(parts != "", parts).otherwise(file))
    used = [n for n in name.values() if n is not None]
    tail = F.map_filter("cells", lambda k, v: ~k.isin(*used) & v.isNotNull() & (v != ""))
    out = rows.select(
        F.coalesce(cell["id"], F.format_string(f"{source.replace('%', '%%')}-%s-%06d", F.regexp_replace(file, r"\.[^.]*$", ""), "line")).alias("id"), cell["text"].alias("text"), cell["audio_path"].alias("audio_path"), cell["speaker_id"].alias("_speaker"), surrogate.alias("_surrogate"),
        F.struct(family.alias("family"), dialect.alias("dialect"), *[p.alias(n) for n, p in places.items()]).alias("labels"), F.lit(source).alias("source"), tail.alias("metadata"),
    ).where("text IS NOT NULL OR audio_path IS NOT NULL")
    speaker = F.coalesce("_speaker", F.concat(F.lit("spk-"), digest8(F.col("_surrogate"))))
    return out.select("id", "text", "audio_path", speaker.alias("speaker_id"), "labels", "source", "metadata")


SEVERITY = {
    "missing-file": "error", "encoding": "error", "no-content-column": "error", "missing-column": "error", "empty-manifest": "error", "malformed-row": "error", "invalid-sample": "error", "parse-error": "error", "duplicate-id": "error",
    "empty-rows": "warning", "unknown-dialect": "warning", "unknown-family": "warning", "speaker-single-surrogate": "warning", "partial-speaker": "warning", "missing-audio": "warning", "speaker-surrogate": "info", "speaker-present": "info",
}


def validate_manifest(spark: SparkSession, path: str, *, source: str = "manifest", columns: dict[str, str | None] | None = None, audio_root: str | None = None) -> DataFrame:
    """(severity, code, n, example) of all that is to be said of a manifest; with an error of reading, nothing but errors.

    n counts records (labels: of each unknown value, a row of its own). missing-audio lists the files under the folder once and leaves out the paths found; a file of no bytes is none.
    """
    columns = columns or {}

    def said(*found) -> DataFrame:
        return spark.createDataFrame([(SEVERITY[c], c, n, e) for c, n, e in found], "severity string, code string, n long, example string")

    try:
        path = probed(spark, path)
    except ManifestError as e:
        return said(("missing-file", 1, str(e)))
    rows = records(spark, path).persist()
    try:
        wrong = faults(rows, columns).groupBy("code").agg(F.count("*").alias("n"), F.min(F.struct("file", "line", "message")).alias("e")).collect()
        if wrong:
            return said(*[(r["code"], r["n"], f"{r['e']['file']}:{r['e']['line']}: {r['e']['message']}") for r in sorted(wrong, key=lambda r: r["code"])])
        if rows.isEmpty() and spark.read.text(path).isEmpty():
            return said(("empty-manifest", 1, path))
        samples = project(rows, source, columns, {})
        name = {c: columns.get(c, c) for c in CORE}
        given = F.nullif(F.trim(F.try_element_at("cells", F.lit(name["speaker_id"] or ""))), F.lit(""))
        n = rows.agg(F.count("*").alias("rows"), F.count(given).alias("spoken"), F.array_distinct(F.flatten(F.collect_set(F.map_keys("cells")))).alias("keys")).first()
        usable = samples.count()
        out = [("empty-rows", n["rows"] - usable, None)] if n["rows"] > usable else []
        twice = samples.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n"), F.min("id").alias("e")).first()
        out += [("duplicate-id", twice["n"], twice["e"])] if twice["n"] else []
        for code, label, known in (("unknown-dialect", "dialect", set(L.FAMILY_OF)), ("unknown-family", "family", set(L.FAMILIES))):
            odd = samples.where(~F.lower(F.trim(f"labels.{label}")).isin(*known)).groupBy(f"labels.{label}").agg(F.count("*").alias("n")).orderBy(label)
            out += [(code, r["n"], r[label]) for r in odd.limit(1000).collect()]  # a report names so many odd labels at most
        places = [c for c in ("village", "region", "voivodeship", "dialect") if name[c] in n["keys"]]
        if not n["spoken"]:
            out.append(("speaker-surrogate", n["rows"], ", ".join(places)) if places else ("speaker-single-surrogate", n["rows"], None))
        else:
            out.append(("partial-speaker", n["rows"] - n["spoken"], None) if n["spoken"] < n["rows"] else ("speaker-present", n["rows"], None))
        heard = samples.where("audio_path IS NOT NULL")
        if not heard.isEmpty():
            root = (audio_root or path.rsplit("/", 1)[0]).rstrip("/")
            there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
            full = F.when(F.col("audio_path").startswith("/"), F.col("audio_path")).otherwise(F.concat(F.lit(root.removeprefix("file://") + "/"), "audio_path"))
            gone = heard.select(full.alias("path")).join(there, "path", "left_anti").agg(F.count("*").alias("n"), F.min("path").alias("e")).first()
            out += [("missing-audio", gone["n"], gone["e"])] if gone["n"] else []
        return said(*out)
    finally:
        rows.unpersist()


def write_splits(df: DataFrame, path: str) -> None:
    df.write.partitionBy("split").json(path)


def read_splits(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
