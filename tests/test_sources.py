"""Numbered manifest records over many blocks, against the csv module; what is wrong with manifests, with lines; digests."""

import csv
import hashlib
import json
import random

import pytest

from corpusloom.sources import lines, manifest


def reader_rows(path, sep=","):
    with open(path, encoding="utf-8-sig", newline="") as f:
        r = csv.DictReader(f, delimiter=sep)
        return [(r.line_num, {k: v for k, v in row.items() if k is not None}) for row in r]


@pytest.mark.parametrize("block", [64, 1000, 1 << 27])
def test_records_over_blocks(spark, tmp_path, block):
    """Quoted cells with line breaks and quotes cross blocks of a few lines."""
    rng = random.Random(block)
    path = tmp_path / "m.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("﻿")
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "text", "note"])
        for i in range(400):
            w.writerow([i, rng.choice(['a "b" c', "line\nline\n\nline", "x,y", "plain", "é" * 40, ""]), rng.choice(["", '"', "n"])][: rng.choice([3, 3, 3, 2])] + (["more"] if rng.random() < 0.1 else []))
            if rng.random() < 0.1:
                f.write("\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = sorted((r["line"], r["cells"], r["code"]) for r in lines.records(spark, str(path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(n, {k: v for k, v in row.items()}, None) for n, row in reader_rows(path)]
    assert [(a, {k: v for k, v in b.items()}, c) for a, b, c in got] == [(a, b, c) for a, b, c in want] and len(got) == 400


def write(tmp_path, name, text):
    (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path / name)


def codes(spark, path, **options):
    return {(r["code"], r["severity"]): (r["n"], r["example"]) for r in manifest.validate_manifest(spark, path, **options).collect()}


@pytest.mark.parametrize(
    ("name", "text", "options", "code", "said"),
    [
        ("a.jsonl", '{"text": "x"}\n\n{oops}\n', {}, "malformed-row", ":3: invalid JSON"), ("b.jsonl", '{"text": "x"}\n[1]\n', {}, "malformed-row", ":2: expected a JSON object"), ("c.csv", b"text\nok\n\xff\xfe\n", {}, "encoding", ":3: not valid UTF-8"),
        ("d.csv", 'id,text\n1,"never closed\n2,b\n', {}, "parse-error", ":3: a quote is not closed"), ("e.csv", "id,note\n1,x\n", {}, "no-content-column", "neither a text column"), ("f.csv", "id,text\n1,x\n", {"columns": {"text": "body"}}, "missing-column", "missing required column(s): body"),
        ("g.jsonl", '{"body": "x"}\n{"text": "y"}\n', {"columns": {"text": "body"}}, "missing-column", ":2: missing required column(s): body"), ("h.csv", "", {}, "empty-manifest", "h.csv"),
    ],
)
def test_faults(spark, tmp_path, name, text, options, code, said):
    path = write(tmp_path, name, text)
    found = codes(spark, path, **options)
    assert (code, "error") in found and {k[1] for k in found} == {"error"} and said in found[code, "error"][1]
    with pytest.raises(manifest.ManifestError):
        manifest.read_manifest(spark, path, **options)


def test_missing_file_and_probing(spark, tmp_path):
    assert set(codes(spark, str(tmp_path / "no.csv"))) == {("missing-file", "error")}
    with pytest.raises(manifest.ManifestError):
        manifest.read_manifest(spark, str(tmp_path / "no.csv"))
    write(tmp_path, "manifest.tsv", "text\tdialect\nhej\tpodhale\n")
    r = manifest.read_manifest(spark, str(tmp_path), source="s").first()
    assert (r["id"], r["text"], r["labels"]["family"]) == ("s-manifest-000002", "hej", "lesser_polish")


def test_advice(spark, tmp_path):
    (tmp_path / "clips").mkdir()
    write(tmp_path / "clips", "a.wav", b"x")
    path = write(tmp_path, "m.csv", "id,text,audio_path,speaker_id,dialect,family\n1,x,clips/a.wav,s,Podhale,\n1,y,clips/b.wav,,nowhere,odd\n3,,,,,\n4,z,,,nowhere,\n")
    found = codes(spark, path)
    assert {k[0]: v[0] for k, v in found.items()} == {"empty-rows": 1, "duplicate-id": 1, "unknown-dialect": 2, "unknown-family": 1, "partial-speaker": 3, "missing-audio": 1}
    assert found["missing-audio", "warning"][1].endswith("clips/b.wav")
    assert set(codes(spark, write(tmp_path, "n.csv", "text\nx\n"))) == {("speaker-single-surrogate", "warning")}
    assert set(codes(spark, write(tmp_path, "o.csv", "text,village\nx,v\n"))) == {("speaker-surrogate", "info")}
    assert set(codes(spark, write(tmp_path, "p.jsonl", '{"text": "x", "speaker_id": "s"}\n'))) == {("speaker-present", "info")}


def test_samples(spark, tmp_path):
    path = write(tmp_path, "m.jsonl", "﻿" + json.dumps({"text": " x ", "dialect": "Kurpie", "age": 30, "n": None, "flag": True}) + "\n" + json.dumps({"text": "y", "village": "V", "region": "R"}) + "\n" + json.dumps({"audio_path": "a.wav"}) + "\n" + json.dumps({"note": "nothing"}))
    rows = {r["id"]: r for r in manifest.read_manifest(spark, path, source="src").collect()}
    spk = lambda *parts: "spk-" + hashlib.blake2b("|".join(parts).encode(), digest_size=8).hexdigest()
    assert set(rows) == {"src-m-000001", "src-m-000002", "src-m-000003"}
    a, b, c = (rows[f"src-m-00000{i}"] for i in (1, 2, 3))
    assert a["text"] == "x" and a["metadata"] == {"age": "30", "flag": "True"} and a["labels"]["family"] == "masovian" and a["speaker_id"] == spk("src", "Kurpie")
    assert b["speaker_id"] == spk("src", "V", "R") and c["text"] is None and c["speaker_id"] == spk("src", "m.jsonl")


def test_default_labels(spark, tmp_path):
    path = write(tmp_path, "m.csv", "text,dialect,family\na,podhale,\nb,,\nc,,silesian\n")
    got = {r["text"]: (r["labels"]["dialect"], r["labels"]["family"]) for r in manifest.read_manifest(spark, path, source="spokes").collect()}
    assert got == {"a": ("podhale", "lesser_polish"), "b": (None, "standard"), "c": (None, "silesian")}
    got = {r["text"]: (r["labels"]["dialect"], r["labels"]["family"]) for r in manifest.read_manifest(spark, path, source="korpus_spiski").collect()}
    assert got == {"a": ("podhale", "lesser_polish"), "b": ("spisz", "lesser_polish"), "c": ("spisz", "silesian")}


def test_common_voice(spark, tmp_path):
    from corpusloom.sources import loaders

    write(tmp_path, "validated.tsv", "client_id\tpath\tsentence\tage\taccents\nu1\ta.mp3\tDzień dobry\ttwenties\tPodhale gwara\nu2\tb.c.mp3\t\t\t\n\tc.mp3\tno speaker\t\t\nu3\t\tno clip\t\t\nu4\t\t\t\t\n")
    rows = {r["id"]: r for r in loaders.load(spark, "common_voice_pl", str(tmp_path), accents={" podhale GWARA": "podhale"}).collect()}
    assert set(rows) == {"common_voice_pl-a", "common_voice_pl-b.c", "common_voice_pl-5"}
    a, b = rows["common_voice_pl-a"], rows["common_voice_pl-b.c"]
    assert (a["labels"]["dialect"], a["labels"]["family"], a["metadata"], a["audio_path"]) == ("podhale", "lesser_polish", {"age": "twenties", "accents": "Podhale gwara"}, f"{tmp_path}/clips/a.mp3")
    assert (b["labels"]["family"], b["text"], b["speaker_id"]) == ("standard", None, "u2")
    with pytest.raises(manifest.ManifestError):
        loaders.common_voice(spark, str(tmp_path), tsv="other.tsv")
    write(tmp_path, "bad.tsv", "path\tsentence\na\tb\n")
    with pytest.raises(manifest.ManifestError, match="client_id"):
        loaders.common_voice(spark, str(tmp_path), tsv="bad.tsv")
    with pytest.raises(ValueError):
        loaders.load(spark, "nobody", str(tmp_path))
