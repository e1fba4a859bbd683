"""What reaches the driver or one task stays bounded whatever one doc_id holds."""

import zlib

from corpusloom.llm import mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string"


def test_rows_learnt_from(spark, monkeypatch):
    """A doc_id on thousands of rows gives about as many examples as asked for; long texts are among them."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)) or (_ for _ in ()).throw(StopIteration))
    ids = [i for i in range(400)]
    long_ = " ".join(f"w{i}" for i in range(60_000))
    hot = next(i for i in ids if zlib.crc32(str(i).encode()) % 3 != 1)  # learnt from
    docs = [(hot, f"text {i}", "", "s") for i in range(3000)] + [(i, f"doc {i}", "", "s") for i in ids] + [(i, long_ + f" {i}", "", "s") for i in ids[:9]]
    labels = spark.createDataFrame([(i, i % 2) for i in ids] * 3, "doc_id long, quality int")
    for most in (100, 10_000):
        try:
            quality.learn(spark.createDataFrame(docs, SCHEMA).repartition(4), labels, most)
        except StopIteration:
            pass
    small, whole = (len(y) for _, y in seen)
    assert small <= 300 and 2000 < whole < 3500
    assert max(len(f) for f in seen[1][0]) > 50_000
    monkeypatch.setattr(quality, "MOST_BYTES", 1 << 18)
    try:
        quality.learn(spark.createDataFrame(docs, SCHEMA), labels, 10_000)
    except StopIteration:
        pass
    assert sum(4 * len(f) for f in seen[2][0]) < 3 << 18


def test_rows_without_an_id_over_shards(spark):
    """Rows without a doc_id are dealt over all shards of their source, and give what the target asks for."""
    rows = [(None, " ".join([f"x{i}"] * (i % 7 + 1)), "", "s") for i in range(600)] + [(i, "a b c", "", "t") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, block_words=4, shard_words=300).collect()
    assert len(out) == 900
    for target in {r["target"] for r in out}:
        taken = sum(r["taken"] for r in out if r["target"] == target)
        assert abs(taken - target) <= max(40, 0.03 * target)
    assert {(r["size"], r["taken"]) for r in out} == {(r["size"], r["taken"]) for r in mixing.mix(docs.repartition(5), block_words=4, shard_words=300).collect()}
