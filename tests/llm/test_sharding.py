"""Shards: a prefix-free cover within the limit."""

from gleaner.llm import sharding

SCHEMA = "doc_id long, text string, shard string, bits int"


def run(spark, rows, limit, **options):
    df = spark.createDataFrame([(d, t, "old", 1) for d, t in rows], SCHEMA)
    return [r.asDict() for r in sharding.shard(df, limit, **options).collect()]


def test_cover_and_limit(spark):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(500)] + [(7, "x" * 200)] * 60 + [(999, "é" * 5000), (1000, None), (1001, "")]
    out = run(spark, rows, 4000)
    assert sorted((r["doc_id"], r["text"] or "", r["n_bytes"]) for r in out) == sorted((d, t or "", len((t or "").encode())) for d, t in rows)
    shards = {}
    for r in out:
        shards.setdefault(r["shard"], []).append(r)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    for name, inside in shards.items():
        size = sum(r["n_bytes"] for r in inside)
        assert {(r["shard_bytes"], r["shard_docs"]) for r in inside} == {(size, len(inside))}
        assert size <= 4000 or len(inside) == 1
        if name:  # its parent was too large
            assert sum(r["n_bytes"] for r in out if r["shard"].startswith(name[:-1])) > 4000


def test_one_shard_when_all_fits(spark):
    out = run(spark, [(1, "a"), (1, "a"), (None, None)], 100, columns=["doc_id"])
    assert [(r["shard"], r["shard_bytes"], r["shard_docs"]) for r in out] == [("", 2, 3)] * 3
    assert set(out[0]) == {"doc_id", "n_bytes", "shard", "shard_bytes", "shard_docs"}


def test_copies_of_one_row_are_split(spark):
    out = run(spark, [(1, "abcd")] * 300, 40)
    assert len(out) == 300 and all(r["shard_bytes"] <= 40 for r in out)


def test_empty_table(spark):
    assert run(spark, [], 10) == []


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50) for i in range(50)], "doc_id long, text string")
    sharding.write_shards(sharding.shard(df, 600), str(tmp_path / "out"))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(50))
