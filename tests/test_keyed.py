"""Keyed tables: small writes, replay, two writers, versions that go."""

import random
import re
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from gleaner.session import shared_dir
from gleaner.sources import keyed
from gleaner.sources.keyed import Conflict, KeyedTable, changes


@pytest.fixture
def root(spark):
    return f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}"


def table(spark, root, **options):
    return KeyedTable(spark, root, "k string, n bigint, tags array<string>", ["k"], **options)


def rows(spark, pairs):
    return spark.createDataFrame([(k, n, [str(n)]) for k, n in pairs], "k string, n bigint, tags array<string>")


def state(t):
    return {r.k: r.n for r in t.read().collect()}


def bytes_below(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def test_random_commits_equal_a_dict(spark, root, monkeypatch):
    monkeypatch.setattr(keyed, "SEGMENTS", 2)
    rng, t, want = random.Random(3), table(spark, root, buckets=4), {}
    assert state(t) == {} and t.versions() == []
    for step in range(7):
        new = {f"k{rng.randrange(40)}": rng.randrange(1000) for _ in range(rng.choice([3, 12]))}
        lost = [k for k in rng.sample(sorted(want), min(3, len(want))) if k not in new]
        m = t.commit(rows(spark, new.items()), spark.createDataFrame([(k,) for k in lost], "k string"))
        t.fold(m)
        want = {k: n for k, n in (want | new).items() if k not in lost}
        assert state(t) == want
    asked = spark.createDataFrame([("k1",), ("k2",), ("nowhere",), (None,)], "k string")
    assert {r.k: r.n for r in t.lookup(asked).collect()} == {k: want[k] for k in ("k1", "k2") if k in want}
    t.expire(1)
    assert len(t.versions()) == 1 and state(t) == want


def test_small_batch_writes_a_small_part_and_replay_nothing(spark, root):
    t = table(spark, root)
    many = spark.range(50_000).select(F.concat(F.lit("key-"), F.sha1(F.col("id").cast("string"))).alias("k"), F.col("id").alias("n"),
                                      F.array(F.sha2(F.col("id").cast("string"), 256)).alias("tags"))
    t.commit(many, label="1", writer="w")
    before = bytes_below(spark, root)
    batch = many.where("n < 250").unionByName(many.where("n < 250").withColumn("k", F.concat("k", F.lit("x"))))
    change = lambda known: batch.join(known.select("k", F.col("n").alias("old")), "k", "left").select("k", (F.coalesce("old", F.lit(0)) + 1_000_000).alias("n"), "tags")
    t.update(batch, change, "w", "2")
    written = bytes_below(spark, root) - before
    assert t.read().where("n >= 1000000").count() == 500 and t.read().count() == 50_250
    assert written < 0.05 * before
    after = bytes_below(spark, root)
    t.update(batch, change, "w", "2")
    t.update(batch, change, "w", "1")
    assert bytes_below(spark, root) == after and t.read().where("n >= 2000000").count() == 0


def test_lookup_reads_the_buckets_of_its_keys(spark, root):
    t = table(spark, root)
    t.commit(rows(spark, [(f"k{i}", i) for i in range(500)]))
    found = t.lookup(rows(spark, [("k7", 0)]))
    assert [r.n for r in found.collect()] == [7]
    assert len({f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles()}) <= keyed.BUCKETS
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", found._jdf.queryExecution().toString())


def test_the_second_writer_of_a_version_loses(spark, root):
    a, b = table(spark, root), table(spark, root)
    m = a.commit(rows(spark, [("x", 1)]))
    a.commit(rows(spark, [("y", 2)]), base=m)
    conflict = keyed.Manifest(2, m.buckets, m.segments, {})
    with pytest.raises(Conflict):
        b._put(conflict)
    assert state(b) == {"x": 1, "y": 2}


def test_two_writers_lose_nothing(spark, root):
    table(spark, root).commit(rows(spark, [("shared", 0)]))
    failed = []

    def work(name):
        try:
            t = table(spark, root)
            for i in range(4):
                add = rows(spark, [("shared", 1), (f"{name}{i}", 1)])
                t.update(add, lambda known, add=add: add.join(known.select("k", F.col("n").alias("old")), "k", "left")
                         .select("k", (F.coalesce("old", F.lit(0)) + F.col("n")).alias("n"), "tags"), name, f"{i:03d}")
        except Exception as e:  # shown below
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in ("a", "b")]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed
    assert state(table(spark, root)) == {"shared": 8} | {f"{n}{i}": 1 for n in "ab" for i in range(4)}


def test_going_back_to_a_label(spark, root):
    t = table(spark, root)
    one = t.commit(rows(spark, [("x", 1)]), writer="s", label="1")
    t.commit(rows(spark, [("x", 2)]), writer="s", label="2")
    assert t.at_label("s", "1") == one and t.at_label("s", None).version == 0
    t.commit(rows(spark, [("z", 9)]), base=one, writer="s", label="2")
    assert state(t) == {"x": 1, "z": 9}


def test_changes(spark):
    before = spark.createDataFrame([(1, "a", {"p": "q"}), (2, "b", None), (None, "c", None)], "k int, v string, m map<string,string>")
    after = spark.createDataFrame([(1, "a", {"p": "q"}), (2, "B", None), (4, "d", {})], "k int, v string, m map<string,string>")
    changed, gone = changes(before, after, ["k"])
    assert sorted(r.k for r in changed.collect()) == [2, 4] and [r.k for r in gone.collect()] == [None]
