"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import simhash
from gleaner.llm.components import connected

SCHEMA = "doc_id long, text string, fp string, component int"


def brute(rows, radius=4):
    fps = [int.from_bytes(simhash.fingerprint(simhash.shingle_hashes(t, 4)), "big") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    out = simhash.groups(df, **options).select("id", simhash.hex_digits(F.col("fp")), "component")
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(n, seed=1):
    rng, rows = random.Random(seed), []
    vocabulary = ["w%d" % i for i in range(300)]
    base = [rng.choices(vocabulary, k=120) for _ in range(6)]
    for i in range(n):
        text = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(vocabulary, k=rng.randint(1, 40))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    return rows


def test_fingerprint_by_definition():
    import xxhash
    text = "A b\tc  D e\n"
    shingles = ["a b c d", "b c d e"]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert int.from_bytes(simhash.fingerprint(simhash.shingle_hashes(text, 4)), "big") == want
    assert simhash.fingerprint(simhash.shingle_hashes("", 4)) == bytes(8)
    assert len(simhash.fingerprint(simhash.shingle_hashes("É x", 4), 4)) == 32


def test_groups_match_brute_force(spark):
    rows = corpus(300) + [(1000, None), (1001, " \n"), (1002, ""), (None, "lone words here"), (None, corpus(3)[0][1]), (5, corpus(6)[5][1])]
    rows += [(2000, "long " + "word " * 30000)]
    assert got(spark, rows) == brute(rows)


def test_hot_bucket_is_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rows = corpus(260, 5)
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("rows", [10, 10**9, 10**12])
def test_exact_tables_cover_every_pattern_of_differences(rows):
    rng, tables = np.random.default_rng(3), simhash.exact_tables(4, rows)
    for _ in range(500):
        differ = set(rng.choice(64, 4, replace=False).tolist())
        assert any(not differ & set(t) for t in tables)


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    found = dict(connected(spark.createDataFrame(path + hub, "u long, v long")).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}
