"""The pipeline's stages on planted documents, each judged on its own input."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gleaner.llm import near_copies, simhash  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(2000)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(10)]
    docs, labels, kinds = [], [], {}

    def add(text, kind):
        d = len(docs)
        docs.append((d, text, "en", f"src{d % 4}", len(text)))
        labels.append((d, 1, int(kind == "toxic")))
        kinds.setdefault(kind, []).append(d)

    for i in range(400):
        body = rng.choices(words, k=150)
        if i % 5 == 0:
            for _ in range(4):
                body.insert(rng.randrange(150), rng.choice(["vilewurd", "nastyterm", "badslur"]))
            add(" ".join(body), "toxic")
        elif i % 5 == 1:
            add(" ".join(body[:60]) + "\n" + items[i % 10][1] + "\n" + " ".join(body[60:]), "leak")
        else:
            add(" ".join(body), "clean")
    for d in kinds["clean"][:30]:
        add(docs[d][1], "copy")
        near = docs[d][1].split()
        near[rng.randrange(10, 140)] = "changed"
        add(" ".join(near), "near")
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs + [(5000, None, None, None, None), (5001, "", "en", "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), kinds


def test_stages(spark, folder):
    path, kinds = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, path), name)
        if name != "sharding":
            assert docs.columns == COLUMNS
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name == "decontamination":
            before_mix = docs
    toxic, dedup, leaks, mix, shards = seen
    rest = set(sum((v for k, v in kinds.items() if k != "toxic"), [])) | {5000, 5001}
    assert len(toxic & set(kinds["toxic"])) <= 2 and len(rest - toxic) <= 2
    # 5000 and 5001 are both blank: one of them stays
    assert not dedup & (set(kinds["copy"]) | set(kinds["near"]) | {5001}) and not (toxic & (set(kinds["clean"]) | set(kinds["leak"]) | {5000})) - dedup
    assert leaks == dedup - set(kinds["leak"])
    assert mix <= leaks and mix == shards
    assert docs.columns == ["doc_id", "source", "n_bytes", "shard", "shard_bytes", "shard_docs"]
    per_source = before_mix.groupBy("source").count().collect()
    assert {r.source for r in per_source} >= {"src0", "src1", "src2", "src3"}


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns[-3:] == ["shard", "shard_bytes", "shard_docs"] and out.count() > 100


def roots(rows, shingle=5, similarity=0.8):
    """The smallest position that each row is connected with."""
    sets = [set(simhash.shingle_hashes(t, shingle).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def edited(rng, words, base, edits):
    text = list(base)
    for _ in range(edits):
        text[rng.randrange(len(text))] = rng.choice(words)
    return " ".join(text)


def ids_kept(spark, rows):
    return sorted((r.doc_id for r in near_copies.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda d: (d is None, d))


def test_dedup_against_brute_force(spark):
    rng = random.Random(6)
    words, rows = [f"w{i}" for i in range(500)], []
    for _ in range(12):
        base = rng.choices(words, k=200)
        rows += [(len(rows) + i, edited(rng, words, base, rng.choice([0, 1, 2, 3, 12, 20]))) for i in range(6)]
    assert ids_kept(spark, rows + [(3, rows[3][1]), (None, "x"), (None, "x")]) == [i for i, r in enumerate(roots(rows)) if r == i] + [None]


@pytest.mark.parametrize("length", [5, 6, 8, 9, 12, 20])
def test_recall_of_short_texts(spark, length):
    """Links between texts of a few words, of which a pair at 0.8 shares 4 of 5 shingles."""
    rng = random.Random(length)
    words, rows = [f"w{i}" for i in range(4000)], []
    for i in range(300):
        base = rng.choices(words, k=length)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + [rng.choice(words)] * rng.choice([0, 1])))]
    want = {i for i, r in enumerate(roots(rows)) if r != i}
    found = set(range(600)) - set(ids_kept(spark, rows))
    assert found <= want and len(found) >= 0.97 * len(want)


def test_recall_near_the_threshold(spark):
    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(4000)], []
    for i in range(400):  # one run of other words: a similarity from 0.8 to 0.83
        base = rng.choices(words, k=204)
        other = base[:90] + rng.choices(words, k=15) + base[105:]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    want = {i for i, r in enumerate(roots(rows)) if r != i}
    found = set(range(800)) - set(ids_kept(spark, rows))
    assert len(want) > 350 and found <= want and len(found) >= 0.98 * len(want)


def test_hot_buckets_lose_nothing(spark, monkeypatch):
    """Many texts of one template, none similar but the copies of each; blocks and keys are made as for a large table."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    monkeypatch.setattr(near_copies, "HOT", 8)
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(5000)], []
    shared = rng.choices(words, k=160)
    for _ in range(70):
        own = rng.choices(words, k=60)
        rows += [(len(rows), " ".join(shared + own)), (len(rows) + 1, " ".join(shared + own[:55] + rng.choices(words, k=5)))]
    base = rng.choices(words, k=150)
    rows += [(len(rows) + i, edited(rng, words, base, rng.randint(0, 3))) for i in range(60)]
    want = [i for i, r in enumerate(roots(rows)) if r == i]
    got = ids_kept(spark, rows)
    assert set(want) <= set(got) and len(got) <= len(want) + 2


def test_rows_are_judged_by_their_text(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(900)]
    one, two, three = (" ".join(rng.choices(words, k=60)) for _ in range(3))
    rows = [(1, one), (1, two), (1, one), (2, two + " end"), (None, three), (None, three), (7, None), (8, ""), (9, " \n")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, row string, node int")
    out = near_copies.dedup(df)
    assert out.columns == df.columns
    assert sorted((tuple(r)[:2] for r in out.collect()), key=str) == sorted([(1, one), (1, two), (None, three), (7, None)], key=str)
    assert near_copies.dedup(df.limit(0)).collect() == []


def test_dedup_looks_past_false_neighbours(spark):
    """Copies in a template: many documents just under the threshold, one of them a copy of each true one."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    shared = rng.choices(words, k=348)
    rows, sets = [], []
    for _ in range(40):
        own = rng.choices(words, k=52)
        partner = list(own)
        partner[:38] = rng.choices(words, k=38)
        rows += [(len(rows), " ".join(shared + own)), (len(rows) + 1, " ".join(shared + partner))]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    alike = {(i, j) for i in range(80) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike == {(i + 1, i) for i in range(0, 80, 2)}
    got = {r.doc_id for r in near_copies.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(0, 80, 2)) <= got and len(got) <= 42  # the bit tables may miss a pair near 0.8


def test_dedup_keeps_texts_that_share_a_repeated_line(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for times in (60, 3000):
        line = rng.choices(words, k=20)
        for _ in range(3):
            rows.append((len(rows), " ".join(line * times + rng.choices(words, k=200))))
    rows += [(None, rows[0][1] + " more"), (6, rows[0][1] + " more words"), (7, rows[0][1] + " " + rows[0][1][:60])]
    got = sorted(r.doc_id for r in near_copies.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None)
    assert got == list(range(6))


def test_hot_buckets_link_pairs_that_share_one_key(spark, monkeypatch):
    """A link counts even if its only common bucket is a hot one."""
    monkeypatch.setattr(near_copies, "HOT", 4)
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    rows = [(i, " ".join(rng.choices(words, k=120))) for i in range(0, 40, 2)]
    rows += [(i + 1, text + " end") for i, text in rows]
    keys = near_copies.band_keys

    def one_shared_key(hashes):
        own = keys(hashes)
        own[0] = 17
        own[1:] = own[1:] * 1_000_003 + len(hashes)
        return own

    monkeypatch.setattr(near_copies, "band_keys", one_shared_key)
    assert ids_kept(spark, rows) == list(range(0, 40, 2))


def test_texts_just_under_the_threshold_make_no_row_per_pair(spark, monkeypatch):
    """A large group of which no two are similar, but for one pair that is not nearest: linear rows, and the pair is found."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(9000)]
    base = rng.choices(words, k=240)
    rows = [(i, " ".join(base[:200] + rng.choices(words, k=40))) for i in range(120)]
    rows.append((120, rows[7][1] + " end"))
    tested, similar = [], near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda *a: tested.append(a[4].count()) or similar(*a))
    assert ids_kept(spark, rows) == [i for i, r in enumerate(roots(rows)) if r == i]
    assert sum(tested) <= 14 * len(rows)


def test_shared_counts_agree_with_sets(monkeypatch):
    import numpy as np
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(-20_000, 20_000), rng.choice([0, 1, 50, 9000]))) for _ in range(30)]
    starts = np.r_[0, np.cumsum([len(s) for s in sets])]
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(30) for j in range(i)]))
    got = near_copies._shared(np.array([v for s in sets for v in s], np.int64), starts, a, b)
    assert got.tolist() == [len(set(sets[i]) & set(sets[j])) for i, j in zip(a, b)]


def test_units_split_by_shingles_link_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LOAD", 700)
    test_dedup_looks_past_false_neighbours(spark)


def test_stages_hand_small_batches_to_python(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: None)
    for module, name in ((corpus_pipeline.toxicity, "fit"), (corpus_pipeline.toxicity, "clean"), (corpus_pipeline.near_copies, "dedup"), (corpus_pipeline.decontaminate, "clean")):
        monkeypatch.setattr(module, name, lambda *a: seen.append(int(spark.conf.get(key))))
    for stage in (corpus_pipeline.reject_toxic, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_contaminated):
        stage(spark, None, "")
    assert seen == [1000] * 4 and spark.conf.get(key) == before
