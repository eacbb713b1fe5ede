"""The round-based dedup equals the sequential rule, row by row."""

import random

from gleaner.functions.vocab import STOP_WORDS
from gleaner.operators import dedup, titles

SCHEMA = "seq bigint, category string, name string, application_link string, known boolean"


def words(name):
    return frozenset(w for w in name.lower().split() if w not in STOP_WORDS)


def similar(a, b):
    return bool(a) and bool(b) and len(a & b) / len(a | b) >= 0.85


def fold_titles(rows):
    kept = [(r[1], words(r[2]), -1) for r in rows if r[4]]
    out = {}
    for seq, cat, name, _, known in sorted(rows):
        if known:
            continue
        w = words(name)
        hits = [] if len(name) < 5 else [s for c, k, s in kept if c == cat and similar(k, w)]
        if hits:
            out[seq] = min(hits)
        elif w:
            kept.append((cat, w, seq))
    return out


def fold_keys(rows):
    names = {(r[1], r[2]) for r in rows if r[4]}
    links = {(r[1], r[3]) for r in rows if r[4]}
    kept = set()
    for seq, cat, name, link, known in sorted(rows):
        if known or (len(name) > 4 and (cat, name) in names) or (len(link) > 10 and (cat, link) in links):
            continue
        kept.add(seq)
        names.add((cat, name))
        links.add((cat, link))
    return kept


def random_titles(rng, groups=160):
    rows, seq = [], 0
    for g in range(groups):
        vocab = [f"w{i}" + "x" * (i % 5) for i in range(rng.choice([3, 8, 12, 24]))] + ["the", "of"]
        base = rng.sample(vocab, min(len(vocab), rng.choice([1, 2, 5, 7, 8, 13, 14, 16, 20])))
        for _ in range(rng.randint(2, 14)):
            title = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if rng.random() < 0.5 and len(title) > 1:
                    title.pop(rng.randrange(len(title)))
                else:
                    title.append(rng.choice(vocab))
            rng.shuffle(title)
            rows.append((seq, f"g{g}", " ".join(title), "", rng.random() < 0.15))
            seq += 1
    rng.shuffle(rows)
    return rows


def check_titles(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["seq"]: r["kept"] for r in titles.title_matches(df.where("known"), df.where("not known")).collect()}
    assert got == fold_titles(rows)


def test_titles_equal_sequential_fold(spark):
    check_titles(spark, random_titles(random.Random(7)))


def test_template_titles_in_one_group(spark):
    """One hot group: copies, near copies and one-word variants."""
    rng = random.Random(3)
    base = [f"word{i}" for i in range(15)]
    rows = []
    for i in range(240):
        n = rng.choice([6, 7, 7, 8, 13, 14, 15])
        title = base[:n]
        if rng.random() < 0.6:
            title[rng.randrange(n)] = f"city{rng.randrange(6)}"
        rows.append((i, "one", " ".join(title), "", False))
    check_titles(spark, rows)


def test_long_titles_equal_sequential_fold(spark):
    """Titles of up to 150 words, some of them near the threshold."""
    rng, rows = random.Random(21), []
    for g in range(12):
        base = [f"t{g}w{i}" for i in range(rng.choice([18, 24, 40, 90, 150]))]
        for _ in range(10):
            title = list(base)
            for _ in range(rng.randint(0, max(2, len(base) // 9))):
                title[rng.randrange(len(title))] = f"z{rng.randrange(10 ** 6)}"
            rows.append((len(rows), "c", " ".join(title), "", rng.random() < 0.1))
    check_titles(spark, rows)


def test_small_groups_take_several_rounds(spark, monkeypatch):
    """The paths for large keys, with the sizes turned down."""
    monkeypatch.setattr(titles, "GROUP", 3)
    monkeypatch.setattr(titles, "WORDS", 2)
    check_titles(spark, random_titles(random.Random(5), 25))


def test_template_that_is_not_similar_needs_few_rounds(spark, monkeypatch):
    """10,000 titles share 20 words and have 6 of their own: none waits for another."""
    rounds, decide = [], titles._decide
    monkeypatch.setattr(titles, "_decide", lambda *a: rounds.append(1) or decide(*a))
    shared = " ".join(f"shared{i}" for i in range(20))
    rows = [(i, "c", shared + "".join(f" own{i}x{k}" for k in range(6)), "", False) for i in range(10_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert titles.title_matches(None, df).count() == 0
    assert len(rounds) <= 10


def test_long_template_needs_few_claims(spark, monkeypatch):
    """10,000 titles share 200 words and have 20 rare ones of their own: they don't meet on the template."""
    rounds, claims, decide, part = [], [], titles._decide, titles._by_length

    def counted(*a):
        out = part(*a)
        claims.append(out.count())
        return out

    monkeypatch.setattr(titles, "_decide", lambda *a: rounds.append(1) or decide(*a))
    monkeypatch.setattr(titles, "_by_length", counted)
    shared = " ".join(f"template{i}" for i in range(200))
    rows = [(i, "one", f"{shared} " + " ".join(f"own{i}x{j}" for j in range(20)), "", False) for i in range(10_000)]
    assert titles.title_matches(None, spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert len(rounds) <= 2 and sum(claims) <= 1000


def test_template_with_frequent_own_words_equals_the_fold(spark, monkeypatch):
    monkeypatch.setattr(titles, "GROUP", 6)
    rng, rows = random.Random(11), []
    shared = [f"t{i}" for i in range(40)]
    for i in range(150):
        n = rng.choice([4, 7, 8, 9, 12])
        rows.append((i, "one", " ".join(shared[:rng.choice([38, 39, 40])] + rng.sample([f"own{j}" for j in range(60)], n)), "", i % 9 == 0))
    check_titles(spark, rows)


def test_large_group_of_near_copies_needs_few_rounds(spark, monkeypatch):
    rounds, decide = [], titles._decide
    monkeypatch.setattr(titles, "_decide", lambda *a: rounds.append(1) or decide(*a))
    shared = " ".join(f"shared{i}" for i in range(30))
    rows = [(i, "c", shared + f" own{i}", "", False) for i in range(3000)]
    got = {r.seq: r.kept for r in titles.title_matches(None, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: 0 for i in range(1, 3000)}
    assert len(rounds) <= 3


def test_keys_equal_sequential_fold(spark, monkeypatch):
    """Names and links, with the hot-key path forced on."""
    monkeypatch.setattr(dedup, "HOT_ROWS", 3)
    monkeypatch.setattr(dedup, "MAX_HOT_KEYS", 10 ** 9)
    rng = random.Random(11)
    rows, seq = [], 0
    for g in range(150):
        for _ in range(rng.randint(2, 20)):
            name = rng.choice(["", "abcd", "alpha", "bravo", "charlie", "delta", "echo five"])
            link = rng.choice(["", "short", "https://a.io/1", "https://a.io/2", "https://a.io/3", "https://a.io/4"])
            rows.append((seq, f"g{g}", name, link, rng.random() < 0.1))
            seq += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["seq"] for r in dedup.merge_dedup(df.where("known"), df.where("not known")).select("seq").collect()}
    assert got == fold_keys(rows)


def test_chain_keeps_first_and_third(spark):
    """A suppresses B by name, so B's link is never recorded and C stays."""
    rows = [(1, "c", "name one", "https://x.io/111", False), (2, "c", "name one", "https://x.io/222", False),
            (3, "c", "name three", "https://x.io/222", False)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r["seq"] for r in dedup.merge_dedup(df.where("known"), df).orderBy("seq").collect()]
    assert got == [1, 3]


def test_long_chain_needs_few_rounds(spark, monkeypatch):
    """10,000 records, each sharing its name with one neighbour and its link with the other."""
    rounds, one = [], dedup._round
    monkeypatch.setattr(dedup, "_round", lambda live: rounds.append(1) or one(live))
    rows = [(i, "c", f"name number {i // 2}", f"https://link.example.org/{(i + 1) // 2}") for i in range(10_000)]
    df = spark.createDataFrame(rows, "seq bigint, category string, name string, application_link string")
    got = sorted(r.seq for r in dedup.merge_dedup(df.limit(0), df).collect())
    names, links, want = set(), set(), []
    for i, _, n, u in rows:
        if n not in names and u not in links:
            names.add(n)
            links.add(u)
            want.append(i)
    assert got == want and len(rounds) <= 10


def test_large_components_go_on_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FOLD", 12)
    rng = random.Random(8)
    rows = [(i, "c", f"name number {rng.randrange(60)}", f"https://link.example.org/{rng.randrange(60)}") for i in range(150)]
    rows += [(200 + i, "c", f"chain name {i // 2}", f"https://chain.example.org/{(i + 1) // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "seq bigint, category string, name string, application_link string")
    got = sorted(r.seq for r in dedup.merge_dedup(df.limit(0), df).collect())
    names, links, want = set(), set(), []
    for i, _, n, u in rows:
        if n not in names and u not in links:
            names.add(n)
            links.add(u)
            want.append(i)
    assert got == want


def test_key_index_stands_for_the_records(spark):
    import uuid

    from gleaner.session import shared_dir
    rng = random.Random(4)
    schema = "seq bigint, category string, name string, application_link string"
    make = lambda k, n: spark.createDataFrame([(k + i, rng.choice("ab"), f"name number {rng.randrange(80)}", f"https://link.example.org/{rng.randrange(300)}") for i in range(n)], schema)
    old, new = make(0, 60), make(1000, 120)
    index = dedup.KeyIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", buckets=8)
    index.add(old)
    want = sorted(r.seq for r in dedup.merge_dedup(old, new).collect())
    out = dedup.merge_dedup(None, new, index)
    assert sorted(r.seq for r in out.collect()) == want and 0 < len(want) < 120


def test_unlike_titles_of_common_words_are_not_compared(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(300)]
    rows = [(i, "c", " ".join(rng.sample(vocab, 60)), "", i % 3 == 0) for i in range(300)]
    rows += [(300 + i, "c", rows[i][2] + " extra", "", False) for i in range(30)]
    compared, verified = [], titles._verified
    monkeypatch.setattr(titles, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.seq: r.kept for r in titles.fuzzy_pairs(df.where("known"), df.where("not known")).collect()}
    assert got == fold_titles(rows)
    assert sum(compared) < 3 * len(rows)


def test_similar_sets_share_a_part():
    import numpy as np
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 85, 100, 340, 400, 1000]:
        for _ in range(8):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop = int(rng.integers(0, n // 6 + 1))
            add = int(rng.integers(0, n // 6 + 1))
            b = np.r_[a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]
            if (n - drop) / (n + add) >= 0.85:
                assert np.intersect1d(titles.part_keys(a, 7, 0.85), titles.part_keys(b, 7, 0.85)).size


def test_one_set_of_several_kinds(spark):
    """An existing title, a short one and longer spellings of one word set, far from all others."""
    rows = [(5, "c", "AI", "", False), (7, "c", "ai the AI", "", False), (9, "c", "AI of ai", "", False),
            (4, "d", "ML the ml", "", True), (6, "d", "ml of ML", "", False), (8, "c", "nothing like it", "", False)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = {r["seq"]: r["kept"] for r in titles.title_matches(df.where("known"), df.where("not known")).collect()}
    assert got == {7: 5, 9: 5, 6: -1}


def test_unlike_titles_become_no_rows(spark, monkeypatch):
    """Of 400 long titles two are similar: only keys that several sets hold are rows."""
    rng, claims, contested = random.Random(17), [], titles._contested
    monkeypatch.setattr(titles, "_contested", lambda c: claims.append(c.count()) or contested(c))
    rows = [(i, "c", " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(200)), "", False) for i in range(400)]
    rows.append((400, "c", rows[3][2] + " more", "", False))
    got = {r["seq"]: r["kept"] for r in titles.title_matches(None, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {400: 3}
    assert claims[0] < 2000   # 29,000 keys


def test_copies_in_many_tasks(spark):
    """Rows of one set stand for it in every task."""
    rows = [(i, "c", f"one title of group {i % 7} number {i % 7}", "", i % 50 == 49) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    got = {r["seq"]: r["kept"] for r in titles.title_matches(df.where("known"), df.where("not known")).collect()}
    assert got == fold_titles(rows)
