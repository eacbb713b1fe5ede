"""Spaced-seed decontamination against planted passages and brute force."""

import random
from itertools import combinations

import numpy as np

from gleaner.llm import decontaminate as dc

VOCABULARY = ["w%d" % i for i in range(4000)]


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, "s", 0) for d, t in docs], "doc_id long, text string, source string, key int"),
            spark.createDataFrame(items, "item_id long, text string"))


def words(rng, n):
    return rng.choices(VOCABULARY, k=n)


def corpus(seed=3):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, rng.randint(14, 50)))) for i in range(20)] + [(20, " ".join(words(rng, 7))), (21, "a short item"), (22, None), (None, "x " * 30)]
    items.append((99, items[4][1].upper()))  # the same tokens
    docs, dirty = [], set()
    for d in range(200):
        text = words(rng, rng.randint(0, 300))
        if d % 4 == 0:
            passage = items[rng.randrange(20)][1].split()
            if d % 8 == 0:  # about one token in ten substituted
                for i in range(5, len(passage), 10):
                    passage[i] = "zzz"
            at = rng.randint(0, len(text))
            text = text[:at] + [w.title() + "," for w in passage] + text[at:]
            dirty.add(d)
        elif d == 1:
            text += items[20][1].split()
            dirty.add(d)
        docs.append((d, " ".join(text)))
    return docs, items, dirty


def test_planted_passages_and_clean_documents(spark):
    docs, items, dirty = corpus()
    docs += [(1000, None), (1001, ""), (1002, "holds: a SHORT item, a short item."), (1004, "a short, other item"), (None, items[0][1]), (1003, "w1 " * 50000 + items[1][1])]
    d, b = frames(spark, docs, items)
    rows = dc.report(d, b).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id for r in rows if r.contaminated} == dirty | {None, 1002, 1003}
    for r in rows:
        assert (r.n_items > 0) == r.contaminated == (r.item_id is not None) == (r.overlap > 0)
        assert not r.contaminated or r.identity >= dc.IDENTITY
    kept = dc.clean(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - dirty - {None, 1002, 1003}


def test_equal_items_count_once(spark):
    text = " ".join(VOCABULARY[:20])
    d, b = frames(spark, [(1, text), (1, text)], [(8, text), (3, text.upper()), (5, "- " + text)])
    assert [(r.n_items, r.item_id, r.overlap, r.identity) for r in dc.report(d, b).collect()] == [(1, 3, 20, 1.0)] * 2


def test_empty_tables(spark):
    d, b = frames(spark, [(1, "a b c d e f")], [])
    assert [tuple(r) for r in dc.report(d, b).collect()] == [(1, False, 0, None, 0, None)]
    d, b = frames(spark, [], [(1, "a b c d e f")])
    assert dc.report(d, b).collect() == []


def test_token_hashes_do_not_depend_on_chunks(monkeypatch):
    text = "ab, cd-EF 9é\nx " * 50
    whole, starts = dc.token_hashes(dc.encoded(text))
    monkeypatch.setattr(dc, "_CHUNK", 32)
    parts, starts2 = dc.token_hashes(dc.encoded(text))
    assert (whole == parts).all() and (starts == starts2).all() and len(set(whole.tolist())) == 5


def test_best_run_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, doc = rng.integers(0, 3, 12), rng.integers(0, 3, 20)
        x = int(rng.integers(-11, 19))
        pairs = [(i + x, i) for i in range(12) if 0 <= i + x < 20]
        best = max((sum(0.2 if doc[a] == item[b] else -0.8 for a, b in pairs[i:j]) for i in range(len(pairs)) for j in range(i, len(pairs) + 1)), default=0)
        n, equal = dc.best_run(doc, item, x)
        assert abs(0.2 * equal - 0.8 * (n - equal) - best) < 1e-9


def test_longest_run_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, doc = rng.integers(0, 2, 14), rng.integers(0, 2, 20)
        x = int(rng.integers(-13, 19))
        same = [int(doc[i + x] == item[i]) for i in range(14) if 0 <= i + x < 20]
        runs = [(j - i, sum(same[i:j])) for i in range(len(same)) for j in range(i, len(same) + 1) if 5 * sum(same[i:j]) >= 4 * (j - i)]
        assert dc.longest_run(doc, item, x) == max(runs, default=(0, 0))


def test_substitutions_at_all_positions(spark):
    rng = random.Random(8)
    items = [(1, " ".join(words(rng, 14))), (2, " ".join(words(rng, 50)))]
    docs = []
    for i in range(14):
        text = items[0][1].split()
        text[i] = "zzz"
        docs.append((i, " ".join(["before", *text, "after"])))
    docs += [(100 + i, " ".join("zzz" if k % 5 == i else w for k, w in enumerate(items[1][1].split()))) for i in range(5)]
    d, b = frames(spark, docs, items)
    rows = dc.report(d, b).collect()
    assert all(r.contaminated and r.identity >= dc.IDENTITY for r in rows)
    assert {(r.doc_id, r.overlap) for r in rows if r.doc_id >= 100} == {(100 + i, 50) for i in range(5)}


def test_masks_hit_every_run_that_counts():
    for n, spare in ((12, 2), (15, 3), (20, 4)):
        for gone in map(set, combinations(range(n), spare)):
            assert any(not gone & {at + p for p in m} for m in dc.MASKS for at in range(n - m[-1]))
    for n in range(dc.LEAST, dc.OVERLAP):
        assert all(any(not set(gone) & set(m) for m in dc.short_masks(n)) for gone in combinations(range(n), n // 5))


def test_short_items_null_ids_and_repeats(spark):
    rng = random.Random(9)
    items = [(n, " ".join(words(rng, n))) for n in range(5, 13)] + [(None, " ".join(words(rng, 20)))]
    twice = words(rng, 6)
    items.append((50, " ".join(twice + words(rng, 9) + twice + words(rng, 9))))
    docs, want = [], {}
    for n, text in items[:8]:
        for gone in combinations(range(n), n // 5):
            docs.append((len(docs), " ".join(["a", *("zzz" if k in gone else w for k, w in enumerate(text.split())), "b"])))
            want[len(docs) - 1] = (True, n)
    docs.append((len(docs), items[8][1]))
    want[len(docs) - 1] = (True, None)
    tail = items[9][1].split()[15:]
    docs.append((len(docs), " ".join(w if k < 6 or k % 5 else "zzz" for k, w in enumerate(tail))))  # after the repeat every fifth word changed
    want[len(docs) - 1] = (True, 50)
    d, b = frames(spark, docs, items)
    assert {r.doc_id: (r.contaminated, r.item_id) for r in dc.report(d, b).collect()} == want
    assert dc.clean(d, b).count() == 0


def test_items_under_five_tokens(spark):
    items = [(1, "Zebra"), (2, "blue moon"), (3, "one two three four"), (4, "?!"), (5, "")]
    docs = [(1, "zebra " * 3000), (2, "a zebra, once"), (3, "blue Moon"), (4, "blue the moon"), (5, "zero one two three four five"), (6, "one two three"), (7, "?!")]
    d, b = frames(spark, docs, items)
    got = {r.doc_id: (r.contaminated, r.item_id, r.overlap) for r in dc.report(d, b).collect()}
    clean = (False, None, 0)
    assert got == {1: (True, 1, 1), 2: (True, 1, 1), 3: (True, 2, 2), 4: clean, 5: (True, 3, 4), 6: clean, 7: clean}
    named = d.toDF("doc_id", "text", "__key", "key")
    kept = dc.clean(named, b)
    assert kept.columns == named.columns and {r.doc_id for r in kept.collect()} == {4, 6, 7}


def test_only_the_aligned_piece_is_compared(spark, monkeypatch):
    real = dc.longest_run

    def bounded(doc, item, diagonal):
        assert len(doc) <= len(item)
        return real(doc, item, diagonal)

    monkeypatch.setattr(dc, "longest_run", bounded)
    item = " ".join(f"q{i}" for i in range(30))
    filler = " ".join(f"w{i}" for i in range(5000))
    docs = spark.createDataFrame([(1, f"{filler} {item} {filler}"), (2, item[30:]), (3, filler)], "doc_id long, text string")
    got = {r.doc_id: r.overlap for r in dc.report(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got[1] == 30 and got[2] >= 12 and got[3] == 0
