"""Phrase mining against plain counting, and the guarantee of the summaries."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gleaner.llm import phrases
from gleaner.llm.bloom import build


def brute(rows, least, longest=5, top=None, absorb=100):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(100 * b >= absorb * a for (other, q), b in found.items() if other == lang and len(q) > len(p)
               and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    rows = []
    for lang in {r[0] for r in out}:
        ordered = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode("utf-8")))
        rows += [(lang, i + 1, *r[1:]) for i, r in enumerate(ordered[:top])]
    return sorted(rows)


ROWS = [("en", "The cat sat, the cat sat. The cat ran!\nThe\tcat sat"), ("en", "the CAT  sat on the mat; the cat"), (None, "a a a a a, a a"), ("en", None), ("en", ""),
        ("de", "Äpfel Äpfel äpfel. äpfel"), ("en", "the cat sat on the mat; the cat"), ("en", "the cat sat on the mat; the cat"), ("de", "x.y.z ,,, ;"),
        ("fr", " nbsp word\x1cin one   wide"), ("fr", " nbsp word\x1cin one   wide")]


@pytest.mark.parametrize("least, top, absorb", [(2, None, 100), (2, 3, 100), (1, 5, 100), (3, None, 50), (50, None, 100)])
def test_equals_plain_counting(spark, least, top, absorb):
    docs = spark.createDataFrame([(i, lang, t, 1) for i, (lang, t) in enumerate(ROWS)], "n long, lang string, text string, score int")
    got = phrases.collocations(docs, least=least, top=top, absorb=absorb)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(ROWS, least, top=top, absorb=absorb)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    text = "one two three four. " * 400
    monkeypatch.setattr(phrases, "CHUNK", 64)
    assert [w for part in phrases.tokens(text) for w in part] == [w for _ in range(400) for w in (b"one", b"two", b"three", b"four", b"\xff")]
    got = phrases.collocations(spark.createDataFrame([("en", text)], "lang string, text string"), least=100).collect()
    assert [(r.phrase, r.a) for r in got] == [("one two three four", 400)]


def test_scores_beyond_64_bits(spark):
    a = 3_000_000_000_000
    row = spark.sql(f"select (cast(1000 as decimal(4,0)) * cast({a} as decimal(19,0)) * cast({5 * a} as decimal(19,0))) div (cast({2 * a} as decimal(19,0)) * cast({a + 1} as decimal(19,0))) as s").first()
    assert row.s == 1000 * a * 5 * a // (2 * a * (a + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 6)), max_size=60), max_size=12), st.integers(2, 30), st.integers(1, 8))
def test_summary_keeps_every_frequent_key(batches, threshold, capacity):
    s, true = phrases.Summary(threshold, capacity), Counter()
    for batch in batches:
        for k, c in batch:
            true[k] += c
        s.add(np.array([k for k, _ in batch], np.uint64), np.array([c for _, c in batch], np.int64))
        s.merge()
        assert len(s.keys) <= s.capacity and s.error < threshold
    assert {k for k, c in true.items() if c >= threshold} <= set(s.survivors().tolist())
    held = dict(zip(s.keys.tolist(), s.counts.tolist()))
    assert all(held.get(k, 0) <= c <= held.get(k, 0) + s.error for k, c in true.items())


def test_windows_that_share_a_hash_are_told_apart():
    ids = np.array([1, 2, 0, 3, 4, 0, 1, 2, 0, 3, 4, 0, 3, 4], np.int32)
    starts = np.array([0, 3, 6, 9, 12])
    assert phrases.counted(ids, 2, starts, np.full(5, 7, np.uint64)) == {(1, 2): 2, (3, 4): 3}


def test_bloom_holds_what_was_put_in(spark):
    keys = [(-(2 ** 63),), (2 ** 63 - 1,), (0,), (-1,), (123456789,)]
    bloom = build(spark.createDataFrame(keys, "key long"), 5)
    assert bloom.holds(np.array([k for k, in keys], np.int64).view(np.uint64)).all()
    assert all(bloom.has(k % (1 << 64)) for k, in keys)
    others = np.random.default_rng(1).integers(0, 2 ** 63, 5000).astype(np.uint64)
    assert bloom.holds(others).mean() < 0.01
    assert [bloom.has(int(k)) for k in others[:200]] == bloom.holds(others[:200]).tolist()
