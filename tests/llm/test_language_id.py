"""Language identification: the backoff by hand, and held-out accuracy."""

import math
import os
import re
from collections import Counter

import pytest

from gleaner.llm import language_id
from gleaner.llm.toxicity import fold
from pyspark.sql import functions as F

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_words():
    assert language_id.words("The CAT's hat, x1y ½ a½b _z_ Ⅷ") == Counter({"the": 1, "cat": 1, "s": 1, "hat": 1, "x": 1, "y": 1, "a": 1, "b": 1, "z": 1})
    assert language_id.words(None) == language_id.words("") == language_id.words("12 34 --- ½ ²") == Counter()


def test_long_texts_are_read_whole(monkeypatch):
    text = "alpha beta gamma " * 50
    monkeypatch.setattr(language_id, "CHUNK", 20)
    assert language_id.words(text) == Counter({"alpha": 50, "beta": 50, "gamma": 50})


def test_long_pieces_come_as_their_words(monkeypatch):
    text = "one,two½three " + "漢字" * 9 + "-x"
    whole = language_id.words(text)
    monkeypatch.setattr(language_id, "LONG", 3)
    assert list(language_id.pieces(text)) == [["one", "two", "three", "漢字" * 9, "x"]]
    assert language_id.words(text) == whole == Counter({"one": 1, "two": 1, "three": 1, "漢字" * 9: 1, "x": 1})


def test_grams():
    assert language_id.grams("ab", 1) == ["a", "b"]
    assert language_id.grams("ab", 3) == [" ab", "ab "]
    assert language_id.grams("ab", 5) == []


def plain(model, text):
    """The rule in plain loops."""
    total, n = [0.0] * len(model.languages), 0
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        found = [dict(model.words[word])] if word in model.words else []
        size = language_id.LONGEST
        while not found and size:
            found = [dict(model.grams[g]) for g in language_id.grams(word, size) if g in model.grams]
            size -= 1
        if found:
            n += 1
            for i in range(len(total)):
                total[i] += sum(f.get(i, 0.0) for f in found) / len(found)
    mean = [t / n for t in total]
    best = mean.index(max(mean))
    return model.languages[best], 1 / sum(math.exp((m - mean[best]) * math.sqrt(n)) for m in mean)


def learned(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, held_out string")


# ids outside the held-out fold
IDS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]


def test_backoff_equals_plain_loops(spark):
    rows = [(i, t, lang, 1, "x") for i, (t, lang) in zip(IDS, [
        ("the cat and the dog", "en"), ("the house is the best", "en"), ("der hund und die katze", "de"), ("das haus ist das beste", "de"), ("le chat et le chien", "fr")] * 3)]
    docs = learned(spark, rows)
    model = language_id.fit(docs)
    assert model.languages == tuple(sorted({r.lang for r in docs.filter(fold("doc_id") != 2).collect()}))
    kept = [r for r in docs.filter(fold("doc_id") != 2).collect()]
    counts = Counter(w for r in kept if r.lang == "en" for w in r.text.split())
    en = model.languages.index("en")
    assert dict(model.words["the"])[en] == pytest.approx(math.log(counts["the"] / sum(counts.values())) - model.penalty)
    scorer = language_id.Scorer(model)
    for text in ("the hund", "katzen und hunde", "thedog", "zzz the", "chaton chiens", "house haus", "the y", "a"):
        got, want = scorer.predict(text), plain(model, text)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1])
    assert scorer.predict("катя") == (model.languages[max(range(len(model.prior)), key=lambda i: (model.prior[i], -i))], max(model.prior))
    small = language_id.Scorer(model)
    small.most = 2  # a table that starts over gives the same scores
    text = "katzen und hunde the house is"
    assert small.predict(text)[0] == scorer.predict(text)[0] and small.predict(text)[1] == pytest.approx(scorer.predict(text)[1])


def test_edges(spark):
    rows = [(1, "the cat", "en", 1, "x"), (3, "der hund", "de", 1, "x"), (4, None, "en", 1, "x"), (5, "", "de", 1, "x"), (None, "the dog", "en", 1, "x"),
            (6, "12 ½ !", "en", 1, "x"), (7, "the the", None, 1, "x"), (7, "the the", None, 1, "x")]
    docs = learned(spark, rows)
    out = language_id.predict(docs, language_id.fit(docs))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = sorted(((r.doc_id or -1), r.lang_pred) for r in out.collect())
    assert got == [(-1, "en"), (1, "en"), (3, "de"), (4, "und"), (5, "und"), (6, "und"), (7, "en"), (7, "en")]
    assert all(0 <= r.score <= 1 for r in out.collect()) and not [r for r in out.collect() if r.held_out is None]
    empty = docs.limit(0)
    model = language_id.fit(empty)
    assert language_id.predict(empty, model).collect() == []
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()} == {("und", 0.0)}


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "same words here", lang, 1, "x") for i, lang in zip(IDS[:8], ["b", "a"] * 4)]
    docs = learned(spark, rows)
    kept = docs.filter(fold("doc_id") != 2)
    if kept.filter("lang = 'a'").count() == kept.filter("lang = 'b'").count():
        assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs)).collect()} == {"a"}


def test_bounds_keep_the_most_frequent(spark):
    docs = learned(spark, [(1, "a a a b b c", "x", 1, "x"), (1, "d d e", "y", 1, "x")])
    model = language_id.fit(docs, most_words=4, most_grams=10 ** 6)
    assert set(model.words) == {"a", "b", "d", "e"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = language_id.predict(docs, language_id.fit(docs)).filter("held_out")
    right = out.join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
