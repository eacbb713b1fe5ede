"""Toxicity: learned lexicons, held-out accuracy, odd rows."""

import random

import pytest

from gleaner.llm import toxicity as tx

VOCABULARY = ["".join(p) for p in zip("bcdfghklmnprstvw" * 30, "aeiou" * 96, "lmnrst" * 80, "aeiou" * 96, "bdgknt" * 80)]
BAD = ["idjot", "scvmbag", "wretch"]


def corpus(n=500, seed=8):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        text, toxic = rng.choices(VOCABULARY, k=rng.randint(20, 120)), int(rng.random() < 0.25)
        for _ in range(rng.randint(2, 5) * toxic):
            word = rng.choice(BAD) if i % 2 else "zorqu" + rng.choice(VOCABULARY)
            text.insert(rng.randrange(len(text)), word)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    extra = [(10_000, None), (10_001, ""), (10_002, "plain " * 40000), (None, " ".join(VOCABULARY[:50])), (10_003, "idjot " * 30 + " ".join(VOCABULARY[:40])), (3, docs[3][1])]
    return (spark.createDataFrame([(d, t, "en", 0.5) for d, t in docs + extra], "doc_id long, text string, lang string, score double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels, len(docs) + len(extra))


@pytest.fixture(scope="module")
def model(frames):
    return tx.fit(*frames[:2])


def test_lexicon_holds_the_marking_terms(model):
    assert set(BAD) <= set(model.lexicon.words)
    assert any("zorqu".startswith(s) or s.startswith("zorqu") for s in model.lexicon.stems)
    assert all(share >= tx.PURITY for share, _ in model.lexicon.words.values())


def test_held_out_accuracy_and_shape(spark, frames, model):
    import zlib
    docs, labels = frames[0], {d: t for d, _, t in frames[3]}
    out = tx.score(docs, model).collect()
    assert len(out) == frames[4] and out[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert len(held) > 80 and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95
    assert next(r for r in out if r.doc_id == 10_003).predicted == 1
    assert not any(r.predicted for r in out if r.doc_id in (10_000, 10_001, 10_002))


def test_held_out_labels_do_not_matter(spark, frames, model):
    docs, labels = frames[0], frames[1]
    flipped = labels.withColumn("toxic", tx.F.when(tx.fold("doc_id") == 2, 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    again = tx.fit(docs, flipped)
    key = lambda m: sorted(tx.score(docs, m).select("doc_id", "score").collect(), key=str)
    assert again.lexicon == model.lexicon and key(again) == key(model)


def test_clean_drops_what_is_rejected(frames, model):
    docs = frames[0]
    bad = {r.doc_id for r in tx.score(docs, model).collect() if r.predicted and r.doc_id is not None}
    kept = tx.clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad


def test_labels_of_one_kind_and_empty_tables(spark, frames):
    docs, labels = frames[0], frames[1]
    assert {r.score for r in tx.score(docs, tx.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert {r.score for r in tx.score(docs, tx.fit(docs, labels.filter("toxic = 1"))).collect()} == {1.0}
    assert tx.score(docs.limit(0), tx.fit(docs, labels.limit(0))).collect() == []


def test_features_of_written_over_words():
    terms = tx.Lexicon({"idiot": (0.99, 5.0)}, {})
    x = dict(zip(tx.FEATURES, tx.features("YOU are an idiot! such 1d1ot, i.d.i.o.t. ok", terms)))
    assert x["hits"] == 1 and x["hidden_hits"] == 2 and x["near_you"] == 1 and x["capital_words"] > 0
    assert len(tx.features(None, terms)) == len(tx.FEATURES) and not any(tx.features("", terms))
