"""Token counts against the library on whole texts."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from gleaner.llm import tokens  # noqa: E402

NAME = "word_bpe_49k.json"
TRICKY = ["", " ", "Hello, World!", "don't we'll 'tis o'clock'", "a.b,c;;d!?", "x<|endoftext|>y <|startoftext|>.", "<|endoftext|>, <|endOFtext|>",
          "tab\tsep\r\nline\x0bvt\x0cff\x1cfs\x85nel ls　ideo\xa0nbsp", "É é ́ , ̸= 1234, 5.6,7", "ΣΑΣ, İstanbul. ẞ!", "日本語。 テスト、 ok", "a" * 5000 + " " + "!" * 3000,
          "word), (word). [x]... «été», 12, 'tword's, it's.", "\U0001f600, ab\U0001f600. 힣!", "\x00 \x01, a\x00.", "non breaking, thin space."]


@pytest.fixture(scope="module")
def model():
    return tokenizers.Tokenizer.from_file(public.path(NAME))


def exact(model, text):
    return len(model.encode(text or "", add_special_tokens=False).ids)


def test_tricky_texts(model):
    counter = tokens.lengths(NAME)
    for t in TRICKY:
        assert counter.count(t) == exact(model, t), repr(t)


def test_random_texts(model, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 40)
    rng, counter = random.Random(4), tokens.lengths(NAME)
    alphabet = "aAbB tT's'sdl.,;:!?\n\t 09-<|>é́Σİ"
    for _ in range(2000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        if rng.random() < 0.3:
            special = rng.choice(["<|endoftext|>", "<|startoftext|>"])
            t = "".join(rng.choice([c, c.upper()]) if rng.random() < 0.5 else c for c in special).join([t[:10], t[10:30], t[30:]])
        assert counter.count(t) == exact(model, t), repr(t)


def test_query_shape(spark, model):
    rows = [(1, "one two", "z"), (2, None, None), (None, "x, y.", "z"), (2, "x, y.", "z"), (3, "word, " * 40000, "z"), (4, "éé", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in tokens.count_tokens(df, NAME).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), exact(model, t), exact(model, t) > 2048) for i, t, _ in rows), key=str)
    assert got == want
    assert tokens.count_tokens(df.limit(0), NAME).collect() == []


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        tokens.lengths("piece_bpe_32k.model")
