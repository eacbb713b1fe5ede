"""Language identification by word-first backoff.

A known word scores its log frequency in each language.  An unseen word falls
back to its longest known character n-grams: those of the longest size of which
any is known are averaged, and if none is, the next shorter size is tried.  A
language without a word or n-gram that another one has gets a fixed penalty.
The mean over all words of a text decides (after the HeLI method).

Words and n-grams are counted over all learnable documents; the scoring model
keeps the most frequent ones of each language, a documented bound, so it can be
broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices
from .toxicity import fold

WORDS = 200_000     # words of the model, all languages together, at most
GRAMS = 200_000     # n-grams of the model, all languages and sizes together, at most
LONGEST = 5         # longest n-gram; a word's ends count as a character
UNKNOWN = "und"
SEEN = 1 << 18      # counters a task holds
CHUNK = 1 << 20     # characters of a text that are looked at in one go
LONG = 64           # characters of a piece that is remembered whole
CACHE_BYTES = 48 << 20
SALTS = 32
_RUNS = re.compile(r"[^\W\d_]+")


def runs(piece: str) -> list[str]:
    """The runs of letters in a lower-cased piece."""
    if piece.isalpha():
        return [piece]
    # some digits, such as fractions and roman numerals, are not digits to a pattern
    return [r for run in _RUNS.findall(piece) for r in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def pieces(text: str | None) -> Iterator[list[str]]:
    """A whole text between white space, lower-cased, a list per stretch; long pieces come as their words."""
    at = 0
    while text and at < len(text):
        to = len(text) if len(text) - at <= CHUNK else (text.find(" ", at + CHUNK) + 1 or len(text))
        parts = text[at:to].lower().split()
        if max(map(len, parts), default=0) > LONG:
            parts = [q for p in parts for q in ([p] if len(p) <= LONG else runs(p))]
        yield parts
        at = to


def words_of(counted: Counter) -> Counter:
    """The words of counted pieces."""
    out: Counter = Counter()
    for piece, n in counted.items():
        for word in runs(piece):
            out[word] += n
    return out


def words(text: str | None) -> Counter:
    """The words of a whole text: runs of letters, lower-cased."""
    out: Counter = Counter()
    for parts in pieces(text):
        out.update(parts)
    return words_of(out)


def grams(word: str, size: int) -> list[str]:
    """The n-grams of a word with a blank at both ends; none of the blank alone."""
    padded = f" {word} "
    return list(word) if size == 1 else [padded[i:i + size] for i in range(len(padded) - size + 1)]


@dataclass(frozen=True)
class Model:
    """Languages in order; for each known word or n-gram its languages' numbers and scores: log frequencies less the penalty."""
    languages: tuple[str, ...]
    prior: tuple[float, ...]
    penalty: float
    words: dict[str, tuple[tuple[int, float], ...]]
    grams: dict[str, tuple[tuple[int, float], ...]]


class Scorer:
    """Scores of pieces between white space, remembered in a table of bounded size.

    A row has the sums of its words' scores by language, the number of words
    with a score and the number of words.
    """

    def __init__(self, model: Model):
        self.model, self.count = model, len(model.languages)
        self.most = max(1 << 10, CACHE_BYTES // (8 * self.count + 116))
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 10, self.count + 2))

    def of(self, word: str) -> list[float] | None:
        """Scores by language; None if not even a character is known."""
        entries = self.model.words.get(word)
        out = [0.0] * self.count
        if entries is not None:
            for lang, value in entries:
                out[lang] = value
            return out
        known = self.model.grams
        for size in range(LONGEST, 0, -1):
            n = 0
            for g in grams(word, size):
                if g in known:
                    n += 1
                    for lang, value in known[g]:
                        out[lang] += value
            if n:
                return [x / n for x in out]
        return None

    def _learn(self, piece: str) -> None:
        """Remember the piece, and its words if it isn't one."""
        row = np.zeros(self.count + 2)
        for word in runs(piece):
            if word != piece:
                if word not in self.place:
                    self._learn(word)
                row += self.table[self.place[word]]
                continue
            found = self.of(word)
            row[-1] = 1
            if found is not None:
                row[:-2], row[-2] = found, 1
        n = len(self.place)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = row
        self.place[piece] = n

    def _sums(self, some: dict[str, int]) -> np.ndarray:
        """The weighted sum of the pieces' rows."""
        if len(self.place) + len(some) > 2 * self.most:
            self._forget()
        for piece in some:
            if piece not in self.place:
                self._learn(piece)
        rows = np.fromiter(map(self.place.__getitem__, some), np.int64, len(some))
        return np.fromiter(some.values(), np.float64, len(some)) @ self.table[rows]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is a tempered posterior of the language, from 0 to 1."""
        model = self.model
        counts: Counter = Counter()
        for parts in pieces(text):
            counts.update(parts)
        total = np.zeros(self.count + 2)
        if len(counts) <= self.most:
            total += self._sums(counts)
        else:
            items = list(counts.items())
            for at in range(0, len(items), self.most):
                total += self._sums(dict(items[at:at + self.most]))
        n = total[-2]
        if not total[-1] or not model.languages:
            return UNKNOWN, 0.0
        if not n:
            best = max(range(self.count), key=lambda i: (model.prior[i], -i))
            return model.languages[best], model.prior[best]
        mean = total[:-2] / n
        best = int(mean.argmax())  # ties go to the language that comes first
        return model.languages[best], float(1.0 / np.exp((mean - mean[best]) * math.sqrt(n)).sum())


def _counts(learnable: DataFrame) -> DataFrame:
    """(lang, term, n): words of all learnable texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in slices(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                count = seen.setdefault(lang, Counter())
                for parts in pieces(text.as_py()):
                    count.update(parts)
                if sum(map(len, seen.values())) > SEEN:
                    yield _batch({k: words_of(c) for k, c in seen.items()})
                    seen.clear()
        yield _batch({k: words_of(c) for k, c in seen.items()})

    return learnable.mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _batch(seen: dict) -> pa.RecordBatch:
    """The counters as rows; they are emptied."""
    rows = [(lang, term, n) for lang, count in seen.items() for term, n in count.items()]
    seen.clear()
    return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                           ["lang", "term", "n"])


def _gram_counts(counted: DataFrame) -> DataFrame:
    """(lang, size, term, n): n-grams of all counted words, as often as the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[str, int]] = {}
        for b in batches:
            for lang, word, n in zip(b.column("lang").to_pylist(), b.column("term").to_pylist(), b.column("n").to_pylist()):
                count = seen.setdefault(lang, Counter())
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        count[g] += n
            if sum(map(len, seen.values())) > SEEN:
                yield _batch(seen)
        yield _batch(seen)

    found = counted.mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return found.select("lang", F.length("term").alias("size"), "term", "n")


def _most_frequent(counted: DataFrame, by: list[str], quota: int) -> DataFrame:
    """The ``quota`` most frequent terms of each group, of every salt of it first; ties to the smaller term."""
    order = [F.desc("n"), F.asc("term")]
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    for part in ([*by, "salt"], by):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("rank") <= quota)
    return salted.drop("salt", "rank")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_words: int = WORDS, most_grams: int = GRAMS) -> Model:
    """A model from the texts with a language outside the held-out fold; every such text counts, each repeated row too."""
    learnable = (docs.filter(F.col(lang_col).isNotNull() & (fold(id_col) != 2)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")))
    counted = materialize(_counts(learnable), "words")
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted(totals))
    if not languages:
        return Model((), (), 0.0, {}, {})
    number = {lang: i for i, lang in enumerate(languages)}
    kept = materialize(_most_frequent(counted, ["lang"], max(1, most_words // len(languages))), "known-words")
    parts = materialize(_gram_counts(counted), "n-grams")
    sizes = {(r.lang, r.size_): r.n for r in parts.groupBy("lang", F.col("size").alias("size_")).agg(F.sum("n").alias("n")).collect()}
    kept_parts = materialize(_most_frequent(parts, ["lang", "size"], max(1, most_grams // (len(languages) * LONGEST))), "known-n-grams")

    penalty = -math.log(2 * max([*totals.values(), *sizes.values()]))  # of a language without a word or n-gram; less than any it has

    def entries(rows: DataFrame, mass) -> dict[str, tuple[tuple[int, float], ...]]:
        grouped = rows.groupBy("term").agg(F.collect_list(F.struct("lang", "n")).alias("of")).toArrow()  # bounded by the quotas
        out = {}
        for term, of in zip(grouped.column("term").to_pylist(), grouped.column("of").to_pylist()):
            out[term] = tuple((number[x["lang"]], math.log(x["n"] / mass(x["lang"], len(term))) - penalty) for x in of)
        return out

    everything = sum(totals.values())
    return Model(languages, tuple(totals[x] / everything for x in languages), penalty,
                 entries(kept, lambda lang, _: totals[lang]), entries(kept_parts, lambda lang, size: sizes[lang, size]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row.

    ``und`` with score 0 where a text is null or has no letter, or where
    nothing was learned.  A text of unknown letters only gets the most frequent
    language.  Repeated rows stay; a null id is not held out; an empty table
    gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches, "text"):
            got = [scorer.predict(t.as_py()) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                                  ["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return (texts.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
            .select("doc_id", (fold("doc_id") == 2).alias("held_out"), "lang_pred", "score"))
