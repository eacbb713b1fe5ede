"""Toxicity by gradient-boosted trees over dense features, isotonically calibrated.

The lexicons are learned from labelled texts: whole words and word beginnings
that stand mostly in toxic ones, each with its log odds.  Features are counts and densities of
lexicon hits, second-person words near hits, capitals, punctuation and
obfuscation.  Trees are fitted on one part of the labelled rows, the
calibration on another; held-out rows are used for neither.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BROADCAST_ROWS, slices, without

SAMPLE = 12_000  # labelled rows that a model is fitted on, at most
STEMS = range(3, 10)  # lengths of word beginnings that may enter the lexicon
SUPPORT = 6  # toxic texts that a lexicon entry must stand in, at least
PURITY = 0.5  # smoothed share of its texts that must be toxic
STRONG = 0.85  # share from which a hit counts by itself
ENTRIES = 4000  # lexicon entries of either kind, at most
NEAR = 6  # words between a hit and a second-person word
THRESHOLD = 0.3
# fixed values: second-person words of the four languages
YOU = set("you your yours yourself u ur du dich dir dein deine deiner euch ihr tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo tuya vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
FEATURES = ["hits", "stem_hits", "hit_density", "stem_density", "weight_density", "stem_weight", "stem_weight_density", "distinct_hits", "hidden_hits", "near_you", "you_density", "capital_share",
            "capital_words", "mark_density", "exclaim_density", "odd_share", "digit_words", "log_words"]
_WORDS = re.compile(r"[^\W\d_]+")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGIT = re.compile(r"\d")


def unhidden(raw: str) -> str:
    """Letters of a written-over word, such as ``1d!ot`` or ``i.d.i.o.t``."""
    return "".join(c for c in raw.lower().translate(LEET) if c.isalpha())


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """One value per entry of FEATURES, all 0 for an empty text."""
    text = text or ""
    tokens = _WORDS.findall(text.lower())
    n = max(1, len(tokens))
    words, stems, heads = lexicon.words, lexicon.stems, lexicon.heads
    at, strong, stem, weight, stem_weight = [], 0, 0, 0.0, 0.0
    for i, w in enumerate(tokens):
        if w in words:
            share, odds = words[w]
            at.append(i)
            strong += share >= STRONG
            weight += odds
        if w[:STEMS[0]] in heads:
            found = [stems[w[:k]] for k in STEMS if len(w) >= k and w[:k] in stems]
            if found:
                stem += max(found)[0] >= STRONG
                stem_weight += max(x[1] for x in found)
    you = [i for i, w in enumerate(tokens) if w in YOU]
    near, j = 0, 0
    for i in at:
        while j < len(you) and you[j] < i - NEAR:
            j += 1
        near += j < len(you) and you[j] <= i + NEAR
    raw = text.split()
    odd = [r for r in raw if not r.strip(".,;:!?()\"'").isalpha()]
    hidden = sum(words.get(unhidden(r), (0.0,))[0] >= STRONG for r in odd) if words else 0
    letters = sum(map(len, tokens)) or 1
    capitals = sum(map(len, _CAPITALS.findall(text)))
    marks = len(text) - sum(map(len, tokens)) - sum(map(text.count, (" ", "\n", "\t")))
    return [float(strong), float(stem), strong / n, stem / n, weight / n, stem_weight, stem_weight / n, float(len({tokens[i] for i in at})), float(hidden), float(near),
            len(you) / n, capitals / letters, sum(map(str.isupper, raw)) / max(1, len(raw)), marks / n, text.count("!") / n, len(odd) / max(1, len(raw)),
            sum(map(bool, map(_DIGIT.search, odd))) / max(1, len(raw)), float(np.log1p(len(tokens)))]


@dataclass(frozen=True)
class Lexicon:
    """Terms with the share of toxic texts among theirs and their log odds."""
    words: dict[str, tuple[float, float]]
    stems: dict[str, tuple[float, float]]

    @cached_property
    def heads(self) -> frozenset[str]:
        return frozenset(s[:STEMS[0]] for s in self.stems)


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4, F.lit(0)).cast("int")


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(id, part, text, label): at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
              .groupBy("id").agg(F.max("label").alias("label")).withColumn("part", fold("id")).filter("part <> 2"))
    chosen = marked.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), "id")  # bounded by ``sample``
    # copies of a text teach the same thing once
    return joined.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("part").alias("part"), F.max("label").alias("label"))


def _terms(rows: DataFrame) -> DataFrame:
    """(term, whole, good, bad): texts of either label that hold a word or a word beginning, if SUPPORT toxic ones do.

    Near copies would lend their rare words too much weight, so of the texts
    that share their smallest pair of neighbouring words only one counts.
    """
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for b in slices(batches, "text"):
            out = []
            for t in b.column("text"):
                tokens = _WORDS.findall(t.as_py().lower())
                out.append(min((xxhash.xxh64_intdigest(a + " " + c) >> 1 for a, c in zip(tokens, tokens[1:])), default=None))
            yield pa.record_batch([b.column("text"), b.column("label"), pa.array(out, pa.int64())], ["text", "label", "anchor"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in slices(batches, "text"):
            for t in b.column("text"):
                tokens = set(_WORDS.findall(t.as_py().lower()))
                seen.update((w, True) for w in tokens)
                seen.update({(w[:k], False) for w in tokens for k in STEMS if len(w) >= k})
            if len(seen) > 1 << 17:
                yield _counted(seen)
                seen.clear()
        if seen:
            yield _counted(seen)

    def counts(label: int) -> DataFrame:
        return single.filter(F.col("label") == label).select("text").mapInArrow(count, "term string, whole boolean, n long")

    single = rows.mapInArrow(anchors, "text string, label int, anchor long").groupBy("anchor", "label").agg(F.min("text").alias("text"))
    single = materialize(single, "single")
    # terms of clean texts matter only if toxic ones hold them often enough
    bad = materialize(counts(1).groupBy("term", "whole").agg(F.sum("n").alias("bad")).filter(F.col("bad") >= SUPPORT), "bad-terms")
    few = bad.count() <= BROADCAST_ROWS
    good = counts(0).join(F.broadcast(bad.select("term", "whole")) if few else bad.select("term", "whole"), ["term", "whole"], "left_semi")
    good = good.groupBy("term", "whole").agg(F.sum("n").alias("good"))
    return bad.join(good, ["term", "whole"], "left").withColumn("good", F.coalesce("good", F.lit(0)))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], ["term", "whole", "n"])


def lexicon(rows: DataFrame) -> Lexicon:
    """Words and word beginnings that stand mostly in toxic texts; at most ENTRIES of each reach the driver."""
    n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    share = F.col("bad") / (F.col("bad") + F.col("good") + 0.5)
    odds = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - float(np.log((toxic + 0.5) / (n - toxic + 0.5)))
    pure = _terms(rows).select("term", "whole", "bad", share.alias("share"), odds.alias("odds")).filter(F.col("share") >= PURITY)
    pure = materialize(pure, "lexicon")
    words, stems = ({r.term: (r.share, r.odds) for r in pure.filter(F.col("whole") == whole).orderBy(F.desc("bad"), "term").limit(ENTRIES).collect()}
                    for whole in (True, False))
    return Lexicon(words, stems)


def featured(rows: DataFrame, terms: Lexicon, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` with an array ``x`` of features of ``text``."""
    kinds = ", ".join(f"`{c}` {rows.select(c).schema[0].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = [features(t.as_py(), terms) for t in b.column("text")]
            yield pa.record_batch([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return rows.select(*keep, "text").mapInArrow(run, f"{kinds}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from labelled rows outside the held-out fold.

    Without rows of both labels there are no trees, and the score of every
    text is the share of toxic rows, 0 if there are none.
    """
    rows = materialize(_sample(docs, labels, id_col, text_col, label_col, sample), "labelled")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = bad / n if n else 0.0
    if not 0 < bad < n:
        return Model(Lexicon({}, {}), None, None, prior)
    terms = lexicon(rows)
    x = materialize(featured(rows, terms, ["part", "label"]), "features").withColumn("features", array_to_vector("x"))
    fitted, spare = x.filter("part <> 3"), x.filter("part = 3")
    if fitted.agg(F.count_distinct("label")).first()[0] < 2 or spare.agg(F.count_distinct("label")).first()[0] < 2:
        fitted = spare = x  # too few rows to part them
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, maxBins=32, seed=17, minInstancesPerNode=5).fit(fitted)
    raw = trees.transform(spare).select(F.col("label").cast("double").alias("label"), vector_to_array("probability")[1].alias("p"))
    calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(raw)
    return Model(terms, trees, calibration, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; a null text is scored as an empty one, repeated rows each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model.trees is None:
        scored = rows.select("doc_id", F.lit(model.prior).alias("score"))
    else:
        x = featured(rows, model.lexicon, ["doc_id"]).withColumn("features", array_to_vector("x"))
        p = model.trees.transform(x).select("doc_id", vector_to_array("probability")[1].alias("p"))
        scored = model.calibration.transform(p).select("doc_id", F.col("prediction").alias("score"))
    return scored.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, columns unchanged; documents without an id stay."""
    bad = score(docs, model, id_col, text_col, threshold).filter("predicted = 1 and doc_id is not null").select("doc_id")
    return without(docs, materialize(bad.distinct(), "toxic"), id_col)
