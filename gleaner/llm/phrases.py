"""Phrase collocations by mergeable Misra-Gries summaries.

Only phrases of frequent words can be frequent, so words are counted first and
the others cut a text like a mark.  Tasks turn texts into arrays of word
numbers and hash all windows of a size at once.  Each task sums its windows and
deals them by hash to partitions; a partition merges them into one Misra-Gries
summary whose capacity exceeds its mass divided by the threshold, so that every
frequent phrase survives in bounded memory.  A further pass counts the
survivors exactly, by their words.  Pairs go first: longer windows need frequent
pairs throughout.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..session import materialize
from .bloom import Bloom, build
from .common import slices

LONGEST = 5
SLACK = 8          # capacity over mass / threshold: the error is an eighth of the threshold at most
PART = 1 << 19     # counters of a summary that are aimed at; more windows make more partitions
BUFFER = 1 << 20   # windows that a task holds before it sums them
CHUNK = 1 << 20    # bytes of a text that are cut into words at a time
VOCABULARY = 1 << 19  # words that a task remembers
HELD = 1 << 18     # phrases whose counts a task holds
ROW = 256          # counters in a row on the way to their partition, so that batches of rows stay small
SALTS = 32

# bytes of a text: A-Z lower-cased, a tab is a blank, a mark becomes 0xFF, which UTF-8 never holds
_BYTES = bytearray(range(256))
_BYTES[65:91] = range(97, 123)
_BYTES[9] = 32
for _mark in b".,;:!?\n\x0b\x0c\r":
    _BYTES[_mark] = 255
_BYTES = bytes(_BYTES)
_MARK = b"\xff"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text in order, ``_MARK`` where a piece ends; in lists of about CHUNK bytes."""
    data = text.encode("utf-8", "surrogatepass").translate(_BYTES) if text else b""
    at = 0
    while at < len(data):
        to = len(data) if len(data) - at <= CHUNK else (data.find(b" ", at + CHUNK) + 1 or len(data))
        yield data[at:to].replace(_MARK, b" \xff ").split()
        at = to


def word_key(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass")))


class Vocabulary(dict):
    """Word -> number, 0 for words that are not frequent and for marks; numbers follow the order of appearance."""

    def __init__(self, lang: str, frequent: Bloom):
        super().__init__({_MARK: 0})
        self.lang, self.frequent, self.words, self.keys = lang, frequent, [b""], [0]

    def __missing__(self, word: bytes) -> int:
        key = word_key(self.lang, word)
        number = 0
        if self.frequent.has(key):
            number = len(self.words)
            self.words.append(word)
            self.keys.append(key)
        self[word] = number
        return number


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(ids: np.ndarray, keys: np.ndarray, longest: int, pairs: Bloom | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first places, hashes) of all windows of 2 to ``longest`` words without a 0; with ``pairs``, of those whose pairs are there."""
    known = ids != 0
    starts = np.flatnonzero(known[:-1] & known[1:])
    hashes = _mixed(keys[ids[starts]] * _STEP + keys[ids[starts + 1]])
    if pairs is not None:
        kept = pairs.holds(hashes)
        starts, hashes = starts[kept], hashes[kept]
    yield 2, starts, hashes
    linked = np.zeros(len(ids) + longest, bool)
    linked[starts] = True
    for size in range(3, longest + 1):
        kept = linked[starts + size - 2]
        starts = starts[kept]
        hashes = _mixed(hashes[kept] * _STEP + keys[ids[starts + size - 1]])
        yield size, starts, hashes


def _numbered(batches: Iterator[pa.RecordBatch], frequent: Bloom) -> Iterator[tuple[str, np.ndarray, Vocabulary]]:
    """(language, word numbers, vocabulary) for about BUFFER words of a language at a time; texts are parted by zeros."""
    vocabularies: dict[str, Vocabulary] = {}
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    waiting = 0

    def done(lang: str) -> tuple[str, np.ndarray, Vocabulary]:
        vocabulary, ids = vocabularies[lang], np.concatenate(held.pop(lang))
        if sum(map(len, vocabularies.values())) > VOCABULARY:
            for unused in vocabularies.keys() - held.keys():
                del vocabularies[unused]
        return lang, ids, vocabulary

    for b in slices(batches, "text"):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            if lang not in vocabularies:
                vocabularies[lang] = Vocabulary(lang, frequent)
            number = vocabularies[lang].__getitem__
            parts = held.setdefault(lang, [])
            parts.append(np.zeros(1, np.int32))
            for words in tokens(text.as_py()):
                parts.append(np.fromiter(map(number, words), np.int32, len(words)))
                sizes[lang] = sizes.get(lang, 0) + len(words)
                waiting += len(words)
            if waiting >= BUFFER:
                largest = max(sizes, key=sizes.get)
                waiting -= sizes.pop(largest)
                yield done(largest)
    for lang in list(held):
        yield done(lang)


class Summary:
    """A Misra-Gries summary of weighted keys: a count is at most ``error`` too small, and ``error`` stays below the threshold.

    Merging adds the counters and, if more than the capacity are left,
    subtracts the largest count beyond it from all (Agarwal et al., 2012).
    The error is at most the mass divided by the capacity; should a partition
    get more mass than its capacity was made for, the capacity grows instead.
    """

    def __init__(self, threshold: int, capacity: int):
        self.threshold, self.capacity, self.error = threshold, capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._new.append((keys, counts))
        self._held += len(keys)
        if self._held >= max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self._new)])
        counts = np.concatenate([self.counts, *(c for _, c in self._new)])
        self._new, self._held = [], 0
        keys, counts = summed(keys, counts)
        while len(keys) > self.capacity:
            cut = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            if self.error + cut >= self.threshold:
                self.capacity *= 2
                continue
            self.error += cut
            kept = counts > cut
            keys, counts = keys[kept], counts[kept] - cut
        self.keys, self.counts = keys, counts

    def survivors(self) -> np.ndarray:
        """All keys that may have reached the threshold, every one that has among them."""
        self.merge()
        return self.keys[self.counts + self.error >= self.threshold]


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts (each 1 if not given)."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts, first)


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, n): words that occur ``least`` times, and a row without a word that has the number of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        total: Counter = Counter()

        def rows(lang: str) -> pa.RecordBatch:
            count = seen.pop(lang)
            words = [w.decode("utf-8", "replace") for w in count]
            return pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(list(count.values()), pa.int64())], ["lang", "word", "n"])

        for b in slices(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                count = seen.setdefault(lang, Counter())
                for words in tokens(text.as_py()):
                    marks = words.count(_MARK)
                    count.update(words)
                    del count[_MARK]
                    total[lang] += len(words) - marks
                if sum(map(len, seen.values())) > VOCABULARY // 2:
                    yield rows(max(seen, key=lambda x: len(seen[x])))
        for lang in list(seen):
            yield rows(lang)
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "n"])

    counted = docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("n") >= least) | F.col("word").isNull())


def survivors(docs: DataFrame, sizes: range, frequent: Bloom, pairs: Bloom | None, mass: int, least: int) -> DataFrame:
    """(key): hashes of the windows of these sizes that may occur ``least`` times, from one summary per hash partition."""
    spark = docs.sparkSession
    wanted = SLACK * mass / least
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(wanted / PART))
    capacity = max(1 << 10, math.ceil(wanted / parts))
    shared = spark.sparkContext.broadcast((frequent, pairs))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, linked = shared.value
        for lang, ids, vocabulary in _numbered(batches, known):
            found = [h for size, _, h in windows(ids, np.array(vocabulary.keys, np.uint64), sizes[-1], linked) if size in sizes]
            keys, counts = summed(np.concatenate(found))
            part = (keys % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, keys, counts = part[order], keys[order], counts[order].astype(np.uint32)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            ends = np.r_[cuts[1:], len(part)] if len(part) else []
            spans = [(at, min(at + ROW, int(end))) for start, end in zip(cuts, ends) for at in range(int(start), int(end), ROW)]
            for some in range(0, len(spans), 4096):
                group = spans[some:some + 4096]
                yield pa.record_batch([pa.array([int(part[a]) for a, _ in group], pa.int32()), pa.array([keys[a:z].tobytes() for a, z in group], pa.binary()),
                                       pa.array([counts[a:z].tobytes() for a, z in group], pa.binary())], ["part", "keys", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries: dict[int, Summary] = {}
        for b in batches:
            for part, keys, counts in zip(b.column("part").to_pylist(), b.column("keys"), b.column("counts")):
                if part not in summaries:
                    summaries[part] = Summary(least, capacity)
                summaries[part].add(np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64))
        for s in summaries.values():
            yield pa.record_batch([pa.array(s.survivors().view(np.int64))], ["key"])

    dealt = docs.mapInArrow(summarise, "part int, keys binary, counts binary").repartition(parts, "part")
    return dealt.mapInArrow(merge, "key long")


def exact_counts(docs: DataFrame, longest: int, frequent: Bloom, pairs: Bloom, chosen: Bloom, parts: int, least: int) -> DataFrame:
    """(lang, phrase, size, n) of the phrases of chosen windows that occur ``least`` times; counted by their words, not their hash.

    Tasks deal their counts to hash partitions in rows of ROW phrases, like the summaries, and a partition adds them up.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, pairs, chosen))
    names = ["part", "lang", "size", "phrases", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, linked, kept = shared.value
        total: dict[tuple[str, int], Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, size), counts in total.items():
                dealt: dict[int, list[bytes]] = {}
                for phrase in counts:
                    dealt.setdefault(xxhash.xxh32_intdigest(phrase) % parts, []).append(phrase)
                groups = [(part, some[at:at + ROW]) for part, some in dealt.items() for at in range(0, len(some), ROW)]
                yield pa.record_batch([pa.array([p for p, _ in groups], pa.int32()), pa.array([lang] * len(groups), pa.string()), pa.array([size] * len(groups), pa.int32()),
                                       pa.array([g for _, g in groups], pa.list_(pa.binary())), pa.array([[counts[x] for x in g] for _, g in groups], pa.list_(pa.int64()))], names)
            total.clear()

        for lang, ids, vocabulary in _numbered(batches, known):
            words = vocabulary.words
            for size, starts, hashes in windows(ids, np.array(vocabulary.keys, np.uint64), longest, linked):
                found = counted(ids, size, *(x[kept.holds(hashes)] for x in (starts, hashes)))
                total.setdefault((lang, size), Counter()).update({b" ".join([words[i] for i in w]): n for w, n in found.items()})
            if sum(map(len, total.values())) > HELD:
                yield from rows()
        yield from rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], Counter] = {}
        for b in batches:
            for lang, size, phrases, counts in zip(*(b.column(c).to_pylist() for c in names[1:])):
                counter = total.setdefault((lang, size), Counter())
                for phrase, n in zip(phrases, counts):
                    counter[phrase] += n
        for (lang, size), counter in total.items():
            enough = [(phrase.decode("utf-8", "replace"), n) for phrase, n in counter.items() if n >= least]
            yield pa.record_batch([pa.array([lang] * len(enough), pa.string()), pa.array([p for p, _ in enough], pa.string()),
                                   pa.array([size] * len(enough), pa.int32()), pa.array([n for _, n in enough], pa.int64())], ["lang", "phrase", "size", "n"])

    dealt = docs.mapInArrow(count, "part int, lang string, size int, phrases array<binary>, counts array<long>").repartition(parts, "part")
    return dealt.mapInArrow(add, "lang string, phrase string, size int, n long")


def counted(ids: np.ndarray, size: int, starts: np.ndarray, hashes: np.ndarray) -> dict[tuple[int, ...], int]:
    """Occurrences of each window of word numbers; windows that share a hash are told apart."""
    _, first, inverse, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    spread = np.arange(size)
    stand = starts[first]
    differs = np.zeros(len(starts), bool)
    for j in range(size):
        differs |= ids[starts + j] != ids[stand[inverse] + j]
    n = n - np.bincount(inverse[differs], minlength=len(n))
    out = Counter(dict(zip(map(tuple, ids[stand[:, None] + spread].tolist()), n.tolist())))
    out.update(map(tuple, ids[starts[differs][:, None] + spread].tolist()))
    return out


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of 1 to ``longest`` words that occur ``least`` times, and (lang, n) of all words."""
    picked = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    all_words = materialize(word_counts(picked, least), "words")
    totals, words = all_words.filter("word is null").select("lang", "n"), all_words.filter("word is not null")
    mass = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = build(_keys(words), words.count())
    pair_keys = materialize(survivors(picked, range(2, 3), frequent, None, mass, least), "pairs")
    pairs = build(pair_keys, pair_keys.count())
    if longest > 2:
        longer = survivors(picked, range(3, longest + 1), frequent, pairs, mass * (longest - 2), least)
        pair_keys = materialize(pair_keys.unionByName(longer), "windows")
    number = pair_keys.count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(number / PART))
    phrases = exact_counts(picked, longest, frequent, pairs, build(pair_keys, number), parts, least)
    singles = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    return materialize(singles.unionByName(phrases), "phrases"), totals


def _keys(words: DataFrame) -> DataFrame:
    """(key): :func:`word_key` of the columns lang and word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [word_key(a, w.encode("utf-8")) for a, w in zip(b.column("lang").to_pylist(), b.column("word").to_pylist())]
            yield pa.record_batch([pa.array(np.array(keys, np.uint64).view(np.int64))], ["key"])

    return words.select("lang", "word").mapInArrow(run, "key long")


def _words(phrase: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = LONGEST, absorb: int = 100, top: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases of each language, best first.

    Texts fall at ``. , ; : ! ?`` and line ends into pieces, these at blanks and
    tabs into words; A-Z counts as a-z.  Phrases have 2 to ``longest`` words in
    one piece and occur ``a >= least`` times.  Of all cuts into a first part
    (``l`` times) and a rest (``r`` times) the one with the lowest
    ``floor(1000 a n / (l r))`` counts, ties to the shorter first part.  A
    phrase inside a longer one that has ``absorb`` per cent of its occurrences
    is dropped.  Ranks go by score, count, phrase; ``top`` keeps so many per
    language, all if None.

    A null language is ``und``, a null text is empty, repeated rows count each,
    an empty table gives an empty table, other columns are not looked at.
    """
    phrases, totals = frequent_phrases(docs, lang_col, text_col, least, longest)
    found = phrases.filter("size > 1").withColumnRenamed("n", "a")
    inner = (found.filter("size > 2")
             .select("lang", "a", F.explode(F.array(_words("phrase", F.lit(1), F.col("size") - 1), _words("phrase", F.lit(2), F.col("size") - 1))).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("a").alias("inside")))
    left = found.join(inner, ["lang", "phrase"], "left").filter(F.col("inside").isNull() | (100 * F.col("inside") < absorb * F.col("a"))).drop("inside")
    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("head", _words("phrase", F.lit(1), F.col("k"))).withColumn("rest", _words("phrase", F.col("k") + 1, F.col("size") - F.col("k")))
    part = phrases.select("lang", "phrase", "n")
    both = (cuts.join(part.toDF("lang", "head", "l"), ["lang", "head"]).join(part.toDF("lang", "rest", "r"), ["lang", "rest"])
            .join(totals, "lang"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    score = F.expr("(cast(1000 as decimal(4,0)) * wa * wn) div (wl * wr)")
    scored = both.select("*", *(c.alias("w" + k) for k, c in wide.items())).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # of every salt first, so that a large language is many tasks
        best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    else:
        best = numbered(best, "place", "lang", *order)
        best = best.join(best.groupBy("lang").agg((F.min("place") - 1).alias("before")), "lang").withColumn("rank", F.col("place") - F.col("before"))
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def oracle(least: int = 100, longest: int = LONGEST, top: int = 2000) -> str:
    """DuckDB SQL with the rows of :func:`collocations` over ``documents``."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    with pieces as (select coalesce(lang, 'und') as lang,
                    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
    words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
    starts as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select unnest(range(1, {longest + 1})) as k) where len(w) >= k),
    f as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k as size, count(*) as f from starts group by all),
    total as (select lang, sum(f)::hugeint as n from f where size = 1 group by 1),
    c as (select * from f where size > 1 and f >= {least}),
    inner_ as (select lang, array_to_string(string_split(phrase, ' ')[s:s + m - 1], ' ') as phrase, max(f) as inside
               from (select lang, phrase, f, size, unnest(range(2, size)) as m from c where size > 2), lateral (select unnest(range(1, size - m + 2)) as s) group by 1, 2),
    kept as (select c.* from c left join inner_ using (lang, phrase) where inside is null or 100 * inside < 100 * c.f),
    cut as (select lang, phrase, f as a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as head, array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') as rest
            from (select *, unnest(range(1, size)) as k from kept)),
    scored as (select cut.lang, cut.phrase, a, k, x.f as l, y.f as r, n, (1000::hugeint * a * n) // (x.f::hugeint * y.f) as score
               from cut join f x on x.lang = cut.lang and x.phrase = head join f y on y.lang = cut.lang and y.phrase = rest join total on total.lang = cut.lang),
    best as (select *, row_number() over (partition by lang, phrase order by score, k) as nth from scored),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best where nth = 1)
    select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= {top}"""
