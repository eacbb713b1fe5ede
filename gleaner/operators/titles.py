"""Near-copy titles under the sequential rule.

A title is dropped when it is similar (Jaccard of its words) to a known title
or to an EARLIER KEPT one; only kept titles suppress later ones.

Candidates share a part of their words.  Similar sets of n and m words differ
in at most (n + m) (1 - t) / (1 + t) words, so if words are dealt by hash to one
part more than that, both sets hold exactly the same words in one part at
least.  Lengths fall into groups so wide that similar sets are of one group or
of neighbouring ones; a set has the keys of its own group and of the next.  Such
keys are several words long, so few unlike sets meet on one, however many
sets there are.

Large keys are extended by a prefix filter.  Words have one fixed order, rare
ones first.  A set of n words shares at least ceil(t n) words with any similar
set, so the first k words that two similar sets share lie in the first
n - ceil(t n) + k words of both: they meet on that combination.

Length and position narrow large keys further.  Sets of n and m words share at
least a(n, m) = ceil(t (n + m) / (1 + t)) words, which is more than ceil(t n)
unless m is the smallest possible, so against sets of m words a prefix of
n - a(n, m) + k words is enough.  The claims of a large key are parted by the
lengths of both sides, in groups of nearly equal ones, and those beyond the
shorter prefix go: titles that fill one long template with rare words of their
own no longer meet on the words of the template.

A title is read once: from then on its words are 64-bit hashes, and a set is the
number of its first row.  Most parts of a set are its own, so they never become
rows: tasks pack the keys with the numbers of their sets, a task per bucket of
keys sorts them, and only keys that several sets hold come out.  Sets that share
none are kept without another look.  Words stay where they were written and are
moved only for the pairs that their bit maps leave.

Candidates are verified before anything waits.  A round compares every set with
the GROUP earliest sets of each of its keys, the first rounds with one of the FIRST, so work is linear in the claims
even where a third of all titles are near copies of each other: those fall to
the first kept one.  What then is left of a larger key is extended by one more
word (k + 1), which leaves sets together only as long as they go on sharing
words.  Waiting follows verified conflicts only.  Of a candidate, bit maps are
compared before the words are: sets differ in at least as many words as in bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocab as V
from ..functions import text as T
from ..functions.text import jaccard, lits, once, text
from ..session import brief_shuffles, materialize, small_batches
from .joins import lookup

RATIO = 1.02      # between the shortest lengths of neighbouring groups
FIRST = 2         # earliest sets of a key, of which a set is held against one at first, as near copies share most of their keys
GROUP = 64        # sets of a key that are compared in a round; what is left of larger keys is extended
WORDS = 8         # words a key may be extended to
COMMON = 10_000   # most frequent words that stand at the end of the order; placement only
BITS = 512        # of a set's bit map; thins the pairs whose words are compared
MORE_BITS = 8192  # of the second one that sets of LONG words have, as the first one is full
LONG = 500
SCOUTS = 2        # rounds that hold a set against one other
PACKED = 1 << 19  # keys that a task packs at once, and about as many of a bucket
FEW = 100_000     # sets whose numbers are broadcast, to pick their words without moving all; 2 MB


def _shared(n: Column, threshold: float) -> Column:
    """Words that a similar set must share with a set of n words."""
    return F.ceil(n * threshold - 1e-9).cast("int")


def _ordered(sets: DataFrame) -> DataFrame:
    """``sets`` (row, words) with the words in the fixed order: common ones last."""
    each = sets.select(F.explode("words").alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("df")).where("df > 1").orderBy(F.desc("df"), "w").limit(COMMON)
    df = {r["w"]: r["df"] for r in counts.collect()}   # at most COMMON
    at = sets.columns.index("words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(w, key=lambda x: (df.get(x, 0), x)) for w in b.column("words").to_pylist()]
            yield b.set_column(at, "words", pa.array(words, pa.list_(pa.int64())))

    return sets.mapInArrow(run, sets.schema)


def _length_group(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(RATIO)).cast("int")


@lru_cache(1 << 16)
def _parts(size: int, threshold: float) -> list[tuple[int, int]]:
    """(length group, parts): what the keys of a set are made by, for its own group of lengths and the next one."""
    step = -math.log(threshold) * (1 + 1e-6)   # similar sets are at most one group apart, whatever is rounded
    own = math.floor(math.log(size) / step)
    longest = [math.floor(math.exp((g + 1) * step) + 1e-6) for g in (own, own + 1)]
    return [(own + i, math.floor(2 * n * (1 - threshold) / (1 + threshold) + 1e-6) + 1) for i, n in enumerate(longest)]


def _keys(hashes: np.ndarray, sizes: np.ndarray, scopes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of the set of each) of sets whose word hashes follow each other."""
    keys, places = [], []
    which = np.arange(len(sizes))
    of_word = np.repeat(which, sizes)
    made = np.array([_parts(n, threshold) for n in sizes.tolist()], np.int64).reshape(-1, 2, 2)
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        for group, parts in (made[:, 0].T, made[:, 1].T):
            start = np.cumsum(parts) - parts
            held = np.zeros(int(parts.sum()), np.uint64)
            np.add.at(held, start[of_word] + (hashes % parts.astype(np.uint64)[of_word]).astype(np.int64), mixed)
            of_key = np.repeat(which, parts)
            place = (np.arange(len(held)) - start[of_key] + (group[of_key] + 1 << 32)).astype(np.uint64)
            key = (held ^ (held >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + place * np.uint64(0x9E3779B97F4A7C15) + scopes[of_key]
            keys.append(key ^ (key >> np.uint64(32)))
            places.append(of_key)
    return np.concatenate(keys).view(np.int64), np.concatenate(places)


def part_keys(hashes: np.ndarray, scope: int, threshold: float) -> np.ndarray:
    """The keys of a set of word hashes: what it holds in each part, an empty one too."""
    return _keys(hashes, np.array([len(hashes)]), np.array([scope & 0xFFFFFFFFFFFFFFFF], np.uint64), threshold)[0]


def _long_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists of longs."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.view(np.uint64), np.diff(column.offsets.to_numpy())


def _packed(keys: list[np.ndarray], nodes: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A row per bucket of keys: the keys and the set of each, as bytes."""
    key, node = np.concatenate(keys), np.concatenate(nodes)
    with np.errstate(over="ignore"):
        bucket = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    ends = [*start[1:].tolist(), len(order)]
    key, node = key[order], node[order]
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(start.tolist(), ends)], pa.binary())
    return pa.record_batch([pa.array(found.astype(np.int64)), cut(key), cut(node)], ["bucket", "keys", "nodes"])


def _met(packed: pa.Table) -> pa.Table:
    """(key, row) of the keys of a bucket that several rows hold."""
    key, node = (np.frombuffer(b"".join(packed.column(c).to_pylist()), np.int64) for c in ("keys", "nodes"))
    order = np.argsort(key, kind="stable")
    key = key[order]
    again = key[1:] == key[:-1]
    hit = np.r_[again, False] | np.r_[False, again]
    return pa.table({"key": key[hit], "row": node[order][hit]})


def _root(rows: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Contested claims of the parts of the sets, which words may extend; ``part`` tells claims that lengths have parted."""
    words = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, int(words * 2 * (1 - threshold) / (1 + threshold) * (1 + 1 / threshold)) // PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, held, seen = [], [], 0, set()   # a task packs a set once for each kind of its rows, which meet
        for b in batches:
            new = [not (s in seen or seen.add(s)) for s in b.column("who").to_pylist()]
            b = b.filter(pa.array(new, pa.bool_()))
            hashes, sizes = _long_lists(b.column("words"))
            row, scope = b.column("row").to_numpy(), b.column("scope").to_numpy().view(np.uint64)
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                begin = int(ends[at] - sizes[at])
                to = max(at + 1, int(np.searchsorted(ends, begin + PACKED, "right")))
                key, of = _keys(hashes[begin:int(ends[to - 1])], sizes[at:to], scope[at:to], threshold)
                keys.append(key)
                found.append(row[at:to][of])
                held, at = held + len(key), to
                if held >= PACKED:
                    yield _packed(keys, found, buckets)
                    keys, found, held = [], [], 0
        if held:
            yield _packed(keys, found, buckets)

    who = F.concat("set", F.when(F.col("old"), "e").when(F.col("short"), "s").otherwise("n")).alias("who")
    packed = rows.select("row", who, F.xxhash64("scope").alias("scope"), "words").mapInArrow(run, "bucket long, keys binary, nodes binary")
    met = materialize(packed.groupBy("bucket").applyInArrow(_met, "key long, row long"), "met-keys")
    n = F.col("n")
    # other rows of a set may stand for it in other tasks
    made = rows.select("row", "set").join(nodes, "set").drop("set")
    return met.join(made, "row").select("node", "rank", "n", (n - _shared(n, threshold)).alias("spare"), "key", F.lit(0).alias("at"), F.lit(False).alias("part")).distinct()


def _row(node: str) -> Column:
    """The row whose words a node has; nodes of one set differ in the last two bits."""
    return F.shiftright(node, 2)


def _words_of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, words) of the sets of some nodes."""
    need = materialize(nodes.select(_row("node").alias("row")).distinct(), "needed-sets")
    few = need.count() <= FEW
    return rows.select("row", "words").join(F.broadcast(need) if few else need, "row", "left_semi")


def _extended(claims: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Claims on ``level`` words: each is extended by a word that comes later in the order, within the prefix for that level."""
    reach = F.least(F.col("n"), F.col("spare") + level)
    grown = claims.withColumn("row", _row("node")).join(sets.select("row", "words"), "row").select(
        "node", "rank", "n", "spare", "key", "at", "part", F.posexplode(F.slice("words", F.col("at") + 1, F.greatest(reach - F.col("at"), F.lit(0)))).alias("i", "w"))
    return grown.select("node", "rank", "n", "spare", F.xxhash64("key", "w").alias("key"), (F.col("at") + F.col("i") + 1).cast("int").alias("at"), "part")


def _contested(claims: DataFrame) -> DataFrame:
    """The claims whose key several sets claim."""
    keys = claims.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("key")
    return claims.join(keys, "key", "left_semi")


def _by_length(claims: DataFrame, level: int, threshold: float, lengths: list[int]) -> DataFrame:
    """Contested claims, those of large keys parted by the length groups of both sides; ``lengths`` are the groups there are."""
    claims = materialize(_contested(claims), "title-claims")
    large = materialize(claims.where(~F.col("part")).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > GROUP).select("key"), "large-keys")
    if large.isEmpty():
        return claims
    wide = claims.where(~F.col("part")).join(large, "key", "left_semi")
    rest = claims.join(large, "key", "left_anti").unionByName(claims.where("part").join(large, "key", "left_semi"))
    n, own = F.col("n"), _length_group(F.col("n"))
    least = _shared(n, threshold)
    most = F.floor((level + n - F.col("at")) * ((1 + threshold) / threshold) - n + 1e-6)   # longest set that the words after this claim allow
    most = F.least(most, F.floor(n / threshold + 1e-6))
    groups = F.when(most >= least, F.array_intersect(F.sequence(_length_group(least), _length_group(F.greatest(most, least))), F.array(*map(F.lit, lengths)))).otherwise(F.array().cast("array<int>"))
    parted = wide.withColumn("other", F.explode(groups)).withColumn("own", own)
    shortest = F.greatest(F.floor(F.pow(F.lit(RATIO), F.col("other")) + 1e-9).cast("int"), least)
    spare = n - F.ceil((n + shortest) * (threshold / (1 + threshold)) - 1e-9).cast("int")
    parted = (parted.withColumn("spare", spare).where(F.col("at") <= F.col("spare") + level)
              .select("node", "rank", "n", "spare", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "at", F.lit(True).alias("part")))
    return materialize(rest.select(parted.columns).unionByName(_contested(parted)), "parted-claims")


def _earliest(claims: DataFrame, count: int) -> DataFrame:
    """The ``count`` smallest ranks of every key; each task of the claims takes as many first, so a hot key is many tasks."""
    return claims.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("rank", "node"))).where(F.col("pos") <= count).drop("pos")


def _bit_maps(sets: DataFrame) -> DataFrame:
    """(row, n, bits, more): of every bit whether an odd number of the set's words has it; ``more`` bits of long sets, else null."""
    def odd(hashes: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
        slot = (hashes >> np.uint64(40)).astype(np.int64) % bits + np.repeat(np.arange(len(sizes)), sizes) * bits
        return np.packbits((np.bincount(slot, minlength=len(sizes) * bits) & 1).astype(np.uint8)).view(np.int64).reshape(len(sizes), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, sizes = _long_lists(b.column("words"))
            more: list[np.ndarray | None] = [None] * len(sizes)
            ends = np.cumsum(sizes)
            for i in np.flatnonzero(sizes >= LONG).tolist():
                more[i] = odd(hashes[ends[i] - sizes[i]:ends[i]], sizes[i:i + 1], MORE_BITS)[0]
            yield pa.record_batch([b.column("row"), pa.array(sizes, pa.int32()), pa.array(list(odd(hashes, sizes, BITS)), pa.list_(pa.int64())),
                                   pa.array(more, pa.list_(pa.int64()))], ["row", "n", "bits", "more"])

    return sets.select("row", "words").mapInArrow(run, "row long, n int, bits array<long>, more array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, maps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, rank_b) whose word sets are similar."""
    pairs = pairs.withColumns({"ra": _row("a"), "rb": _row("b")})
    first = maps.drop("more")
    near = pairs.join(first.toDF("ra", "na", "ma"), "ra").join(first.toDF("rb", "nb", "mb"), "rb")
    apart = sum((F.bit_count(F.get("ma", F.lit(i)).bitwiseXOR(F.get("mb", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    most = (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    near = materialize(near.where(apart <= most).select("a", "b", "rank_b", "ra", "rb", most.alias("most"), F.least("na", "nb").alias("least")), "near-pairs")
    second = maps.where(F.col("n") >= LONG)
    apart = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    long = near.where(F.col("least") >= LONG).join(second.select(F.col("row").alias("ra"), F.col("more").alias("ma")), "ra").join(second.select(F.col("row").alias("rb"), F.col("more").alias("mb")), "rb")
    near = materialize(near.where(F.col("least") < LONG).unionByName(long.where(apart <= F.col("most")).drop("ma", "mb")).select("a", "b", "rank_b", "ra", "rb"), "near-pairs")
    words = materialize(_words_of(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))), sets), "compared-words")
    both = near.join(words.toDF("ra", "wa"), "ra").join(words.toDF("rb", "wb"), "rb")
    return both.where(jaccard(F.col("wa"), F.col("wb")) >= threshold).select("a", "b", "rank_b")


def _candidates(claims: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b, rank_b, rank) that meet on a key and whose sizes allow the threshold, with the number of such keys."""
    right = others.select("key", F.col("node").alias("b"), F.col("rank").alias("rank_b"), F.col("n").alias("m"))
    met = claims.join(right, "key").where((F.col("node") != F.col("b")) & (F.least("n", "m") >= _shared(F.greatest("n", "m"), threshold)))
    return met.groupBy(F.col("node").alias("a"), "b", "rank_b", "rank").agg(F.count("*").alias("met"))


def _decide(open_: DataFrame, edges: DataFrame, kept: DataFrame, unseen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open, kept) nodes after all that the edges decide; ``unseen`` nodes have not met every earlier set yet."""
    while True:
        hit = edges.join(kept.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")).distinct()
        left = materialize(open_.join(hit, "node", "left_anti"), "undecided")
        waits = (edges.join(left.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node"))
                 .unionByName(unseen)).distinct()
        free = materialize(left.join(waits, "node", "left_anti"), "kept")
        open_ = materialize(left.join(free, "node", "left_anti"), "open")
        kept = kept.unionByName(free)
        if open_.isEmpty() or free.isEmpty():
            return open_, kept


def first_kept(rows: DataFrame, nodes: DataFrame, threshold: float = V.JACCARD) -> DataFrame:
    """(node, kept): for every set that is dropped, or only asks, the rank of the earliest kept set similar to it.

    ``rows`` has row, set, old, short, scope, words, n: words are hashes, several rows
    may have one set.  ``nodes`` has node (four times one of the set's rows, plus 0 to 3),
    set, n, rank, fixed: fixed sets are kept from the start, sets with a null rank
    only ask.  Ranks of other sets are unique.  Sets similar to none are left out.
    """
    root = materialize(_contested(materialize(_root(rows, nodes.select("node", "set", "n", "rank"), threshold), "root-claims")), "title-claims")
    live = materialize(nodes.select("node", "rank", "fixed").join(root.select("node").distinct(), "node", "left_semi"), "live-sets")
    maps = materialize(_bit_maps(rows), "bit-maps")
    kept = live.where("fixed").select("node")
    open_ = live.where(F.col("rank").isNotNull() & ~F.col("fixed")).select("node")
    lengths = sorted(r[0] for r in maps.select(_length_group(F.col("n"))).distinct().collect())  # grows with the logarithm of a title's length
    alive, edges, level, ordered = root.where(F.col("rank").isNotNull()), None, -SCOUTS, None
    while not open_.isEmpty():
        if 0 < level <= WORDS:
            ordered = ordered or materialize(_ordered(_words_of(alive, rows)), "ordered-sets")
            alive = _by_length(_extended(alive, ordered, level), level, threshold, lengths)
        elif level >= 0:
            alive = materialize(_contested(alive), "title-claims")
        most = FIRST if level < 0 else GROUP
        first = materialize(_earliest(alive, most), "earliest")
        more = materialize(first.groupBy("key").agg(F.count("*").alias("c"), F.max("rank").alias("upto")).where(F.col("c") >= most), "large-keys")
        asking = materialize(alive.join(open_, "node", "left_semi"), "asking")
        unseen = asking.join(more, "key").where(F.col("rank") > F.col("upto")).select("node")
        pairs = _candidates(asking, first, threshold).where(F.col("rank_b") < F.col("rank"))
        if level < 0:
            # a set is held against the one that it meets on most keys; any other may stand against it yet
            best = F.max_by(F.struct("b", "rank_b"), F.struct("met", -F.col("rank_b")))
            pairs = materialize(pairs.groupBy("a").agg(best.alias("best"), F.count("*").alias("c")), "best-pairs")
            unseen = unseen.unionByName(pairs.where("c > 1").select(F.col("a").alias("node")))
            pairs = pairs.select("a", "best.b", "best.rank_b")
        unseen = materialize(unseen.distinct(), "unseen")
        found = materialize(_verified(pairs, rows, maps, threshold), "conflicts")
        edges = found if edges is None else edges.unionByName(found)
        if unseen.isEmpty() or not found.isEmpty():   # else nothing new is decided that would end the comparison of a key
            open_, kept = _decide(open_, edges, kept, unseen)
            if open_.isEmpty():
                break
        if level >= 0:   # what was compared in a key is done there, small keys are done
            alive = alive.join(more, "key", "left_semi").join(first.select("key", "node"), ["key", "node"], "left_anti")
        # dropped sets suppress nothing
        alive = materialize(alive.join(open_.unionByName(kept), "node", "left_semi"), "open-claims")
        level = max(level + 1, 0) if found.isEmpty() else level + 1
    return _partners(root, rows, live, maps, edges, materialize(kept, "kept-sets"), threshold, lengths)


def _partners(claims: DataFrame, rows: DataFrame, live: DataFrame, maps: DataFrame, edges: DataFrame | None, kept: DataFrame, threshold: float, lengths: list[int]) -> DataFrame:
    """(node, kept): the smallest rank among the kept sets that are similar and, if the set has a rank, earlier.

    A conflict with a kept set is a first answer, so only kept sets of smaller ranks are looked for.
    """
    marks = live.select("node", "rank").join(kept.withColumn("kept", F.lit(True)), "node", "left")
    known = live.select(F.col("node").alias("a"), F.lit(None).cast("bigint").alias("known")).limit(0)
    if edges is not None:
        known = edges.join(kept.withColumnRenamed("node", "b"), "b", "left_semi").groupBy("a").agg(F.min("rank_b").alias("known"))
    known = known.withColumnRenamed("a", "node")
    # a set without rank may ask for any kept one
    below = F.when(F.col("rank").isNull() & F.col("known").isNull(), F.lit((1 << 63) - 1)).otherwise(F.least("known", "rank"))
    marks = materialize(marks.join(known, "node", "left").select("node", F.col("kept").isNotNull().alias("kept"), "known", below.alias("below")), "marks")
    asks = marks.where(~F.col("kept"))
    if asks.isEmpty():
        return asks.select("node", F.col("known").alias("kept"))
    found, ordered = [], None
    for level in range(WORDS + 1):
        if level:
            ordered = ordered or materialize(_ordered(_words_of(claims, rows)), "ordered-sets")
            claims = _by_length(_extended(claims, ordered, level), level, threshold, lengths)
        marked = claims.join(marks.drop("known"), "node")
        limits = marked.where(~F.col("kept")).groupBy("key").agg(F.max("below").alias("limit"))
        earlier = materialize(marked.where("kept").join(limits, "key").where(F.col("rank") < F.col("limit")).drop("limit"), "earlier-kept")
        sizes = materialize(earlier.groupBy("key").agg(F.count("*").alias("c"), F.min("rank").alias("least")), "earlier-keys")
        asking = marked.where(~F.col("kept")).join(sizes, "key").where(F.col("below") > F.col("least")).drop("least")
        both = materialize(asking.unionByName(earlier.join(sizes.drop("least"), "key")), "both-sides")
        ready = both.where(F.col("c") <= GROUP) if level < WORDS else both
        pairs = _candidates(ready.where(~F.col("kept")), ready.where("kept"), threshold).join(asks.select(F.col("node").alias("a"), "below"), "a")
        found.append(materialize(pairs.where(F.col("rank_b") < F.col("below")).select("a", "b", "rank_b"), "partners"))
        claims = both.where(F.col("c") > GROUP).select(claims.columns)
        if level == WORDS or claims.isEmpty():
            break
    similar = _verified(reduce(DataFrame.unionByName, found).distinct(), rows, maps, threshold).select(F.col("a").alias("node"), F.col("rank_b").alias("kept"))
    answers = similar.unionByName(asks.where("known is not null").select("node", F.col("known").alias("kept")))
    return answers.groupBy("node").agg(F.min("kept").alias("kept"))


def title_matches(existing: DataFrame | None, incoming: DataFrame, threshold: float = V.JACCARD) -> DataFrame:
    """For every title that repeats an earlier accepted one: seq and kept.

    ``kept`` is the seq of the earliest accepted incoming title, or -1 when an
    existing record is similar.  Titles under five letters are never dropped.
    A boolean column ``eligible`` may mark rows that are refused anyway: they
    are looked up but suppress nothing.  Copies of one word set take part
    once, through their first row.
    """
    if "eligible" not in incoming.columns:
        incoming = incoming.withColumn("eligible", F.lit(True))
    titles = _titles(incoming.select("seq", "eligible", F.lit(False).alias("old"), "category", "name"))
    if existing is not None:
        nothing = F.lit(None).cast(incoming.schema["seq"].dataType).alias("seq")
        titles = titles.unionByName(_titles(existing.select(nothing, F.lit(False).alias("eligible"), F.lit(True).alias("old"), "category", "name")))
    with small_batches(incoming.sparkSession), brief_shuffles(incoming.sparkSession):
        rows = materialize(titles.withColumn("n", F.size("words")).withColumn("row", F.monotonically_increasing_id()), "title-rows")
        verdict = materialize(_verdicts(rows, threshold), "title-verdicts")
    # a set without partner was kept through its first eligible row
    earliest = F.coalesce("kept", "rank")
    return (lookup(rows.where(~F.col("short") & ~F.col("old")).select("seq", "set"), verdict, ["set"], how="inner")
            .select("seq", earliest.alias("kept")).where(F.col("kept") < F.col("seq")))


def _verdicts(rows: DataFrame, threshold: float) -> DataFrame:
    """(set, rank, kept) of every set of incoming titles: its first eligible row and the earliest accepted one similar to it."""
    def first(cond: Column) -> Column:
        return F.min(F.when(cond, F.col("seq")))

    found = rows.groupBy("set").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.max("old").alias("old"),
                                    F.max(~F.col("short") & ~F.col("old")).alias("asks"), first(~F.col("short") & F.col("eligible")).alias("rank"),
                                    first(F.col("short") & F.col("eligible")).alias("short_rank"))
    found = materialize(found, "title-sets")
    # of one set, what asks, its first short title and the existing ones are apart
    kinds = F.array_compact(F.array(F.when(F.col("asks"), 0), F.when(F.col("short_rank").isNotNull(), 1), F.when(F.col("old"), 2)))
    kind = F.col("kind")
    rank = F.when(kind == 0, F.col("rank")).when(kind == 1, F.col("short_rank")).otherwise(F.lit(-1))
    nodes = materialize(found.withColumn("kind", F.explode(kinds)).select(
        (F.col("row") * 4 + kind).alias("node"), "set", "n", rank.cast("bigint").alias("rank"), (kind != 0).alias("fixed")), "title-nodes")
    partner = first_kept(rows, nodes, threshold).join(nodes.select("node", "set"), "node").select("set", "kept")
    return found.where("asks").select("set", "rank").join(partner, "set", "left")


def _titles(df: DataFrame) -> DataFrame:
    """(seq, eligible, old, scope, short, set, words) of the titles that have words, each text read once.

    ``words`` are the hashes of :func:`similarity_tokens` in order, ``set`` is
    128 bits that stand for them and the scope.
    """
    letters = F.lower(F.regexp_replace(text("name"), rf"[^{T.WORD}{T.SPACE}]", ""))
    split = once(df.withColumn("scope", text("category")), tokens=F.split(letters, rf"[{T.SPACE}]+"))
    named = once(split, known=F.array_except("tokens", lits([*V.STOP_WORDS, ""])))
    # three words are five letters with the spaces between
    short = F.when(F.size("known") > 2, F.lit(False)).otherwise(F.length(F.array_join(F.array_remove("tokens", ""), " ")) < 5)
    hashed = once(named, short=short, words=F.sort_array(F.transform("known", lambda w: F.xxhash64(w)))).where(F.size("words") > 0)
    return hashed.select("seq", "eligible", "old", "scope", "short", F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), "scope", "words")), 16, "0") for i in (1, 2)]).alias("set"), "words")


def fuzzy_pairs(existing: DataFrame | None, incoming: DataFrame, threshold: float = V.JACCARD) -> DataFrame:
    """Every dropped title beside the earliest accepted title that it repeats."""
    return title_matches(existing, incoming, threshold)


def fuzzy_dedup(existing: DataFrame | None, incoming: DataFrame, threshold: float = V.JACCARD) -> DataFrame:
    """Incoming records whose title is not a near copy of an accepted one."""
    return incoming.join(title_matches(existing, incoming, threshold).select("seq"), "seq", "left_anti")
