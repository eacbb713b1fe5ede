"""Benchmark decontamination by spaced seeds.

Texts become 64-bit token hashes.  A seed reads a window of tokens through a
mask and ignores the masked-out ones, so a window still hits when ignored
tokens were substituted.  The masks together hit every run that counts.  A Bloom filter of fixed size, made from
the benchmark's seed hashes, thins the training windows before the join; the
join on the hash decides.  Each hit gives an alignment, along which the longest
run with at least ``IDENTITY`` equal tokens is measured on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BROADCAST_ROWS, slices, without
from .simhash import _mixed

# fixed masks: the token positions that are read.  They hit every run of 12 tokens with 2 substitutions, of 15 with 3 and of 20 with 4
# wherever these are; any longer run with a fifth substituted holds one of these.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 6, 7, 8), (0, 1, 2, 9, 10, 11), (0, 1, 2, 4, 5, 8))
LEAST = 1  # tokens of an item; those of fewer than 5 are searched without substitutions
OVERLAP = 12  # tokens of a verified overlap, or the whole item if it is shorter
IDENTITY = 0.8
BLOOM_BITS = 22  # 512 KB, whatever the benchmark's size
_CHUNK = 1 << 18

_WORD = np.zeros(256, np.int8)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        size = max(n, _CHUNK + 1)
        _powers[name] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
    return _powers[name][:n]


def _chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.r_[np.int8(0), _WORD[raw], np.int8(0)])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(raw)))]
    values = (sums[ends] - sums[starts]) * _power("down", pow(_BASE, -1, 1 << 64), len(raw) + 1)[starts]
    return _mixed(values, 1), starts


def token_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte position of every token: runs of ASCII letters, digits and non-ASCII bytes of lower-cased UTF-8."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = at + _CHUNK
        if to < len(data):  # cut at white space
            cut = max(data.rfind(b" ", at, to), data.rfind(b"\n", at, to))
            to = cut + 1 if cut > at else (data.find(b" ", to) + 1 or len(data))
        h, s = _chunk(data[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def encoded(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass") if text else b""


def seeds(hashes: np.ndarray, text_of: np.ndarray, masks: list[tuple[int, ...]], span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first token, seed hash) for every window that lies in one text, mask by mask."""
    n = len(hashes) - span + 1
    if n <= 0:
        return
    first = np.flatnonzero(text_of[:n] == text_of[span - 1:])
    for m in masks:
        key = np.full(len(first), len(m) * 1000 + span, np.uint64)
        for p in m:
            key = key * np.uint64(0xD6E8FEB86659FD93) + hashes[first + p] * np.uint64(2 * p + 1)
        yield first, _mixed(key, 2)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over a whole item of n < OVERLAP tokens; one of them leaves out any positions that may be substituted."""
    spare = n - -(-n * round(100 * IDENTITY) // 100)
    parts = np.array_split(np.arange(n), spare + 2)
    return [tuple(np.concatenate(kept).tolist()) for kept in combinations(parts, 2)]


def _windows(hashes: np.ndarray, text_of: np.ndarray, short: list[int], long: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(first token, seed hash, whether a hit is a whole item)."""
    for m in MASKS if long else ():
        for first, keys in seeds(hashes, text_of, [m], m[-1] + 1):
            yield first, keys, False
    for span in short:  # items shorter than an overlap are looked up whole
        masks = short_masks(span)
        for first, keys in seeds(hashes, text_of, masks, span):
            yield first, keys, masks == [tuple(range(span))]


def _slot(keys: np.ndarray, probe: int) -> np.ndarray:
    """The Bloom bit of a key for either probe; the same bits as in :func:`_bloom`."""
    shift = 8 if probe else 64 - BLOOM_BITS
    return ((keys >> np.uint64(shift)) & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a batch's texts, the text of each token, and the first token of each text."""
    data = [encoded(t.as_py()) for t in batch.column("text")]
    offsets = np.cumsum([0, *(len(d) + 1 for d in data)])
    hashes, starts = token_hashes(b"\n".join(data))
    text_of = np.searchsorted(offsets, starts, "right") - 1
    return hashes, text_of, np.searchsorted(text_of, np.arange(len(data)))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(no, item, tokens): distinct token sequences of at least LEAST tokens, their smallest id (null if none has one) and own number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hashes, _, first = _texts(b)
            lists = [x.view(np.int64) for x in np.split(hashes, first[1:])]
            yield pa.record_batch([b.column("item"), pa.array(lists, pa.list_(pa.int64()))], ["item", "tokens"])

    found = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    found = found.mapInArrow(run, "item long, tokens array<long>").filter(F.size("tokens") >= LEAST)
    return found.groupBy("tokens").agg(F.min("item").alias("item")).select(F.xxhash64("tokens").alias("no"), "item", "tokens")


def _item_seeds(items: DataFrame, short: list[int]) -> DataFrame:
    """(seed, no, at): where an item has a seed hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, tokens in zip(b.column("no").to_pylist(), b.column("tokens")):
                hashes = np.asarray(tokens.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                alone = [len(hashes)] if len(hashes) in short else []
                for first, keys, _ in _windows(hashes, np.zeros(len(hashes), np.int64), alone, not alone):
                    yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), no)), pa.array(first)], ["seed", "no", "at"])

    return items.select("no", "tokens").mapInArrow(run, "seed long, no long, at long").distinct()


def _bloom(seeds_of_items: DataFrame) -> np.ndarray:
    """Bits set by the benchmark's seeds; at most 2^16 words reach the driver."""
    slots = seeds_of_items.select(F.explode(F.array(F.shiftrightunsigned("seed", 64 - BLOOM_BITS),
                                                    F.shiftright("seed", 8).bitwiseAND((1 << BLOOM_BITS) - 1))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits")).collect()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    for w, bits in words:
        out[w] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return out


def _hits(docs: DataFrame, bloom: np.ndarray, short: list[int]) -> DataFrame:
    """(key, seed, pos): training windows that may share a seed with the benchmark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _CHUNK):
            ids = b.column("key").to_numpy()
            hashes, text_of, first_token = _texts(b)
            for first, keys, whole in _windows(hashes, text_of, short):
                for probe in (0, 1):
                    slot = _slot(keys, probe)
                    kept = (bloom[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
                    first, keys = first[kept], keys[kept]
                own = text_of[first]
                if whole and len(first):  # one hit of a text tells all, however often it repeats the item
                    order = np.lexsort((first, keys, own))
                    order = order[np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(own[order]) != 0)]]
                    first, keys, own = first[order], keys[order], own[order]
                yield pa.record_batch([pa.array(ids[own]), pa.array(keys.view(np.int64)), pa.array(first - first_token[own])], ["key", "seed", "pos"])

    return docs.mapInArrow(run, "key long, seed long, pos long")


def best_run(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int]:
    """(tokens, equal tokens) of the best run along an alignment; a run starts and ends with equal tokens."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if low >= high:
        return 0, 0
    same = doc[low + diagonal:high + diagonal] == item[low:high]
    total = np.r_[0, np.cumsum(np.where(same, 1 - IDENTITY, -IDENTITY))]
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    start = int(np.flatnonzero(total[:end + 1] == lowest[end])[-1])
    return end - start, int(same[start:end].sum())


def longest_run(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int]:
    """(tokens, equal tokens) of the longest run along an alignment with at least IDENTITY equal tokens, ties to more equal ones."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if low >= high:
        return 0, 0
    equal = np.r_[0, np.cumsum(doc[low + diagonal:high + diagonal] == item[low:high])]
    # in whole numbers: a run from i to j counts if total[i] <= total[j]
    total = 100 * equal - round(100 * IDENTITY) * np.arange(len(equal))
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    tokens = np.arange(len(equal)) - start
    ends = np.flatnonzero(tokens == tokens.max())
    return int(tokens.max()), int((equal[ends] - equal[start[ends]]).max())


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id",
             item_text: str = "text") -> DataFrame:
    """(key, item, overlap, equal): verified overlaps of documents with benchmark items.

    ``key`` is ``xxhash64(id, text)`` of the document.  Items of equal tokens
    count as one with the smallest id, null if none has one.  Items with fewer
    than 5 tokens count where they occur as they are; items without tokens never do.
    """
    items = materialize(_items(benchmark, item_col, item_text), "items")
    short = sorted(r[0] for r in items.filter(F.size("tokens") < OVERLAP).select(F.size("tokens")).distinct().collect())  # below OVERLAP
    planted = materialize(_item_seeds(items, short), "seeds")
    texts = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text")).filter("text is not null")
    hits = materialize(_hits(texts, _bloom(planted), short), "hits")
    lines = materialize(hits.join(planted, "seed").select("key", "no", (F.col("pos") - F.col("at")).alias("diagonal")).distinct(), "alignments")
    wanted = lines.select("key").distinct()
    few = wanted.count() <= BROADCAST_ROWS
    chosen = texts.join(F.broadcast(wanted) if few else wanted, "key", "left_semi")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _CHUNK):
            hashes, _, first = _texts(b)
            lists = [x.view(np.int64) for x in np.split(hashes, first[1:])]
            yield pa.record_batch([b.column("key"), pa.array(lists, pa.list_(pa.int64()))], ["key", "doc"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [longest_run(piece.values.to_numpy(zero_copy_only=False), item.values.to_numpy(zero_copy_only=False), at)
                    for piece, item, at in zip(b.column("piece"), b.column("tokens"), b.column("at").to_pylist())]
            need = [min(OVERLAP, len(t.values)) for t in b.column("tokens")]
            kept = [n <= r[0] for n, r in zip(need, runs)]
            out = pa.record_batch([b.column("key"), b.column("no"), b.column("item"), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.int64())],
                                  ["key", "no", "item", "overlap", "equal"])
            yield out.filter(pa.array(kept, pa.bool_()))

    parsed = chosen.dropDuplicates(["key"]).mapInArrow(tokens, "key long, doc array<long>")
    # of a document only what lies along the item, cut out row by row in the JVM
    start = F.greatest("diagonal", F.lit(0)).cast("int")
    paired = lines.join(items, "no").join(parsed, "key").select(
        "key", "no", "item", "tokens", F.slice("doc", start + 1, F.size("tokens")).alias("piece"), (F.col("diagonal") - start).alias("at"))
    found = paired.mapInArrow(verify, "key long, no long, item long, overlap long, equal long")
    best = found.groupBy("key", "no").agg(F.any_value("item").alias("item"), F.max(F.struct("overlap", "equal")).alias("best"))
    return best.select("key", "item", "best.overlap", "best.equal")


def report(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, contaminated, n_items, item_id, overlap, identity), one row per document.

    ``item_id`` is the item of the longest overlap, ties to more equal tokens,
    then to the smaller id; null, 0 and null for clean documents.  An item
    without an id counts, and is named by null.  Null and
    blank texts are clean; an empty benchmark leaves all documents clean.
    """
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    best = (overlaps(docs, benchmark, **columns)
            .groupBy("key").agg(F.count("*").alias("n_items"), F.max(F.struct("overlap", "equal", (-F.col("item")).alias("item"))).alias("best")))
    base = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"))
    return base.join(best, "key", "left").select(
        "doc_id", F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        (-F.col("best.item")).alias("item_id"), F.coalesce("best.overlap", F.lit(0)).alias("overlap"),
        (F.col("best.equal") / F.col("best.overlap")).alias("identity"))


def clean(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """The documents without a verified overlap; columns unchanged, whatever their names."""
    found = materialize(overlaps(docs, benchmark, **columns).select("key").distinct(), "contaminated")
    key = F.xxhash64(columns.get("id_col", "doc_id"), columns.get("text_col", "text"))
    name = "key"
    while name in docs.columns:
        name += "_"
    return without(docs.withColumn(name, key), found, name).drop(name)
