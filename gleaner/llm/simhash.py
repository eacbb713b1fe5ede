"""SimHash near-duplicates by bit-sliced comparison.

Documents become fingerprints of ``64 * words`` bits; equal fingerprints are
one node.  Nodes meet in *tables*: lists of bit positions on which two nodes
must agree to be compared.  With :func:`exact_tables` every pair within the
radius agrees on some table (pigeonhole), so no link is lost.  Inside a bucket
the fingerprints stand as vertical bit planes of 64 lanes; a query's planes are
added to all lanes at once with carry-save counters, and blocks whose lanes
have all left the radius are abandoned.  Buckets over ``BLOCK`` rows are split
into pairs of blocks, so a hot bucket becomes many tasks.  A task returns a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices
from .components import connected

BLOCK = 2048  # rows of one side of a comparison task
ROWS = 1 << 13  # rows compared in one go, units being whole
SEED = 42
BUCKET = 2048.0  # wanted rows of a random bucket; decides how many pieces are used, not what is found
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th hash derived from a 64-bit hash (splitmix finaliser); the first is the hash itself."""
    if not j:
        return h
    h = h + np.uint64((0x9E3779B97F4A7C15 * j) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; a shorter text is one shingle, no word is none."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    runs = zip(*(tokens[i:] for i in range(size)))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)), np.uint64, len(tokens) - size + 1)


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """Big-endian words; a bit is 1 if it is set in over half of the hashes."""
    out = b""
    for j in range(words):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 15):
            part = _mixed(hashes[at:at + (1 << 15)], j).astype(">u8")
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out += np.packbits(2 * votes > len(hashes)).tobytes()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """(id, fp): one row per document; a null or blank text has the fingerprint zero."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle), words) for t in b.column("text")]
            yield pa.record_batch([b.column("id"), pa.array(fps, pa.binary())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp binary")


def exact_tables(radius: int, rows: int, bits: int = 64) -> list[list[int]]:
    """Bit lists such that any two fingerprints within the radius agree on one of them.

    The bits fall into p pieces; at most ``radius`` of them differ, so some
    ``p - radius`` agree.  More pieces give longer keys and more tables; p is
    the smallest whose random buckets stay near BUCKET rows.
    """
    pieces = radius + 1
    while pieces < radius + 6 and rows / 2.0 ** (bits * (pieces - radius) / pieces) > BUCKET:
        pieces += 1
    cuts = [bits * i // pieces for i in range(pieces + 1)]
    return [[b for k in kept for b in range(cuts[k], cuts[k + 1])] for kept in combinations(range(pieces), pieces - radius)]


def _bit_matrix(fps: pa.Array) -> np.ndarray:
    """Rows of 0/1 bytes, first bit of the first byte first."""
    flat = np.frombuffer(b"".join(fps.to_pylist()), np.uint8)
    return np.unpackbits(flat.reshape(len(fps), -1), axis=1)


def _keyed(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """(key, fp): a row per node and table; the key is a hash of the table number and its bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bits = _bit_matrix(b.column("fp"))
            for t, positions in enumerate(tables):
                packed = np.packbits(bits[:, positions], axis=1)
                value = np.zeros(b.num_rows, np.uint64)
                for col in packed.T:  # keys may be longer than a word: fold byte by byte
                    value = _mixed(value ^ col.astype(np.uint64), t + 1)
                yield pa.record_batch([pa.array(value.view(np.int64)), b.column("fp")], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp binary")


def _pairs_within(planes: np.ndarray, rows: np.ndarray, query: np.ndarray, word: np.ndarray, dead: np.ndarray,
                  radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, lane number) of all lanes within the radius.

    ``planes[b, w]``: bit b of the 64 fingerprints of word w.  ``rows[b, q]``:
    bit b of row q as 0 or all ones.  The counters start so that passing the
    radius is a carry out of the highest one.
    """
    width = int(radius + 1).bit_length()
    start = (1 << width) - radius - 1
    count = [np.full(len(query), _ALL if start >> k & 1 else 0, np.uint64) for k in range(width)]
    for b in range(len(planes)):
        carry = planes[b][word] ^ rows[b][query]
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        dead |= carry
        if b % 8 == 7:
            live = dead != _ALL
            if live.sum() < 0.8 * len(live):
                query, word, dead, count = query[live], word[live], dead[live], [c[live] for c in count]
                if not len(query):
                    break
    live = dead != _ALL
    lanes = np.unpackbits((~dead[live]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(lanes)
    return query[live][at], word[live][at] * 64 + lane


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of ``labels`` along the pairs; a label is the smallest row of its tree."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def unit_pairs(unit: np.ndarray, side: np.ndarray, bits: np.ndarray, radius: int, step: int = 1 << 12,
               label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(earlier row, later row) of all pairs within the radius, in parts; a part has all pairs of its earlier rows.

    Rows are sorted by (unit, side).  A unit with one side compares all its
    rows; one with two compares the rows of the first with those of the second.
    With ``label``, blocks of lanes that all have a row's own label are passed over.
    """
    n = len(unit)
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[first, n])
    of = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - first[of]
    head = np.add.reduceat((side == side[first][of]).astype(np.int64), first)  # rows of the first side
    begin = first[of] + np.where(head[of] == size[of], place + 1, np.where(place < head[of], head[of], size[of]))
    end = first[of] + size[of]
    words = -(-n // 64)
    planes = np.zeros((bits.shape[1], words * 64), np.uint8)
    planes[:, :n] = bits.T
    planes = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)
    rows = np.where(bits.T == 1, _ALL, np.uint64(0))
    if label is not None:
        least, most = (f(label, np.arange(0, n, 64)) for f in (np.minimum.reduceat, np.maximum.reduceat))
    todo = np.where(begin < end, (end - 1) // 64 - begin // 64 + 1, 0)
    ends = np.cumsum(todo)
    at = 0
    while at < n:  # about ``step`` (row, word) pairs at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        some = np.arange(at, to)
        query = np.repeat(some, todo[some])
        if len(query):
            nth = np.arange(len(query)) - np.repeat(np.cumsum(todo[some]) - todo[some], todo[some])
            word = begin[query] // 64 + nth
            if label is not None:
                other = (least[word] != label[query]) | (most[word] != label[query])
                query, word = query[other], word[other]
            low = np.clip(begin[query] - word * 64, 0, 63).astype(np.uint64)
            high = np.minimum(end[query] - word * 64, 64).astype(np.uint64)
            valid = (_ALL << low) & (_ALL >> (np.uint64(64) - high))
            yield _pairs_within(planes, rows, query, word, ~valid, radius)
        at = to


def compare_units(unit: np.ndarray, side: np.ndarray, bits: np.ndarray, radius: int, step: int = 1 << 12) -> np.ndarray:
    """For each row the smallest row that its unit's links connect it with, or itself; rows as in :func:`unit_pairs`."""
    labels = np.arange(len(unit))
    for a, b in unit_pairs(unit, side, bits, radius, step):
        _forest(labels, a, b)
    return labels


def _dealt(nodes: DataFrame, tables: list[list[int]]) -> DataFrame:
    """The rows of the comparison tasks, sorted by (unit, side)."""
    keyed = _keyed(nodes, tables)
    buckets = (keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
               .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")))
    dealt = (keyed.join(buckets, "key")
             .withColumn("side", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("k")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("unit"), "side", "fp",
                     F.xxhash64("fp", "key").alias("place")))
    return dealt.repartition("unit").sortWithinPartitions("unit", "side", "place")


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ROWS rows or more that hold whole units."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        unit = t.column("unit").to_numpy()
        cut = int(np.searchsorted(unit, unit[-1], "left"))  # the last unit may go on
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, rows = t.to_batches(), t.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def links(nodes: DataFrame, radius: int, tables: list[list[int]]) -> DataFrame:
    """(u, v): links between distinct fingerprints, of each comparison task a spanning forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_units(batches):
            fps = t.column("fp").combine_chunks()
            got = compare_units(t.column("unit").to_numpy(), t.column("side").to_numpy(), _bit_matrix(fps), radius)
            moved = np.flatnonzero(got != np.arange(len(got)))
            yield pa.record_batch([fps.take(pa.array(moved)), fps.take(pa.array(got[moved]))], ["u", "v"])

    return _dealt(nodes, tables).mapInArrow(run, "u binary, v binary")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1, radius: int = 4) -> DataFrame:
    """(id, fp, component): every document with its fingerprint and the smallest id of its group.

    Documents link if their fingerprints differ in at most ``radius`` bits; the
    search is exact.  Equal fingerprints are one node, so copies cost nothing.
    Null ids are never a group's smallest; a group without any id has a null
    component.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle, words), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    stars = connected(links(nodes, radius, exact_tables(radius, nodes.count(), 64 * words)))
    named = nodes.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    label = materialize(named.join(smallest, "root").select("fp", "component"), "labels")
    return marked.join(label, "fp").select("id", "fp", "component")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.hex(fp))
