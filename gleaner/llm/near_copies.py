"""Near copies by Jaccard similarity of word shingles: SimHash comparison in MinHash buckets.

Rows with the same set of shingles are one node.  A node has a fingerprint of
its distinct shingles and ``BANDS`` keys, each made of ``PER_BAND`` min-hashes:
two nodes share a key with a probability of their similarity to the power
``PER_BAND``, at any number of nodes and any length of text, while unlike texts
share none.  So buckets grow with the groups of copies, not with the table.

Every node is first held against the smallest one of its buckets, then against
the nearest of another component; what the shingles confirm is one component
from then on.  Buckets with more pairs than that are compared throughout, by bit
planes (:func:`simhash.unit_pairs`) and shingles in the same task, which returns
a spanning forest: a large group just under the threshold makes no row per
pair.  Every link counts only after the two texts' shingles were compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BROADCAST_ROWS, slices, without
from .components import connected
from .simhash import BLOCK, _bit_matrix, _forest, _mixed, _whole_units, fingerprint, shingle_hashes, unit_pairs

BANDS, PER_BAND = 13, 4  # a pair at 0.8 shares a key with a probability of 0.999
WORDS = 4                # 64-bit words of a fingerprint
RADIUS = 64              # a pair at 0.8 is 39 of 256 bits apart, with a deviation of 6
HOT = 2048               # rows of a bucket outside its largest component, beyond which it waits for what the others link
LOAD = 1 << 21           # shingles of one side of a comparison task
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The bucket keys of a set of shingle hashes; a set without any has none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(_FACTORS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[at:at + (1 << 12), None] * _FACTORS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, PER_BAND).T:
        keys = _mixed(keys ^ row, 1)
    return keys.view(np.int64)


def node_of(distinct: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles."""
    return xxhash.xxh3_128_digest(distinct.tobytes())


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that stand for a row's id and text; nulls differ from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def marked(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, row, node, fp, size, keys) per row; size is the number of distinct shingles."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in b.column("text")]
            yield pa.record_batch([b.column("id"), b.column("row"), pa.array(map(node_of, sets), pa.binary()),
                                   pa.array([fingerprint(s, WORDS) for s in sets], pa.binary()),
                                   pa.array(map(len, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))],
                                  ["id", "row", "node", "fp", "size", "keys"])

    picked = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, row binary, node binary, fp binary, size long, keys array<long>")


def _members(nodes: DataFrame) -> DataFrame:
    """(key, node, fp, size) of the buckets that several nodes share."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return keyed.join(shared, "key", "left_semi").join(nodes.select("node", "fp", "size"), "node").select("key", "node", "fp", "size")


def _first_pairs(members: DataFrame, radius: int) -> DataFrame:
    """(u, v): every node with the smallest one of each of its buckets, if their fingerprints are near."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apart = np.bitwise_count(_packed(b.column("fp")) ^ _packed(b.column("other"))).sum(1, dtype=np.int64)
                yield b.select(["u", "v"]).filter(pa.array(apart <= radius))

    hubs = members.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("hub"))
    pairs = members.join(hubs, "key").filter(F.col("node") != F.col("hub.node"))
    return pairs.select(F.col("node").alias("u"), F.col("hub.node").alias("v"), "fp", F.col("hub.fp").alias("other")).mapInArrow(near, "u binary, v binary").distinct()


def _packed(fps: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(len(fps), -1)


def _mixed_buckets(rows: DataFrame) -> DataFrame:
    """(key, n, load, main, most, held): buckets with several components, their rows and shingles, the largest one's label, rows and shingles."""
    per = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("load"))
    return per.groupBy("key").agg(F.sum("n").alias("n"), F.sum("load").alias("load"), F.max(F.struct("n", "label", "load")).alias("top")).select(
        "key", "n", "load", F.col("top.label").alias("main"), F.col("top.n").alias("most"), F.col("top.load").alias("held")).filter("n > most")


def _comparable(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, n, load, main, most, held, node, fp, size, label): rows of the buckets that hold several components."""
    label = F.xxhash64("node") if labels is None else F.xxhash64(F.coalesce("root", "node"))
    rows = members if labels is None else members.join(labels.toDF("node", "root"), "node", "left")
    rows = rows.select("key", "node", "fp", "size", label.alias("label"))
    return rows.join(_mixed_buckets(rows), "key")


def _units(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of the comparison tasks, sorted, with the columns ``more``; blocks of the largest component meet the other blocks only.

    A block has about BLOCK rows, or LOAD shingles if the tasks are given them.
    """
    main = F.col("label") == F.col("main")
    blocks = lambda n, load: F.ceil(F.greatest(n / BLOCK, load / (LOAD if more else 1 << 62)))
    whole = blocks(F.col("n"), F.col("load")) <= 1
    rows = rows.withColumn("a", blocks(F.col("most"), F.col("held"))).withColumn("b", blocks(F.col("n") - F.col("most"), F.col("load") - F.col("held")))
    rows = rows.withColumn("side", F.when(whole, 0).when(main, F.pmod(F.xxhash64("node"), F.col("a"))).otherwise(F.col("a") + F.pmod(F.xxhash64("node"), F.col("b"))).cast("long"))
    others = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.when(main, F.col("a")).otherwise(0).cast("long"), (F.col("a") + F.col("b") - 1).cast("long")))
    dealt = rows.withColumn("other", F.explode(others)).select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("unit"), "side", "key", "node", "fp", "label", *more)
    return dealt.repartition("unit").sortWithinPartitions("unit", "side", "label", "node")


def _candidates(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """(key, u, v): pairs of unlike labels within the radius, of each node and task the ``most`` nearest.

    A task that has more of them adds a row with nothing but its bucket's key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_units(batches):
            node, fps = t.column("node").combine_chunks(), t.column("fp").combine_chunks()
            key, label, packed = t.column("key").to_numpy(), t.column("label").to_numpy(), _packed(fps)
            for a, b in unit_pairs(t.column("unit").to_numpy(), t.column("side").to_numpy(), _bit_matrix(fps), radius, label=label):
                unlike = label[a] != label[b]
                a, b = a[unlike], b[unlike]
                if not len(a):
                    continue
                apart = np.bitwise_count(packed[a] ^ packed[b]).sum(1, dtype=np.int64)
                order = np.lexsort((b, apart, a))
                a, b = a[order], b[order]
                new = np.r_[True, a[1:] != a[:-1]]
                taken = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1] < most
                yield pa.record_batch([pa.array(key[a[taken]]), node.take(pa.array(a[taken])), node.take(pa.array(b[taken]))], ["key", "u", "v"])
                more = np.unique(key[a[~taken]])
                if len(more):
                    none = pa.nulls(len(more), pa.binary())
                    yield pa.record_batch([pa.array(more), none, none], ["key", "u", "v"])

    return _units(rows).mapInArrow(run, "key long, u binary, v binary")


def _shared(values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the sets a[i] and b[i] share; set r is values[starts[r]:starts[r + 1]], without repeats."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    row, column = row[times[column] > 1], (np.cumsum(times > 1) - 1)[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros(len(a), np.int64)
    for low in range(0, int((times > 1).sum()), 1 << 13):  # a bit matrix of at most 1 KB a row at a time
        i, j = np.searchsorted(column, [low, low + (1 << 13)])
        bits = np.zeros((len(starts) - 1, -(-min(1 << 13, int(column[j - 1]) - low + 1) // 64) * 8), np.uint8)
        np.bitwise_or.at(bits, (row[i:j], (column[i:j] - low) >> 3), np.uint8(1) << ((column[i:j] - low) & 7).astype(np.uint8))
        bits = bits.view(np.uint64)
        for at in range(0, len(a), 1 << 14):
            some = slice(at, at + (1 << 14))
            out[some] += np.bitwise_count(bits[a[some]] & bits[b[some]]).sum(1, dtype=np.int64)
    return out


def _unit_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table per unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit = batch.column("unit").to_numpy()
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                if held and held[0].column("unit")[0].as_py() != unit[i]:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _links(rows: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(u, v): of each comparison task a spanning forest of the labels that pairs within the radius and of that similarity connect."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _unit_tables(batches):
            label, fps, shingles = t.column("label").to_numpy(), t.column("fp").combine_chunks(), t.column("shingles").combine_chunks()
            if isinstance(shingles, pa.ChunkedArray):
                shingles = shingles.chunk(0)
            values, size = shingles.flatten().to_numpy(), pa.compute.list_value_length(shingles).to_numpy().astype(np.int64)
            starts = np.r_[0, np.cumsum(size)]
            _, first, of = np.unique(label, return_index=True, return_inverse=True)
            known = first[of]
            root = known.copy()
            for a, b in unit_pairs(t.column("unit").to_numpy(), t.column("side").to_numpy(), _bit_matrix(fps), radius, step=1 << 14, label=label):
                apart = (root[a] != root[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
                a, b = a[apart], b[apart]
                if len(a):
                    both = _shared(values, starts, a, b)
                    good = (both > 0) & (both >= similarity * (size[a] + size[b] - both))
                    _forest(root, a[good], b[good])
            moved = np.flatnonzero((known == np.arange(len(known))) & (root != known))
            if len(moved):
                node = t.column("node").combine_chunks()
                yield pa.record_batch([node.take(pa.array(moved)), node.take(pa.array(root[moved]))], ["u", "v"])

    return _units(rows.join(sets, "node"), "shingles").mapInArrow(run, "u binary, v binary")


def _shingles(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): the distinct shingles of the nodes in the one column of ``wanted``."""
    asked = materialize(nodes.join(wanted.toDF("node").distinct(), "node").select(F.col("least.row").alias("row")), "asked")
    keyed = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    texts = keyed.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, "row", "left_semi")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in b.column("text")]
            yield pa.record_batch([pa.array(map(node_of, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return materialize(texts.select("text").mapInArrow(parsed, "node binary, shingles array<long>").dropDuplicates(["node"]), "shingles")


def _similar(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, edges: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The edges (u, v) whose texts share at least ``similarity`` of their distinct shingles (Jaccard)."""
    sets = _shingles(docs, id_col, text_col, nodes, edges.select("u").unionByName(edges.select(F.col("v").alias("u"))), shingle)
    paired = edges.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    # row by row in the JVM, so that two long texts are all that is held at a time
    both = F.size(F.array_intersect("a", "b"))
    return paired.select("u", "v", both.alias("both"), (F.size("a") + F.size("b")).alias("all")).filter(
        (F.col("both") > 0) & (F.col("both") >= similarity * (F.col("all") - F.col("both")))).select("u", "v")


def components(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame | None:
    """Stars, as of :func:`connected`, of all pairs that share a bucket and whose shingles confirm them; None if there are none.

    The smallest nodes of all buckets are tested first, then the nearest partner
    of each node; what is connected by then needs no test.  Buckets with
    untested pairs, and hot ones, are compared as a whole at the end, when most
    of their links are known; their blocks are tasks of their own.
    """
    members = materialize(_members(nodes), "members")
    stars = None

    def tested(part: DataFrame) -> None:
        nonlocal stars
        if not part.isEmpty():
            good = _similar(docs, id_col, text_col, nodes, part, shingle, similarity)
            stars = connected(good if stars is None else stars.unionByName(good))

    ordered = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    early = materialize(_first_pairs(members, radius), "pairs")
    tested(early)
    rows = materialize(_comparable(members, stars), "compared")
    large = F.col("n") - F.col("most") > HOT
    found = materialize(_candidates(rows.filter(~large), radius, 1), "candidates")
    tested(materialize(found.filter("u is not null").select(*ordered).distinct().join(early.select(*ordered), ["u", "v"], "left_anti"), "pairs"))
    more = found.filter("u is null").select("key").unionByName(rows.filter(large).select("key")).distinct()
    rest = materialize(_comparable(rows.join(more, "key", "left_semi").select("key", "node", "fp", "size"), stars), "compared")
    if not rest.isEmpty():
        links = materialize(_links(rest, _shingles(docs, id_col, text_col, nodes, rest.select("node"), shingle), radius, similarity), "links")
        if not links.isEmpty():
            stars = connected(links if stars is None else stars.unionByName(links))
    return stars


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; columns unchanged.

    Rows link if their texts share ``similarity`` of their distinct word
    shingles (Jaccard); a text of fewer words is one shingle; texts without
    words are copies of each other, be they null or empty.  Ids need not be
    unique: every row is judged by its own text.  Of rows with the smallest id
    the one with the smallest hash of its text stays, null ids come last, and
    of rows that repeat an id with its text one stays.  An empty table gives an
    empty table.
    """
    rows = materialize(marked(docs, id_col, text_col, shingle), "marked")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    nodes = materialize(rows.groupBy("node").agg(least, F.any_value("fp").alias("fp"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys")), "nodes")
    stars = components(docs, id_col, text_col, nodes, shingle, similarity, radius)
    named = nodes.select("node", "least", F.col("node").alias("root"))
    if stars is not None:
        named = nodes.join(stars.toDF("node", "root"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    kept = materialize(named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row")), "kept")
    numbers = rows.groupBy("row").agg(F.count("*").alias("n"))
    tagged = materialize(numbers.join(kept.withColumn("stays", F.lit(True)), "row", "left"), "tagged")
    gone = materialize(tagged.filter("stays is null").select("row"), "copies")
    name = "row"
    while name in docs.columns:
        name += "_"
    out = without(docs.withColumn(name, row_key(id_col, text_col)), gone, name)
    repeated = materialize(tagged.filter("stays and n > 1").select("row"), "repeated")
    if not repeated.isEmpty():
        once = out.join(repeated.toDF("__row"), F.col(name) == F.col("__row"), "left_semi").dropDuplicates([name])
        out = without(out, repeated, name).unionByName(once)
    return out.drop(name)
