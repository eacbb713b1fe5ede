"""Order-respecting deduplication on exact keys.

The rule is sequential: an item is dropped when it conflicts with a known item
or with an EARLIER KEPT one; only kept items suppress later ones.  That is the
lexicographically first independent set of the conflict graph, not connected
components.  It is computed in rounds (Blelloch, Fineman, Shun, SPAA 2012):
every undecided item that has no earlier undecided opponent is kept, and the
opponents of kept items are dropped.

A chain of conflicts whose ranks rise along it would take a round per item.  So
after ROUNDS rounds what is undecided falls into its connected components, and
each one of up to FOLD claims is folded in one pass, rank by rank; only larger
ones go on in rounds, which break them up.

Conflicts are never listed as pairs.  An item makes *claims* (item, rank, key)
and two items conflict when they claim one key, so a round only needs the
smallest rank per key.  Similar titles are in :mod:`titles`.
"""

from __future__ import annotations

from copy import copy

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import collapse, normalize_name, text
from ..functions.urls import merge_link
from ..session import materialize
from ..sources.keyed import BUCKETS, KeyedTable, Manifest
from .components import connected

HOT_ROWS = 100_000    # a key with more claims is spread over SALTS tasks
MAX_HOT_KEYS = 10_000
SALTS = 64
ROUNDS = 3            # before components are looked for
FOLD = 200_000        # claims of a component that one task folds


# ---- the greedy rule -----------------------------------------------------

def _least(claims: DataFrame) -> DataFrame:
    """Smallest rank per key, once per salt of the key; pre-aggregated before the shuffle."""
    per_key = claims.groupBy("key").agg(F.min("rank").alias("least"), F.max("salts").alias("salts"))
    return per_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _contested(claims: DataFrame) -> DataFrame:
    """Claims on keys that several items claim, with their salt.

    Hot keys are found by count.  At most MAX_HOT_KEYS keys can reach the
    limit, so broadcasting them is bounded whatever the data looks like.
    """
    limit = max(HOT_ROWS, claims.count() // MAX_HOT_KEYS)
    counts = claims.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    tagged = claims.join(F.broadcast(counts.where(F.col("n") > limit)), "key", "left")
    hot = tagged.where(F.col("n").isNotNull()).withColumn("salts", F.lit(SALTS))
    cold = (tagged.where(F.col("n").isNull()).drop("n")
            .join(counts.where(F.col("n") <= limit), "key").withColumn("salts", F.lit(1)))
    return (hot.unionByName(cold).drop("n")
            .withColumn("salt", F.pmod(F.xxhash64("item"), F.col("salts").cast("bigint")).cast("int")))


def _round(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dropped items, claims that stay undecided) after one round."""
    waits = live.join(_least(live), ["key", "salt"]).withColumn("wait", F.col("least") < F.col("rank"))
    free = waits.groupBy("item").agg(F.max("wait").alias("wait")).where(~F.col("wait")).select("item", F.lit(True).alias("free"))
    marked = materialize(live.join(free, "item", "left"), "marked")
    rest = marked.where(F.col("free").isNull()).drop("free")
    kept = _least(marked.where("free")).select("key", "salt")
    hits = rest.join(kept, ["key", "salt"], "left_semi").select("item", F.lit(True).alias("gone")).distinct()
    after = materialize(rest.join(hits, "item", "left"), "after")
    return after.where("gone").select("item").distinct(), after.where(F.col("gone").isNull()).drop("gone")


def _folded(claims: pa.Table) -> pa.Table:
    """The items of one component that the sequential rule drops."""
    taken: set[str] = set()
    gone, held = [], {}
    for item, rank, key in zip(*(claims.column(c).to_pylist() for c in ("item", "rank", "key"))):
        held.setdefault((rank, item), []).append(key)
    for (_, item), keys in sorted(held.items()):
        if taken.isdisjoint(keys):
            taken.update(keys)
        else:
            gone.append(item)
    return pa.table({"item": pa.array(gone, claims.schema.field("item").type)})


def _components(live: DataFrame) -> DataFrame:
    """The claims with the component of each and its number of claims."""
    claims = live.select("item", "rank", "key").distinct()
    nodes = claims.withColumn("node", F.concat(F.lit("#"), F.col("item").cast("string")))
    roots = connected(nodes.select(F.col("node").alias("u"), F.col("key").alias("v"))).toDF("node", "root")
    placed = nodes.join(roots, "node", "left").select("item", "rank", "key", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("root").agg(F.count("*").alias("size"))
    return materialize(placed.join(sizes, "root"), "components")


def greedy_dropped(claims: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Items that the sequential rule drops, one column ``item``; ``known`` keys are taken from the start."""
    claims = materialize(claims, "claims")
    kind = claims.schema["item"].dataType.simpleString()
    lost, live = [], claims
    if known is not None:
        taken = materialize(claims.join(known.select("key").distinct(), "key", "left_semi").select("item").distinct(), "taken")
        lost, live = [taken], claims.join(taken, "item", "left_anti")
    live = materialize(_contested(live), "contested")
    rounds = 0
    while not live.isEmpty():
        gone, live = _round(live)
        lost.append(gone)
        rounds += 1
        if rounds % ROUNDS or live.isEmpty():
            continue
        placed = _components(live)
        small = placed.where(F.col("size") <= FOLD)
        lost.append(materialize(small.select("root", "item", "rank", "key").groupBy("root").applyInArrow(_folded, f"item {kind}"), "folded"))
        live = materialize(live.join(small.select("item").distinct(), "item", "left_anti"), "large-components")
    out = claims.select("item").limit(0)
    for part in lost:
        out = out.unionByName(part)
    return out


# ---- exact keys ----------------------------------------------------------

def _claims(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """One claim per non-blank key, within the category."""
    made = F.array_compact(F.array(*[
        F.when(value != "", F.md5(F.concat_ws("\x1f", F.lit(kind), text("category"), value))) for kind, value in keys.items()]))
    return df.select(F.col("seq").alias("item"), F.col("seq").alias("rank"), F.explode(made).alias("key"))


def _longer(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, c).otherwise("")


def merge_claims(df: DataFrame) -> DataFrame:
    """(item, rank, key) of the name (over 4 letters) and the link (over 10) of each record."""
    return _claims(df, {"name": _longer(normalize_name("name"), 4), "link": _longer(merge_link("application_link"), 10)})


def merge_dedup(existing: DataFrame | None, incoming: DataFrame, index: KeyIndex | None = None) -> DataFrame:
    """Incoming records whose name and link are new.

    ``seq`` is the arrival order and must be unique over ``incoming``.  With an
    ``index`` of the existing records' keys, those records are not read.
    """
    claims = merge_claims(incoming)
    known = merge_claims(existing) if index is None else index.known(claims)
    return incoming.join(greedy_dropped(claims, known).withColumnRenamed("item", "seq"), "seq", "left_anti")


class KeyIndex:
    """The keys of a snapshot's records, kept in hash buckets, so that a batch is held against them without the records."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.table = KeyedTable(spark, root, "key string, seq bigint", ["key"], buckets)
        self.version: Manifest | None = None

    def at(self, version: Manifest) -> KeyIndex:
        """The same index, read at one version."""
        out = copy(self)
        out.version = version
        return out

    def known(self, claims: DataFrame) -> DataFrame:
        """(key) of the claims that are taken; reads the buckets of these keys."""
        return self.table.lookup(claims.select("key").distinct(), self.version).select("key")

    def add(self, records: DataFrame, base: Manifest | None = None, writer: str = "", label: str | None = None) -> Manifest:
        """Put in the keys of records that have joined the snapshot; a key keeps its earliest record."""
        keys = merge_claims(records).groupBy("key").agg(F.min("rank").alias("seq"))
        return self.table.fold(self.table.commit(keys, base=base, writer=writer, label=label))


def feed_dedup(df: DataFrame) -> DataFrame:
    """The same rule on lower-cased link or word-only name, without length limits."""
    keys = {"link": F.lower(F.regexp_replace(text("application_link"), r"/+\z", "")),
            "name": collapse(F.regexp_replace(F.lower(text("name")), r"[^\p{L}\p{N}_]+", " "))}
    return df.join(greedy_dropped(_claims(df, keys)).withColumnRenamed("item", "seq"), "seq", "left_anti")
