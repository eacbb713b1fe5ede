"""Tables with one row per key that change by small writes.

A table is a list of segments, each a folder of Parquet files in hash buckets of
the key.  The oldest segment is the base; every commit adds a segment with the
rows it changed and the keys it removed, so a batch writes what it touches and
not the whole table, and reads only the buckets of the keys it asks for.  A row
of a newer segment hides older ones.  Segments are folded together when they
have grown to a share of the base, which makes each row be rewritten a few times
over its life, whatever the number of batches.

A version is one manifest, a small text that names the segments.  It is put in
place by a rename that fails where the version exists: of two writers one wins,
and the other starts over from the winner's version.  Readers never see half a
commit.  Each writer's last label is in the manifest, so a replayed batch
changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import _fs

BUCKETS = 64
FOLD = 0.25      # share of the base that the newer segments may hold
SEGMENTS = 8     # newer segments before they become one
KEEP = 3         # versions that stay readable
_OWN = ("_key", "_gone", "_bucket")


class Conflict(Exception):
    """Another writer has put this version in place."""


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    segments: tuple[dict, ...] = ()          # path below the root, rows; the first one is the base
    done: dict[str, str] = field(default_factory=dict)   # writer -> label of its last batch

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "segments": list(self.segments), "done": self.done})


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.keys, self._buckets = spark, root.rstrip("/"), schema, keys, buckets
        self.columns = spark.createDataFrame([], schema).schema

    # ---- versions --------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        """Versions that can be read, oldest first."""
        fs, _ = _fs(self.spark, self.root)
        folder = self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """One version, by default the newest; an empty one if there is none yet."""
        found = self.versions()
        if version is None and not found:
            return Manifest(0, self._buckets)
        fs, _ = _fs(self.spark, self.root)
        stream = fs.open(self._path(f"manifests/{found[-1] if version is None else version:012d}.json"))
        try:
            got = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Manifest(got["version"], got["buckets"], tuple(got["segments"]), got["done"])

    def at_label(self, writer: str, label: str | None) -> Manifest:
        """The newest version in which ``label`` is the writer's last one; without a label, the table before its first batch."""
        for version in reversed(self.versions()):
            m = self.manifest(version)
            if m.done.get(writer) == label:
                return m
        return Manifest(0, self._buckets)

    def _put(self, m: Manifest) -> None:
        """Exclusive creation of a version."""
        fs, _ = _fs(self.spark, self.root)
        jvm = self.spark._jvm
        draft, final = self._path(f"manifests/.draft-{uuid.uuid4().hex}"), self._path(f"manifests/{m.version:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(m.text().encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), none)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(m.version) from None
            raise

    # ---- rows ------------------------------------------------------------

    def key(self) -> Column:
        parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in self.keys]
        return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64("_key"), F.lit(m.buckets)).cast("int")

    def _segment(self, segment: dict, chosen: list[int] | None) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.columns.fields)
        df = self.spark.read.schema(f"{fields}, _key binary, _gone boolean, _bucket int").parquet(f"{self.root}/{segment['path']}")
        return df if chosen is None else df.where(F.col("_bucket").isin(chosen))

    def _latest(self, segments: tuple[dict, ...], chosen: list[int] | None) -> DataFrame:
        """The newest row of every key, removed keys among them."""
        parts = [self._segment(s, chosen).withColumn("_age", F.lit(i)) for i, s in enumerate(segments)]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        if len(parts) == 1:
            return both.drop("_age")
        names = [f.name for f in self.columns.fields] + ["_gone", "_bucket"]
        newest = both.groupBy("_key").agg(F.max_by(F.struct(*names), "_age").alias("r"))
        return newest.select("r.*", "_key").select(*names[:-2], "_key", "_gone", "_bucket")

    def _rows(self, m: Manifest, chosen: list[int] | None = None) -> DataFrame:
        if not m.segments:
            return self.spark.createDataFrame([], self.schema).withColumn("_key", F.lit(None).cast("binary"))
        base = self._segment(m.segments[0], chosen).where("not _gone").drop("_gone", "_bucket")
        if len(m.segments) == 1:
            return base
        newer = self._latest(m.segments[1:], chosen)
        return base.join(newer.select("_key"), "_key", "left_anti").unionByName(newer.where("not _gone").drop("_gone", "_bucket"))

    def read(self, m: Manifest | None = None) -> DataFrame:
        """All rows of a version, by default of the newest."""
        return self._rows(m or self.manifest()).drop("_key")

    def lookup(self, asked: DataFrame, m: Manifest | None = None) -> DataFrame:
        """The rows whose key is in ``asked``; only their buckets are read."""
        m = m or self.manifest()
        wanted = asked.select(self.key().alias("_key")).distinct()
        chosen = sorted(r[0] for r in wanted.select(self._bucket(m).alias("b")).distinct().collect())  # as many as there are buckets at most
        return self._rows(m, chosen).join(wanted, "_key", "left_semi").drop("_key")

    # ---- changes ---------------------------------------------------------

    def _write(self, rows: DataFrame, m: Manifest) -> dict:
        """A segment; rows have _key and _gone."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(m)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}")
        written = self.spark.read.schema("_gone boolean").parquet(f"{self.root}/{name}").count()
        return {"path": name, "rows": written}

    def _delete(self, segments: list[dict]) -> None:
        fs, _ = _fs(self.spark, self.root)
        for s in segments:
            fs.delete(self._path(s["path"]), True)

    def commit(self, changed: DataFrame | None, gone: DataFrame | None = None, base: Manifest | None = None, writer: str = "", label: str | None = None) -> Manifest:
        """A version with the changed rows in place of those of their keys and without the keys of ``gone``.

        ``base`` is the version that the change was made from; what came after
        it, if anything, is dropped only if no other version was put in place
        in the meantime.  Raises :class:`Conflict` if one was.
        """
        m = base or self.manifest()
        found = self.versions()
        newest = found[-1] if found else 0
        names = [f.name for f in self.columns.fields]
        parts = []
        if changed is not None:
            parts.append(changed.select(*[F.col(f.name).cast(f.dataType) for f in self.columns.fields], self.key().alias("_key"), F.lit(False).alias("_gone")))
        if gone is not None:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.columns.fields if f.name not in self.keys]
            parts.append(gone.select(*self.keys, *empty, self.key().alias("_key"), F.lit(True).alias("_gone")).select(*names, "_key", "_gone"))
        segments = m.segments
        added = []
        if parts:
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            added = [self._write(rows, m)]
        segments = (*segments, *[s for s in added if s["rows"]])
        new = Manifest(newest + 1, m.buckets, segments, m.done | ({writer: label} if label is not None else {}))
        try:
            self._put(new)
        except Conflict:
            self._delete(added)
            raise
        return new

    def update(self, asked: DataFrame, change: Callable[[DataFrame], DataFrame], writer: str = "", label: str | None = None) -> Manifest:
        """Replace the rows of the asked keys by what ``change`` makes of them, once for each label of a writer.

        Labels of a writer rise in text order.  If another writer comes first,
        the change is made again from its version.
        """
        while True:
            m = self.manifest()
            if label is not None and label <= m.done.get(writer, ""):
                return m
            try:
                new = self.commit(change(self.lookup(asked, m)), base=m, writer=writer, label=label)
            except Conflict:
                continue
            return self.fold(new)

    def fold(self, m: Manifest) -> Manifest:
        """Fold segments that have grown; another writer's version simply stays."""
        newer = sum(s["rows"] for s in m.segments[1:])
        if m.segments and newer > FOLD * m.segments[0]["rows"]:
            some, rest = m.segments, ()
        elif len(m.segments) > SEGMENTS + 1:
            some, rest = m.segments[1:], m.segments[:1]
        else:
            return m
        rows = self._latest(some, None).drop("_bucket")
        merged = self._write(rows if rest else rows.where("not _gone"), m)
        new = replace(m, version=m.version + 1, segments=(*rest, merged))
        try:
            self._put(new)
        except Conflict:
            self._delete([merged])
            return self.manifest()
        return new

    def expire(self, keep: int = KEEP) -> None:
        """Remove all but the newest ``keep`` versions with the segments that only they name."""
        found = self.versions()
        old, kept = found[:-keep], found[-keep:]
        if not old:
            return
        used = {s["path"] for v in kept for s in self.manifest(v).segments}
        unused = [s for v in old for s in self.manifest(v).segments if s["path"] not in used]
        fs, _ = _fs(self.spark, self.root)
        for v in old:
            fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        self._delete(unused)


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ``after`` that are new or differ, keys of ``before`` that are gone); keys are compared null-safely.

    Rows are compared by a hash of their JSON text, so only keys and hashes of
    ``before`` are shuffled.
    """
    def key(df: DataFrame) -> Column:
        return F.struct(*[F.col(k) for k in keys])

    def mark(df: DataFrame) -> Column:
        return F.unhex(F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))))

    old = before.select(F.to_json(key(before)).alias("_k"), mark(before).alias("_old"))
    new = after.withColumn("_k", F.to_json(key(after))).withColumn("_new", mark(after))
    changed = new.join(old, "_k", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("_new"))).drop("_k", "_old", "_new")
    gone = before.withColumn("_k", F.to_json(key(before))).join(new.select("_k"), "_k", "left_anti").select(*keys)
    return changed, gone
