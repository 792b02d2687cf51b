"""Changes of a keyed table as files per bucket of keys, resolved when they are read.

A change set is written once, as files in folders per bucket (hash of the key), and becomes visible with a numbered
manifest that lists the live files of every bucket. Nothing is rewritten: a bucket without changes keeps its files. A
reader resolves a bucket by keeping the highest version of each key, and rows of one bucket meet no others, so the work
follows the changes. ``compact`` folds the files of buckets that have many.

A change is a ``put`` (the row competes by version; of equal versions the later change set wins) or an ``erase`` (the
key and everything written before it is gone).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vektorloom.collections.published import SharedFolder

BUCKETS = 64
MANIFEST = "commit-"


class Deltas:
    """The change sets below a folder. ``schema`` is that of the table; it has the key and the version."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, version: str = "version", buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema, self.key, self.version, self.buckets = schema, key, version, buckets
        extra = [T.StructField("_erase", T.BooleanType()), T.StructField("_commit", T.LongType())]
        self.stored = T.StructType([*schema.fields, *extra])

    @property
    def folder(self) -> SharedFolder:
        return SharedFolder(self.spark, self.path)

    def commits(self) -> list[int]:
        return sorted(int(n[len(MANIFEST) : -len(".json")]) for n in self.folder.names() if n.startswith(MANIFEST))

    def manifest(self) -> dict:
        """Number, buckets, live files (``{bucket: [folders, oldest first]}``) and the tokens of applied change sets."""
        numbers = self.commits()
        if not numbers:
            return {"number": 0, "buckets": self.buckets, "files": {}, "tokens": {}}
        return json.loads(self.folder.read(f"{MANIFEST}{numbers[-1]:010d}.json"))

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")

    def _written(self, rows: DataFrame, buckets: int) -> tuple[str, list[int]]:
        name = f"set-{uuid.uuid4().hex[:12]}"
        placed = rows.withColumn("_bucket", self._bucket(buckets))
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        found = SharedFolder(self.spark, f"{self.path}/{name}").names()
        return name, sorted(int(n.split("=")[1]) for n in found if n.startswith("_bucket="))

    def _publish(self, change) -> None:
        """Publish ``change(manifest)``; if another writer has taken the number, try again on its manifest."""
        while True:
            old = self.manifest()
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return
            new["number"] = old["number"] + 1
            if self.folder.publish(f"{MANIFEST}{new['number']:010d}.json", json.dumps(new)):
                return

    def put(self, rows: DataFrame, token: tuple[str, int] | None = None) -> None:
        """Add rows with their versions; one row per key. A ``token`` (writer, number) that is not above the writer's
        last one has been applied already: nothing happens."""
        self._add(rows.select(*self.schema.names).withColumn("_erase", F.lit(False)), token)

    def erase(self, keys: DataFrame) -> None:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.key]
        named = keys.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)).distinct()
        self._add(named.select(self.key, *none).select(*self.schema.names).withColumn("_erase", F.lit(True)), None)

    def before(self, token: tuple[str, int]) -> Deltas:
        """The changes as they were before a change set with this token was applied; for reading."""
        for number in reversed(self.commits()):
            manifest = json.loads(self.folder.read(f"{MANIFEST}{number:010d}.json"))
            if manifest["tokens"].get(token[0], -1) < token[1]:
                break
        else:
            manifest = {"number": 0, "buckets": self.buckets, "files": {}, "tokens": {}}
        return _Past(self, manifest)

    def applied(self, token: tuple[str, int]) -> bool:
        return self.manifest()["tokens"].get(token[0], -1) >= token[1]

    def _add(self, rows: DataFrame, token: tuple[str, int] | None) -> None:
        if token is not None and self.applied(token):
            return
        # the number of a change set follows the order of publishing, so it is not written with the rows
        name, touched = self._written(rows.withColumn("_commit", F.lit(None).cast("long")), self.manifest()["buckets"])

        def change(manifest: dict) -> dict | None:
            if token is not None:
                if manifest["tokens"].get(token[0], -1) >= token[1]:
                    return None
                manifest["tokens"][token[0]] = token[1]
            for bucket in touched:
                manifest["files"].setdefault(str(bucket), []).append([name, manifest["number"] + 1])
            return manifest

        self._publish(change)

    def _read(self, files: dict[str, list]) -> DataFrame:
        """All rows of the listed files with the number of their change set."""
        by_set: dict[str, tuple[int, list[str]]] = {}
        for bucket, sets in files.items():
            for name, number in sets:
                by_set.setdefault(name, (number, []))[1].append(f"{self.path}/{name}/_bucket={bucket}")
        if not by_set:
            return self.spark.createDataFrame([], self.stored)
        paths = [p for _, folders in by_set.values() for p in folders]
        rows = self.spark.read.schema(self.stored).parquet(*paths).withColumn("_file", F.col("_metadata.file_path"))
        numbers = self.spark.createDataFrame([(n, v[0]) for n, v in by_set.items()], "_set string, _number long")
        named = rows.withColumn("_set", F.regexp_extract("_file", r"(set-[0-9a-f]{12})/_bucket=", 1))
        known = named.join(F.broadcast(numbers), "_set")  # one row per change set
        return known.select(*self.schema.names, "_erase", F.coalesce("_commit", "_number").alias("_commit"))

    def resolved(self) -> DataFrame:
        """The last word on every changed key: its row, or a row with ``_erase`` and the key alone; with ``_cut``, the
        number of the change set that erased what was before (0: none)."""
        return self._resolve(self._read(self.manifest()["files"]))

    def _resolve(self, rows: DataFrame) -> DataFrame:
        erased = F.max(F.when(F.col("_erase"), F.col("_commit"))).over(Window.partitionBy(self.key))
        cut = rows.withColumn("_cut", F.coalesce(erased, F.lit(0).cast("long")))
        alive = cut.where(F.col("_erase") & (F.col("_commit") == F.col("_cut")) | ~F.col("_erase") & (F.col("_commit") > F.col("_cut")))
        best = Window.partitionBy(self.key).orderBy("_erase", F.desc(self.version), F.desc("_commit"))
        return alive.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")

    def over(self, base: DataFrame, send) -> DataFrame:
        """The table: ``base`` (unique keys) with the changes. ``send`` marks a small frame for broadcast; rows of
        ``base`` without a change then stay where they are."""
        if not self.manifest()["files"]:
            return base
        changed = self.resolved()
        keys = send(changed.select(self.key))
        untouched = base.join(keys, self.key, "left_anti").select(*base.columns)
        stored = base.join(keys, self.key, "left_semi").select(*self.schema.names)
        before = stored.withColumn("_erase", F.lit(False)).withColumn("_commit", F.lit(0).cast("long"))
        # a stored row came before all changes: an erased key has none
        cuts = changed.where("_cut > 0").select(self.key)
        before = before.join(cuts, self.key, "left_anti")
        rivals = before.select(*self.stored.names).unionByName(changed.select(*self.stored.names))
        best = Window.partitionBy(self.key).orderBy("_erase", F.desc(self.version), F.desc("_commit"))
        winners = rivals.withColumn("_n", F.row_number().over(best)).where("_n = 1 AND NOT _erase")
        return untouched.unionByName(winners.select(*base.columns))

    def compact(self, most_sets: int = 4) -> list[int]:
        """Fold the files of every bucket that has more than ``most_sets`` change sets into one; other buckets keep
        theirs. Returns the buckets. Old files stay until ``clean``."""
        old = self.manifest()
        many = {b: sets for b, sets in old["files"].items() if len(sets) > most_sets}
        if not many:
            return []
        last = self._resolve(self._read(many))
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.key]
        cuts = last.where("_cut > 0 AND NOT _erase").select(self.key, *none, F.lit(True).alias("_erase"), F.col("_cut").alias("_commit"))
        rows = last.drop("_cut").unionByName(cuts.select(*self.stored.names))
        name, _ = self._written(rows.select(*self.stored.names), old["buckets"])
        kept = {b: len(sets) for b, sets in many.items()}

        def change(manifest: dict) -> dict:
            for bucket, count in kept.items():
                later = manifest["files"][bucket][count:]  # written meanwhile
                manifest["files"][bucket] = [[name, many[bucket][-1][1]], *later]
            return manifest

        self._publish(change)
        return sorted(int(b) for b in many)

    def clean(self) -> None:
        """Remove sets and manifests that the current manifest does not name; older readers lose them."""
        live = {name for sets in self.manifest()["files"].values() for name, _ in sets}
        last = self.commits()[-1:]
        for name in self.folder.names():
            if name.startswith("set-") and name not in live:
                self.folder.remove(name)
            if name.startswith(MANIFEST) and int(name[len(MANIFEST) : -len(".json")]) not in last:
                self.folder.remove(name)

    def drop(self) -> None:
        self.folder.remove()


class _Past(Deltas):
    """An earlier state; what is put is put into the current one (and so is a no-op for a token that was applied)."""

    def __init__(self, now: Deltas, manifest: dict):
        super().__init__(now.spark, now.path, now.schema, now.key, now.version, now.buckets)
        self._now, self._then = now, manifest

    def manifest(self) -> dict:
        return self._then

    def put(self, rows: DataFrame, token: tuple[str, int] | None = None) -> None:
        self._now.put(rows, token)

    def compact(self, most_sets: int = 4) -> list[int]:
        return self._now.compact(most_sets)
