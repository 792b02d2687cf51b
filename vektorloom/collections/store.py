"""Named vector collections as catalog tables over versioned parquet snapshots.

Appends add files to the current snapshot. Upserts and deletes are written as change sets beside it (see ``deltas``)
and resolved when the collection is read; ``compact`` folds them into a new snapshot folder and then points the table at
it with one catalog update. Readers see either the old or the new rows, and a lost executor only costs a retry.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vektorloom.collections.deltas import Deltas
from vektorloom.operators.embedding import require_valid
from vektorloom.operators.ranking import latest_per_key
from vektorloom.operators.spread import send_if_small
from vektorloom.session import remove_folder

TEXT_FIELDS = [
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    T.StructField("version", T.LongType()),
]
MULTI_VECTOR_FIELDS = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("seq_id", T.LongType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("filepath", T.StringType()),
]
SCHEMAS = {"text": T.StructType(TEXT_FIELDS), "image": T.StructType(MULTI_VECTOR_FIELDS)}


class Collections:
    """Collections of one database, stored below ``root``."""

    def __init__(self, spark: SparkSession, root: str, database: str = "vektorloom"):
        self.spark, self.root, self.database = spark, root.rstrip("/"), database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{self.root}/{database}.db'")

    def _table(self, name: str) -> str:
        return f"`{self.database}`.`{name.lower()}`"

    def _fresh_folder(self, name: str) -> str:
        return f"{self.root}/{name.lower()}/snapshot-{uuid.uuid4().hex[:12]}"

    def create(self, name: str, dim: int, data_type: str = "text", if_exists: str = "replace") -> None:
        """Create an empty collection. ``if_exists`` is replace, ignore or error."""
        if data_type not in SCHEMAS:
            raise ValueError(f"unknown data type {data_type!r}; use one of {sorted(SCHEMAS)}")
        if if_exists not in ("replace", "ignore", "error"):
            raise ValueError(f"unknown if_exists {if_exists!r}")
        if self.has(name):
            if if_exists == "error":
                raise FileExistsError(f"collection {name} exists")
            if if_exists == "ignore":
                return
            self.drop(name)
        folder = self._fresh_folder(name)
        self.spark.createDataFrame([], SCHEMAS[data_type]).write.parquet(folder)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[data_type])
        self.spark.sql(
            f"CREATE TABLE {self._table(name)} ({columns}) USING parquet LOCATION '{folder}' "
            f"TBLPROPERTIES ('vector.dim' = '{dim}', 'vector.data_type' = '{data_type}', "
            f"'vector.changes' = '{uuid.uuid4().hex[:12]}')"
        )

    def has(self, name: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{name.lower()}")

    def drop(self, name: str) -> None:
        """Remove a collection from the catalog and its files from the store."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        remove_folder(self.spark, f"{self.root}/{name.lower()}")

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def row_counts(self) -> DataFrame:
        """``collection, n_rows`` of every collection."""
        parts = [self.scan(n).agg(F.lit(n).alias("collection"), F.count("*").alias("n_rows")) for n in self.names()]
        if not parts:
            return self.spark.createDataFrame([], "collection string, n_rows long")
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def describe(self, name: str) -> DataFrame:
        return self.spark.sql(f"DESCRIBE TABLE {self._table(name)}")

    def dim(self, name: str) -> int:
        return int(self._property(name, "vector.dim"))

    def snapshot(self, name: str) -> str:
        """The folder that the collection's rows are in now."""
        rows = self.spark.sql(f"DESCRIBE FORMATTED {self._table(name)}").where("col_name = 'Location'")
        return rows.first().data_type

    def _property(self, name: str, key: str) -> str | None:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self._table(name)}").where(F.col("key") == key).collect()
        return rows[0]["value"] if rows else None

    def _deltas(self, name: str) -> Deltas:
        """Changes since the current snapshot."""
        return Deltas(self.spark, f"{self.root}/{name.lower()}/changes-{self._property(name, 'vector.changes')}", self._stored(name).schema, "id")

    def _stored(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name.lower()}")

    def scan(self, name: str) -> DataFrame:
        """The whole collection."""
        rows = self._stored(name)
        return self._deltas(name).over(rows, send_if_small) if "version" in rows.columns else rows

    def query(self, name: str, condition: str, fields: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
        """Rows that satisfy a SQL condition; condition and fields reach the file scan."""
        rows = self.scan(name).where(condition)
        rows = rows.select(*fields) if fields else rows
        return rows if limit is None else rows.limit(limit)

    def insert_rows(self, name: str, rows: DataFrame, records_per_file: int = 1_000_000) -> None:
        """Append records. Bad vectors fail the write; missing columns become NULL."""
        target = self._stored(name)
        for field in target.schema:
            if field.name not in rows.columns:
                rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
        typed = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema])
        checked = require_valid(typed, self.dim(name))
        (
            checked.write.mode("append")
            .option("maxRecordsPerFile", records_per_file)
            .insertInto(f"{self.database}.{name.lower()}")
        )

    def insert_vectors(
        self,
        name: str,
        vectors: DataFrame,
        chunks: DataFrame,
        key: str = "chunk_id",
        strict: bool = True,
    ) -> None:
        """Append vectors and their chunks, paired by key. ``strict`` refuses unpaired rows and repeated keys."""
        if strict:
            missing = unpaired(vectors, chunks, key).first()
            if missing.only_left or missing.only_right:
                raise ValueError(f"{missing.only_left} vectors and {missing.only_right} chunks have no partner")
            for side, rows in (("vectors", vectors), ("chunks", chunks)):
                twice = rows.groupBy(key).count().where("count > 1").first()
                if twice:
                    raise ValueError(f"key {twice[0]!r} stands for {twice[1]} {side}")
        paired = pair_rows(vectors, chunks, key)
        self.insert_rows(
            name,
            paired.withColumn("id", F.col(key).cast("string")).withColumn("payload", F.create_map(F.lit("chunk"), "text")),
        )

    def compact(self, name: str) -> None:
        """Fold all changes into a new snapshot; the one before and its changes stay for running readers, older ones go."""
        folder, changes = self._fresh_folder(name), uuid.uuid4().hex[:12]
        self.scan(name).select(self._stored(name).columns).write.parquet(folder)
        for old in (self._property(name, "vector.before"), self._property(name, "vector.changes_before")):
            if old:
                remove_folder(self.spark, old)
        before, done = self.snapshot(name), self._deltas(name).path
        self.spark.sql(
            f"ALTER TABLE {self._table(name)} SET TBLPROPERTIES ('vector.before' = '{before}', "
            f"'vector.changes_before' = '{done}', 'vector.changes' = '{changes}')"
        )
        self.spark.sql(f"ALTER TABLE {self._table(name)} SET LOCATION '{folder}'")
        self.spark.catalog.refreshTable(f"{self.database}.{name.lower()}")

    def compact_buckets(self, name: str, most_sets: int = 4) -> list[int]:
        """Fold the change sets of buckets that have many; the snapshot and all other buckets keep their files."""
        return self._deltas(name).compact(most_sets)

    def upsert(self, name: str, changes: DataFrame, key: str = "id", version: str = "version", token: tuple[str, int] | None = None) -> None:
        """Insert or replace by key. The highest version of a key wins, also over the stored row.

        Only the changes are written. ``token`` (writer, number) makes a repeated change set a no-op.
        """
        last = latest_per_key(changes.withColumnRenamed(version, "version"), [key], ["version"])
        target = self._stored(name)
        for field in target.schema:
            if field.name not in last.columns:
                last = last.withColumn(field.name, F.lit(None).cast(field.dataType))
        typed = last.select([F.col(key if f.name == "id" else f.name).cast(f.dataType).alias(f.name) for f in target.schema])
        self._deltas(name).put(require_valid(typed, self.dim(name)), token)

    def delete(self, name: str, keys: DataFrame, key: str = "id") -> None:
        """Remove the rows with the given keys."""
        self._deltas(name).erase(keys.select(F.col(key).alias("id")))


def pair_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Match two lists by an explicit key instead of by position."""
    return left.join(right, key)


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many rows of either side have no partner."""
    only_left = left.select(key).join(right.select(key), key, "left_anti").select(F.lit("left").alias("_side"))
    only_right = right.select(key).join(left.select(key), key, "left_anti").select(F.lit("right").alias("_side"))
    return only_left.unionByName(only_right).agg(
        F.count(F.when(F.col("_side") == "left", 1)).alias("only_left"),
        F.count(F.when(F.col("_side") == "right", 1)).alias("only_right"),
    )


def merged(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Current rows without a change, and the changed rows. ``changes`` has one row per key.

    The keys of a small change set are sent to the current rows, which are then not shuffled.
    """
    typed = changes
    for field in current.schema:
        if field.name not in changes.columns:
            typed = typed.withColumn(field.name, F.lit(None).cast(field.dataType))
    typed = typed.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in current.schema])
    untouched = current.join(send_if_small(changes.select(key)), key, "left_anti").select(current.columns)
    return untouched.unionByName(typed)


def apply_changes(current: DataFrame, feed: DataFrame, key: str = "id", version: str = "version", op: str = "op") -> DataFrame:
    """A change feed of inserts, updates and deletes: the highest version of a key decides."""
    last = latest_per_key(feed, [key], [version])
    kept = merged(current, last, key)
    gone = send_if_small(last.where(F.col(op) == "delete").select(key))
    return kept.join(gone, key, "left_anti").select(current.columns)
