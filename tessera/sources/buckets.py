"""Tables in hash buckets that are kept over runs: a change writes the buckets that it touches anew, and one rename makes it visible.

A store is a folder of Parquet in ``table/store_version=VERSION/store_bucket=K``. A manifest names the version that each bucket of each table
has; it is written beside and renamed into place, so a failed change leaves the state before, readers see all of
a change or nothing, and of two writers at once the later one fails. A bucket is always one folder, which its next
change compacts. Works in any folder that Spark's file systems reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import kept

BUCKETS = 64


class BucketStore:
    """Named tables, each dealt into buckets by the hash of one of its columns.

    ``keys`` gives that column for each table. The number of buckets is fixed when the folder is first written.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), dict(keys)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        number, manifest = self._latest()
        self.buckets = manifest["buckets"] if number else buckets

    # --- manifests

    def _latest(self) -> tuple[int, dict]:
        where = self._path(f"{self.folder}/_manifests")
        names = [s.getPath().getName() for s in self._files.listStatus(where)] if self._files.exists(where) else []
        number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
        if not number:
            return 0, {"buckets": None, "tables": {}}
        stream = self._files.open(self._path(f"{self.folder}/_manifests/{number}.json"))
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int:
        """How often the store has changed."""
        return self._latest()[0]

    def _publish(self, number: int, manifest: dict) -> None:
        jvm = self.spark._jvm
        draft = self._path(f"{self.folder}/_manifests/{uuid.uuid4().hex}.draft")
        stream = self._files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, self._path(f"{self.folder}/_manifests/{number}.json"), none)  # fails where that number exists

    # --- rows

    @staticmethod
    def _fits(state: dict | None, table: str, rows: DataFrame) -> DataFrame:
        """rows with the table's columns in its order."""
        if state is None:
            return rows
        names = StructType.fromJson(state["schema"]).names
        if set(names) != set(rows.columns):
            raise ValueError(f"{table} has the columns {names}")
        return rows.select(*names)

    def bucket(self, column: Column | str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets of the table that the keys of rows fall into."""
        return sorted(r[0] for r in rows.select(self.bucket(self.keys[table])).distinct().collect())

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The table, or only some of its buckets: others aren't read. None where it has never been written."""
        _, manifest = self._latest()
        state = manifest["tables"].get(table)
        if state is None:
            return None
        schema = StructType.fromJson(state["schema"])
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.folder}/{table}/store_version={v}/store_bucket={k}" for k, v in sorted(state["versions"].items(), key=lambda x: int(x[0])) if wanted is None or int(k) in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(StructType(schema.fields).add("store_version", "string").add("store_bucket", "integer")).option("basePath", f"{self.folder}/{table}").parquet(*paths)
        return (found if wanted is None else found.where(F.col("store_bucket").isin(*sorted(wanted)))).select(*schema.names)

    def replace(self, changes: dict[str, tuple[Iterable[int], DataFrame]]) -> int:
        """Give the named buckets of each table these rows and no others; all of it becomes visible at once. The new version."""
        number, manifest = self._latest()
        manifest["buckets"] = self.buckets
        version = f"{number + 1}-{uuid.uuid4().hex[:8]}"
        for table, (buckets, rows) in changes.items():
            gone = set(buckets)
            state = manifest["tables"].setdefault(table, {"schema": json.loads(rows.schema.json()), "versions": {}})
            rows = self._fits(state, table, rows)
            path = f"{self.folder}/{table}/store_version={version}"
            dealt = rows.withColumn("store_bucket", self.bucket(self.keys[table])).where(F.col("store_bucket").isin(*sorted(gone)) if gone else F.lit(False))
            dealt.hint("rebalance", "store_bucket").write.partitionBy("store_bucket").parquet(path)
            written = {s.getPath().getName().removeprefix("store_bucket=") for s in self._files.listStatus(self._path(path)) if s.isDirectory()}
            state["versions"] = {k: v for k, v in state["versions"].items() if int(k) not in gone} | {k: version for k in written if k.isdigit()}
        self._publish(number + 1, manifest)
        return number + 1

    def put(self, table: str, rows: DataFrame) -> int:
        """Rows by key: those with a new key are added, others take the place of the old ones."""
        rows = kept(self._fits(self._latest()[1]["tables"].get(table), table, rows))
        touched = self.touched(table, rows)
        if not touched:
            return self.version()
        old, key = self.read(table, touched), self.keys[table]
        whole = rows if old is None else old.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)
        return self.replace({table: (touched, whole)})

    def add(self, table: str, rows: DataFrame) -> int:
        """Those of rows whose key the table lacks, one for each key; where there are none, nothing is written."""
        key = self.keys[table]
        rows = kept(self._fits(self._latest()[1]["tables"].get(table), table, rows))
        touched = self.touched(table, rows)
        old = self.read(table, touched)
        fresh = rows.dropDuplicates([key])
        if old is not None:
            fresh = kept(fresh.join(old.select(key), key, "left_anti").select(*rows.columns))
        if fresh.isEmpty():
            return self.version()
        touched = self.touched(table, fresh)
        old = self.read(table, touched)
        return self.replace({table: (touched, fresh if old is None else old.unionByName(fresh))})

    def remove(self, table: str, keys: DataFrame) -> int:
        """The table without the rows that have these keys."""
        key = self.keys[table]
        keys = kept(keys.select(key).distinct())
        touched = self.touched(table, keys)
        old = self.read(table, touched)
        return self.version() if old is None or not touched else self.replace({table: (touched, old.join(keys, key, "left_anti"))})

    def sweep(self) -> int:
        """Delete the versions that no bucket has any more, and older manifests; how many folders went. Not while others read or write."""
        number, manifest = self._latest()
        gone = 0
        for table, state in manifest["tables"].items():
            live = set(state["versions"].values())
            for s in self._files.listStatus(self._path(f"{self.folder}/{table}")):
                if s.getPath().getName().removeprefix("store_version=") not in live:
                    gone += self._files.delete(s.getPath(), True)
        for s in self._files.listStatus(self._path(f"{self.folder}/_manifests")) if number else []:
            if s.getPath().getName() != f"{number}.json":
                self._files.delete(s.getPath(), False)
        return gone

    def clear(self) -> None:
        self._files.delete(self._path(self.folder), True)
