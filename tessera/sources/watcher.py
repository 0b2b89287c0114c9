"""A folder as a stream of changes: a data source whose offsets are listings of the folder."""

from __future__ import annotations

import base64
import json
import os
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tessera.sources.files import PROBE_BYTES, list_files

SCHEMA = "path string, language_key string, kind string, generation long, text string, skip_reason string"
UPSERT, DELETE = "upsert", "delete"
#: Files that one task reads.
FILES_A_TASK = 64


def _pack(listing: dict) -> str:
    return base64.b64encode(zlib.compress(json.dumps(listing, sort_keys=True).encode())).decode()


def _unpack(offset: dict) -> dict:
    return json.loads(zlib.decompress(base64.b64decode(offset["listing"]))) if offset.get("listing") else {}


def _folders(paths: dict) -> set[str]:
    out: set[str] = set()
    for p in paths:
        while "/" in p and (p := p.rpartition("/")[0]) not in out:
            out.add(p)
    return out


def changes_between(before: dict, after: dict) -> tuple[list[str], list[str]]:
    """Paths that are new or have changed, and paths that are gone: files, and folders in which nothing is left."""
    upserts = sorted(p for p, seen in after.items() if before.get(p) != seen)
    return upserts, sorted((before.keys() - after.keys()) | (_folders(before) - _folders(after)))


class Changes(InputPartition):
    def __init__(self, rows: list[tuple], generation: int):
        self.rows, self.generation = rows, generation


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.excludes = tuple(x for x in options.get("excludes", "").split("\n") if x)
        self.most = int(options.get("maxKb", "1024")) * 1024
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"at": 0, "listing": ""}

    def latestOffset(self) -> dict:
        listing = {}
        for full, path, key in list_files(self.root, self.excludes):
            try:
                s = os.stat(full)
            except OSError:  # gone since
                continue
            listing[path] = [s.st_mtime_ns, s.st_size, key]
        packed = _pack(listing)
        if self.last is None or self.last["listing"] != packed:
            self.last = {"at": time.time_ns(), "listing": packed}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after = _unpack(end)
        upserts, gone = changes_between(_unpack(start), after)
        rows = [(p, after[p][2], UPSERT) for p in upserts] + [(p, None, DELETE) for p in gone]
        return [Changes(rows[i : i + FILES_A_TASK], end["at"]) for i in range(0, len(rows), FILES_A_TASK)] or [Changes([], end["at"])]

    def read(self, partition: Changes) -> Iterator[tuple]:
        for path, key, kind in partition.rows:
            text = reason = None
            if kind == UPSERT:
                full = os.path.join(self.root, path)
                try:
                    if os.path.getsize(full) > self.most:
                        reason = "too large"
                    else:
                        with open(full, "rb") as f:
                            data = f.read()
                        if b"\0" in data[:PROBE_BYTES]:
                            reason = "binary"
                        else:
                            text = data.decode("utf-8", "replace")
                except FileNotFoundError:
                    key, kind = None, DELETE
                except OSError as e:
                    reason = f"unreadable ({e.strerror})"
            yield path, key, kind, partition.generation, text, reason

    def commit(self, end: dict) -> None:
        pass


class FolderChanges(DataSource):
    """``folder_changes``: an upsert with its text for each source file that is new or has changed since the last batch, and a
    delete for each file that is gone and each folder with nothing left in it.

    Options: path, excludes (globs, one a line), maxKb. A batch's two listings stand in the query's checkpoint, so a query
    that starts again gives what has changed meanwhile, and a batch that is repeated has the same paths. Generations grow
    with time. The folder must be one that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))


def watch_folder(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), max_kb: int = 1024) -> DataFrame:
    """The stream of changes below a folder; the first batch has all of its files."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("path", os.path.abspath(root)).option("excludes", "\n".join(excludes)).option("maxKb", str(max_kb)).load()
