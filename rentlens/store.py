"""Derived tables on shared storage, found again by later sessions.

A table's key is a digest of its sources' files (names, sizes, times of change), the
code that derives it and the settings it depends on: other data or another version has
another key, so a table is never stale. A table is written to a folder of its own and
published by a manifest, a small file that is renamed into place when all is written:
readers see a whole table or none, and of two writers one wins. A reader holds a lease;
expired tables without a lease are deleted by `sweep`.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def code_version() -> str:
    """Digest of the package's own source."""
    top = Path(__file__).resolve().parent
    digest = hashlib.sha256()
    for folder in ("functions", "operators", "plans", "sources"):
        for path in sorted((top / folder).glob("*.py")):
            digest.update(path.read_bytes())
    return digest.hexdigest()


class Files:
    """The few calls on a Hadoop file system that the store needs."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def of(self, path: str):
        return self.path(path).getFileSystem(self.conf)

    def listed(self, folder: str) -> list:
        fs = self.of(folder)
        return list(fs.listStatus(self.path(folder))) if fs.exists(self.path(folder)) else []

    def read(self, path: str) -> str | None:
        fs = self.of(path)
        if not fs.exists(self.path(path)):
            return None
        stream = fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Writes aside and renames into place; False if another was first."""
        fs, aside = self.of(path), self.path(f"{path}.{uuid.uuid4().hex}.part")
        stream = fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(self.path(path)) or not fs.rename(aside, self.path(path)):
            fs.delete(aside, False)
            return False
        return True

    def delete(self, path: str) -> None:
        self.of(path).delete(self.path(path), True)


class Store:
    def __init__(self, spark: SparkSession, root: str, keep_seconds: float = 86_400.0) -> None:
        self.spark, self.root, self.keep_seconds, self.files = spark, f"{root}/rentlens-store", keep_seconds, Files(spark)
        self.session = uuid.uuid4().hex

    def snapshot(self, frames: dict[str, DataFrame]) -> str | None:
        """A digest of the files behind the frames, or None if one of them reads no files."""
        found = []
        for name, frame in sorted(frames.items()):
            paths = sorted(frame.inputFiles())
            if not paths:
                return None
            for path in paths:
                status = self.files.of(path).getFileStatus(self.files.path(path))
                found.append([name, path, status.getLen(), status.getModificationTime()])
        return hashlib.sha256(json.dumps(found).encode()).hexdigest()

    def _manifest(self, key: str) -> str:
        return f"{self.root}/manifests/{key}.json"

    def find(self, key: str) -> DataFrame | None:
        """The published table, leased to this session."""
        text = self.files.read(self._manifest(key))
        if text is None:
            return None
        manifest = json.loads(text)
        if manifest["expires"] < time.time():
            return None
        self.lease(key)
        # Who deletes looks for leases after the manifest is gone; a table that went meanwhile is built anew.
        if self.files.read(self._manifest(key)) is None:
            return None
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(manifest["path"])

    def put(self, key: str, frame: DataFrame, folders: str | None = None) -> DataFrame:
        """Writes and publishes a table; if another session has done so meanwhile, theirs is used."""
        path = f"{self.root}/tables/{key}-{uuid.uuid4().hex}"
        writer = frame.write
        (writer.partitionBy(folders) if folders else writer).parquet(path)
        manifest = {"path": path, "schema": frame.schema.jsonValue(), "expires": time.time() + self.keep_seconds}
        if not self.files.publish(self._manifest(key), json.dumps(manifest)):
            if (theirs := self.find(key)) is not None:
                self.files.delete(path)
                return theirs
            self.files.delete(self._manifest(key))  # an expired one
            self.files.publish(self._manifest(key), json.dumps(manifest))
        self.lease(key)
        return self.spark.read.schema(frame.schema).parquet(path)

    def lease(self, key: str) -> None:
        """A file per session and table, good for as long as tables are kept."""
        path = f"{self.root}/leases/{key}/{self.session}"
        self.files.delete(path)
        self.files.publish(path, json.dumps(time.time() + self.keep_seconds))

    def release(self) -> None:
        """Ends this session's leases."""
        for folder in self.files.listed(f"{self.root}/leases"):
            self.files.delete(f"{folder.getPath().toString()}/{self.session}")

    def _leased(self, key: str) -> bool:
        texts = (self.files.read(x.getPath().toString()) for x in self.files.listed(f"{self.root}/leases/{key}"))
        return any(t and float(json.loads(t)) > time.time() for t in texts)

    def sweep(self) -> list[str]:
        """Deletes expired tables that no live lease holds, and folders that were never published; the keys that went."""
        gone, held = [], set()
        for entry in self.files.listed(f"{self.root}/manifests"):
            name = entry.getPath().getName()
            if not name.endswith(".json"):
                continue
            key, text = name.removesuffix(".json"), self.files.read(entry.getPath().toString())
            manifest = json.loads(text) if text else None
            if manifest is None:
                continue
            if manifest["expires"] >= time.time() or self._leased(key):
                held.add(manifest["path"].rsplit("/", 1)[1])
                continue
            self.files.delete(self._manifest(key))
            if not self._leased(key):
                self.files.delete(manifest["path"])
            self.files.delete(f"{self.root}/leases/{key}")
            gone.append(key)
        old = (time.time() - self.keep_seconds) * 1000
        for entry in self.files.listed(f"{self.root}/tables"):
            # A folder that nothing names and nobody has touched for long was left by a failed writer.
            if entry.getPath().getName() not in held and entry.getModificationTime() < old:
                self.files.delete(entry.getPath().toString())
        return gone
