"""A log of small JSON entries, each published by one atomic rename, under rising sequence numbers."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


class ConflictError(RuntimeError):
    """Another writer published the same sequence number first."""


class Manifest:
    """Entries below ``base``, a folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.base).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.base).toUri(), conf)
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename

    def sequences(self) -> list[int]:
        folder = self._path(f"{self.base}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, sequence: int) -> dict:
        stream = self._fs.open(self._path(f"{self.base}/commits/{sequence:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> dict | None:
        known = self.sequences()
        return self.read(known[-1]) if known else None

    def publish(self, sequence: int, entry: dict) -> None:
        """Make ``entry`` number ``sequence``, or fail if that number is taken."""
        hidden = self._path(f"{self.base}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        target = self._path(f"{self.base}/commits/{sequence:020d}.json")
        none = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        none[0] = self._rename.NONE
        try:
            self._context.rename(hidden, target, none)
        except Exception as error:
            self._fs.delete(hidden, False)
            raise ConflictError(f"sequence {sequence} is taken") from error

    def remove_unused(self, prefix: str, used: set[str], older_than_s: int) -> int:
        """Delete folders that begin with ``prefix``, are not ``used`` and were not touched for so long."""
        root, gone = self._path(self.base), 0
        for s in self._fs.listStatus(root) if self._fs.exists(root) else []:
            name = s.getPath().getName()
            if name.startswith(prefix) and name not in used and s.getModificationTime() <= (time.time() - older_than_s) * 1000:
                gone += self._fs.delete(s.getPath(), True)
        return gone

    def ensure(self, folder: str) -> None:
        self._fs.mkdirs(self._path(f"{self.base}/{folder}"))
