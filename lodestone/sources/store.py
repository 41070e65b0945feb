"""Several tables that change together.

A commit writes new segments and then publishes one entry that names the segments of every table; a reader resolves it
once and sees either all of a change or none of it. Tables whose rows belong to documents grow by segments: a change
writes the rows of the documents it brings and the ids of those it replaces or removes, and a reader leaves out rows
older than the last removal of their document. So a commit costs what it changes; every ``COMPACT`` changes the segments
are brought together.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.manifest import Manifest

TABLES = {
    "settings": "key string, value string",
    "directories": "path string",
    "documents": "id string, root string, path string, name string, extension string, modified_ms bigint, size bigint, embedding array<float>, indexed_at timestamp",
    "chunks": "id bigint, document_id string, position int, text string",
    "vectors": "chunk_id bigint, document_id string, extension string, buckets array<int>, weights array<double>",
    "document_vectors": "document_id string, extension string, buckets array<int>, weights array<double>",
    "postings": "term string, chunk_id bigint, document_id string, tf int, dl int",
    "lengths": "chunk_id bigint, document_id string, dl int",
    "failures": "path string, category string, reason string, updated_at timestamp",
}


#: Tables whose rows belong to a document, and the column with its id.
OWNED = {"documents": "id", "chunks": "document_id", "vectors": "document_id", "document_vectors": "document_id", "postings": "document_id", "lengths": "document_id"}
#: Changes after which the segments of a table are brought together, and tables written at a time.
COMPACT, TOGETHER = 20, 4


class Store:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.manifest = spark, Manifest(spark, base)
        #: Seconds that each table took in the last change.
        self.took: dict[str, float] = {}

    def version(self) -> int:
        known = self.manifest.sequences()
        return known[-1] if known else 0

    def _entry(self, version: int) -> dict:
        return self.manifest.read(version) if version else {"tables": {}, "removed": []}

    def _segment(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.manifest.base}/{folder}")

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version; tables that were never written are empty."""
        entry = self._entry(self.version() if version is None else version)
        return {n: self._visible(n, entry) for n in TABLES}

    def _visible(self, name: str, entry: dict) -> DataFrame:
        segments = entry["tables"].get(name, [])
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        removed = [x for x in entry["removed"] if name in OWNED and x[0] > segments[0][0]]
        if not removed:
            return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.manifest.base}/{f}" for _, f in segments])
        union = lambda a, b: a.unionByName(b)
        rows = reduce(union, [self._segment(f, TABLES[name]).withColumn("__at", F.lit(at)) for at, f in segments])
        gone = reduce(union, [self._segment(f, "document_id string").withColumn("__gone", F.lit(at)) for at, f in removed])
        last = gone.groupBy(F.col("document_id").alias("__owner")).agg(F.max("__gone").alias("__gone"))
        older = (rows[OWNED[name]] == last["__owner"]) & (rows["__at"] < last["__gone"])
        return rows.join(last, older, "left_anti").drop("__at")

    def _write(self, frames: dict[str, DataFrame]) -> dict[str, str]:
        """Write each frame to a folder of its own, several at a time."""
        names = {n: f"{n}-{uuid.uuid4().hex}" for n in frames}

        def one(name: str) -> None:
            began = time.monotonic()
            schema = self.spark.createDataFrame([], TABLES.get(name, "document_id string")).schema
            df = frames[name]
            df = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
            # in order of term, so that a search reads only the parts of a file that hold its terms
            (df.sortWithinPartitions("term") if name == "postings" else df).write.parquet(f"{self.manifest.base}/{names[name]}")
            self.took[name] = self.took.get(name, 0.0) + time.monotonic() - began

        with ThreadPoolExecutor(TOGETHER) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(one), frames))
        return names

    def commit(self, based_on: int, changed: dict[str, DataFrame]) -> int:
        """Write ``changed`` as a whole and publish it as the version after ``based_on``; fails if another writer was faster."""
        return self.change(based_on, None, {}, changed)

    def change(self, based_on: int, removed: DataFrame | None, added: dict[str, DataFrame], whole: dict[str, DataFrame], committing: Callable = nullcontext) -> int:
        """Publish the version after ``based_on``: without the documents ``removed`` (``document_id``), with the rows ``added``.

        ``removed`` takes the documents' rows out of all tables that have such, ``added`` comes after it; tables in ``whole``
        are written anew. ``committing`` gives the context in which the version is published.
        """
        self.took = {}
        entry, at = self._entry(based_on), based_on + 1
        frames = {**added, **whole}
        if removed is not None and based_on:
            frames["removed"] = removed.select("document_id").distinct()
        written = self._write(frames)
        tables = {n: list(x) for n, x in entry["tables"].items()}
        for name in added:
            tables[name] = [*tables.get(name, []), [at, written[name]]]
        for name in whole:
            tables[name] = [[at, written[name]]]
        gone = [*entry["removed"], *([[at, written["removed"]]] if "removed" in written else [])]
        new = {"tables": tables, "removed": gone}
        if max((len(x) for x in tables.values()), default=0) > COMPACT:
            many = [n for n in OWNED if len(tables.get(n, [])) > 1]
            together = self._write({n: self._visible(n, new) for n in many})
            tables |= {n: [[at, f]] for n, f in together.items()}
        # removals older than every segment have nothing left to remove
        oldest = min((x[0][0] for n, x in tables.items() if n in OWNED), default=at)
        new["removed"] = [x for x in gone if x[0] > oldest]
        with committing():
            self.manifest.publish(at, new)
        return at
