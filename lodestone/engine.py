"""The search engine: one object over a store, with the operations of a document-search service."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.vectors import BUCKETS
from lodestone.operators import catalog, keyword, search, sync
from lodestone.operators.chunking import prepare
from lodestone.runtime import cut
from lodestone.sources import files
from lodestone.sources.store import Store

#: Names the vectors of this build; stored vectors of another profile are made anew.
PROFILE = "hashed-768-v1"
# The stages of an index task, and those that are timed.
STAGES = ["ready", "starting", "scanning", "checking", "parsing", "embedding", "storage", "text_index", "committing"]
TIMED = ["scan", "check", "parse", "embedding", "storage", "text_index"]


class BusyError(RuntimeError):
    """A full index is being built already."""


class SearchEngine:
    def __init__(self, spark: SparkSession, base: str, roots: list[str] | None = None) -> None:
        self.spark, self.store = spark, Store(spark, base)
        self.roots = sync.normalize_roots(roots or [])
        self._busy = threading.Lock()
        self._index: tuple[int, search.Index] | None = None
        #: Seconds of each timed stage of the last task; where it is, since when, and its files.
        self.timings: dict[str, float] = {}
        self.stage, self.stage_began, self.task_began = "ready", time.monotonic(), None
        self.processed, self.total, self.watcher = 0, 0, "starting"

    # reading

    def health(self) -> dict:
        return {"status": "ok", "version": self.store.version()}

    def stats(self) -> DataFrame:
        """One row: the counts, the extensions and directories in order, the time of the last index, the profile, the
        progress and the stage times of the task that runs or ran last."""
        t = self.store.read()
        settings = t["settings"].groupBy().agg(
            F.max(F.when(F.col("key") == "last_indexed", F.col("value"))).alias("last_indexed"),
            F.max(F.when(F.col("key") == "embedding_profile", F.col("value"))).alias("embedding_model"),
        )
        facets = t["documents"].agg(F.array_sort(F.collect_set(F.when(F.col("extension") != "", F.col("extension")))).alias("extensions"))
        folders = t["directories"].agg(F.array_sort(F.collect_set("path")).alias("directories"))
        row = catalog.counts(t["documents"], t["chunks"], t["failures"])
        for other in (settings, facets, folders):
            row = row.join(F.broadcast(other))
        now = time.monotonic()
        shown = {
            "status": F.lit("indexing" if self._busy.locked() else "ready"),
            "processed_files": F.lit(self.processed).cast("bigint"),
            "total_files": F.lit(self.total).cast("bigint"),
            "index_stage": F.lit(self.stage),
            "index_stage_elapsed_ms": F.lit(int((now - self.stage_began) * 1000)).cast("bigint"),
            "index_total_elapsed_ms": F.lit(int(sum(self.timings.values()) * 1000) if self.task_began is None else int((now - self.task_began) * 1000)).cast("bigint"),
            **{f"index_{x}_ms": F.lit(int(self.timings.get(x, 0.0) * 1000)).cast("bigint") for x in TIMED},
            "storage_backend": F.lit("parquet segments"),
            "embedding_backend": F.lit("fallback"),
            "watcher_status": F.lit(self.watcher),
        }
        return row.withColumns(shown)

    def documents(self, offset: int = 0, limit: int = 50) -> DataFrame:
        return catalog.document_page(self.store.read()["documents"].drop("embedding"), offset, limit)

    def document(self, path: str) -> DataFrame:
        return catalog.document_by_path(self.store.read()["documents"], path)

    def chunk(self, chunk_id: int) -> DataFrame:
        return catalog.chunk_by_id(self.store.read()["chunks"], chunk_id)

    def setting(self, key: str) -> str | None:
        return catalog.setting(self.store.read()["settings"], key)

    def chunks(self, offset: int = 0, limit: int = 50) -> DataFrame:
        t = self.store.read()
        return catalog.chunk_page(t["chunks"], t["documents"], offset, limit)

    def failures(self, offset: int = 0, limit: int = 50) -> DataFrame:
        return catalog.failure_page(self.store.read()["failures"], offset, limit)

    def index(self) -> search.Index:
        """The index of the current version, kept while the version stays."""
        version = self.store.version()
        if self._index is None or self._index[0] != version:
            t = self.store.read(version)
            docs = search.clean_documents(t["documents"])
            index = search.Index(docs, search.clean_chunks(t["chunks"]), keyword.Postings(t["postings"], t["lengths"]), t["vectors"], t["document_vectors"])
            self._index = (version, index)
        return self._index[1]

    def search_many(self, requests: DataFrame) -> DataFrame:
        return search.search(requests, self.index())

    def search(self, query: str, mode: str = "hybrid", extension: str | None = None, limit: int = 20) -> DataFrame:
        if not query.strip():
            raise ValueError("the query is blank")
        schema = "query_id bigint, query string, search_mode string, extension string, max_results int"
        request = self.spark.createDataFrame([(0, query, mode, extension, limit)], schema)
        return self.search_many(request).orderBy("rank")

    # writing

    def sync(self, roots: list[str] | None = None) -> int:
        """Bring the store in step with the files of all roots; one at a time."""
        if not self._busy.acquire(blocking=False):
            raise BusyError("an index task is running")
        try:
            if roots is not None:
                self.roots = sync.normalize_roots(roots)
            return self._full()
        finally:
            self._busy.release()

    @contextmanager
    def _in(self, stage: str, timed: str | None = None) -> Iterator[None]:
        began = time.monotonic()
        self.stage, self.stage_began = stage, began
        try:
            yield
        finally:
            if timed:
                self.timings[timed] = self.timings.get(timed, 0.0) + time.monotonic() - began

    @contextmanager
    def _task(self) -> Iterator[None]:
        """An index task from its start to its end, however it ends."""
        self.timings, self.processed, self.total = {}, 0, 0
        self.task_began = time.monotonic()
        try:
            with self._in("starting"):
                yield
        finally:
            self.stage, self.stage_began, self.task_began = "ready", time.monotonic(), None

    def _full(self) -> int:
        with self._task():
            version = self.store.version()
            t = self.store.read(version)
            folders = self.spark.createDataFrame([(r,) for r in self.roots], "path string")
            with self._in("scanning", "scan"):
                seen, status, failed = files.scan_roots(self.spark, self.roots)
                scan = cut(seen.join(sync.longest_root(seen, folders).toDF("path", "own"), "path").where("root = own").drop("own"))
                self.total = scan.count()
            complete = status.where("complete").select("root")
            kept = t["documents"].join(folders.withColumnRenamed("path", "root"), "root", "left_semi")
            with self._in("checking", "check"):
                gone = sync.orphaned_by_roots(t["documents"], folders).select("id").unionByName(sync.vanished(kept, scan, complete).select("id"))
                jobs = cut(sync.changed_files(scan, kept))
                self.processed = self.total - jobs.count()
            return self._apply(version, t, jobs, gone, sync.failures_of(failed), fresh_failures=True, directories=folders)

    def apply_changes(self, paths: DataFrame) -> int:
        """Handle changed paths: files are read anew if they differ, folders walked, missing paths removed with all below.

        Only these paths are looked at. A folder that cannot be read keeps its documents. Paths under no root are passed
        over. Doing it twice changes nothing but the time of the last index.
        """
        with self._busy, self._task():
            version = self.store.version()
            t = self.store.read(version)
            folders = self.spark.createDataFrame([(r,) for r in self.roots], "path string")
            with self._in("checking", "check"):
                seen, read = files.scan_paths(paths)
                named = seen.join(sync.longest_root(seen, folders), "path").select("path", "root", "modified_ms", "size")
                touched = sync.below_any(t["documents"], read)
                gone = touched.join(named.select("path"), "path", "left_anti").select("id")
                jobs = cut(sync.changed_files(named, t["documents"], BUCKETS))
                self.total = jobs.count()
            return self._apply(version, t, jobs, gone, None, fresh_failures=False)

    def _apply(self, version: int, t: dict[str, DataFrame], jobs: DataFrame, gone: DataFrame, failed: DataFrame | None, fresh_failures: bool, directories: DataFrame | None = None) -> int:
        with self._in("parsing", "parse"):
            read = cut(files.extract(jobs))
            prepared = cut(prepare(read.where("text is not null")))
        now = F.current_timestamp()
        names = prepared.select("id", "name", "extension")
        parts = prepared.select(F.col("id").alias("document_id"), F.posexplode("chunks").alias("position", "text"))
        parts = parts.select(F.xxhash64("document_id", "position").alias("id"), "document_id", "position", "text")
        fresh = search.clean_chunks(parts)
        with self._in("embedding", "embedding"):
            vectors = cut(search.hashed_chunk_vectors(fresh, names))
        each = vectors.select("document_id", "extension", F.explode(F.arrays_zip("buckets", "weights")).alias("e"))
        sums = each.groupBy("document_id", "extension", F.col("e.buckets").alias("b")).agg(F.sum("e.weights").alias("s"))
        own = sums.groupBy("document_id", "extension").agg(F.array_sort(F.collect_list(F.struct("b", "s"))).alias("m"))
        norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda t, x: t + x["s"] * x["s"]))
        own = own.select("document_id", "extension", F.transform("m", lambda x: x["b"]).alias("buckets"), "m", norm.alias("n"))
        own = own.select("document_id", "extension", "buckets", F.transform("m", lambda x: x["s"] / F.col("n")).alias("weights"))
        entries = F.map_from_arrays("buckets", "weights").alias("m")
        dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0.0)).cast("float"))
        embedded = own.select(F.col("document_id").alias("id"), entries).select("id", dense.alias("embedding"))
        nothing = F.array_repeat(F.lit(0.0).cast("float"), BUCKETS)  # of a text without terms
        new = prepared.drop("chunks").join(embedded, "id", "left").withColumn("embedding", F.coalesce("embedding", nothing)).withColumn("indexed_at", now)
        out = gone.select("id").unionByName(prepared.select("id")).distinct()
        owners = out.withColumnRenamed("id", "document_id")
        added = keyword.build_postings(fresh, names)
        bad = read.where("reason is not null").select("path", "category", "reason").withColumn("updated_at", now)
        if failed is not None:
            bad = bad.unionByName(failed.withColumn("updated_at", now))
        solved = t["failures"].join(prepared.select("path"), "path", "left_anti")
        settings = self.spark.createDataFrame([("embedding_profile", PROFILE)], "key string, value string").unionByName(self.spark.range(1).select(F.lit("last_indexed").alias("key"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("value")))
        rows = {"documents": new, "chunks": parts, "vectors": vectors, "document_vectors": own, "postings": added.terms, "lengths": added.lengths}
        whole = {"failures": bad if fresh_failures else sync.record_failures(solved, bad), "settings": sync.put_settings(t["settings"], settings)}
        if directories is not None:
            whole["directories"] = directories.distinct()
        with self._in("storage"):
            done = self.store.change(version, owners, rows, whole, committing=lambda: self._in("committing"))
        index = {"postings", "lengths"}
        for name, seconds in self.store.took.items():
            stage = "text_index" if name in index else "storage"
            self.timings[stage] = self.timings.get(stage, 0.0) + seconds
        self.processed = self.total
        return done

    def rebuild(self) -> int:
        """Make the inverted index anew from the tables."""
        version = self.store.version()
        t = self.store.read(version)
        built = keyword.build_postings(search.clean_chunks(t["chunks"]), t["documents"])
        return self.store.commit(version, {"postings": built.terms, "lengths": built.lengths})

    def reconcile(self, migrated: bool = False) -> list[str]:
        """What a start has to put right: an index that does not match its table, vectors of another profile or none.

        With roots configured, documents without a vector and documents just ``migrated`` are read anew.
        """
        done = []
        t = self.store.read()
        if keyword.needs_rebuild(keyword.Postings(t["postings"], t["lengths"]), t["chunks"].withColumnRenamed("id", "chunk_id")):
            self.rebuild()
            done.append("rebuilt")
        profile = catalog.setting(t["settings"], "embedding_profile")
        if profile not in (None, PROFILE):
            version = self.store.version()
            t = self.store.read(version)
            docs, vectors = sync.clear_vectors(t["documents"], t["vectors"])
            self.store.commit(version, {"documents": docs, "vectors": vectors, "document_vectors": t["document_vectors"].limit(0)})
            done.append("vectors cleared")
        if self.roots and (migrated or catalog.missing_vectors(self.store.read()["documents"], BUCKETS).first()[0]):
            self.sync()
            done.append("indexed")
        return done

    def import_legacy(self, path: str) -> bool:
        """Take over a legacy index file, once, into an empty store."""
        version = self.store.version()
        t = self.store.read(version)
        if not t["documents"].isEmpty():
            return False
        got = sync.import_legacy(self.spark.read.schema(sync.LEGACY).option("multiLine", True).json(path))
        documents = got["documents"].withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("indexed_at", F.current_timestamp())
        chunks = got["chunks"].withColumn("id", F.xxhash64("document_id", "position"))
        done = self.spark.createDataFrame([("legacy_migrated", "true")], "key string, value string")
        failures = got["failures"].withColumn("updated_at", F.current_timestamp())
        self.store.commit(version, {"documents": documents, "chunks": chunks, "failures": failures, "directories": got["directories"], "settings": got["settings"].unionByName(done)})
        self.rebuild()
        return True
