"""Keeping the tables in step with the files: change detection, deletions, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def normalize_roots(roots: list[str]) -> list[str]:
    """The roots without repetitions, in their order."""
    return list(dict.fromkeys(roots))


def below(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies in it, by whole components."""
    return (path == folder) | F.startswith(path, F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/")))


def folders_of(path: Column) -> Column:
    """A path and every folder it lies in, longest first."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    every = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.transform(every, lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``path, root``: for each path the longest root that it lies in; paths under no root are dropped.

    A path names all the folders it can be in, so this is an equi-join instead of a comparison with every root.
    """
    each = paths.select("path").where("path is not null").distinct().select("path", F.explode(folders_of(F.col("path"))).alias("__folder"))
    known = roots.select(F.col("path").alias("root"), F.when(F.col("path") == "/", F.col("path")).otherwise(F.regexp_replace("path", "/+$", "")).alias("__folder")).distinct()
    found = each.join(known, "__folder").groupBy("path").agg(F.max_by("root", F.struct(F.char_length("root"), "root")).alias("root"))
    return found.select("path", "root")


def below_any(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """The rows of ``paths`` that are, or lie in, one of ``folders``."""
    stated = folders.select(F.when(F.col("path") == "/", F.col("path")).otherwise(F.regexp_replace("path", "/+$", "")).alias("__folder")).distinct()
    hit = paths.select("path").distinct().select("path", F.explode(folders_of(F.col("path"))).alias("__folder")).join(stated, "__folder", "left_semi")
    return paths.join(hit.select("path").distinct(), "path", "left_semi")


def changed_files(scan: DataFrame, previous: DataFrame, dimensions: int | None = None) -> DataFrame:
    """The scanned files (``path, root, modified_ms, size``) that are new, differ, or lack a vector.

    ``dimensions``: the vector must have this length, not only be there.
    """
    has = F.col("embedding").isNotNull() if dimensions is None else F.coalesce(F.size("embedding") == dimensions, F.lit(False))
    old = previous.select("path", F.col("modified_ms").alias("__ms"), F.col("size").alias("__size"), has.alias("__has")).dropDuplicates(["path"])
    same = F.col("__has") & (F.col("modified_ms") == F.col("__ms")) & (F.col("size") == F.col("__size"))
    return scan.join(old, "path", "left").where(~F.coalesce(same, F.lit(False))).select(*scan.columns)


def orphaned_by_roots(previous: DataFrame, roots: DataFrame) -> DataFrame:
    """Documents of roots that are no longer configured."""
    return previous.join(roots.select(F.col("path").alias("root")).distinct(), "root", "left_anti")


def vanished(previous: DataFrame, scan: DataFrame, complete_roots: DataFrame) -> DataFrame:
    """Documents whose file was not seen, in roots that were read completely."""
    return previous.join(complete_roots.select("root").distinct(), "root", "left_semi").join(scan.select("path").distinct(), "path", "left_anti")


def sync_plan(scan: DataFrame, previous: DataFrame, roots: DataFrame, complete_roots: DataFrame) -> DataFrame:
    """``path, action``: what a full sync has to do, ``parse`` or ``delete``; other files are left as they are."""
    kept = previous.join(roots.select(F.col("path").alias("root")).distinct(), "root", "left_semi")
    gone = orphaned_by_roots(previous, roots).select("path").unionByName(vanished(kept, scan, complete_roots).select("path"))
    jobs = changed_files(scan, kept).select("path", F.lit("parse").alias("action"))
    return jobs.unionByName(gone.distinct().select("path", F.lit("delete").alias("action")))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table with ``new`` in it; old rows of the same id or the same path go."""
    rest = old.join(new.select("id").distinct(), "id", "left_anti").join(new.select("path").distinct(), "path", "left_anti")
    return rest.select(*new.columns).unionByName(new)


def upsert_chunks(old: DataFrame, documents: DataFrame, prepared: DataFrame) -> DataFrame:
    """The chunks after the upsert: those of replaced documents go, the prepared ones (arrays) come in order.

    Chunks are known by ``document_id`` and ``position``.
    """
    rest = old.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi")
    rest = rest.join(prepared.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti")
    added = prepared.select(F.col("id").alias("document_id"), F.posexplode("chunks").alias("position", "text"))
    return rest.select("document_id", "position", "text").unionByName(added)


def upsert_vectors(old: DataFrame, new: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunk_id, document_id, extension, embedding``: new vectors replace old ones; those without chunk are dropped."""
    owners = chunks.select(F.col("id").alias("chunk_id"), "document_id").distinct().join(documents.select(F.col("id").alias("document_id"), "extension"), "document_id")
    added = new.select("chunk_id", "embedding").dropDuplicates(["chunk_id"]).join(owners, "chunk_id").select("chunk_id", "document_id", "extension", "embedding")
    return old.join(added.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "document_id", "extension", "embedding").unionByName(added)


def cascade(deleted: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents ``id``."""
    by_id = deleted.select("id").distinct()
    owner = by_id.withColumnRenamed("id", "document_id")
    return documents.join(by_id, "id", "left_anti"), chunks.join(owner, "document_id", "left_anti"), vectors.join(owner, "document_id", "left_anti")


def latest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last writer's row of each key: the greatest of ``order``, then of the other columns."""
    rest = [c for c in rows.columns if c != key and c not in order]
    top = F.max(F.struct(*order, *rest)).alias("__r")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(top).select(*[F.col(c) if c == key else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def record_failures(old: DataFrame, new: DataFrame) -> DataFrame:
    """Failures by path, the newest counts; categories in lower case, ``parse`` where there is none."""
    rows = old.select("path", "category", "reason", "updated_at").unionByName(new.select("path", "category", "reason", "updated_at"))
    return latest_by(rows.withColumn("category", F.lower(F.coalesce("category", F.lit("parse")))), "path", ["updated_at"])


def put_settings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Settings by key: a new value replaces the old one."""
    return old.join(new.select("key").distinct(), "key", "left_anti").unionByName(new)


def clear_vectors(documents: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a change of the embedding model."""
    return documents.withColumn("embedding", F.lit(None).cast("array<float>")), vectors.limit(0)


def import_legacy(index: DataFrame) -> dict[str, DataFrame]:
    """``directories, documents, chunks, failures, settings`` from a legacy index, one JSON object in one row.

    The root of a document is the longest directory that its path begins with as a string, or empty.
    """
    folders = index.select(F.explode(F.coalesce("directories", F.array().cast("array<string>"))).alias("path")).distinct()
    docs = index.select(F.explode("documents").alias("d"), F.coalesce("directories", F.array().cast("array<string>")).alias("dirs"))
    fits = F.filter("dirs", lambda r: F.startswith(F.col("d.path"), r))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(F.char_length(r).alias("n"), r.alias("r"))))
    documents = docs.select("d.id", F.coalesce(longest["r"], F.lit("")).alias("root"), "d.path", "d.name", "d.extension", "d.modified_ms", "d.size")
    chunks = index.select(F.explode("documents").alias("d")).select(F.col("d.id").alias("document_id"), F.posexplode("d.chunks").alias("position", "c")).select("document_id", "position", "c.text")
    failures = index.select(F.explode("failures").alias("f")).select("f.path", F.coalesce("f.category", F.lit("parse")).alias("category"), "f.reason")
    settings = index.select(F.lit("last_indexed").alias("key"), F.col("last_indexed").alias("value")).where("value is not null")
    return {"directories": folders, "documents": documents, "chunks": chunks, "failures": failures, "settings": settings}


LEGACY = (
    "directories array<string>, documents array<struct<id: string, path: string, name: string, extension: string, modified_ms: bigint, size: bigint, "
    "chunks array<struct<text: string>>>>, failures array<struct<path: string, category: string, reason: string>>, last_indexed string"
).replace("chunks array", "chunks: array")


def failures_of(paths: DataFrame) -> DataFrame:
    """``path, category, reason`` from ``path, reason``."""
    return paths.select("path", T.classify_failure(F.col("reason")).alias("category"), "reason")
