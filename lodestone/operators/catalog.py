"""Inventory: counts, facets and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_lower
from lodestone.functions.vectors import lacks_vector
from lodestone.operators.ranking import grouped_rank


def page_bounds(offset: int = 0, limit: int = 50) -> tuple[int, int]:
    """A page's bounds: offset 0 or more, limit from 1 to 100."""
    return max(0, offset), max(1, min(100, limit))


def counts(documents: DataFrame, chunks: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: how many documents, chunks and failures there are."""
    one = [d.agg(F.count(F.lit(1)).alias(c)) for d, c in ((documents, "document_count"), (chunks, "chunk_count"), (failures, "failed_count"))]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))


def extensions(documents: DataFrame) -> DataFrame:
    """The extensions in use that are not empty, in their order without ASCII case."""
    return documents.where("extension <> ''").select("extension").distinct().orderBy(ascii_lower(F.col("extension")), "extension")


def missing_vectors(documents: DataFrame, dimensions: int) -> DataFrame:
    """One row: documents whose vector is null or of another length."""
    return documents.agg(F.count_if(lacks_vector(F.col("embedding"), dimensions)).alias("missing"))


def document_page(documents: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Documents by name without ASCII case, then path. Only the page's rows are kept while sorting."""
    offset, limit = page_bounds(offset, limit)
    return documents.orderBy(ascii_lower(F.col("name")).asc_nulls_first(), F.col("path").asc_nulls_first(), "id").offset(offset).limit(limit)


def chunk_page(chunks: DataFrame, documents: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Chunks with their documents by name, path and position; chunks without document are left out.

    The page is found on narrow rows; texts are fetched for its rows only.
    """
    offset, limit = page_bounds(offset, limit)
    docs = documents.select(F.col("id").alias("document_id"), "name", "path").dropDuplicates(["document_id"])
    slim = chunks.select(F.col("id").alias("chunk_id"), "document_id", "position").dropDuplicates(["chunk_id"])
    page = slim.join(docs, "document_id").orderBy(ascii_lower(F.col("name")).asc_nulls_first(), F.col("path").asc_nulls_first(), "position", "chunk_id").offset(offset).limit(limit)
    texts = chunks.select(F.col("id").alias("chunk_id"), "text")
    return texts.join(F.broadcast(page), "chunk_id").dropDuplicates(["chunk_id"]).select("chunk_id", "document_id", "name", "path", "position", "text")


def failure_page(failures: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Failures, the newest first, then by path."""
    offset, limit = page_bounds(offset, limit)
    return failures.orderBy(F.col("updated_at").desc(), F.col("path").asc_nulls_first(), "category", "reason").offset(offset).limit(limit)


def directory_list(directories: DataFrame) -> DataFrame:
    return directories.select("path").distinct().orderBy("path")


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """All chunks by id, repeated rows once."""
    return chunks.where("id is not null").dropDuplicates(["id"]).orderBy("id")


def lookup(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``column`` is one of ``wanted`` (its first column): point lookups of any number at once."""
    keys = wanted.select(F.col(wanted.columns[0]).alias(column)).distinct()
    return rows.join(keys, column, "left_semi")


def document_by_path(documents: DataFrame, path: str) -> DataFrame:
    return documents.where(F.col("path") == path)


def chunk_by_id(chunks: DataFrame, chunk_id: int) -> DataFrame:
    return chunks.where(F.col("id") == chunk_id).dropDuplicates(["id"])


def setting(settings: DataFrame, key: str) -> str | None:
    found = settings.where(F.col("key") == key).select("value").first()
    return found[0] if found else None


def first_chunks(chunks: DataFrame, first: int) -> DataFrame:
    """``document_id, id, position, place``: the first chunks of every document, however many it has."""
    once = chunks.where("id is not null").select("document_id", "id", "position").dropDuplicates(["id"])
    placed = grouped_rank(once, ["document_id"], [("position", "asc"), ("id", "asc")], "place", ties=False)
    return placed.where(F.col("place") <= first)


def file_totals(scan: DataFrame) -> DataFrame:
    """``root, files``: how many files each root has."""
    return scan.groupBy("root").agg(F.count(F.lit(1)).alias("files"))


def largest(rows: DataFrame, by: str, key: str, text: str) -> DataFrame:
    """``by, key, n``: the row with the most characters of each batch; of equal ones the smallest key."""
    size = F.coalesce(F.char_length(text), F.lit(0))
    top = F.min(F.struct((-size).alias("n"), F.col(key).alias("k"))).alias("t")
    return rows.groupBy(by).agg(top).select(by, F.col("t.k").alias(key), (-F.col("t.n")).cast("bigint").alias("n"))


def chunks_of(chunks: DataFrame, document_id: str, first: int | None = None) -> DataFrame:
    """A document's chunks in order, or the first of them."""
    rows = chunks.where(F.col("document_id") == document_id).dropDuplicates(["id"]).orderBy("position", "id")
    return rows if first is None else rows.limit(max(1, first))
