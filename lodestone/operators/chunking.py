"""Cutting texts into windows, and choosing among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Window and overlap in characters, samples of a document, characters of an embedding text.
WINDOW, OVERLAP = 800, 100
SAMPLES = 4
EMBED_WHOLE, EMBED_SIDE = 480, 240


def windows(text: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """The text's windows as an array; a text that fits comes whole, the last window ends with the text."""
    n = F.char_length(text)
    count = 1 + F.ceil(F.greatest(n - window, F.lit(0)) / F.lit(float(window - overlap))).cast("int")
    return F.when(text.isNotNull(), F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * (window - overlap) + 1, F.lit(window))))


def chunk(df: DataFrame, key: str, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """``key, position, text``; null texts give none. One generator, no shuffle."""
    return df.select(key, F.posexplode(windows(F.col(text), window, overlap)).alias("position", "text"))


def is_sampled(position: Column, count: Column, samples: int = SAMPLES) -> Column:
    """Whether a chunk is one of the at most ``samples`` evenly spread over the ``count`` of its document."""
    s = F.least(count, F.lit(samples))
    places = F.transform(F.sequence(F.lit(0), s - 1), lambda i: F.floor(i * (count - 1) / F.greatest(s - 1, F.lit(1))).cast("int"))
    return F.array_contains(places, position.cast("int"))


def sample_chunks(chunks: DataFrame, key: str, position: str = "position") -> DataFrame:
    """The sampled chunks of each document by their order of position; counts are combined before they are shuffled."""
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("__n"))
    return chunks.join(counts, key).where(is_sampled(F.col(position), F.col("__n"))).drop("__n")


def embedding_text(name: Column, text: Column) -> Column:
    """The name and the text, or both its ends if it is long."""
    ends = F.concat_ws("\n", name, F.left(text, F.lit(EMBED_SIDE)), F.right(text, F.lit(EMBED_SIDE)))
    return F.when(F.char_length(text) <= EMBED_WHOLE, F.concat_ws("\n", name, text)).otherwise(ends)


def prepare(files: DataFrame) -> DataFrame:
    """``id, root, path, name, extension, modified_ms, size, chunks`` from ``root, path, modified_ms, size, text``."""
    path = F.col("path")
    return files.select(T.stable_id(path).alias("id"), "root", "path", T.basename(path).alias("name"), T.extension_of(path).alias("extension"), "modified_ms", "size", windows(T.normalize_text(F.col("text"))).alias("chunks"))
