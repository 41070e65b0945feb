"""Cutting oversized texts at natural boundaries: lexical cohesion.

A text is read as sentences. Blocks of words before and after every sentence end are compared; a valley of their
similarity marks a change of topic, and its depth is measured against the peaks on both sides. Each piece ends at the
deepest valley inside its size window, the second half of the limit; without a sentence end there it ends at the
deepest one before, as far as that brings new text, then at a clause, then at white space, then at the limit. The next piece begins ``overlap`` characters before that cut, or at the natural pause nearest to it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_text
from lodestone.operators.ranking import grouped_rank

LIMIT = 800
OVERLAP = 100
#: Buckets of the hashed word counts, and characters in a block on either side of a boundary.
BUCKETS = 128
BLOCK = 300
#: Boundaries that are compared at a time: bounds the memory of a text of any length.
SENTENCES = 4_096

_SENTENCE = re.compile(r"(?:[。！？；]|[.!?…](?=\s|$)|\n|(?<=\})\r)[\"'”’»）)\]}]*\s*")
_CLAUSE = re.compile(r"[，、,;:：](?=\s|[^\x00-\x7f])\s*|\s[–—-]\s")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")


def _words(sentence: str) -> list[str]:
    out = []
    for word in _WORD.findall(sentence.lower()):
        if _CJK.search(word):
            out += [word[i : i + 2] for i in range(max(1, len(word) - 1))]
        elif len(word) > 3:
            out.append(word)
    return out


def valleys(text: str, ends: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """How deep the cohesion falls at each of the boundaries ``ends``; 0 where it does not fall."""
    edges = np.concatenate([[0], ends, [len(text)]])
    lo = np.searchsorted(edges, ends - block, "left")
    hi = np.minimum(np.searchsorted(edges, ends + block, "right") - 1, len(edges) - 1)
    at = np.arange(1, len(ends) + 1)
    lo, hi = np.minimum(lo, at - 1), np.maximum(hi, at + 1)
    alike = np.zeros(len(ends))
    for first in range(0, len(ends), SENTENCES):  # so many at a time, with the blocks beside them
        own = slice(first, first + SENTENCES)
        begin, end = int(lo[own].min()), int(hi[own].max())
        counts = np.zeros((end - begin + 1, BUCKETS))
        for i in range(begin, end):
            for word in _words(text[edges[i] : edges[i + 1]]):
                counts[i + 1 - begin, zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS] += 1
        total = np.cumsum(counts, axis=0)
        here = total[at[own] - begin]
        before, after = here - total[lo[own] - begin], total[hi[own] - begin] - here
        norm = np.sqrt((before**2).sum(1) * (after**2).sum(1))
        alike[own] = np.divide((before * after).sum(1), norm, out=np.zeros(len(here)), where=norm > 0)
    return _climb(alike) + _climb(alike[::-1])[::-1] - 2 * alike


def _climb(values: np.ndarray) -> np.ndarray:
    """From each value the peak that is reached going left as long as it rises."""
    peaks = values.copy()
    for i in range(1, len(values)):
        if values[i - 1] >= values[i]:
            peaks[i] = peaks[i - 1]
    return peaks


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Begin and end of each piece, in characters; together they cover the text. One piece if it is not too long."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    pauses = [np.array(sorted({m.end() for m in p.finditer(text)} - {0, n}), np.int64) for p in (_SENTENCE, _CLAUSE, _SPACE)]
    depth = valleys(text, pauses[0]) if len(pauses[0]) else np.zeros(0)
    anywhere = np.unique(np.concatenate(pauses))
    out, start, cut = [], 0, 0
    while n - start > limit:
        least = start + max(limit // 2, overlap + 1)
        early = max(start + overlap, cut) + 1  # a piece is more than its overlap, and ends after the last one
        cut = 0
        for kind, ends, begin in ((0, pauses[0], least), (0, pauses[0], early), (1, pauses[1], least), (2, pauses[2], least)):
            a, b = np.searchsorted(ends, begin, "left"), np.searchsorted(ends, start + limit, "right")
            if b > a:
                # of equal depth the latest, so that pieces are not shorter than they need be
                cut = int(ends[b - 1 - np.argmax(depth[a:b][::-1])]) if kind == 0 else int(ends[b - 1])
                break
        cut = cut or start + limit
        out.append((start, cut))
        start = _restart(anywhere, start, cut, overlap)
    out.append((start, n))
    return out


def _restart(pauses: np.ndarray, start: int, cut: int, overlap: int) -> int:
    """Where the next piece begins: at the pause nearest to the wanted overlap, within half of it, else exactly there."""
    want = cut - overlap
    a, b = np.searchsorted(pauses, max(start + 1, want - overlap // 2), "left"), np.searchsorted(pauses, want + overlap // 2, "right")
    if b > a:
        near = pauses[a:b]
        return int(near[np.argmin(np.abs(near - want))])
    return max(start + 1, want)


def split_rows(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, key: str = "id", text: str = "text") -> DataFrame:
    """``chunk_id, piece, begin, end`` for every row whose text has more than ``limit`` characters.

    Null, empty and shorter texts give no row, nor do null keys; repeated rows count once. ``overlap`` must be under
    half of ``limit``. Texts of any length are read whole, one at a time.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and under half of the limit")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, i, a, b) for k, t in zip(batch.column("chunk_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for i, (a, b) in enumerate(cut_points(t, limit, overlap))]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.record_batch([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[1:]]], names=["chunk_id", "piece", "begin", "end"])

    rows = df.where(F.col(key).isNotNull() & (F.char_length(text) > limit)).select(F.col(key).cast("bigint").alias("chunk_id"), F.col(text).alias("text"))
    return map_text(rows, "text", lambda: work, "chunk_id bigint, piece int, begin int, end int").distinct()


def resplit(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``document_id, position, chunk_id, piece, text``: all chunks with the oversized ones cut, positions counted anew.

    Positions run from 0 within a document, in the order of the old position, chunk and piece; a null position comes
    last. Repeated rows count once; null texts keep their row; null documents form one group; rows with a null id cannot be
    told apart and are left out. Numbering works over
    range partitions, so one document may hold any share of the chunks; the text is shuffled once.
    """
    once = chunks.where("id is not null").select("id", "document_id", "position", "text").dropDuplicates(["id"])
    pieces = split_rows(chunks, limit, overlap)
    slim = chunks.where("id is not null").select("id", "document_id", F.col("position").alias("old")).distinct()
    rows = slim.join(pieces, slim["id"] == pieces["chunk_id"], "left").select("document_id", "old", slim["id"].alias("chunk_id"), F.coalesce("piece", F.lit(0)).alias("piece"), "begin", "end")
    placed = grouped_rank(rows, ["document_id"], [("old", "asc"), ("chunk_id", "asc"), ("piece", "asc")], "place", ties=False).drop("document_id", "old")
    text = F.when(F.col("begin").isNull(), F.col("text")).otherwise(F.substring("text", F.col("begin") + 1, F.col("end") - F.col("begin")))
    return once.join(placed, once["id"] == placed["chunk_id"]).select("document_id", (F.col("place") - 1).cast("int").alias("position"), "chunk_id", "piece", text.alias("text"))
