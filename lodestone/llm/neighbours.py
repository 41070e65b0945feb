"""The most similar vectors of every vector.

Equal vectors are one point of the index. Points lie in the cell of their nearest centroid, and every vector is compared
with all points of its nearest cells (``probes``; ``scan``), of which it needs more the more cells there are. Centroids are
fitted on a bounded sample; every vector is indexed. Many centroids hang in a tree of two levels, in which points find their
own cell; the cells that a vector asks for are chosen among all centroids.

Points are written once, cell by cell, to files in the folder that all executors share, and removed when the search is over.
A task searches for the points of one file and reads the cells that they ask for, so that asking more cells costs
comparisons, but neither shuffles nor disk. The files are of about ``SLICE`` points; a cell of more is cut into parts, so a
dense region never becomes one task. A task's memory is bounded by its file, the cells asked for, and one cell's part.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import scan
from lodestone.runtime import cut, scratch_path

K = 5
DIMENSIONS = 64
#: Points that a cell should have, and how many times that before the cells grow in number.
SHARD, LARGE = 128, 2
#: The number of cells is bounded, and so is what is sent to every task; up to so many are compared without a tree.
MOST_SHARDS, FLAT = 65_536, 1_024
#: Cells searched by each vector at least, and with so many cells; beyond, probes grow with this power of the cells.
LEAST_PROBES, PROBES, PROBES_UPTO, PROBES_POWER = 24, 32, 768, 0.85
#: Points of one file, which search in one task.
SLICE = 16_000
#: Cells asked for by the queries of one pass over them.
ASKED = 12_000_000
#: Vectors that the centroids are fitted on.
SAMPLE = 20_000
#: Upper centroids below which a vector's cell is looked for.
BELOW = 8
#: Files that a task holds open.
OPEN = 512


def probes(cells: int) -> int:
    """How many of the cells each vector searches."""
    return min(cells, max(LEAST_PROBES, math.ceil(PROBES * (cells / PROBES_UPTO) ** PROBES_POWER)))


def usable(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``dimensions`` finite numbers that are not all zero, and these vectors with length 1."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dimensions)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    vectors = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dimensions)
    good = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
    at, vectors = at[good], vectors[good]
    vectors = vectors / np.abs(vectors).max(1, keepdims=True, initial=0)  # very large or small values stay in range
    return at, (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _binary(vectors: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(vectors, np.float32)
    edges = np.arange(len(raw) + 1, dtype=np.int32) * (raw.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(edges), pa.py_buffer(raw)])


def _matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    raw = b"".join(b"".join(p.to_pylist()) for p in parts)
    return np.frombuffer(raw, np.float32).reshape(-1, dimensions)


def valid_vectors(df: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """``key, h, vec``: the usable vectors with length 1 as bytes, and their hash."""

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = usable(batch.column("vec"), dimensions)
            if len(at):
                hashes = [xxhash.xxh3_64_intdigest(v.tobytes()) - (1 << 63) for v in vectors]
                yield pa.record_batch([batch.column("key").take(pa.array(at)), pa.array(hashes, pa.int64()), _binary(vectors)], names=["key", "h", "vec"])

    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    return rows.mapInArrow(clean, "key bigint, h bigint, vec binary")


def centroids(vectors: np.ndarray, count: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(7)
    out = vectors[rng.choice(len(vectors), min(count, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        near = (vectors @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norms > 0, sums / np.maximum(norms, 1e-12), out).astype(np.float32)
    return out


class Shards:
    """The centroids of all cells, and the cell of each vector."""

    def __init__(self, sample: np.ndarray, count: int) -> None:
        self.top: np.ndarray | None = None
        if count <= FLAT:
            self.leaves = centroids(sample[:SAMPLE], count)
            return
        self.top = centroids(sample[:SAMPLE], round(math.sqrt(count)))
        near = _nearest(sample, self.top)
        sizes = np.bincount(near, minlength=len(self.top))
        parts = [centroids(sample[near == c], max(1, round(count * n / len(sample))), 4) for c, n in enumerate(sizes.tolist()) if n]
        self.top = self.top[sizes > 0]
        self.leaves = np.concatenate(parts)
        self.first = np.cumsum([0, *[len(p) for p in parts]])

    def __len__(self) -> int:
        return len(self.leaves)

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest cell of each vector; in a tree the nearest below its ``BELOW`` nearest upper centroids."""
        if self.top is None:
            return _nearest(vectors, self.leaves)
        near = -(vectors @ self.top.T)
        wide = min(BELOW, len(self.top))
        upper = np.argpartition(near, wide - 1, axis=1)[:, :wide]
        out, best = np.zeros(len(vectors), np.int64), np.full(len(vectors), -np.inf, np.float32)
        for c in np.unique(upper).tolist():
            row = np.flatnonzero((upper == c).any(1))
            sims = vectors[row] @ self.leaves[self.first[c] : self.first[c + 1]].T
            at = sims.argmax(1)
            sims = sims[np.arange(len(row)), at]
            better = sims > best[row]
            out[row[better]], best[row[better]] = at[better] + self.first[c], sims[better]
        return out


def _nearest(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.concatenate([(vectors[i : i + 8192] @ to.T).argmax(1) for i in range(0, len(vectors), 8192)])


def _part(keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (mixed % parts.astype(np.uint64)).astype(np.int64)


def file_plan(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``first, parts``: the file that each cell is in, or with several parts the first of its files; about ``SLICE`` points a file."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, held = 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > SLICE:
            at, held = at + 1, 0
        first[cell], parts[cell] = at, max(1, -(-n // SLICE))
        held += n
        if parts[cell] > 1:
            at, held = at + int(parts[cell]), 0
    return first, parts


def _writer(folder: str, dimensions: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        files, path = _folder(folder)
        cells, keys = table.column("cell").to_numpy(), table.column("key").to_numpy()
        order = np.lexsort((keys, cells))
        cells, keys, vectors = cells[order], keys[order], _matrix(table.column("vec"), dimensions)[order]
        edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
        name = f"{uuid.uuid4().hex}.cells"  # another attempt writes another file; what is read is the one returned
        with files.open_output_stream(f"{path}/{name}") as out:
            for a, b in itertools.pairwise(edges.tolist()):
                out.write(vectors[a:b].tobytes())
                out.write(keys[a:b].tobytes())
        n = len(edges) - 1
        return pa.table([pa.array([name] * n), pa.array(cells[edges[:-1]], pa.int32()), pa.array(edges[:-1], pa.int64()), pa.array(np.diff(edges), pa.int64())], names=["file", "cell", "begin", "n"])

    return run


class Cells:
    """Where the points of each cell are: rows of ``file, cell, begin, n``, in the files' order."""

    def __init__(self, folder: str, pieces: pa.Table, count: int, dimensions: int) -> None:
        self.folder, self.dimensions = folder, dimensions
        pieces = pieces.sort_by([("file", "ascending"), ("begin", "ascending")])
        names = pieces.column("file").combine_chunks().dictionary_encode()
        self.names = names.dictionary.to_pylist()
        self.file, self.cell, self.begin, self.n = names.indices.to_numpy(), *(pieces.column(c).to_numpy() for c in ("cell", "begin", "n"))
        self.order = np.argsort(self.cell, kind="stable")
        self.edges = np.searchsorted(self.cell[self.order], np.arange(count + 1))

    def reader(self) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
        """Reads a piece: its vectors and keys."""
        files, path = _folder(self.folder)
        wide = self.dimensions * 4

        @lru_cache(maxsize=OPEN)
        def opened(file: int) -> pa.NativeFile:
            return files.open_input_file(f"{path}/{self.names[file]}")

        def piece(i: int) -> tuple[np.ndarray, np.ndarray]:
            n = int(self.n[i])
            raw = opened(int(self.file[i])).read_at(n * (wide + 8), int(self.begin[i]) * (wide + 8))
            if len(raw) != n * (wide + 8):
                raise OSError(f"{self.names[self.file[i]]} ends early")
            return np.frombuffer(raw, np.float32, n * self.dimensions).reshape(n, -1), np.frombuffer(raw, np.int64, n, n * wide)

        return piece

    def pieces_of(self, cell: int) -> np.ndarray:
        return self.order[self.edges[cell] : self.edges[cell + 1]]


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", uri))


def _searcher(sent: Broadcast, where: Broadcast, asked: int, k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, leaves = where.value, sent.value.leaves
        piece = cells.reader()

        def read(cell: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from map(piece, cells.pieces_of(cell))

        for batch in batches:
            for file in batch.column(0).to_pylist():
                own = [piece(i) for i in np.flatnonzero(cells.file == file).tolist()]
                vectors, keys = (np.concatenate(x) for x in zip(*own, strict=True))
                most = -(-len(keys) // -(-len(keys) * asked // ASKED))  # as few passes as may be: each reads the cells again
                for a in range(0, len(keys), most):
                    sims, names = scan.best_in_cells(vectors[a : a + most], leaves, asked, read, k + 1)
                    on = (sims > -np.inf) & (names != keys[a : a + most, None])
                    on &= np.cumsum(on, axis=1) <= k
                    row, col = np.nonzero(on)
                    yield pa.record_batch([pa.array(keys[a + row]), pa.array(names[row, col]), pa.array(sims[row, col])], names=["key", "neighbour", "cosine"])

    return run


class Neighbours:
    """The ``k`` most similar other vectors of every usable vector of a column.

    Vectors that are null, of another length, not finite or all zero are left aside, as are null keys; repeated rows
    count once. Equal vectors are neighbours of cosine 1, those with the smallest keys first. Fewer than ``k`` other
    vectors give fewer rows; an empty table gives none. Other columns are not read.
    """

    def __init__(self, df: DataFrame, key: str, vector: str = "embedding", k: int = K, dimensions: int = DIMENSIONS) -> None:
        self.spark, self.k, self.dimensions = df.sparkSession, k, dimensions
        rows = valid_vectors(df, key, vector, dimensions)
        self.members = rows.select("key", "h").distinct()
        #: One point for all equal vectors.
        self.points = cut(rows.groupBy("h").agg(F.min("key").alias("key"), F.min("vec").alias("vec")))

    def between_points(self) -> DataFrame:
        """``key, neighbour, cosine``: the at most ``k`` best that each point finds in the cells it searches."""
        dims, spark = self.dimensions, self.spark
        total = self.points.count()
        if not total:
            return spark.createDataFrame([], "key bigint, neighbour bigint, cosine float")
        size = max(SHARD, min(SHARD * LARGE, total // LEAST_PROBES))
        count = max(1, min(MOST_SHARDS, total // size))
        held = SAMPLE if count <= FLAT else max(SAMPLE, 4 * count)
        sample = _matrix(self.points.orderBy(F.xxhash64("key")).limit(held).select("vec").toArrow().column("vec"), dims)
        shards = Shards(sample, count)
        # files are planned by the sample, so that each point's cell is looked for once
        homes = np.concatenate([shards.home(sample[i : i + 8192]) for i in range(0, len(sample), 8192)])
        plan = file_plan(np.bincount(homes, minlength=len(shards)) * total // len(sample))
        sent, planned = spark.sparkContext.broadcast(shards), spark.sparkContext.broadcast(plan)

        def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, parts = planned.value
            for batch in batches:
                cells = sent.value.home(_matrix(batch.column("vec"), dims))
                at = first[cells] + _part(batch.column("key").to_numpy(), parts[cells])
                yield pa.record_batch([pa.array(at, pa.int32()), pa.array(cells, pa.int32()), batch.column("key"), batch.column("vec")], names=["at", "cell", "key", "vec"])

        folder = scratch_path(spark, "cells")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        folder = files.makeQualified(path).toString()
        files.mkdirs(path)
        try:
            routed = self.points.select("key", "vec").mapInArrow(route, "at int, cell int, key bigint, vec binary")
            pieces = routed.groupBy("at").applyInArrow(_writer(folder, dims), "file string, cell int, begin bigint, n bigint").toArrow()
            cells = Cells(folder, pieces, len(shards), dims)
            where = spark.sparkContext.broadcast(cells)
            each = spark.range(0, len(cells.names), 1, len(cells.names))
            return cut(each.mapInArrow(_searcher(sent, where, probes(len(shards)), self.k), "key bigint, neighbour bigint, cosine float"))
        finally:
            files.delete(path, True)

    def neighbours(self) -> DataFrame:
        """``key, neighbour, cosine, place``: places from 1, by cosine and then key."""
        k = self.k
        near = Window.partitionBy("key").orderBy(F.col("cosine").desc(), "neighbour")
        best = self.between_points()
        points = self.points.select("h", F.col("key").alias("point"))
        members = self.members.join(points, "h").select("point", "key")
        # k + 1 members of a point are enough for anyone's list, whoever asks
        few = members.withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy("key"))).where(F.col("n") <= k + 1).drop("n")
        copied = members.groupBy("point").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("point")
        same = copied.select("point", F.col("point").alias("other"), F.lit(1.0).cast("float").alias("cosine"))
        lists = best.toDF("point", "other", "cosine").unionByName(same)
        offered = lists.join(few.toDF("other", "neighbour"), "other")
        top = offered.withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy(F.col("cosine").desc(), "neighbour"))).where(F.col("n") <= k + 1)
        each = members.join(top.select("point", "neighbour", "cosine"), "point").where(F.col("key") != F.col("neighbour"))
        place = F.row_number().over(near)
        return each.select("key", "neighbour", "cosine").withColumn("place", place).where(F.col("place") <= k)

    def pairs(self, at_least: float) -> DataFrame:
        """``key_a, key_b``: pairs of at least that cosine in which one is among the ``k`` most similar of the other."""
        close = self.neighbours().where(F.round(F.col("cosine").cast("double"), 6) >= at_least)
        return close.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
